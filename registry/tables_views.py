"""Registered queries: reports, warehouse, statistics, queue and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysieve.operators.dedup import FINDING_KEY, insert_new
from keysieve.operators.skew import numbered
from keysieve.plans import queue as Q
from keysieve.plans import report as R
from keysieve.plans import statistics as S
from keysieve.plans import warehouse as W
from keysieve.plans.scan import scan_files
from keysieve.sources.reports import parse_reports, report_findings
from keysieve.streaming import monitor as M
from keysieve.workspace import stored, workspace
from registry import detection_sql as D
from registry.base import ORACLES, Tables, query
from registry.detection_sql import q
from registry.tables import with_clause as w

_HIGH = "regexp_matches(rule_id, 'private-key|aws|database|jwt')"
_MEDIUM = "regexp_matches(rule_id, 'api-key|token|secret')"
_TOTALS = f"""count(*) AS total_findings, count(DISTINCT rule_id) AS unique_rules,
    count(*) FILTER ({_HIGH}) AS high, count(*) FILTER ({_MEDIUM}) AS medium,
    greatest(0, count(*) - count(*) FILTER ({_HIGH}) - count(*) FILTER ({_MEDIUM})) AS low"""


# --- report aggregates -----------------------------------------------------------------


@query(f"{w('findings')} SELECT scan_id, {_TOTALS} FROM findings GROUP BY scan_id")
def report_totals(t: Tables):
    return R.totals(t["findings"], ["scan_id"])


@query(f"{w('findings')} SELECT {_TOTALS} FROM findings")
def report_totals_overall(t: Tables):
    return R.totals(t["findings"])


@query(f"{w('findings')} SELECT scan_id, rule_id, count(*) AS findings FROM findings GROUP BY ALL")
def report_by_rule(t: Tables):
    return R.by_rule(t["findings"], ["scan_id"])


@query(f"""{w('findings')} SELECT scan_id, split_part(rule_id, '-', 1) AS category,
    count(*) AS findings FROM findings GROUP BY ALL""")
def report_by_category(t: Tables):
    return R.by_category(t["findings"], ["scan_id"])


_ORDERED = """SELECT verification_status AS scan_id, scan_id || '/' || file_path AS path,
    line_number AS line, column_number AS pos, rule_id, rule_name, secret_preview AS secret
    FROM findings"""


@query(f"""{w('findings')} SELECT scan_id, path, line, pos, row_number() OVER (
      PARTITION BY scan_id ORDER BY path, line, pos, rule_id, secret) AS id
    FROM ({_ORDERED})""")
def report_row_ids(t: Tables):
    return numbered(t.sql(_ORDERED, "findings"), ["scan_id"], order=("pos", "rule_id", "secret")
                    ).select("scan_id", "path", "line", "pos", "id")


@query(f"""{w('findings')} SELECT scan_id, file_path, line_number, rule_id FROM findings
    ORDER BY scan_id, file_path, line_number, column_number, rule_id LIMIT 50""")
def short_listing(t: Tables):
    return R.listing(t["findings"], ["scan_id", "file_path", "line_number", "column_number",
                                     "rule_id"]).select(
        "scan_id", "file_path", "line_number", "rule_id")


def _documents(t: Tables):
    """Findings of a scan of the planted files, one scan per repository."""
    found = scan_files(t["files"], context_lines=1, hide="own")
    return stored(found.withColumnRenamed("repo", "scan_id"), "findings")


def _flat(docs, schema: str, path: str):
    parsed = docs.select("scan_id", F.explode(F.from_json("document", schema)[path]).alias("f"))
    return parsed.select("scan_id", "f.*")


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT repo AS scan_id, rule_id, path AS file, line, col0 + 1 AS "column",
           {D.redact('secret_raw')} AS secret,
           least(line, 1) + least(1, (SELECT count(*) FROM all_lines l WHERE l.repo = f.repo
             AND l.path = f.path AND l.line = f.line + 1)) + CASE WHEN line > 1 THEN 1 ELSE 0 END
             AS context_lines FROM found f""")
def json_documents(t: Tables):
    return _json_findings(R.json_documents(_documents(t), ["scan_id"], at_most=20))


def _json_findings(docs):
    return _flat(docs, """struct<findings: array<struct<rule_id: string, file: string, line: int,
        column: int, secret: string, context: array<struct<line: int>>>>>""", "findings").select(
        "scan_id", "rule_id", "file", "line", "column", "secret",
        F.size("context").alias("context_lines"))


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT repo AS scan_id, rule_id AS "ruleId", 'error' AS level,
      'Potential ' || rule_name || ' detected' AS message, path AS uri, line AS "startLine",
      col0 + 1 AS "startColumn" FROM found""")
def sarif_documents(t: Tables):
    return _sarif_results(R.sarif_documents(_documents(t), ["scan_id"]))


def _sarif_results(docs):
    place = """array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>,
        region: struct<startLine: int, startColumn: int>>>>"""
    schema = f"""struct<version: string, runs: array<struct<results: array<struct<ruleId: string,
        level: string, message: struct<text: string>, locations: {place}>>>>>"""
    r = docs.select("scan_id", F.explode(F.from_json("document", schema)["runs"][0]["results"]
                                         ).alias("r"))
    p = F.col("r.locations")[0]["physicalLocation"]
    return r.select(
        "scan_id", "r.ruleId", "r.level", F.col("r.message.text").alias("message"),
        p["artifactLocation"]["uri"].alias("uri"), p["region"]["startLine"].alias("startLine"),
        p["region"]["startColumn"].alias("startColumn"))


@query(f"""{w('files')}, {D.findings_ctes('files')},
    s AS (SELECT repo AS scan_id, {_TOTALS} FROM found GROUP BY repo)
    SELECT r.repo AS scan_id, coalesce(total_findings, 0) AS total_findings,
      coalesce(unique_rules, 0) AS unique_rules, coalesce(high, 0) AS high,
      coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
      coalesce(unique_rules, 0) AS listed_rules, coalesce(total_findings, 0) AS listed,
      coalesce(total_findings, 0) AS last_id
    FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN s ON r.repo = s.scan_id""")
def report_documents(t: Tables):
    docs = _reports(t)
    schema = """struct<summary: struct<total_findings: bigint, unique_rules_triggered: bigint,
        findings_by_rule: map<string,bigint>,
        severity_breakdown: struct<high: bigint, medium: bigint, low: bigint>>,
        findings: array<struct<id: bigint>>>"""
    d = docs.select("scan_id", F.from_json("document", schema).alias("d"))
    return d.select(
        "scan_id", "d.summary.total_findings",
        F.col("d.summary.unique_rules_triggered").alias("unique_rules"),
        "d.summary.severity_breakdown.*", F.size("d.summary.findings_by_rule").alias("listed_rules"),
        F.size("d.findings").alias("listed"),
        F.coalesce(F.array_max("d.findings.id"), F.lit(0)).alias("last_id"))


def _scans(t: Tables):
    return t["files"].select("repo").distinct().select(
        F.col("repo").alias("scan_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.concat(F.lit("/data/"), "repo").alias("path"), F.lit("directory").alias("type"),
        *[F.lit(None).cast("string").alias(c) for c in ("git_branch", "git_commit", "git_remote")],
        F.lit(0).cast("bigint").alias("scan_duration_ms"))


def _reports(t: Tables):
    return R.report_documents(_documents(t), _scans(t))


@query(f"""{w('files')}, {D.findings_ctes('files')}, n AS (SELECT repo, count(*) AS n FROM found
      GROUP BY repo)
    SELECT r.repo AS scan_id, coalesce(n, 0) + 2 AS lines, coalesce(n, 0) AS listed,
      coalesce(n, 0) AS total_findings, coalesce(n, 0) AS last_id
    FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN n ON r.repo = n.repo""")
def report_rows(t: Tables):
    """Reports written as sorted lines with an index, read back and parsed."""
    home = workspace(t.spark, "report-rows")
    R.write_rows(R.report_rows(_documents(t), _scans(t)), home)
    texts = R.read_rows(t.spark, home).groupBy("scan_id").agg(
        F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("part", "line", "text"))
                                                  ).alias("rows"))
    schema = """struct<scan_id: string, summary: struct<total_findings: bigint>,
        findings: array<struct<id: bigint>>>"""
    d = texts.select("scan_id", "lines", F.from_json(F.array_join(F.transform(
        "rows", lambda r: r["text"]), ""), schema).alias("d")).where("d.scan_id = scan_id")
    return d.select("scan_id", "lines", F.size("d.findings").cast("long").alias("listed"),
                    "d.summary.total_findings",
                    F.coalesce(F.array_max("d.findings.id"), F.lit(0)).alias("last_id"))


def _read_back(t: Tables, rows, name: str):
    """scan_id, document: rows of documents, written, read and put together."""
    home = workspace(t.spark, name)
    R.write_rows(rows, home)
    return R.read_rows(t.spark, home).groupBy("scan_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "line", "text"))), lambda r: r["text"]), ""
        ).alias("document"))


@query(ORACLES["json_documents"])
def json_rows(t: Tables):
    """JSON documents of any size, as sorted lines."""
    docs = _read_back(t, R.json_rows(_documents(t), ["scan_id"], _scans(t)), "json-rows")
    return _json_findings(docs)


@query(ORACLES["sarif_documents"])
def sarif_rows(t: Tables):
    """SARIF logs of any size, as sorted lines."""
    docs = _read_back(t, R.sarif_rows(_documents(t), ["scan_id"], _scans(t)), "sarif-rows")
    return _sarif_results(docs)


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT DISTINCT repo AS scan_id, 0 AS results, '2.1.0' AS version FROM files
    WHERE repo NOT IN (SELECT repo FROM found)""")
def sarif_clean_scans(t: Tables):
    """An empty SARIF log for each scan that found nothing."""
    docs = R.sarif_documents(_documents(t), ["scan_id"], scans=_scans(t))
    schema = "struct<version: string, runs: array<struct<results: array<struct<ruleId: string>>>>>"
    d = docs.select("scan_id", F.from_json("document", schema).alias("d"))
    return d.select("scan_id", F.size(F.col("d.runs")[0]["results"]).alias("results"),
                    "d.version").where("results = 0")


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT repo AS scan_id, '/data/' || repo AS target, row_number() OVER (
      PARTITION BY repo ORDER BY path, line, pos) AS id, rule_id, path AS file, line,
      col0 + 1 AS "column" FROM found""")
def report_document_findings(t: Tables):
    """Every finding of the report documents with its id and target."""
    schema = """struct<target: struct<path: string>, findings: array<struct<id: bigint,
        rule_id: string, location: struct<file: string, line: int, column: int>>>>"""
    d = _reports(t).select("scan_id", F.from_json("document", schema).alias("d")).select(
        "scan_id", F.col("d.target.path").alias("target"), F.explode("d.findings").alias("f"))
    return d.select("scan_id", "target", "f.id", "f.rule_id", "f.location.*")


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT repo AS scan_id, 'rule' AS kind, rule_id AS name, count(*) AS n FROM found GROUP BY ALL
    UNION ALL SELECT repo, 'category', split_part(rule_id, '-', 1), count(*) FROM found
    GROUP BY ALL""")
def report_document_counts(t: Tables):
    """Both maps of the report documents, entry by entry."""
    schema = """struct<summary: struct<findings_by_rule: map<string,bigint>,
        findings_by_category: map<string,bigint>>>"""
    d = _reports(t).select("scan_id", F.from_json("document", schema)["summary"].alias("s"))

    def entries(kind: str):
        return d.select("scan_id", F.lit(kind).alias("kind"),
                        F.explode(f"s.findings_by_{kind}").alias("name", "n"))

    return entries("rule").unionByName(entries("category"))


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT r.repo AS scan_id, count(f.rule_id) AS findings
    FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN found f ON r.repo = f.repo GROUP BY r.repo""")
def json_documents_of_all_scans(t: Tables):
    """A scan without findings has a document, too."""
    scans = t["files"].select(F.col("repo").alias("scan_id"))
    docs = R.json_documents(_documents(t), ["scan_id"], scans=scans)
    listed = F.from_json("document", "struct<findings: array<struct<rule_id: string>>>")
    return docs.groupBy("scan_id").agg(
        F.sum(F.size(listed["findings"]).cast("bigint")).alias("findings"))


# --- warehouse -----------------------------------------------------------------------------


_OK = """ok AS (SELECT *, cast(replace(replace(file, 'r', ''), '.json', '') AS bigint) AS k,
      json(document) AS d FROM report_docs WHERE document <> '{"findings": [')"""
_PARSED = f"""{w('report_docs')}, {_OK.replace(".json', ''", ".json', ''")},
    flat AS (SELECT *, unnest(list_concat(json_extract(d, '$.findings[*]'),
                                          json_extract(d, '$.report.findings[*]'))) AS f FROM ok)"""
_IMPORTED = "k % 4 <> 3"
_SCAN_ID = "CASE WHEN k % 4 = 0 THEN 's' || k ELSE md5(file) END"
_STATUS = """lower(CASE WHEN (f->'$.verification_status') IS NOT NULL
      THEN f->>'$.verification_status.status' WHEN (f->'$.verification') IS NOT NULL
      THEN f->>'$.verification.status' ELSE 'not_verified' END)"""


@query(f"""{_PARSED} SELECT {_SCAN_ID} AS scan_id,
      CASE k % 4 WHEN 0 THEN '0.1.0' WHEN 1 THEN '1.0' ELSE '1.2' END AS scanner_version,
      CASE WHEN k % 4 = 0 THEN substr(d->>'$.timestamp', 1, 10) ELSE '2024-06-01' END AS scanned_on,
      CASE WHEN k % 4 = 0 THEN d->>'$.target.path' ELSE file END AS target_path,
      d->>'$.target.type' AS target_type, d->>'$.target.git_branch' AS git_branch,
      CASE WHEN k % 4 = 0 THEN coalesce(cast(d->>'$.target.scan_duration_ms' AS bigint), 0) END
        AS scan_duration_ms, k % 3 AS total_findings
    FROM ok WHERE {_IMPORTED}""")
def imported_scans(t: Tables):
    scans, _ = W.import_reports(parse_reports(t["report_docs"]),
                                F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return scans.select(
        "scan_id", "scanner_version", F.date_format("timestamp", "yyyy-MM-dd").alias("scanned_on"),
        "target_path", "target_type", "git_branch", "scan_duration_ms", "total_findings")


@query(f"""{_PARSED} SELECT {_SCAN_ID} AS scan_id, f->>'$.rule_id' AS rule_id,
      f->>'$.rule_name' AS rule_name, coalesce(f->>'$.location.file', f->>'$.file') AS file_path,
      cast(coalesce(f->>'$.location.line', f->>'$.line') AS int) AS line_number, 3 AS column_number,
      'tok_...x' AS secret_preview, 'pending' AS verification_status FROM flat WHERE {_IMPORTED}""")
def imported_findings(t: Tables):
    _, findings = W.import_reports(parse_reports(t["report_docs"]))
    return findings.drop("context")


@query(f"""{w('scans')}, newer AS (SELECT scan_id, max(n) AS n FROM (
      SELECT 'scan-' || (o_orderkey * 2 % 20000) AS scan_id, o_orderkey % 50 AS n
      FROM orders) GROUP BY scan_id)
    SELECT s.scan_id, scan_duration_ms, coalesce(n, total_findings) AS total_findings
    FROM scans s LEFT JOIN newer USING (scan_id)
    UNION ALL SELECT scan_id, -1, n FROM newer WHERE scan_id NOT IN (SELECT scan_id FROM scans)""")
def upserted_scans(t: Tables):
    """Only the number of findings of a known scan changes, as on a second import."""
    current = t["scans"].select("scan_id", "scan_duration_ms", "total_findings")
    incoming = t.sql("""SELECT 'scan-' || cast(o_orderkey * 2 % 20000 as string) AS scan_id,
        cast(-1 as bigint) AS scan_duration_ms, o_orderkey % 50 AS total_findings FROM orders""",
                     "orders")
    return W.upsert_scans(current, incoming, F.col("total_findings"))


@query(f"""{w('scans', 'findings')} SELECT s.scan_id, s.total_findings,
      count(DISTINCT f.rule_id) AS unique_rules_triggered,
      count(CASE WHEN verification_status = 'active' THEN 1 END) AS verified_active,
      count(CASE WHEN verification_status = 'inactive' THEN 1 END) AS verified_inactive,
      count(CASE WHEN verification_status = 'pending' THEN 1 END) AS pending_verification
    FROM scans s LEFT JOIN findings f ON s.scan_id = f.scan_id GROUP BY s.scan_id, s.total_findings""")
def scan_summary(t: Tables):
    return W.scan_summary(t["scans"], t["findings"]).drop(
        "timestamp", "target_path", "git_remote", "git_branch")


@query(f"""{w('scans', 'findings')} SELECT coalesce(git_remote, target_path) AS repository, rule_id,
      rule_name, count(*) AS occurrence_count, max(timestamp) AS last_seen,
      min(timestamp) AS first_seen
    FROM findings f JOIN scans s ON f.scan_id = s.scan_id GROUP BY ALL""")
def findings_by_repo(t: Tables):
    return W.findings_by_repo(t["scans"], t["findings"])


@query(f"""{w('scans', 'findings')} SELECT f.scan_id, rule_id, file_path, line_number,
      column_number, git_branch, git_commit FROM findings f JOIN scans s ON f.scan_id = s.scan_id""")
def findings_with_scans(t: Tables):
    return W.findings_with_scans(t["scans"], t["findings"]).select(
        "scan_id", "rule_id", "file_path", "line_number", "column_number", "git_branch",
        "git_commit")


@query(f"""{w('scans', 'findings')} SELECT git_remote AS repository, rule_id, rule_name, file_path,
      line_number, secret_preview, verification_status, timestamp AS scan_timestamp
    FROM findings f JOIN scans s ON f.scan_id = s.scan_id WHERE verification_status = 'active'
      AND (rule_id LIKE '%api-key%' OR rule_id LIKE '%private-key%' OR rule_id LIKE '%aws%'
           OR rule_id LIKE '%database%')""")
def bounty_candidates(t: Tables):
    return W.bounty_candidates(t["scans"], t["findings"])


@query(f"""{w('scans', 'findings')}, j AS (SELECT date_trunc('day', timestamp) AS scan_date,
      s.scan_id, s.total_findings, f.rule_id, coalesce(git_remote, target_path) AS repository
      FROM scans s LEFT JOIN findings f ON s.scan_id = f.scan_id)
    SELECT strftime(scan_date, '%Y-%m-%d') AS scan_date, count(DISTINCT scan_id) AS total_scans,
      (SELECT sum(total_findings) FROM scans s WHERE date_trunc('day', s.timestamp) = j.scan_date)
        AS total_findings, sum(total_findings) AS total_findings_joined,
      count(DISTINCT rule_id) AS unique_rules, count(DISTINCT repository) AS unique_repos
    FROM j GROUP BY j.scan_date""")
def security_stats(t: Tables):
    return W.security_stats(t["scans"], t["findings"]).withColumn(
        "scan_date", F.date_format("scan_date", "yyyy-MM-dd"))


# --- statistics over reports -----------------------------------------------------------------


@query(f"""{_PARSED} SELECT count(*) AS total_reports, sum(k % 3) AS total_findings,
      count(*) FILTER (k % 3 > 0) AS reports_with_findings,
      count(*) FILTER (k % 3 = 0) AS reports_without_findings,
      round(count(*) FILTER (k % 3 > 0) * 100.0::double / count(*), 1) AS percent_with_findings,
      round(sum(k % 3)::double / count(*), 1) AS average_per_report FROM ok""")
def corpus_statistics(t: Tables):
    return S.corpus_statistics(parse_reports(t["report_docs"]))


@query(f"""{_PARSED}, c AS (SELECT f->>'$.rule_id' AS rule_id, count(*) AS findings FROM flat GROUP BY 1)
    SELECT *, round(findings * 100.0::double / sum(findings) OVER (), 1) AS percent FROM c""")
def statistics_by_rule(t: Tables):
    return S.by_rule(report_findings(parse_reports(t["report_docs"])))


@query(f"""{_PARSED}, c AS (SELECT {_STATUS} AS status, count(*) AS findings FROM flat GROUP BY 1)
    SELECT *, round(findings * 100.0::double / sum(findings) OVER (), 1) AS percent FROM c""")
def statistics_by_status(t: Tables):
    return S.by_status(report_findings(parse_reports(t["report_docs"])))


_VALUED = ", ".join(q(r) for r in S.HIGH_VALUE_RULES)


@query(f"""{_PARSED} SELECT count(*) AS high_value_findings,
      count(*) FILTER ({_STATUS} = 'active') AS active_high_value_secrets
    FROM flat WHERE (f->>'$.rule_id') IN ({_VALUED})""")
def high_value_findings(t: Tables):
    return S.high_value(report_findings(parse_reports(t["report_docs"])))


@query(f"""{_PARSED} SELECT file AS report, f->>'$.rule_id' AS rule_id, {_STATUS} AS status,
      cast(coalesce(f->>'$.location.line', f->>'$.line') AS int) AS line_number
    FROM flat WHERE (f->>'$.rule_id') IN ({_VALUED}) ORDER BY 1, 4, 2 LIMIT 10""")
def high_value_sample(t: Tables):
    return S.high_value_sample(
        report_findings(parse_reports(t["report_docs"])), ["report", "line_number", "rule_id"]
    ).select("report", "rule_id", "status", "line_number")


@query(f"""{_PARSED}, h AS (SELECT CASE WHEN k % 4 = 2 THEN 'git.example.net'
      WHEN contains(d->>'$.target.path', 'github.com') THEN 'github.com'
      WHEN contains(d->>'$.target.path', 'gitlab.com') THEN 'gitlab.com' END AS platform FROM ok)
    SELECT platform, count(*) AS reports FROM h WHERE platform IS NOT NULL GROUP BY 1""")
def reports_by_platform(t: Tables):
    return S.by_platform(parse_reports(t["report_docs"]))


@query(f"""{_PARSED} SELECT min(substr(d->>'$.timestamp', 1, 10)) AS earliest,
      max(substr(d->>'$.timestamp', 1, 10)) AS latest, count(d->>'$.timestamp') AS total_scans
    FROM ok""")
def scan_period(t: Tables):
    p = S.scan_period(parse_reports(t["report_docs"]))
    return p.select(F.date_format("earliest", "yyyy-MM-dd").alias("earliest"),
                    F.date_format("latest", "yyyy-MM-dd").alias("latest"), "total_scans")


_PROGRAM = "CASE " + " ".join(
    f"WHEN (f->>'$.rule_id') IN ({', '.join(q(r) for r in rules)}) THEN {q(name)}"
    for name, rules in S.PROGRAM_RULES.items()) + " ELSE 'other' END"


@query(f"""{_PARSED} SELECT {_PROGRAM} AS program, count(*) AS findings FROM flat
    WHERE {_STATUS} = 'active' GROUP BY 1""")
def findings_by_program(t: Tables):
    return S.program_counts(report_findings(parse_reports(t["report_docs"])))


# --- queue -------------------------------------------------------------------------------


@query(f"""{w('repos')} SELECT url, priority, discovered_at FROM repos WHERE status = 'pending'
    AND priority >= 4 ORDER BY priority DESC, discovered_at, url LIMIT 50""")
def next_repos(t: Tables):
    return Q.next_repos(t["repos"], 50, 4).select("url", "priority", "discovered_at")


@query(f"""{w('repos', 'scan_log')} SELECT DISTINCT url FROM repos
    WHERE url NOT IN (SELECT repo_url FROM scan_log WHERE status = 'completed')""")
def unscanned_repos(t: Tables):
    done = t["scan_log"].where("status = 'completed'").select(F.col("repo_url").alias("url"))
    return Q.unscanned(t["repos"], done)


_LAST = """last AS (SELECT repo_url, count(*) AS scans, arg_max(status, (completed_at, scan_id)) AS st,
      arg_max(findings, (completed_at, scan_id)) AS fi, max(completed_at) AS at_
      FROM scan_log WHERE completed_at IS NOT NULL GROUP BY repo_url)"""


@query(f"""{w('repos', 'scan_log')}, {_LAST} SELECT url, priority,
      CASE WHEN scans IS NULL THEN status WHEN st = 'completed' THEN 'scanned' ELSE 'error' END
        AS status, coalesce(scans, 0) AS scan_count, coalesce(fi, 0) AS findings_count,
      at_ AS last_scanned_at FROM repos LEFT JOIN last ON url = repo_url""")
def rolled_forward_repos(t: Tables):
    return Q.roll_forward(t["repos"], t["scan_log"]).select(
        "url", "priority", "status", "scan_count", "findings_count", "last_scanned_at")


@query(f"""{w('scan_log')} SELECT scan_id, 1000 * (epoch(date_trunc('second', completed_at))
      - epoch(date_trunc('second', started_at))) AS duration_ms
    FROM scan_log WHERE completed_at IS NOT NULL""")
def scan_durations(t: Tables):
    return Q.scan_durations(t["scan_log"]).select("scan_id", "duration_ms")


@query("""SELECT event_type AS name, arg_max('c' || event_id, row(ts, 'c' || event_id)) AS last_cursor,
    max(ts) AS last_fetched_at, sum(user_id % 7) AS repos_fetched FROM events GROUP BY 1""")
def feed_cursors(t: Tables):
    fetches = t.sql("""SELECT event_type AS name, 'c' || cast(event_id as string) AS cursor,
        ts AS fetched_at, user_id % 7 AS new FROM events""", "events")
    return Q.feed_cursors(fetches)


_RUNS = """SELECT batch AS batch_id, repo_url AS url, CASE WHEN status = 'completed' THEN 'success'
    ELSE 'failed' END AS status, findings FROM scan_log"""


@query(f"""{w('scan_log')} SELECT batch_id, count(*) AS total,
      count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
      sum(findings) AS findings FROM ({_RUNS}) GROUP BY 1""")
def batch_summary(t: Tables):
    return Q.batch_summary(t.sql(_RUNS, "scan_log"))


@query(f"""{w('scan_log')} SELECT batch_id, url, regexp_extract(url, '([^/]*)\\.git$', 1) AS name,
      status, findings FROM ({_RUNS})""")
def batch_rows(t: Tables):
    return Q.batch_rows(t.sql(_RUNS, "scan_log"))


@query(f"""{w('scan_log')} SELECT batch_id, url, name, status, findings, total, success FROM (
      SELECT batch_id, url, regexp_extract(url, '([^/]*)\\.git$', 1) AS name, status, findings,
        count(*) OVER (PARTITION BY batch_id) AS total,
        count(*) FILTER (status = 'success') OVER (PARTITION BY batch_id) AS success
      FROM ({_RUNS}))""")
def batch_documents(t: Tables):
    docs = Q.batch_documents(t.sql(_RUNS, "scan_log"), at_most=40)
    schema = """struct<batch_id: bigint, summary: struct<total: bigint, success: bigint>, repos:
        array<struct<url: string, name: string, status: string, findings: bigint>>>"""
    d = docs.select(F.from_json("document", schema).alias("d")).select(
        "d.batch_id", "d.summary.*", F.explode("d.repos").alias("r"))
    return d.select("batch_id", "r.*", "total", "success")


@query("""SELECT DISTINCT 'https://github.com/u/r' || user_id || '.git' AS url FROM events""")
def distinct_urls(t: Tables):
    return Q.distinct_urls(t.sql(
        "SELECT 'https://github.com/u/r' || user_id || '.git' AS url FROM events", "events"))


@query(f"""{w('repos')} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'scanned') AS scanned, count(*) FILTER (status = 'error') AS errors,
    count(*) FILTER (findings_count > 0) AS with_findings FROM repos""")
def repo_status(t: Tables):
    return Q.repo_status(t["repos"])


@query(f"""{w('queue_findings')} SELECT count(*) AS total, count(*) FILTER (verified) AS verified,
    count(*) FILTER (NOT reported) AS unreported FROM queue_findings""")
def finding_status(t: Tables):
    return Q.finding_status(t["queue_findings"])


@query(f"""{w('repos')} SELECT platform, count(*) AS repos, sum(findings_count) AS findings
    FROM repos GROUP BY platform""")
def repos_by_platform(t: Tables):
    return Q.by_platform(t["repos"])


@query(f"""{w('queue_findings')} SELECT rule_id, count(*) AS findings FROM queue_findings
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_rules(t: Tables):
    return Q.top_rules(t["queue_findings"])


@query(f"""{w('repos', 'queue_findings', 'scan_log')}
    SELECT 'repos' AS name, count(*) AS n FROM repos UNION ALL
    SELECT 'findings', count(*) FROM queue_findings UNION ALL
    SELECT 'scans', count(*) FROM scan_log""")
def table_counts(t: Tables):
    return Q.table_counts({"repos": t["repos"], "findings": t["queue_findings"],
                           "scans": t["scan_log"]})


@query(f"""{w('repos')} SELECT url, owner || '/' || name AS repo, priority, status FROM repos
    WHERE findings_count > 0 ORDER BY priority DESC, discovered_at DESC, url LIMIT 100""")
def repo_listing(t: Tables):
    r = t["repos"].withColumn("last_scanned_at", F.lit(None).cast("timestamp"))
    return Q.list_repos(r, F.col("findings_count") > 0).select("url", "repo", "priority", "status")


@query(f"""{w('repos', 'queue_findings')} SELECT finding_id, rule_id, secret_preview, repo_url,
      found_at FROM queue_findings f JOIN repos r ON f.repo_url = r.url WHERE r.priority > 5
    ORDER BY found_at DESC, finding_id LIMIT 5""")
def recent_findings(t: Tables):
    """Of known repositories only; the others' findings may be newer."""
    return Q.recent_findings(t["queue_findings"], t["repos"].where("priority > 5"))


@query(f"""{w('repos', 'queue_findings')} SELECT finding_id, rule_id,
      left(repo_url, 50) AS repo_url, found_at, r.platform
    FROM queue_findings f JOIN repos r ON f.repo_url = r.url
    WHERE rule_id = 'github-pat' AND r.priority > 5
    ORDER BY found_at DESC, finding_id LIMIT 100""")
def finding_listing(t: Tables):
    """Joined, then cut off: findings of unknown repositories take no place."""
    known = t["repos"].where("priority > 5")
    return Q.list_findings(t["queue_findings"], known, F.col("rule_id") == "github-pat").select(
        "finding_id", "rule_id", "repo_url", "found_at", "platform")


@query(f"""{w('repos', 'queue_findings')} SELECT finding_id, rule_id, file_path, line_number,
      verified, repo_url, platform, owner, name AS repo_name, found_at
    FROM queue_findings f JOIN repos r ON f.repo_url = r.url WHERE NOT reported""")
def active_findings(t: Tables):
    return Q.active_findings(t["queue_findings"], t["repos"]).select(
        "finding_id", "rule_id", "file_path", "line_number", "verified", "repo_url", "platform",
        "owner", "repo_name", "found_at")


_PROGRAMS = "progs(program, pplat, purl, key_types, min_payout, max_payout) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL::double" if v is None else q(v) if isinstance(v, str) else f"{v}::double"
                    for v in p) + ")" for p in Q.PROGRAMS) + ")"
_ELIGIBLE = f"""{w('repos', 'queue_findings')}, {_PROGRAMS},
    eligible AS (SELECT f.finding_id, f.rule_id, r.url AS repo_url, program, min_payout, max_payout
      FROM queue_findings f JOIN repos r ON f.repo_url = r.url
      JOIN progs ON (',' || key_types || ',') LIKE ('%,' || f.rule_id || ',%')
      WHERE NOT reported)"""


@query(f"{_ELIGIBLE} SELECT * FROM eligible")
def bounty_eligible(t: Tables):
    return Q.bounty_eligible(t["queue_findings"], t["repos"], Q.programs(t.spark)).select(
        "finding_id", "rule_id", "repo_url", "program", "min_payout", "max_payout")


@query(f"""{_ELIGIBLE} SELECT * FROM eligible
    ORDER BY max_payout DESC NULLS LAST, finding_id, program LIMIT 50""")
def top_eligible(t: Tables):
    e = Q.bounty_eligible(t["queue_findings"], t["repos"], Q.programs(t.spark))
    return Q.top_eligible(e).select(
        "finding_id", "rule_id", "repo_url", "program", "min_payout", "max_payout")


@query(f"""{w('queue_findings')}, {_PROGRAMS} SELECT f.finding_id, f.rule_id, program, max_payout
    FROM queue_findings f JOIN progs ON (',' || key_types || ',') LIKE ('%,' || f.rule_id || ',%')
    WHERE f.finding_id = (SELECT max(finding_id) FROM queue_findings WHERE rule_id = 'github-pat')""")
def finding_programs(t: Tables):
    f = t["queue_findings"]
    last = f.where("rule_id = 'github-pat'").agg(F.max("finding_id").alias("finding_id"))
    one = f.join(last, "finding_id", "left_semi")
    return one.join(Q.rule_programs(Q.programs(t.spark)), "rule_id").select(
        "finding_id", "rule_id", "program", "max_payout")


@query(f"""{w('repos', 'queue_findings')} SELECT finding_id, rule_id, file_path, line_number, repo_url,
      platform, owner, name AS repo_name FROM queue_findings f JOIN repos r ON f.repo_url = r.url
    WHERE f.finding_id = (SELECT max(finding_id) FROM queue_findings WHERE rule_id = 'github-pat')""")
def finding_detail(t: Tables):
    f = t["queue_findings"]
    last = f.where("rule_id = 'github-pat'").agg(F.max("finding_id")).scalar()
    one, _ = Q.finding_detail(f, t["repos"], Q.programs(t.spark), F.col("finding_id") == last)
    return one.select("finding_id", "rule_id", "file_path", "line_number", "repo_url", "platform",
                      "owner", "repo_name")


@query(f"""{w('repos', 'queue_findings')} SELECT finding_id, rule_id, rule_name, file_path,
      line_number, secret_preview, verified, verification_status, reported, reported_to, found_at,
      repo_url, platform, owner, name AS repo_name
    FROM queue_findings f JOIN repos r ON f.repo_url = r.url""")
def exported_findings(t: Tables):
    return Q.export(t["queue_findings"], t["repos"])


_EVENTS = """SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber
    AS finding_id, 'program' || (l_partkey % 5) AS reported_to, l_shipdate AS reported_at
    FROM lineitem WHERE l_discount > 0.05"""


@query(f"""{w('queue_findings')}, ev AS ({_EVENTS}) SELECT f.finding_id, ev.reported_to,
      ev.finding_id IS NOT NULL AS reported FROM queue_findings f
    LEFT JOIN ev ON f.finding_id = ev.finding_id""")
def reported_findings(t: Tables):
    return Q.mark_reported(t["queue_findings"], t.sql(_EVENTS, "lineitem")).select(
        "finding_id", "reported_to", "reported")


@query(f"""{w('repos')}, ev AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS e
      FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
    SELECT url, CASE e WHEN 'click' THEN 'pending' WHEN 'error' THEN 'error' ELSE status END AS status
    FROM repos LEFT JOIN ev USING (k)""")
def reset_repos(t: Tables):
    events = t.sql("""SELECT url, CASE event_type WHEN 'click' THEN 'pending' ELSE 'error' END
        AS status, struct(ts, event_id) AS at FROM events JOIN repos ON user_id = k
        WHERE event_type IN ('click', 'error')""", "repos", "events")
    return Q.apply_events(t["repos"], events, "url", F.col("at")).select("url", "status")


_STORE = """SELECT repo_url, rule_id, file_path, line_number, {sha}(rule_id || file_path ||
    cast(line_number as string) || secret_preview{bits}) AS secret_hash, found_at
    FROM queue_findings"""
_KEYS = ", ".join(FINDING_KEY)


@query(f"""{w('queue_findings')}, f AS ({_STORE.format(sha='sha256', bits='')})
    SELECT {_KEYS}, min(found_at) AS found_at FROM f WHERE ({_KEYS}) NOT IN (
      SELECT ({_KEYS}) FROM f WHERE found_at < TIMESTAMP '1997-01-01') GROUP BY {_KEYS}""")
def new_findings(t: Tables):
    f = t.sql(_STORE.format(sha="sha2", bits=", 256"), "queue_findings")
    known = f.where("found_at < timestamp_ntz'1997-01-01'").select(*FINDING_KEY).distinct()
    return insert_new(f, known, FINDING_KEY, F.col("found_at"))


# --- streams -----------------------------------------------------------------------------


def _stream(t: Tables, name: str):
    schema = t.given(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}*.parquet")


@query(f"""{w('docs')}, {D.findings_ctes('docs')} SELECT repo, path, line, col0 + 1 AS "column",
    rule_id, {D.redact('secret_raw')} AS secret FROM found""")
def stream_scan(t: Tables):
    """Findings of files that arrive in a stream."""
    files = _stream(t, "documents").selectExpr(
        "source AS repo", "cast(doc_id as string) AS path", "text AS content")
    home = workspace(t.spark, "stream-scan")
    M.scan_stream(files, f"{home}/findings", f"{home}/checkpoint", context_lines=0
                  ).awaitTermination()
    return t.spark.read.parquet(f"{home}/findings").select(
        "repo", "path", "line", "column", "rule_id", "secret")


def _urls(t: Tables):
    return _stream(t, "events").selectExpr(
        "'https://github.com/u/r' || user_id || '.git' AS url", "cast(ts as timestamp) AS ts")


def _drain(t: Tables, stream, name: str):
    home = workspace(t.spark, name)
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint")
     .trigger(availableNow=True).start(f"{home}/out").awaitTermination())
    return t.spark.read.parquet(f"{home}/out")


@query("SELECT DISTINCT 'https://github.com/u/r' || user_id || '.git' AS url FROM events")
def stream_first_seen(t: Tables):
    """URLs of a feed, each once."""
    return _drain(t, M.first_seen(_urls(t).select("url")), "first-seen")


@query("SELECT DISTINCT 'https://github.com/u/r' || user_id || '.git' AS url FROM events")
def stream_first_seen_within(t: Tables):
    """The same with state that forgets; the feed is shorter than the memory."""
    return _drain(t, M.first_seen_within(_urls(t), "3650 days"), "seen-within").select("url")


@query("""WITH u AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY first, 'https://github.com/u/r' || user_id || '.git')
          AS n FROM u)
    SELECT 'https://github.com/u/r' || user_id || '.git' AS url, n <= 50 AS scanned FROM r""")
def stream_monitor(t: Tables):
    """One cycle of the monitor: new URLs queued, the first fifty of them scanned."""
    urls = _urls(t).withColumnRenamed("ts", "found_at")
    home = workspace(t.spark, "monitor")
    M.monitor(urls, home, per_cycle=50).awaitTermination()
    done = M.read_state(t.spark, home, "scanned").select("url", F.lit(True).alias("scanned"))
    return M.read_state(t.spark, home, "discovered").join(done, "url", "left").select(
        "url", F.coalesce("scanned", F.lit(False)).alias("scanned"))


@query("""SELECT 'https://github.com/u/r' || user_id || '.git' AS url, CAST(2 AS BIGINT) AS times
    FROM events GROUP BY user_id""")
def stream_seen_again(t: Tables):
    """State that forgets: the same feed again, long after, is new again."""
    home = workspace(t.spark, "seen-again")
    urls = t.sql("""SELECT 'https://github.com/u/r' || user_id || '.git' AS url,
        cast(ts as timestamp) AS ts FROM events""", "events")
    one = urls.agg(F.lit("later").alias("url"), F.max("ts").alias("ts"))
    # two rows in between move the watermark past the memory of the first feed
    for day, rows in ((0, urls), (4000, one), (4001, one), (8000, urls)):
        rows.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(day))).write.parquet(
            f"{home}/feed/{day}")
        feed = t.spark.readStream.schema(urls.schema).parquet(f"{home}/feed/*")
        (M.first_seen_within(feed, "90 days").writeStream.format("parquet")
         .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
         .start(f"{home}/out").awaitTermination())
    return t.spark.read.parquet(f"{home}/out").where("url <> 'later'").groupBy("url").agg(
        F.count("*").alias("times"))


@query(f"""{w('files')}, {D.findings_ctes('files')},
    e AS (SELECT 'https://github.com/u/r' || user_id || '.git' AS url, ts, user_id % 10 AS priority,
          event_id % 2 AS half FROM events),
    d AS (SELECT url, priority, min(half) AS since,
          coalesce(min(ts) FILTER (half = 0), min(ts)) AS first FROM e GROUP BY url, priority),
    a AS (SELECT url, 0 AS cycle FROM d WHERE since = 0
          ORDER BY priority DESC, first, url LIMIT 10),
    b AS (SELECT url, 1 AS cycle FROM d WHERE url NOT IN (SELECT url FROM a)
          ORDER BY priority DESC, first, url LIMIT 10)
    SELECT s.url, s.cycle, count(f.rule_id) AS findings
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b) s
    LEFT JOIN found f ON s.url = 'https://github.com/u/r' || substr(f.repo, 5) || '.git'
    GROUP BY ALL""")
def stream_monitor_cycles(t: Tables):
    """Two cycles: what the first leaves queued is scanned by priority in the second."""
    home = workspace(t.spark, "monitor-cycles")
    urls = t.sql("""SELECT 'https://github.com/u/r' || user_id || '.git' AS url,
        cast(ts as timestamp) AS found_at, cast(user_id % 10 as int) AS priority,
        event_id % 2 AS half FROM events""", "events")
    files = t["files"].withColumn("repo", F.concat(
        F.lit("https://github.com/u/r"), F.expr("substr(repo, 5)"), F.lit(".git")))
    for half in (0, 1):
        urls.where(F.col("half") == half).drop("half").write.parquet(f"{home}/feed/{half}")
        feed = t.spark.readStream.schema(urls.drop("half").schema).parquet(f"{home}/feed/*")
        M.monitor(feed, home, files=files, per_cycle=10).awaitTermination()
    found = t.spark.read.parquet(f"{home}/findings").groupBy(F.col("repo").alias("url")).agg(
        F.count("*").alias("findings"))
    return M.read_state(t.spark, home, "scanned").select(
        "url", F.col("batch").alias("cycle")).join(found, "url", "left").fillna(0, ["findings"])


@query("""WITH e AS (SELECT 'https://github.com/u/r' || user_id || '.git' AS url, ts,
      event_id % 3 AS part FROM events),
    f0 AS (SELECT url, min(ts) AS ts FROM e WHERE part = 0 GROUP BY 1),
    k0 AS (SELECT *, 0 AS b FROM f0 QUALIFY (SELECT count(*) FROM f0) <= 40
           OR row_number() OVER (ORDER BY ts DESC, url DESC) <= 20),
    n1 AS (SELECT url, min(ts) AS ts FROM e WHERE part = 1 AND url NOT IN (SELECT url FROM k0)
           GROUP BY 1),
    s1 AS (SELECT * FROM k0 UNION ALL SELECT *, 1 FROM n1),
    k1 AS (SELECT * FROM s1 QUALIFY (SELECT count(*) FROM s1) <= 40
           OR row_number() OVER (ORDER BY b DESC, ts DESC, url DESC) <= 20),
    n2 AS (SELECT DISTINCT url FROM e WHERE part < 2 AND url NOT IN (SELECT url FROM k1))
    SELECT url, 0 AS batch FROM f0 UNION ALL SELECT url, 1 FROM n1 UNION ALL SELECT url, 2 FROM n2""")
def stream_seen_bounded(t: Tables):
    """A seen set of forty URLs that forgets all but the last twenty, and sees the others again."""
    home = workspace(t.spark, "seen-bounded")
    urls = t.sql("""SELECT 'https://github.com/u/r' || user_id || '.git' AS url,
        cast(ts as timestamp) AS ts, event_id % 3 AS part FROM events""", "events")
    for n, part in enumerate(("part = 0", "part = 1", "part < 2")):
        urls.where(part).drop("part").write.parquet(f"{home}/feed/{n}")
        feed = t.spark.readStream.schema(urls.drop("part").schema).parquet(f"{home}/feed/*")
        M.first_seen_bounded(feed, home, most=40, kept=20).awaitTermination()
    return t.spark.read.parquet(f"{home}/new").select("url", "batch")


@query(f"""{w('files')}, {D.findings_ctes('files')},
    e AS (SELECT 'https://github.com/u/r' || user_id || '.git' AS url, min(ts) AS first,
          min(event_id % 5) AS since FROM events GROUP BY 1),
    f AS (SELECT 'https://github.com/u/r' || user_id || '.git' AS url, event_id % 5 AS part,
          min(ts) AS first FROM events GROUP BY ALL),
    q AS (SELECT f.url, e.since, f.first FROM f JOIN e ON f.url = e.url AND f.part = e.since),
    hit AS (SELECT DISTINCT 'https://github.com/u/r' || substr(repo, 5) || '.git' AS url
            FROM found),
    c0 AS (SELECT url, 0 AS cycle FROM q WHERE since <= 0 ORDER BY first, url LIMIT 7),
    c1 AS (SELECT url, 1 AS cycle FROM q WHERE since <= 1 AND url NOT IN (SELECT url FROM c0)
           ORDER BY first, url LIMIT 7),
    c2 AS (SELECT url, 2 AS cycle FROM q WHERE since <= 2 AND url NOT IN (
             SELECT url FROM c0 UNION ALL SELECT url FROM c1) ORDER BY first, url LIMIT 7),
    done AS (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2)
    SELECT CAST(c.cycle AS INT) AS cycle,
      (SELECT count(*) FROM q WHERE since <= c.cycle)
        - (SELECT count(*) FROM done WHERE cycle <= c.cycle) AS queued,
      (SELECT count(*) FROM done d WHERE d.cycle = c.cycle) AS scanned,
      (SELECT count(*) FROM done d SEMI JOIN hit ON d.url = hit.url WHERE d.cycle = c.cycle)
        AS reports
    FROM (SELECT unnest([0, 1, 2]) AS cycle) c""")
def stream_monitor_counters(t: Tables):
    """What each of three cycles left queued, scanned and reported."""
    home = workspace(t.spark, "monitor-counters")
    urls = t.sql("""SELECT 'https://github.com/u/r' || user_id || '.git' AS url,
        cast(ts as timestamp) AS found_at, event_id % 5 AS part FROM events""", "events")
    files = t["files"].withColumn("repo", F.concat(
        F.lit("https://github.com/u/r"), F.expr("substr(repo, 5)"), F.lit(".git")))
    for part in range(3):
        urls.where(F.col("part") == part).drop("part").write.parquet(f"{home}/feed/{part}")
        feed = t.spark.readStream.schema(urls.drop("part").schema).parquet(f"{home}/feed/*")
        M.monitor(feed, home, files=files, per_cycle=7).awaitTermination()
    return M.read_state(t.spark, home, "cycles").select(
        F.col("batch").alias("cycle"), "queued", "scanned", "reports")


# --- views kept up to date by imports -----------------------------------------------------


def _two_imports(t: Tables):
    """The states that two imports leave, each of half of the scans."""
    home = workspace(t.spark, "states")
    half = F.pmod(F.xxhash64("scan_id"), F.lit(2))
    for number in (0, 1):
        W.add_import(t["scans"].where(half == number), t["findings"].where(half == number),
                     home, number)
    return W.read_states(t.spark, home)


@query(ORACLES["scan_summary"])
def scan_summary_of_imports(t: Tables):
    return W.fold_scan_summary(_two_imports(t)).drop(
        "timestamp", "target_path", "git_remote", "git_branch")


@query(ORACLES["findings_by_repo"])
def findings_by_repo_of_imports(t: Tables):
    return W.fold_findings_by_repo(_two_imports(t))


@query(ORACLES["security_stats"])
def security_stats_of_imports(t: Tables):
    return W.fold_security_stats(_two_imports(t)).withColumn(
        "scan_date", F.date_format("scan_date", "yyyy-MM-dd"))
