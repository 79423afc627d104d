"""Registered queries: sources, path filters, detection, context, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysieve.functions import identity as I
from keysieve.functions import text as T
from keysieve.operators.dedup import insert_counts, insert_new
from keysieve.plans import history as H
from keysieve.plans.report import leak_gate
from keysieve.plans.scan import scan_files
from keysieve.plans.verification import apply_verdicts
from keysieve.sources import feeds, files as S
from keysieve.sources import history as V
from keysieve.sources.reports import parse_scanner_json, parse_scanner_text
from keysieve.sources.rules import Rule, RuleSet, load_rules
from keysieve.workspace import workspace
from registry import detection_sql as D
from registry.base import ORACLES, Tables, query
from registry.tables import with_clause as w

OUT = ["repo", "path", "line", "column", "pos", "rule_id", "rule_name", "matched", "secret"]
FOUND = f"""repo, path, line, col0 + 1 AS "column", pos, rule_id, rule_name,
            {D.redact('matched')} AS matched, {D.redact('secret_raw')} AS secret"""


def found(files: str, rules: RuleSet | None = None, select: str = FOUND, tail: str = "") -> str:
    return f"{w(files)}, {D.findings_ctes(files, rules=rules)} SELECT {select} FROM found {tail}"


def of_kind(kind: str) -> RuleSet:
    return RuleSet(tuple(r for r in load_rules().rules if r.kind == kind))


def _odd_rules() -> RuleSet:
    """Rules of a user's own, whose literals hold what the default ones never do."""
    return RuleSet((
        Rule("spring-password", "Spring password", "keyvalue", ("spring.datasource.password",), 8,
             ord=1),
        Rule("client-secret", "Client secret", "keyvalue", ("client secret",), 10, ord=2),
        Rule("bearer", "Bearer token", "prefix", ("Bearer ",), 24, "AlphaNum", ord=3),
        Rule("plain-key", "Plain key", "keyvalue", ("plain_key",), 10, ord=4),
        Rule("prod-token", "Token of a place", "keyvalue", ("app/token@prod :",), 10, ord=5),
    ))


# --- detection ---------------------------------------------------------------------------


@query(f"""{w('docs')}, {D.findings_ctes('docs')}
    SELECT d.repo, count(DISTINCT d.path) AS files, count(f.rule_id) AS findings,
           count(DISTINCT f.rule_id) AS unique_rules, count(f.rule_id) > 0 AS failed
    FROM docs d LEFT JOIN found f ON d.repo = f.repo AND d.path = f.path GROUP BY d.repo""")
def leak_summary_by_source(t: Tables):
    """Flagship: every source of documents with its files, findings and rules."""
    docs = t["docs"]
    per_rule = scan_files(docs, context_lines=0).groupBy("repo", "rule_id").agg(
        F.count("*").alias("n"))
    hits = per_rule.groupBy("repo").agg(
        F.sum("n").alias("findings"), F.count("*").alias("unique_rules"))
    return (docs.groupBy("repo").agg(F.count("*").alias("files")).join(hits, "repo", "left")
            .fillna(0).withColumn("failed", F.col("findings") > 0))


@query(found("docs"))
def scan_documents(t: Tables):
    return scan_files(t["docs"], context_lines=0).select(*OUT)


@query(found("files"))
def scan_planted_files(t: Tables):
    return scan_files(t["files"], context_lines=0).select(*OUT)


@query(found("trigger_files"))
def scan_planted_triggers(t: Tables):
    """Every key and prefix of the catalogue, and near misses of each."""
    return scan_files(t["trigger_files"], context_lines=0).select(*OUT)


@query(f"""{w('trigger_files')}, {D.findings_ctes('trigger_files')}
    SELECT r.rule_id, count(f.rule_id) AS lines_hit
    FROM (SELECT DISTINCT rule_id FROM rules) r LEFT JOIN found f ON r.rule_id = f.rule_id
    GROUP BY ALL""")
def trigger_usage(t: Tables):
    hits = scan_files(t["trigger_files"], context_lines=0).groupBy("rule_id").agg(
        F.count("*").alias("lines_hit"))
    return load_rules().to_df(t.spark).select("rule_id").join(
        hits, "rule_id", "left").fillna(0, ["lines_hit"])


@query(found("files", of_kind("prefix")))
def detect_prefix(t: Tables):
    return scan_files(t["files"], of_kind("prefix"), context_lines=0).select(*OUT)


@query(found("files", of_kind("keyvalue")))
def detect_key_value(t: Tables):
    return scan_files(t["files"], of_kind("keyvalue"), context_lines=0).select(*OUT)


@query(found("files", of_kind("contains")))
def detect_contains(t: Tables):
    return scan_files(t["files"], of_kind("contains"), context_lines=0).select(*OUT)


@query(found("files", of_kind("endpoint")))
def detect_endpoint(t: Tables):
    return scan_files(t["files"], of_kind("endpoint"), context_lines=0).select(*OUT)


_ONLY = "github-pat, generic-token, generic-password, aws-secret-key, database-url-env"


@query(found("files", load_rules().subset(_ONLY, "generic-password")))
def scan_rule_subset(t: Tables):
    return scan_files(t["files"], context_lines=0, only=_ONLY, exclude=["generic-password"]
                      ).select(*OUT)


@query(found("odd_files", rules=_odd_rules()))
def scan_custom_rules(t: Tables):
    return scan_files(t["odd_files"], _odd_rules(), context_lines=0).select(*OUT)


@query(found("docs", select="repo, path, line, matched, secret_raw AS secret"))
def scan_unredacted(t: Tables):
    return scan_files(t["docs"], context_lines=0, redacted=False).select(
        "repo", "path", "line", "matched", "secret")


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT f.repo, f.path, f.line, f.pos, l.line AS context_line,
           replace(l.text, f.secret_raw, {D.redact('f.secret_raw')}) AS content,
           l.line = f.line AS is_match
    FROM found f JOIN all_lines l ON f.repo = l.repo AND f.path = l.path
         AND l.line BETWEEN f.line - 2 AND f.line + 2""")
def scan_context(t: Tables):
    s = scan_files(t["files"], context_lines=2, hide="own")
    return s.select("repo", "path", "line", "pos", F.explode("context").alias("c")).select(
        "repo", "path", "line", "pos", F.col("c.line").alias("context_line"), "c.content",
        "c.is_match")


@query(f"""{w('files')}, {D.findings_ctes('files')},
    near AS (SELECT f.repo, f.path, f.line, f.pos,
               list(DISTINCT struct_pack(n := length(g.secret_raw), r := g.secret_raw,
                                         s := {D.redact('g.secret_raw')})) AS secrets
             FROM found f JOIN found g ON f.repo = g.repo AND f.path = g.path GROUP BY ALL),
    sorted AS (SELECT * EXCLUDE (secrets), list_reverse_sort(secrets) AS secrets FROM near),
    blotted AS (
      SELECT f.repo, f.path, f.line, f.pos, l.line AS context_line, l.line = f.line AS is_match,
             f.secrets, 0 AS i, l.text AS content
      FROM sorted f JOIN all_lines l ON f.repo = l.repo AND f.path = l.path
           AND l.line BETWEEN f.line - 3 AND f.line + 3
      UNION ALL
      SELECT repo, path, line, pos, context_line, is_match, secrets, i + 1,
             replace(content, secrets[i + 1].r, secrets[i + 1].s)
      FROM blotted WHERE i < len(secrets))
    SELECT repo, path, line, pos, context_line, content, is_match
    FROM blotted WHERE i = len(secrets)""")
def scan_context_all_hidden(t: Tables):
    s = scan_files(t["files"], context_lines=3, hide="all")
    return s.select("repo", "path", "line", "pos", F.explode("context").alias("c")).select(
        "repo", "path", "line", "pos", F.col("c.line").alias("context_line"), "c.content",
        "c.is_match")


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT repo, count(DISTINCT f.path) AS files_hit, count(rule_id) AS findings,
           count(rule_id) > 0 AS failed
    FROM (SELECT DISTINCT repo FROM files) LEFT JOIN found f USING (repo) GROUP BY repo""")
def leak_gate_by_repo(t: Tables):
    s = scan_files(t["files"], context_lines=0)
    hit = s.select("repo", "path").distinct().groupBy("repo").agg(F.count("*").alias("files_hit"))
    return leak_gate(t["files"], s).join(hit, "repo", "left").fillna(0).select(
        "repo", "files_hit", "findings", "failed")


# --- sources and path filters --------------------------------------------------------------


@query("""SELECT coalesce(source, 'none') AS repo,
      cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS bigint) AS n_lines,
      cast(sum(length(text) + 1) AS bigint) AS n_chars
    FROM (SELECT source, coalesce(text, '') AS text FROM documents) GROUP BY 1""")
def file_tree(t: Tables):
    """The documents as a tree of files, read back; what lies in skipped folders stays unread."""
    return _tree(t, workspace(t.spark, "tree"))


@query(ORACLES["file_tree"])
def hidden_root_tree(t: Tables):
    """The same below a hidden folder: only folders below the root are tested."""
    return _tree(t, workspace(t.spark, "tree") + "/.hidden/node_modules/root")


def _tree(t: Tables, root: str):
    docs = t["documents"].select(F.coalesce("source", F.lit("none")).alias("repo"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    for folder in ("src", "node_modules", "src/.cache"):
        docs.write.partitionBy("repo").text(f"{root}/{folder}")
    files = S.text_files(S.read_tree(t.spark, root)).select(
        F.regexp_extract("path", "/repo=([^/]*)/", 1).alias("repo"), "content")
    return files.groupBy("repo").agg(
        F.sum(F.length(F.regexp_replace("content", "[^\n]+", "")).cast("bigint")).alias("n_lines"),
        F.sum(F.length("content").cast("bigint")).alias("n_chars"))


@query(f"""{w('docs')}, {D.lines_ctes('docs', filtered=False)}
    SELECT repo, path, line, text FROM all_lines""")
def split_into_lines(t: Tables):
    return S.explode_lines(t["docs"]).select("repo", "path", "line", "text")


@query(f"""{w('files')} SELECT path,
      list_has_any(string_split(path, '/'), [{', '.join(D.q(d) for d in S.SKIPPED_DIRS)}]) AS in_dir,
      regexp_matches(path, '(^|/)\\.[^./][^/]*/') AS hidden,
      lower(regexp_extract(string_split(path, '/')[-1], '.\\.([^.]*)$', 1))
        IN ({', '.join(D.q(e) for e in S.BINARY_EXTENSIONS)}) AS binary_file,
      string_split(path, '/')[-1] IN ({', '.join(D.q(e) for e in S.LOCK_FILES)}) AS lock_file,
      {D.scannable('path')} AS scanned FROM files""")
def path_filters(t: Tables):
    p = F.col("path")
    return t["files"].select(
        p, S.in_skipped_dir(p).alias("in_dir"), S.in_hidden_dir(p).alias("hidden"),
        S.has_binary_extension(p).alias("binary_file"), S.is_lock_file(p).alias("lock_file"),
        S.scannable(p).alias("scanned"))


@query("""SELECT doc_id, length(text) AS n FROM documents WHERE lang <> 'fr'""")
def utf8_gate(t: Tables):
    raw = F.col("text").cast("binary")
    broken = F.when(F.col("lang") == "fr", F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return S.text_files(t["documents"].withColumn("content", broken)).select(
        "doc_id", F.length("content").cast("long").alias("n"))


@query(f"""{w('files')} SELECT repo, path FROM files f
    WHERE EXISTS (SELECT 1 FROM orders o WHERE 'repo' || o_custkey = f.repo
                  AND o_orderstatus = 'F' AND starts_with(f.path, 'p' || o_orderkey || '/'))""")
def tracked_files(t: Tables):
    tracked = t.sql("""SELECT f.repo, f.path FROM files f JOIN orders o
        ON split_part(f.path, '/', 1) = 'p' || o_orderkey WHERE o_orderstatus = 'F'""",
                    "files", "orders")
    return S.tracked_only(t["files"], tracked).select("repo", "path")


_LIST = """SELECT CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '# ' || c_name
    ELSE 'https://github.com/o/r' || cast(c_custkey as string) END AS value FROM customer"""


@query(f"SELECT value AS url FROM ({_LIST}) WHERE value <> '' AND NOT starts_with(value, '#')")
def repo_list(t: Tables):
    return feeds.repo_list(t.sql(_LIST, "customer"))


@query(f"""{w('findings')}
    SELECT scan_id AS repo_url, rule_id, file_path, line_number, column_number, rule_name,
           secret_preview, 'x = 1' AS context FROM findings
    UNION ALL SELECT scan_id, 'other-rule', 'dir/b c.py', 7, 9, 'Other', verification_status, ''
    FROM findings""")
def scanner_text(t: Tables):
    return parse_scanner_text(t["outputs"]).drop("record")


@query(f"""{w('report_docs')},
    ok AS (SELECT file AS repo_url, json(document) AS d FROM report_docs
           WHERE document <> '{{"findings": ['),
    f AS (SELECT repo_url, unnest(json_extract(d, '$.findings[*]')) AS f FROM ok)
    SELECT repo_url, f->>'$.rule_id' AS rule_id, f->>'$.rule_name' AS rule_name,
      coalesce(f->>'$.location.file', f->>'$.file') AS file_path,
      cast(coalesce(f->>'$.location.line', f->>'$.line') AS int) AS line_number,
      coalesce(f->>'$.secret_preview', f->>'$.secret') AS secret_preview,
      coalesce(f->>'$.verification_status.status', '') IN ('Active', 'Inactive') AS verified,
      CASE f->>'$.verification_status.status' WHEN 'Active' THEN 'active'
        WHEN 'Inactive' THEN 'inactive' ELSE 'unknown' END AS verification_status
    FROM f""")
def scanner_json(t: Tables):
    docs = t["report_docs"].select(F.col("file").alias("repo_url"), "document")
    return parse_scanner_json(docs)


_PAYLOAD = r"""(SELECT source, unnest(list_concat(
      regexp_extract_all(payload, '"clone_url"\s*:\s*"([^"]*)"', 1),
      regexp_extract_all(payload, '"http_url_to_repo"\s*:\s*"([^"]*)"', 1),
      list_filter(regexp_extract_all(payload, '"href"\s*:\s*"([^"]*)"', 1),
                  lambda u: suffix(u, '.git')))) AS url FROM payloads)"""


@query(f"{w('payloads')} SELECT source, url, count(*) AS n FROM {_PAYLOAD} GROUP BY ALL")
def payload_urls(t: Tables):
    return feeds.payload_urls(t["payloads"]).groupBy("source", "url").agg(F.count("*").alias("n"))


@query(f"""{w('payloads')} SELECT DISTINCT source, 'https://pagure.io/' || regexp_extract(payload,
    '"fullname":"([^"]*)"', 1) || '.git' AS url FROM payloads""")
def payload_names(t: Tables):
    return feeds.payload_names(t["payloads"], "https://pagure.io").distinct()


_LINKS = r"""(SELECT DISTINCT source, rid, CASE WHEN contains(u, 'gitlab.com')
      THEN regexp_replace(u, '#.*|/-/.*', '') ELSE
      regexp_replace(u, '#.*|/(issues|pull|blob|tree).*', '') END AS u
    FROM (SELECT source, rid, unnest(regexp_extract_all(text,
      'https?://(?:github|gitlab)\.com/[a-zA-Z0-9_-]+/[a-zA-Z0-9_.-]+')) AS u
      FROM (SELECT *, row_number() OVER () AS rid FROM posts)))"""


@query(f"""{w('posts')} SELECT source, regexp_replace(u, '\\.git$', '') || '.git' AS url,
    count(*) AS n FROM {_LINKS} GROUP BY ALL""")
def text_urls(t: Tables):
    return feeds.text_urls(t["posts"]).groupBy("source", "url").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT event_type AS source,
    'https://github.com/u' || user_id || '/p' || (event_id % 9) || '.git' AS url
    FROM events WHERE event_type <> 'view'""")
def event_urls(t: Tables):
    names = t.sql("""SELECT event_type AS source, CASE WHEN event_type = 'view' THEN 'nobody'
        ELSE 'u' || user_id || '/p' || (event_id % 9) END AS name FROM events""", "events")
    return feeds.event_urls(names)


@query("""SELECT source, url FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY url)
    AS r FROM (SELECT DISTINCT event_type AS source, 'https://github.com/u' || user_id || '/p'
               || (event_id % 9) || '.git' AS url FROM events)) WHERE r <= 30""")
def capped_urls(t: Tables):
    names = t.sql("""SELECT event_type AS source, 'u' || user_id || '/p' || (event_id % 9)
        AS name FROM events""", "events")
    return feeds.cap_per_source(feeds.event_urls(names), 30)


_NEW = f"""{w('payloads', 'repos')}, incoming AS (SELECT DISTINCT source, url FROM {_PAYLOAD}),
    known AS (SELECT 'https://gitlab.com/g/r' || c_custkey || '.git' AS url FROM customer
              WHERE c_mktsegment = 'BUILDING')"""


def _incoming(t: Tables):
    urls = feeds.payload_urls(t["payloads"]).distinct()
    known = t.sql("""SELECT 'https://gitlab.com/g/r' || c_custkey || '.git' AS url FROM customer
        WHERE c_mktsegment = 'BUILDING'""", "customer")
    return urls, insert_new(urls, known, ["url"], F.col("source"))


@query(f"""{_NEW} SELECT url, min(source) AS source FROM incoming
    WHERE url NOT IN (SELECT url FROM known) GROUP BY url""")
def new_repos(t: Tables):
    return _incoming(t)[1].select("url", "source")


@query(f"""{_NEW}, fresh AS (SELECT url, min(source) AS source FROM incoming
      WHERE url NOT IN (SELECT url FROM known) GROUP BY url)
    SELECT i.source, i.total, coalesce(f.n, 0) AS "new"
    FROM (SELECT source, count(*) AS total FROM incoming GROUP BY source) i
    LEFT JOIN (SELECT source, count(*) AS n FROM fresh GROUP BY source) f ON i.source = f.source""")
def feed_counts(t: Tables):
    urls, new = _incoming(t)
    return insert_counts(urls, new, "source")


@query(f"""{w('repos')} SELECT url, platform, owner, name, source, priority, status,
    discovered_at FROM (SELECT url, platform, CASE WHEN platform = 'unknown' THEN '' ELSE owner END
      AS owner, CASE WHEN platform = 'unknown' THEN '' ELSE name END AS name, source, 7 AS priority,
      'pending' AS status, discovered_at FROM repos)""")
def queued_repos(t: Tables):
    return feeds.as_repos(t["repos"].select("url", "source", "discovered_at"), 7)


# --- history -----------------------------------------------------------------------------


def _history(select: str, table: str = "versions", more: str = "") -> str:
    key = "repo, commit, path"
    return (f"{w('versions')}, {more} {D.findings_ctes(table, key)} {select}")


_HEADS = """seen AS (SELECT repo, path, commit, ts, change FROM onb UNION ALL
      SELECT repo, old_path, commit, ts, 'D' FROM onb WHERE change = 'R' AND old_path <> path),
    heads AS (SELECT repo, path, commit FROM (SELECT *, row_number() OVER (
      PARTITION BY repo, path ORDER BY ts DESC, commit DESC, change <> 'D' DESC) AS r FROM seen)
      WHERE r = 1 AND change <> 'D'),
    tree AS (SELECT v.* FROM onb v JOIN heads h ON v.repo = h.repo AND v.path = h.path
             AND v.commit = h.commit),"""
_TREE = f"onb AS (SELECT * FROM versions WHERE branch = 'main'), {_HEADS}"
_FEATURE = f"""fork AS (SELECT repo, min(ts) AS since FROM versions WHERE branch = 'feature'
      GROUP BY repo),
    onb AS (SELECT * FROM versions WHERE branch = 'feature' UNION ALL
      SELECT v.* FROM versions v JOIN fork f ON v.repo = f.repo
      WHERE v.branch = 'main' AND v.ts < f.since), {_HEADS}"""
_LIVE = "live AS (SELECT * FROM versions WHERE change <> 'D'),"
_BRANCH = "live AS (SELECT * FROM versions WHERE change <> 'D' AND branch = 'feature'),"


@query(f"{w('versions')} SELECT DISTINCT repo, path FROM versions WHERE change = 'A'")
def added_paths(t: Tables):
    return V.added_paths(t["versions"])


@query(_history('SELECT repo, commit, path, line, col0 + 1 AS "column", rule_id FROM found',
                "live", _BRANCH))
def scan_branch(t: Tables):
    return H.scan_branch(t["versions"], "feature").select(
        "repo", "commit", "path", "line", "column", "rule_id")


@query(_history('SELECT repo, commit, path, line, col0 + 1 AS "column", rule_id FROM found',
                "tree", _TREE))
def scan_current_tree(t: Tables):
    return H.scan_tree(t["versions"], "main").select(
        "repo", "commit", "path", "line", "column", "rule_id")


@query(_history('SELECT repo, commit, path, line, col0 + 1 AS "column", rule_id FROM found',
                "tree", _FEATURE))
def scan_feature_tree(t: Tables):
    """A branch as it is now: its own files and those it has from the branch it left."""
    return H.scan_tree(t["versions"], "feature", base="main").select(
        "repo", "commit", "path", "line", "column", "rule_id")


@query(_history("""SELECT f.repo, rule_id, sha256('keysieve:' || secret_raw) AS secret_id,
        strftime(min(v.ts), '%Y-%m-%d') AS first_seen, strftime(max(v.ts), '%Y-%m-%d') AS last_seen,
        count(*) AS occurrences
    FROM found f JOIN versions v ON f.repo = v.repo AND f.commit = v.commit AND f.path = v.path
    WHERE NOT EXISTS (SELECT 1 FROM found g JOIN heads h ON g.repo = h.repo AND g.path = h.path
        AND g.commit = h.commit WHERE g.repo = f.repo AND g.rule_id = f.rule_id
        AND g.secret_raw = f.secret_raw) GROUP BY ALL""", "live", _TREE + _LIVE))
def removed_secrets(t: Tables):
    v = t["versions"]
    gone = H.removed_secrets(H.scan_versions(v), V.heads(v, "main"))
    return gone.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd")).withColumn(
        "last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


_VERDICTS = """SELECT rule_id, secret_preview, CASE n % 5 WHEN 0 THEN 200 WHEN 1 THEN 401
      WHEN 2 THEN 429 WHEN 3 THEN 403 ELSE 500 END AS http_code, at AS checked_at
    FROM (SELECT rule_id, secret_preview, max(line_number) AS n, max(column_number) AS at
          FROM findings WHERE verification_status <> 'pending' GROUP BY rule_id, secret_preview) v"""
_VERIFIABLE = ", ".join(D.q(r) for r in I.VERIFIABLE_RULES)


@query(f"""{w('findings')}, v AS ({_VERDICTS.replace(' at ', ' chk ').replace('AS at', 'AS chk')})
    SELECT f.scan_id, f.file_path, f.line_number, f.rule_id, f.secret_preview,
      CASE WHEN f.rule_id NOT IN ({_VERIFIABLE}) THEN 'not_supported'
        WHEN http_code IS NULL THEN 'pending' WHEN http_code BETWEEN 200 AND 299 THEN 'active'
        WHEN http_code IN (401, 403) THEN 'inactive' ELSE 'unknown' END AS verification_status,
      CASE WHEN f.rule_id NOT IN ({_VERIFIABLE}) THEN 'No verifier for this secret type'
        WHEN http_code IS NULL THEN NULL WHEN http_code BETWEEN 200 AND 299 THEN 'Secret is valid'
        WHEN http_code IN (401, 403) THEN 'Secret is invalid or revoked'
        WHEN http_code = 429 THEN 'Rate limited' ELSE 'HTTP ' || http_code END
        AS verification_message
    FROM findings f LEFT JOIN v ON f.rule_id = v.rule_id AND f.secret_preview = v.secret_preview""")
def verdicts(t: Tables):
    v = t.sql(_VERDICTS, "findings")
    f = t["findings"].drop("verification_status")
    return apply_verdicts(f, v, ["rule_id", "secret_preview"]).select(
        "scan_id", "file_path", "line_number", "rule_id", "secret_preview",
        "verification_status", "verification_message")


# --- scalar functions --------------------------------------------------------------------


_VALUES = """SELECT k, CASE k % 16 WHEN 0 THEN 'changeme' WHEN 1 THEN '${KEY' || k || '}'
      WHEN 2 THEN 'self.key' || k WHEN 3 THEN 'abc_def' WHEN 4 THEN 'eyJ' || h || '.x'
      WHEN 5 THEN 'a.b' || k WHEN 6 THEN 'get(' || k || ')' WHEN 7 THEN 'http://localhost:' || k
      WHEN 8 THEN 'XXXXXX' WHEN 9 THEN 'sk-xxxxxxxxxx' WHEN 10 THEN 'my_' || h WHEN 11 THEN h
      WHEN 12 THEN 'x[''' || k WHEN 13 THEN '//lo' || k WHEN 14 THEN 'key-example'
      ELSE 'a->b' || k END AS v
    FROM (SELECT o_orderkey AS k, {h} AS h FROM orders) o"""


@query(f"""SELECT k, v, {D.placeholder('v')} AS placeholder, {D.code_pattern('v')} AS code,
    {D.looks_like_code('v')} AS codelike, {D.localhost('v')} AS loopback
    FROM ({_VALUES.replace('{h}', 'sha256(cast(o_orderkey as string))')})""")
def value_tests(t: Tables):
    v = F.col("v")
    return t.sql(_VALUES.replace("{h}", "sha2(cast(o_orderkey as string), 256)"), "orders").select(
        "k", v, T.is_placeholder(v).alias("placeholder"), T.is_code_pattern(v).alias("code"),
        T.looks_like_code(v).alias("codelike"), T.is_localhost(v).alias("loopback"))


@query(f"""SELECT conv_id, turn, {D.redact('text')} AS redacted,
    left(text, 20) || '...' AS preview, CASE WHEN length(text) <= 60 THEN text ELSE
    left(text, 29) || '…' || right(text, 30) END AS elided FROM conversations""")
def text_shortening(t: Tables):
    x = F.col("text")
    return t["conversations"].select(
        "conv_id", "turn", T.redact(x).alias("redacted"), T.preview(x).alias("preview"),
        T.elide(x, 60).alias("elided"))


@query("""SELECT conv_id, turn, substr(cast(to_json(text) as varchar), 2,
    length(cast(to_json(text) as varchar)) - 2) AS escaped FROM conversations""")
def json_escaping(t: Tables):
    return t["conversations"].select("conv_id", "turn", T.json_escape(F.col("text")).alias("escaped"))


_URLS = """SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN 'https://github.com/o' || n || '/r'
      || c_custkey || '.git' WHEN 1 THEN 'git@github.com:o/r' || c_custkey || '.git'
      WHEN 2 THEN 'git@host:r' || c_custkey WHEN 3 THEN 'https://gitlab.com/g/p' || c_custkey
      || '/-/issues/1' WHEN 4 THEN 'https://github.com/o/r' || c_custkey || '/tree/main/src'
      WHEN 5 THEN '/data/repo' || c_custkey WHEN 6 THEN 'ssh://git@codeberg.org/o/r'
      || c_custkey || '/' WHEN 7 THEN 'https://bitbucket.org/t/r' || c_custkey || '#top'
      ELSE 'c' || c_custkey END AS u FROM (SELECT *, c_nationkey AS n FROM customer) c"""


@query(f"""SELECT k, u,
    CASE WHEN starts_with(u, 'http') OR starts_with(u, 'git@') THEN 'git_url' ELSE 'directory' END
      AS target_type,
    regexp_matches(u, '^(https?://|git@|ssh://|git://)') AS is_git,
    CASE WHEN contains(b, '/') THEN regexp_extract(b, '[^/]*$') WHEN contains(b, ':')
      THEN regexp_extract(b, '[^:]*$') END AS repo_name,
    CASE WHEN contains(u, 'github.com') THEN 'github' WHEN contains(u, 'gitlab.com') THEN 'gitlab'
      WHEN contains(u, 'codeberg.org') THEN 'codeberg' WHEN contains(u, 'bitbucket.org')
      THEN 'bitbucket' ELSE 'unknown' END AS platform,
    regexp_extract(u, '^.*\\.(?:com|org)/([^/]*)/', 1) AS owner,
    regexp_extract(u, '^.*\\.(?:com|org)/[^/]*/([^/.]*)', 1) AS project,
    regexp_replace(CASE WHEN contains(u, 'gitlab.com') THEN regexp_replace(u, '#.*|/-/.*', '')
      ELSE regexp_replace(u, '#.*|/(issues|pull|blob|tree).*', '') END, '\\.git$', '') || '.git'
      AS canonical,
    CASE WHEN contains(u, '://') THEN regexp_extract(u, '://([^/]*)', 1) END AS host
    FROM (SELECT *, regexp_replace(regexp_replace(u, '/+$', ''), '\\.git$', '') AS b
          FROM ({_URLS}))""")
def url_functions(t: Tables):
    u = F.col("u")
    return t.sql(_URLS, "customer").select(
        "k", u, I.target_type(u).alias("target_type"), I.is_git_url(u).alias("is_git"),
        I.repo_name(u).alias("repo_name"), I.platform(u).alias("platform"),
        I.owner(u).alias("owner"), I.project(u).alias("project"),
        I.canonical_url(u).alias("canonical"), I.url_host(u).alias("host"))


@query(f"""{w('findings')} SELECT rule_id, regexp_matches(rule_id, 'private-key|aws|database|jwt')
      AS high, regexp_matches(rule_id, 'api-key|token|secret') AS medium,
      split_part(rule_id, '-', 1) AS category, CASE WHEN starts_with(rule_id, 'generic-') THEN 0
      ELSE length(rule_id) END AS specificity, count(*) AS n FROM findings GROUP BY rule_id""")
def rule_classes(t: Tables):
    r = F.col("rule_id")
    return t["findings"].groupBy(
        r, I.is_high(r).alias("high"), I.is_medium(r).alias("medium"),
        I.category(r).alias("category"), I.specificity(r).alias("specificity")).agg(
        F.count("*").alias("n"))


@query("""SELECT event_id, lpad(lower(to_hex(epoch_us(ts))), 32, '0') AS scan_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def scan_times(t: Tables):
    ts = F.col("ts").cast("timestamp")
    return t["events"].select("event_id", I.scan_id(ts).alias("scan_id"), I.iso_utc(ts).alias("iso"))


@query(f"""{w('findings')} SELECT scan_id, rule_id, line_number, sha256(rule_id || file_path ||
    line_number || secret_preview) AS secret_hash FROM findings""")
def secret_hashes(t: Tables):
    return t["findings"].select("scan_id", "rule_id", "line_number", I.secret_hash(
        F.col("rule_id"), F.col("file_path"), F.col("line_number"), F.col("secret_preview")
    ).alias("secret_hash"))


_CODES = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 401
    WHEN 3 THEN 403 WHEN 4 THEN 429 WHEN 5 THEN 500 ELSE 0 END AS code, event_type FROM events"""


@query(f"""SELECT event_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'active' WHEN code IN (401, 403)
      THEN 'inactive' ELSE 'unknown' END AS status, CASE WHEN code BETWEEN 200 AND 299 THEN
      'Secret is valid' WHEN code IN (401, 403) THEN 'Secret is invalid or revoked'
      WHEN code = 429 THEN 'Rate limited' ELSE 'HTTP ' || code END AS message FROM ({_CODES})""")
def http_verdicts(t: Tables):
    c = F.col("code")
    return t.sql(_CODES, "events").select(
        "event_id", I.http_status(c).alias("status"), I.http_message(c).alias("message"))


@query(f"""{w('files')}, {D.findings_ctes('files')}
    SELECT r.rule_id, r.form, r.spec AS specificity, count(DISTINCT f.repo || f.path || f.line)
      AS lines_hit
    FROM (SELECT DISTINCT rule_id, spec, CASE form WHEN 'p' THEN 'prefix' WHEN 'c' THEN 'contains'
          WHEN 'k' THEN 'keyvalue' ELSE 'endpoint' END AS form FROM rules) r
    LEFT JOIN found f ON r.rule_id = f.rule_id GROUP BY ALL""")
def rule_usage(t: Tables):
    hits = scan_files(t["files"], context_lines=0).groupBy("rule_id").agg(
        F.count("*").alias("lines_hit"))
    return load_rules().to_df(t.spark).select(
        "rule_id", F.col("kind").alias("form"), "specificity").join(
        hits, "rule_id", "left").fillna(0, ["lines_hit"])
