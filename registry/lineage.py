"""Registered queries: files in byte ranges, crowded files, histories by their commit graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysieve.plans import history as H
from keysieve.plans.scan import scan_large, scan_tree
from keysieve.sources import history as V
from keysieve.workspace import workspace
from registry import detection_sql as D
from registry.base import Tables, query
from registry.scans import found
from registry.tables import with_clause as w

# --- large files ----------------------------------------------------------------------------

# all files of the repositories with the same last digit, one behind the other
_JOINED = """joined AS (SELECT 'all' AS repo, 'part' || right(repo, 1) AS path,
      string_agg(content, '' ORDER BY path) AS content FROM files
      WHERE path NOT LIKE '%node_modules%' GROUP BY 2),"""
_LARGE = f"{w('files')}, {_JOINED} {D.findings_ctes('joined')}"
RANGE, RANGES = 128 << 10, 512  # bytes at least, so that small test data make many ranges; how many


def _folder(t: Tables, files) -> str:
    """A folder with one large file for each ``part`` of (part, path, content), in that order."""
    root = workspace(t.spark, "large")
    lines = files.where("content is not null").select("part", "path", "content", F.expr(
        "left(content, length(content) - 1)").alias("text"))  # a row ends its last line
    lines.repartition("part").sortWithinPartitions("part", "path", "content").select(
        "part", "text").write.option("maxRecordsPerFile", 0).partitionBy("part").text(root)
    return root


def _part():
    return F.concat(F.lit("part"), F.regexp_extract("path", "/part=([^/]*)/", 1))


def _joined(t: Tables, **options):
    """The findings of some large files, each read by many tasks."""
    root = _folder(t, t["files"].where(~F.contains("path", F.lit("node_modules"))).select(
        F.right("repo", F.lit(1)).alias("part"), "path", "content"))
    conf, name = t.spark.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(name)
    size = t.spark.read.format("binaryFile").load(root).agg(F.sum("length")).first()[0] or 0
    conf.set(name, str(max(RANGE, size // RANGES)))
    try:
        rows = scan_large(t.spark, root, **options)
    finally:
        conf.set(name, before)
    return rows.withColumn("repo", F.lit("all")).withColumn("path", _part())


@query(f"""{_LARGE} SELECT repo, path, line, col0 + 1 AS "column", pos, rule_id,
      {D.redact('secret_raw')} AS secret FROM found""")
def scan_large_files(t: Tables):
    """Line numbers of files that no row and no task holds whole."""
    return _joined(t, context_lines=0).select(
        "repo", "path", "line", "column", "pos", "rule_id", "secret")


@query(f"""{_LARGE}, lines AS (SELECT path, unnest(l) AS content, generate_subscripts(l, 1) AS line
      FROM (SELECT path, string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') AS l
            FROM joined))
    SELECT f.path, f.line, f.pos, l.line AS at,
           replace(l.content, f.secret_raw, {D.redact('f.secret_raw')}) AS content
    FROM found f JOIN lines l ON f.path = l.path AND l.line BETWEEN f.line - 2 AND f.line + 2""")
def scan_large_context(t: Tables):
    """Context lines of large files, also across the ends of ranges."""
    return _joined(t, context_lines=2, hide="own").select(
        "path", "line", "pos", F.explode("context").alias("c")).select(
        "path", "line", "pos", F.col("c.line").alias("at"), "c.content")


# --- files with very many findings ---------------------------------------------------------------

CROWDED = 1 << 20  # bytes up to which such a file is one row


@query(f"""{w('files')}, joined AS (SELECT 'all' AS repo, 'part' || right(repo, 1) AS path,
      string_agg(content, '' ORDER BY path) AS content FROM files
      WHERE repo LIKE '%7' OR repo LIKE '%8' GROUP BY 2), {D.findings_ctes('joined')},
    lines AS (SELECT path, unnest(l) AS content, generate_subscripts(l, 1) AS nr
      FROM (SELECT path, string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') AS l
            FROM joined)),
    shown AS (SELECT DISTINCT l.path, nr, content FROM found f JOIN lines l
              ON f.path = l.path AND nr BETWEEN line - 1 AND line + 1),
    secrets AS (SELECT DISTINCT path, secret_raw AS raw, {D.redact('secret_raw')} AS red FROM found),
    held AS (SELECT s.path, nr, list(struct_pack(n := length(raw), raw := raw, red := red)
                                     ORDER BY length(raw) DESC, raw DESC, red DESC) AS held
             FROM shown s JOIN secrets x ON s.path = x.path AND contains(content, raw) GROUP BY ALL),
    clean AS (SELECT path, nr, content, 0 AS step FROM shown UNION ALL
              SELECT c.path, c.nr, replace(content, held[step + 1].raw, held[step + 1].red), step + 1
              FROM clean c JOIN held h ON c.path = h.path AND c.nr = h.nr
              WHERE step < len(held)),
    last AS (SELECT path, nr, arg_max(content, step) AS content FROM clean GROUP BY ALL)
    SELECT f.path, f.line, f.pos, nr, content FROM found f JOIN last l
    ON f.path = l.path AND nr BETWEEN line - 1 AND line + 1""")
def scan_crowded_context(t: Tables):
    """All secrets hidden in the contexts of files that hold thousands of them."""
    root = _folder(t, t["files"].where("repo like '%7' or repo like '%8'").select(
        F.right("repo", F.lit(1)).alias("part"), "path", "content"))
    return scan_tree(t.spark, root, whole=CROWDED, context_lines=1).select(
        _part().alias("path"), F.col("line").cast("int").alias("line"), "pos",
        F.explode("context").alias("c")).select(
        "path", "line", "pos", F.col("c.line").alias("nr"), "c.content")


# --- the commit graph -------------------------------------------------------------------------------

_GRAPH = w("commits", "tips", "graph_versions")
_REACH = """,
    link AS (SELECT repo, commit, unnest(parents) AS parent FROM commits),
    reach AS (SELECT repo, commit FROM tips WHERE branch = '{branch}' UNION
              SELECT l.repo, l.parent FROM reach r JOIN link l
              ON r.repo = l.repo AND r.commit = l.commit),
    inside AS (SELECT v.* FROM graph_versions v JOIN reach r
               ON v.repo = r.repo AND v.commit = r.commit),
    touch AS (SELECT repo, path, commit, change FROM inside UNION ALL
              SELECT repo, old_path, commit, 'D' FROM inside
              WHERE change = 'R' AND old_path <> path),
    older AS (SELECT repo, commit, parent AS old FROM link UNION
              SELECT o.repo, o.commit, l.parent FROM older o JOIN link l
              ON o.repo = l.repo AND o.old = l.commit),
    heads AS (SELECT repo, path, commit FROM touch t WHERE change <> 'D' AND NOT EXISTS (
              SELECT 1 FROM touch u JOIN older o ON u.repo = o.repo AND u.commit = o.commit
              WHERE u.repo = t.repo AND u.path = t.path AND o.old = t.commit)),
    tree AS (SELECT v.* FROM inside v JOIN heads h
             ON v.repo = h.repo AND v.commit = h.commit AND v.path = h.path),
    live AS (SELECT * FROM inside WHERE change <> 'D'), """
_KEY = "repo, commit, path"
_SELECT = 'SELECT repo, commit, path, line, col0 + 1 AS "column", rule_id FROM found'


def _graph(branch: str, table: str, select: str = _SELECT) -> str:
    return (f"{_GRAPH}{_REACH.format(branch=branch)}{D.findings_ctes(table, _KEY)} {select}")


def _tips(t: Tables, branch: str):
    return t["tips"].where(F.col("branch") == branch)


@query(f"""{_GRAPH}{_REACH.format(branch='main').rstrip().rstrip(',')}
    SELECT repo, commit, path FROM heads""")
def graph_heads(t: Tables):
    """The files of a branch, with what merges brought in; time stamps play no part."""
    return V.graph_heads(t["graph_versions"], t["commits"], _tips(t, "main"))


@query(_graph("main", "tree"))
def scan_graph_tree(t: Tables):
    return H.scan_graph_tree(t["graph_versions"], t["commits"], _tips(t, "main")).select(
        "repo", "commit", "path", "line", "column", "rule_id")


@query(_graph("topic", "tree"))
def scan_graph_topic_tree(t: Tables):
    return H.scan_graph_tree(t["graph_versions"], t["commits"], _tips(t, "topic")).select(
        "repo", "commit", "path", "line", "column", "rule_id")


@query(_graph("main", "live", "SELECT repo, rule_id, count(*) AS n FROM found GROUP BY ALL"))
def scan_graph_history(t: Tables):
    """All that was ever committed to a branch or came to it by a merge."""
    return H.scan_graph_branch(t["graph_versions"], t["commits"], _tips(t, "main")).groupBy(
        "repo", "rule_id").agg(F.count("*").alias("n"))


@query(f"""{w('versions')} SELECT count(DISTINCT sha256(content)) AS n_contents
    FROM versions WHERE change <> 'D'""")
def history_contents(t: Tables):
    """What a history scan reads: contents, not versions."""
    kept = t["versions"].where("change <> 'D'").withColumn("digest", F.sha2("content", 256))
    return H.contents(kept).agg(F.count("*").alias("n_contents"))
