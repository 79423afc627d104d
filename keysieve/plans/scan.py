"""Files -> findings: the whole scan as one plan.

Files are split, searched and cut down to their candidate lines inside the row, so
no line is shuffled.  Only matches are: once, by file and line, to be resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.functions.text import redact
from keysieve.operators.detect import candidates_sql, detect, gate_sql
from keysieve.operators.resolve import resolve
from keysieve.sources.files import (
    WHOLE, line_ranges, line_text, read_lines, read_tree, scannable, split_lines, text_files,
)
from keysieve.sources.rules import RuleSet, load_rules
from keysieve.workspace import stored


ID_KEY = "keysieve"
PIECE = 10_000  # lines of a file that are searched together


def candidate_lines(files: DataFrame, rules: RuleSet, context_lines: int = 0) -> DataFrame:
    """(…, content) -> (…, line, text, cand, around) for lines worth a closer look.

    ``around`` holds the neighbouring lines.  It is cut here because the file is at
    hand; later it would take a join with all lines of the corpus.
    """
    kept = [c for c in files.columns if c != "content"]
    # most files without a secret are not even split; this is no filter, because one
    # would be pushed below the projection that yields the content and repeat it
    gate = F.expr(gate_sql("content", rules, stops=" \\n"))
    whole = files.select(*kept, F.when(gate, split_lines(F.col("content"))).alias("lines_"))
    # Each piece with the lines before and behind it that contexts may show, so that the hits
    # of a long file never stand in one row together.
    n = context_lines
    pieces = f"""if(lines_ is null, null, transform(sequence(0, size(lines_) - 1, {PIECE}),
        at -> struct(at, greatest(at - {n}, 0) as skip,
                     slice(lines_, greatest(at - {n}, 0) + 1, {PIECE + n} + least(at, {n})) as lines)))"""
    hits = f"""filter(transform(filter(
        transform(piece_.lines, (text, i) -> struct(piece_.skip + i + 1 as line, text as text)),
        x -> x.line > piece_.at and x.line <= piece_.at + {PIECE} and {gate_sql('x.text', rules)}),
        x -> struct(x.line, x.text, {candidates_sql('x.text', rules)} as cand)),
        x -> size(x.cand) > 0)"""
    if n > 0:
        hits = f"""transform({hits}, x -> struct(x.line, x.text, x.cand, transform(
            slice(piece_.lines, greatest(x.line - {n}, 1) - piece_.skip,
                  {n + 1} + least({n}, x.line - 1)),
            (c, i) -> struct(greatest(x.line - {n}, 1) + i as line, c as content,
                             greatest(x.line - {n}, 1) + i = x.line as is_match)) as around))"""
    # outer, so that the optimizer does not search every file twice to test for hits
    names = [f"`{c}`" for c in kept]
    return (whole.selectExpr(*names, f"explode_outer({pieces}) as piece_")
            .selectExpr(*names, f"explode_outer({hits}) as hit_")
            .selectExpr(*names, "hit_.*").where("line is not null"))


def scan_files(
    files: DataFrame,
    rules: RuleSet | None = None,
    context_lines: int = 3,
    redacted: bool = True,
    hide: str = "all",
    only=None,
    exclude=None,
    filter_paths: bool = True,
    keep_raw: bool = False,
    id_key: str = ID_KEY,
    crowded: bool = False,
) -> DataFrame:
    """Findings of a table of files.

    ``files`` has ``path``, ``content`` and any columns that come with the file, such
    as ``repo``; together they identify the file.  ``hide`` says which secrets are
    blotted out of the context lines: "own" (of the finding itself) or "all" (of every
    finding in the file).  The raw secret is dropped unless ``keep_raw`` asks for it.
    ``secret_id`` is a digest keyed with ``id_key``: set one of your own, or short secrets
    can be looked up.  ``crowded`` says that files may have very many findings: hiding all
    secrets then stores the findings and brings those of such files together piece by piece,
    where the plain plan, for files of ordinary size, has one group per file.
    """
    rules = (rules or load_rules()).subset(only, exclude)
    if filter_paths:
        files = files.where(scannable(F.col("path")))
    key = [c for c in files.columns if c != "content"] + ["line"]
    lines = candidate_lines(files, rules, context_lines)
    carry = ["around"] if context_lines > 0 else []
    found = resolve(detect(lines, rules), key, carry)

    return _shown(found, key, context_lines, redacted, hide, keep_raw, id_key, crowded)


def _shown(found: DataFrame, key: list[str], context_lines: int, redacted: bool = True,
           hide: str = "all", keep_raw: bool = False, id_key: str = ID_KEY,
           crowded: bool = True) -> DataFrame:
    """Findings as they are reported: secrets redacted and hidden in the context."""
    shown = redact(F.col("secret_raw")) if redacted else F.col("secret_raw")
    found = (
        found.withColumn("column", F.col("col0") + 1)
        .withColumn("matched", redact(F.col("matched")) if redacted else F.col("matched"))
        .withColumn("secret", shown)
        .withColumn("secret_id", F.sha2(F.concat(F.lit(id_key + ":"), "secret_raw"), 256))
    )
    if context_lines > 0:
        found = found.withColumn("context", _blot(
            F.col("around"), F.col("secret_raw"), F.col("secret")))
        if redacted and hide == "all":
            hidden = _blot_any if crowded else _blot_all
            found = hidden(found, [c for c in key if c != "line"])
    out = key + ["column", "pos", "rule_id", "rule_name", "matched", "secret", "secret_id"]
    if context_lines > 0:
        out.append("context")
    if keep_raw:
        out.append("secret_raw")
    return found.select(*out)


def _blot(context: Column, secret: Column, shown: Column) -> Column:
    return F.transform(context, lambda c: F.struct(
        c["line"].alias("line"),
        F.replace(c["content"], secret, shown).alias("content"),
        c["is_match"].alias("is_match")))


MANY = 1000  # findings of a file that may meet in one group
GRAM = 8  # characters of a secret by which it is looked up in a line


def _blot_all(found: DataFrame, file_key: list[str]) -> DataFrame:
    """Blot out of each context all secrets found anywhere in the file, the longest first.

    One pass: the findings of a file meet once, shuffled by file.
    """
    secret = F.struct(F.length("secret_raw").alias("n"), "secret_raw", "secret")
    everywhere = F.sort_array(F.collect_set(secret).over(W.partitionBy(*file_key)), asc=False)
    return found.withColumn("all_", everywhere).withColumn("context", F.transform(
        "around", lambda c: F.struct(
            c["line"].alias("line"), _without(c["content"], F.col("all_")).alias("content"),
            c["is_match"].alias("is_match")))).drop("all_")


def _blot_any(found: DataFrame, file_key: list[str]) -> DataFrame:
    """The same, however many findings a file has.

    The findings of a file meet in one group while they are ``MANY`` at most.  In files with
    more, secrets and context lines meet by substrings instead, so no group grows with a file.
    """
    found = stored(found, "found")
    crowded = stored(found.groupBy(*file_key).agg(F.count("*").alias("n_")).where(
        F.col("n_") > MANY).select(*file_key), "crowded")
    if crowded.isEmpty():
        return _blot_all(found, file_key)
    few = _blot_all(found.join(crowded, file_key, "left_anti"), file_key)
    return few.unionByName(_blot_crowded(
        found.join(crowded, file_key, "left_semi"), file_key))


def _without(content: Column, secrets: Column) -> Column:
    """The line with those of the secrets it holds replaced, in their order."""
    return F.aggregate(F.filter(secrets, lambda s: F.contains(content, s["secret_raw"])), content,
                       lambda text, s: F.replace(text, s["secret_raw"], s["secret"]))


def _blot_crowded(found: DataFrame, file_key: list[str]) -> DataFrame:
    """The same for files with any number of findings.

    Each secret is looked up by its ``GRAM`` characters that the fewest secrets of the file
    have (all of a shorter one), among those of the context lines.
    """
    secrets = found.select(*file_key, "secret_raw", "secret").distinct().withColumn(
        "size", F.least(F.length("secret_raw"), F.lit(GRAM)))
    grams = secrets.select("*", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("secret_raw") - F.col("size") + 1),
        lambda i: F.substring(F.col("secret_raw"), i, F.col("size"))))).alias("gram"))
    shared = grams.groupBy(*file_key, "gram").agg(F.count("*").alias("n_"))
    names = stored(grams.join(shared, [*file_key, "gram"]).groupBy(
        *file_key, "secret_raw", "secret", "size").agg(
        F.min_by("gram", F.struct("n_", "gram")).alias("gram")), "secrets")
    sizes = stored(names.select(*file_key, "size").distinct(), "sizes")  # eight a file at most

    spots = found.select(*file_key, "line", "pos", F.explode("around").alias("c")).select(
        *file_key, "line", "pos", F.col("c.line").alias("at"), "c.content", "c.is_match")
    # an equal line is the same line, whichever finding shows it
    lines = stored(spots.groupBy(*file_key, "at").agg(F.first("content").alias("content")), "lines")
    parts = lines.join(sizes, file_key).select(*file_key, "at", "content", F.explode(
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("content") - F.col("size") + 1, F.lit(1))),
            lambda i: F.substring(F.col("content"), i, F.col("size"))))).alias("gram"))
    hits = parts.join(names, [*file_key, "gram"]).where(F.contains("content", "secret_raw"))
    held = hits.groupBy(*file_key, "at").agg(F.sort_array(F.collect_set(F.struct(
        F.length("secret_raw").alias("n"), "secret_raw", "secret")), asc=False).alias("all_"))
    clean = lines.join(held, [*file_key, "at"], "left").select(
        *file_key, "at", F.coalesce(_without(F.col("content"), F.col("all_")), "content").alias(
            "content"))
    contexts = spots.drop("content").join(clean, [*file_key, "at"]).groupBy(
        *file_key, "line", "pos").agg(F.sort_array(F.collect_list(F.struct(
            F.col("at").alias("line"), "content", "is_match"))).alias("context"))
    return found.drop("context").join(contexts, [*file_key, "line", "pos"])


# --- files of any length ------------------------------------------------------------------

CELL = 4096  # lines; a wanted line and the range that holds it meet by cells


def scan_large(spark: SparkSession, root: str, rules: RuleSet | None = None,
               context_lines: int = 3, over: int = -1, path_glob: str | None = None,
               only=None, exclude=None, **shown) -> DataFrame:
    """Findings of the files below ``root`` that have more than ``over`` bytes.

    A file is read in byte ranges by many tasks, and no row holds more than a line.  Line
    numbers are restored from the counts of the ranges.  The context is fetched afterwards:
    only lines next to a finding are looked up again.
    """
    rules = (rules or load_rules()).subset(only, exclude)
    # read once: a range's ids must stay as they are
    lines = stored(read_lines(spark, root, path_glob, over), "lines")
    ranges = stored(line_ranges(lines), "line-ranges").where("text").drop("text")

    near = lines.where(F.expr(gate_sql("text", rules))).join(ranges, ["path", "start"])
    line = F.col("base") + F.col("id") - F.col("first") + 1
    clean = line_text(F.col("text"), line, F.col("total"), F.col("marked"), F.col("open"))
    # exploded, so that the candidates are not computed from the text's expression, many times
    numbered = near.select("path", F.explode(F.array(F.struct(
        line.alias("line"), clean.alias("text")))).alias("l")).select("path", "l.*")
    cands = numbered.withColumn("cand", F.expr(candidates_sql("text", rules)))
    found = resolve(detect(cands, rules), ["path", "line"])
    if context_lines > 0:
        found = stored(found, "found")
        found = found.join(_around(found, lines, ranges, context_lines), ["path", "line"])
    return _shown(found, ["path", "line"], context_lines, **shown)


def _around(found: DataFrame, lines: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """path, line, around: the lines around each line with a finding."""
    spots = found.select("path", "line").distinct().select("path", "line", F.explode(
        F.sequence(F.greatest(F.col("line") - n, F.lit(1)), F.col("line") + n)).alias("at"))
    wanted = spots.select("path", "at").distinct().withColumn(
        "cell", F.floor(F.col("at") / CELL))
    cells = ranges.where("n > 0").withColumn("cell", F.explode(F.sequence(
        F.floor((F.col("base") + 1) / CELL), F.floor((F.col("base") + F.col("n")) / CELL))))
    places = wanted.join(cells, ["path", "cell"]).where("at > base and at <= base + n").select(
        "path", "start", (F.col("first") + F.col("at") - F.col("base") - 1).alias("id"),
        "at", "total", "marked", "open")
    places = stored(places, "places")  # Spark sees how few they are
    texts = lines.select("path", "start", "id", "text").join(
        places, ["path", "start", "id"]).select(
        "path", "at", line_text(F.col("text"), F.col("at"), F.col("total"), F.col("marked"),
                                F.col("open")).alias("content"))
    return spots.join(texts, ["path", "at"]).groupBy("path", "line").agg(F.sort_array(
        F.collect_list(F.struct(F.col("at").cast("int").alias("line"), "content",
                                (F.col("at") == F.col("line")).alias("is_match")))
        ).alias("around"))


def scan_tree(spark: SparkSession, root: str, rules: RuleSet | None = None, whole: int = WHOLE,
              path_glob: str | None = None, **options) -> DataFrame:
    """Findings of all files below ``root``: those of up to ``whole`` bytes in one row each,
    larger ones in byte ranges.  Both give the same findings for the same file."""
    small = scan_files(text_files(read_tree(spark, root, path_glob, up_to=whole)), rules,
                       filter_paths=False, crowded=True, **options)
    return small.withColumn("line", F.col("line").cast("long")).unionByName(
        scan_large(spark, root, rules, over=whole, path_glob=path_glob, **options))
