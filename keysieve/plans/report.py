"""Findings -> summaries and report documents.

``by`` names the columns that identify a scan (or a repository, or nothing at all for
the whole table).  Every summary first counts by rule, so that a scan that holds most
of the findings is reduced in each task before anything is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.functions.identity import category, is_high, is_medium
from keysieve.operators.skew import numbered
from keysieve.sources.reports import SCANNER
from keysieve.workspace import dropped, shuffles_dropped, stored, workspace

VERSION = "0.1.0"
SARIF_SCHEMA = ("https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/"
                "Schemata/sarif-schema-2.1.0.json")
SHOWN = 50  # findings listed when the output is not a terminal


def by_rule(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    return findings.groupBy(*by, "rule_id").agg(F.count("*").alias("findings"))


def by_category(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    return by_rule(findings, by).groupBy(*by, category(F.col("rule_id")).alias("category")).agg(
        F.sum("findings").alias("findings"))


def totals(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Findings, distinct rules and the severity counts.

    A rule can be high and medium at once; it then counts as both, and "low" is what
    the two counts leave of the total.
    """
    n, rule = F.col("findings"), F.col("rule_id")
    sums = by_rule(findings, by).groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_findings"),
        F.count("*").alias("unique_rules"),
        F.coalesce(F.sum(F.when(is_high(rule), n)), F.lit(0)).alias("high"),
        F.coalesce(F.sum(F.when(is_medium(rule), n)), F.lit(0)).alias("medium"),
    )
    return sums.withColumn("low", F.greatest(
        F.lit(0), F.col("total_findings") - F.col("high") - F.col("medium")))


def leak_gate(files: DataFrame, findings: DataFrame, by: str = "repo") -> DataFrame:
    """Every repository with its number of findings and whether it fails."""
    found = findings.groupBy(by).agg(F.count("*").alias("n"))
    return files.select(by).distinct().join(found, by, "left").select(
        by, F.coalesce("n", F.lit(0)).alias("findings"), (F.coalesce("n", F.lit(0)) > 0).alias("failed"))


def listing(findings: DataFrame, order: list, shown: int = SHOWN) -> DataFrame:
    """The findings a short listing shows; the total belongs to ``totals``."""
    return findings.orderBy(*order).limit(shown)


def numbered_findings(findings: DataFrame, by: list[str]) -> DataFrame:
    return numbered(findings, by)


# --- documents -----------------------------------------------------------------------


SALTS = 64


def _parts(rows: DataFrame, by: list[str], at_most: int) -> DataFrame:
    """Deal the rows of each scan over documents of about ``at_most`` rows.

    Nearly all scans fit one document.  One that does not would be too large for a
    single row, so it becomes several, and none of its findings is left out.  The table
    of large scans has one row in ``at_most`` or fewer; repeating it ``SALTS`` times
    lets the findings of one scan be looked up in as many tasks.
    """
    large = rows.groupBy(*by).agg(F.count("*").alias("n_")).where(F.col("n_") > at_most).select(
        *by, F.ceil(F.col("n_") / at_most).alias("parts"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt_"))
    place = F.xxhash64("path", "line", "pos", "rule_id")
    salted = rows.withColumn("salt_", F.pmod(place, F.lit(SALTS)))
    return salted.join(large, [*by, "salt_"], "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64("rule_id", "path", "line", "pos"), F.col("parts")) + 1
    ).drop("salt_")


def _document(rows: DataFrame, by: list[str], item: Column, at_most: int) -> DataFrame:
    """(by, part, parts, items): the items of each document in file order."""
    dealt = _parts(rows, by, at_most).select(
        *by, "part", "parts", F.struct("path", "line", "pos", item.alias("item")).alias("e"))
    return dealt.groupBy(*by, "part", "parts").agg(
        F.transform(F.array_sort(F.collect_list("e")), lambda e: e["item"]).alias("items"))


def _with_clean(items: DataFrame, scans: DataFrame | None, by: list[str]) -> DataFrame:
    """Also an empty document for each of ``scans`` that has no finding."""
    if scans is None:
        return items
    clean = scans.select(*by).distinct().join(items.select(*by).distinct(), by, "left_anti")
    one = F.lit(1).cast("bigint")
    return items.unionByName(clean.select(
        *by, one.alias("part"), one.alias("parts"),
        F.array().cast(items.schema["items"].dataType).alias("items")))


def _json_item() -> Column:
    return F.struct("rule_id", "rule_name", F.col("path").alias("file"), "line", "column",
                    "secret", "context")


def _sarif_item() -> Column:
    place = F.struct(
        F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")
                 ).alias("region"))
    return F.struct(
        F.col("rule_id").alias("ruleId"), F.lit("error").alias("level"),
        F.struct(F.concat(F.lit("Potential "), "rule_name", F.lit(" detected")).alias("text")
                 ).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))


def json_documents(findings: DataFrame, by: list[str], at_most: int = 10_000,
                   scans: DataFrame | None = None) -> DataFrame:
    """One JSON document of findings per scan; of all ``scans``, if given."""
    item = _json_item()
    doc = F.struct(F.lit("1.0").alias("version"), F.lit(SCANNER).alias("scanner"),
                   F.col("items").alias("findings"))
    return _with_clean(_document(findings, by, item, at_most), scans, by).select(
        *by, "part", "parts", F.to_json(doc).alias("document"))


def sarif_documents(findings: DataFrame, by: list[str], at_most: int = 10_000,
                    scans: DataFrame | None = None) -> DataFrame:
    """One SARIF 2.1.0 log per scan; of all ``scans``, if given."""
    driver = F.struct(F.lit(SCANNER).alias("name"), F.lit(VERSION).alias("version"),
                      F.array().cast("array<string>").alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("items").alias("results"))
    doc = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"),
                   F.array(run).alias("runs"))
    return _with_clean(_document(findings, by, _sarif_item(), at_most), scans, by).select(
        *by, "part", "parts", F.to_json(doc).alias("document"))


def summaries(findings: DataFrame, by: list[str]) -> DataFrame:
    """The whole summary of each scan, out of one list of its counts by rule.

    The list has at most one entry per rule, so the rest is arithmetic inside a row.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col("findings").alias("n"), "rule_id")),
                         asc=False)
    rows = by_rule(findings, by).groupBy(*by).agg(pairs.alias("pairs"))

    def added(test: Column | None = None) -> Column:
        chosen = F.col("pairs") if test is None else F.filter("pairs", test)
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda total, p: total + p["n"])

    categories = F.array_distinct(F.transform("pairs", lambda p: category(p["rule_id"])))
    by_category = F.sort_array(F.transform(categories, lambda c: F.struct(
        added(lambda p: category(p["rule_id"]) == c).alias("n"), c.alias("category"))), asc=False)
    counted = rows.select(
        *by, added().alias("total_findings"),
        F.size("pairs").cast("bigint").alias("unique_rules"),
        added(lambda p: is_high(p["rule_id"])).alias("high"),
        added(lambda p: is_medium(p["rule_id"])).alias("medium"),
        F.map_from_entries(F.transform("pairs", lambda p: F.struct(p["rule_id"], p["n"]))
                           ).alias("by_rule"),
        F.map_from_entries(F.transform(by_category, lambda c: F.struct(c["category"], c["n"]))
                           ).alias("by_category"))
    return counted.withColumn("low", F.greatest(
        F.lit(0), F.col("total_findings") - F.col("high") - F.col("medium")))


def _verification() -> Column:
    return F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("verified_at"),
                    F.lit(None).cast("boolean").alias("is_active")).alias("verification")


def _report_item() -> Column:
    return F.struct(
        "id", "rule_id", "rule_name",
        F.struct(F.col("path").alias("file"), "line", "column").alias("location"),
        F.col("secret").alias("secret_preview"), "context", _verification())


def _report_head() -> list[Column]:
    """What a report has besides its findings, from a scan and its summary."""
    none, zero = F.create_map().cast("map<string,bigint>"), F.lit(0)
    summary = F.struct(
        F.coalesce("total_findings", zero).alias("total_findings"),
        F.coalesce("unique_rules", zero).alias("unique_rules_triggered"),
        F.coalesce("by_rule", none).alias("findings_by_rule"),
        F.coalesce("by_category", none).alias("findings_by_category"),
        F.struct(F.coalesce("high", zero).alias("high"), F.coalesce("medium", zero).alias("medium"),
                 F.coalesce("low", zero).alias("low")).alias("severity_breakdown"))
    target = F.struct("path", "type", "git_branch", "git_commit", "git_remote", "scan_duration_ms")
    return [F.lit("2.0").alias("report_version"), F.lit(SCANNER).alias("scanner"),
            F.lit(VERSION).alias("scanner_version"), F.col("timestamp"), F.col("scan_id"),
            target.alias("target"), summary.alias("summary")]


def report_documents(findings: DataFrame, scans: DataFrame, at_most: int = 10_000) -> DataFrame:
    """One version 2.0 report per scan, with its target and summary.

    ``scans`` has scan_id, timestamp (text), path, type, git_branch, git_commit,
    git_remote and scan_duration_ms; scans without findings get a report as well.
    ``findings`` is read several times: give a stored table, not a scan to be repeated.
    """
    by = ["scan_id"]
    ids = numbered_findings(findings, by)
    items = _document(ids, by, _report_item(), at_most)

    # a row per document, so that a scan of many documents is not one key of the join
    n = F.greatest(F.ceil(F.coalesce("total_findings", F.lit(0)) / at_most), F.lit(1))
    heads = scans.join(summaries(findings, by), by, "left").withColumn("parts", n).withColumn(
        "part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("parts"))))
    full = heads.join(items.drop("parts"), [*by, "part"], "left")
    doc = F.struct(*_report_head(), F.col("items").alias("findings"))
    filled = full.withColumn("items", F.coalesce("items", F.array().cast(
        full.schema["items"].dataType)))
    return filled.select(
        "scan_id", "part", "parts", F.to_json(doc, _NULLS).alias("document"))


def write_documents(documents: DataFrame, path: str, by: list[str]) -> None:
    """Documents as text files, one folder per scan."""
    documents.select(*by, "document").write.mode("append").partitionBy(*by).text(path)


# --- documents of any size ----------------------------------------------------------------

TAIL = 1 << 62  # behind every item
_NULLS = {"ignoreNullFields": "false"}


_SARIF = ["path", "line", "column", "pos", "rule_id", "rule_name"]  # what items show or sort by
_JSON = [*_SARIF, "secret", "context"]


def _rows(findings: DataFrame, by: list[str], shown: list[str], item: Column, heads: DataFrame,
          tail: str, options: dict) -> DataFrame:
    """(by, nth, text): the opening texts of ``heads`` (by, text), the items, what closes them."""
    numbered_ = numbered_findings(findings.select(*dict.fromkeys([*by, *shown])), by)
    items = numbered_.select(*by, F.col("id").alias("nth"), F.concat(
        F.when(F.col("id") > 1, ",").otherwise(""), F.to_json(item, options)).alias("text"))
    first = heads.select(*by, F.lit(0).cast("long").alias("nth"), "text")
    tails = heads.select(*by, F.lit(TAIL).alias("nth"), F.lit(tail).alias("text"))
    return first.unionByName(items).unionByName(tails)


def _of_all(findings: DataFrame, scans: DataFrame | None, by: list[str]) -> DataFrame:
    known = findings.select(*by) if scans is None else findings.select(*by).unionByName(
        scans.select(*by))
    return known.distinct()


def json_rows(findings: DataFrame, by: list[str], scans: DataFrame | None = None) -> DataFrame:
    """``json_documents`` of any size, as rows: see ``report_rows``."""
    head = json.dumps({"version": "1.0", "scanner": SCANNER, "findings": []})[:-2]
    heads = _of_all(findings, scans, by).withColumn("text", F.lit(head))
    return _rows(findings, by, _JSON, _json_item(), heads, "]}", {})


def sarif_rows(findings: DataFrame, by: list[str], scans: DataFrame | None = None) -> DataFrame:
    """``sarif_documents`` of any size, as rows: see ``report_rows``."""
    driver = {"name": SCANNER, "version": VERSION, "rules": []}
    head = json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0",
                       "runs": [{"tool": {"driver": driver}, "results": []}]})[:-4]
    heads = _of_all(findings, scans, by).withColumn("text", F.lit(head))
    return _rows(findings, by, _SARIF, _sarif_item(), heads, "]}]}", {})


def report_rows(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """The version 2.0 reports of all scans as rows (scan_id, nth, text).

    A report is the texts of its scan in the order of ``nth``: one row opens it, each finding
    is a row, and one row closes it, whether there are none or millions of them.
    """
    by = ["scan_id"]
    opened = F.to_json(F.struct(*_report_head()), _NULLS)
    heads = scans.join(summaries(findings, by), by, "left").select(
        "scan_id", F.concat(F.left(opened, F.length(opened) - 1), F.lit(',"findings":[')).alias(
            "text"))
    return _rows(findings, by, _JSON, _report_item(), heads, "]}", _NULLS)


def write_rows(rows: DataFrame, path: str, by: tuple = ("scan_id",)) -> None:
    """Documents as sorted lines of text, and an index of them.

    Files hold ranges of (by, nth), so a document is a stretch of lines of one file, or of
    files that follow each other, and a large one is written by many tasks.  ``index`` tells of
    each document in which files (``part``) it is, from which line on, and how many lines.
    """
    spark = rows.sparkSession
    home = workspace(spark, "ranges")
    with shuffles_dropped(spark):
        rows.repartitionByRange(*by, "nth").withColumn(
            "part", F.spark_partition_id()).write.parquet(home)
        ranged = spark.read.parquet(home)
        sorted_ = ranged.repartition("part").sortWithinPartitions("part", *by, "nth")
        sorted_.select("part", "text").write.partitionBy("part").text(f"{path}/lines")
        here = ranged.groupBy("part", *by).agg(F.count("*").alias("lines"))
        before = F.sum("lines").over(W.partitionBy("part").orderBy(*by).rowsBetween(
            W.unboundedPreceding, -1))
        here.select(*by, "part", (F.coalesce(before, F.lit(0)) + 1).alias("line"),
                    "lines").write.parquet(f"{path}/index")
    dropped(spark, home)


def read_rows(spark: SparkSession, path: str, by: tuple = ("scan_id",)) -> DataFrame:
    """(by), part, line, text: the lines of the documents, by the index."""
    lines = spark.read.text(f"{path}/lines").select(
        F.col("part").cast("int"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    lines = stored(lines, "lines")
    ranges = lines.groupBy("part", "file", "start").agg(
        F.min("id").alias("first"), F.count("*").alias("n"))
    of_part = W.partitionBy("part").orderBy("file", "start").rowsBetween(
        W.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(of_part), F.lit(0))).drop("n")
    numbered_ = lines.join(ranges, ["part", "file", "start"]).select(
        "part", (F.col("base") + F.col("id") - F.col("first") + 1).alias("line"), "text")
    starts = spark.read.parquet(f"{path}/index").select(
        "part", "line", F.lit(None).cast("string").alias("text"), F.struct(*by).alias("document_"))
    # each line belongs to the last document that begins in its part before it
    known = numbered_.withColumn("document_", F.lit(None).cast(starts.schema["document_"].dataType))
    first = F.col("document_").isNull()  # documents before the lines they begin with
    return known.withColumn("text_", F.lit(True)).unionByName(
        starts.withColumn("text_", F.lit(False))).withColumn(
        "document_", F.last("document_", ignorenulls=True).over(
            W.partitionBy("part").orderBy("line", first))).where("text_").select(
        "document_.*", "part", "line", "text")
