"""Scanner reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.identity import finding_status, is_verified, verified_status
from keysieve.functions.text import strip_ansi

SCANNER = "keysieve"

_CONTEXT = "array<struct<line: int, content: string, is_match: boolean>>"
_FINDING = f"""struct<
    rule_id: string, rule_name: string, file: string, line: int, column: int,
    location: struct<file: string, line: int, column: int>,
    secret: string, secret_preview: string, context: {_CONTEXT},
    verification: struct<status: string, message: string>,
    verification_status: struct<status: string, message: string>>"""
# every shape of report; ``target`` is text or an object, so it is read as text
REPORT_SCHEMA = f"""struct<
    report_version: string, version: string, scanner: string, scanner_version: string,
    timestamp: string, scan_id: string, target: string,
    summary: struct<total_findings: int>,
    findings: array<{_FINDING}>, report: struct<findings: array<{_FINDING}>>>"""
TARGET_SCHEMA = """struct<path: string, type: string, git_branch: string, git_commit: string,
    git_remote: string, scan_duration_ms: bigint>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, document): whole report files."""
    return spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))


def parse_reports(documents: DataFrame, scanner: str = SCANNER) -> DataFrame:
    """(file, document) -> one row per report; what is no report is skipped.

    ``format`` says how a report is imported: "enhanced" (version 2.0 of our own),
    "simple", or null when it only counts for the statistics.
    """
    r = documents.select("file", F.from_json("document", REPORT_SCHEMA).alias("r")).select(
        "file", "r.*")
    own = F.coalesce(F.col("scanner") == scanner, F.lit(False))
    plain = F.col("findings").isNotNull() & F.col("version").isNotNull()
    return (
        r.withColumn("format", F.when(own & (F.col("report_version") == "2.0"), "enhanced")
                     .when(own | plain, "simple"))
        .withColumn("findings", F.coalesce("findings", "report.findings"))
        .where(F.col("findings").isNotNull())
        .withColumn("target_object", F.when(
            F.col("target").startswith("{"), F.from_json("target", TARGET_SCHEMA)))
        .withColumn("n_findings", F.size("findings"))
        .drop("report")
    )


def report_findings(reports: DataFrame) -> DataFrame:
    """All findings of all reports, with one status whichever field held it."""
    f = reports.select("file", F.explode("findings").alias("f"))
    return f.select(
        F.col("file").alias("report"), "f.rule_id", "f.rule_name",
        F.coalesce("f.location.file", "f.file", F.lit("")).alias("file_path"),
        F.coalesce("f.location.line", "f.line", F.lit(0)).alias("line_number"),
        F.coalesce("f.secret_preview", "f.secret", F.lit("")).alias("secret_preview"),
        F.lower(finding_status(F.col("f.verification_status"), F.col("f.verification"))
                ).alias("status"),
    )


def parse_scanner_json(outputs: DataFrame) -> DataFrame:
    """(repo_url, document) -> queue findings of a scanner's JSON output."""
    r = outputs.select("repo_url", F.from_json("document", REPORT_SCHEMA).alias("r"))
    f = r.select("repo_url", F.explode("r.findings").alias("f"))
    status = F.coalesce("f.verification_status.status", "f.verification.status")
    return f.select(
        "repo_url", "f.rule_id", "f.rule_name",
        F.coalesce("f.location.file", "f.file").alias("file_path"),
        F.coalesce("f.location.line", "f.line", F.lit(1)).alias("line_number"),
        F.coalesce("f.secret_preview", "f.secret", F.lit("")).alias("secret_preview"),
        is_verified(status).alias("verified"), verified_status(status).alias("verification_status"),
    ).where("rule_id is not null and file_path is not null")


_HEADER = r"^[a-z0-9-]+[ \t]+[^\n]+:[0-9]+:[0-9]+$"


def parse_scanner_text(outputs: DataFrame) -> DataFrame:
    """(repo_url, document) -> queue findings of a scanner's text output.

    An output is cut before each header line, inside its row; the lines of a record
    are looked at in order and the last of a kind counts.
    """
    records = outputs.select(
        "repo_url", F.posexplode(F.split(strip_ansi(F.col("document")), f"(?m)(?={_HEADER})")
                                 ).alias("record", "block"))
    head = F.regexp_extract
    blocks = records.where(F.col("block").rlike(f"(?m)\\A{_HEADER}")).select(
        "repo_url", "record", F.split("block", "\n").alias("lines"))
    rule, secret, source = r"Rule:\s*(.+)", r"Secret:\s*(.+)", r"^>\s+[0-9]+\s\| (.+)"

    def last(pattern: str, unless=()) -> Column:
        fits = F.filter("lines", lambda x: x.rlike(pattern) & ~F.coalesce(
            *[F.when(x.rlike(u), True) for u in unless], F.lit(False)))
        return F.coalesce(head(F.try_element_at(fits, F.lit(-1)), pattern, 1), F.lit(""))

    first = F.get("lines", F.lit(0))
    parts = r"^([a-z0-9-]+)[ \t]+(.+):([0-9]+):([0-9]+)$"
    return blocks.select(
        "repo_url", "record", head(first, parts, 1).alias("rule_id"),
        head(first, parts, 2).alias("file_path"),
        head(first, parts, 3).cast("int").alias("line_number"),
        head(first, parts, 4).cast("int").alias("column_number"),
        last(rule).alias("rule_name"), last(secret, [rule]).alias("secret_preview"),
        last(source, [rule, secret]).alias("context"),
    )
