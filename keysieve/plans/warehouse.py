"""The warehouse of scans and findings, and its views.

Tables: ``scans`` (scan_id, scanner_version, timestamp, target_path, target_type,
git_remote, git_branch, git_commit, scan_duration_ms, total_findings) and ``findings``
(scan_id, rule_id, rule_name, file_path, line_number, column_number, secret_preview,
context, verification_status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.operators.skew import latest, skew_join
from keysieve.workspace import stored

SCAN_COLUMNS = [
    "scan_id", "scanner_version", "timestamp", "target_path", "target_type", "git_remote",
    "git_branch", "git_commit", "scan_duration_ms", "total_findings",
]


def import_reports(reports: DataFrame, imported_at: Column | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Parsed reports -> rows of ``scans`` and ``findings``.

    A simple report has no scan id; a digest of its file name stands in, so that an
    import that is repeated gives the same rows.
    """
    now = imported_at if imported_at is not None else F.current_timestamp()
    r = reports.where(F.col("format").isNotNull())
    rich = F.col("format") == "enhanced"
    t = F.col("target_object")
    r = r.withColumn("scan_id", F.when(rich & F.col("scan_id").isNotNull(), F.col("scan_id"))
                     .otherwise(F.md5("file")))
    scans = r.select(
        "scan_id",
        F.coalesce(F.when(rich, F.col("scanner_version")).otherwise(F.col("version")),
                   F.lit("unknown")).alias("scanner_version"),
        F.coalesce(F.when(rich, F.try_to_timestamp("timestamp")), now).alias("timestamp"),
        F.when(rich, t["path"]).otherwise(F.col("file")).alias("target_path"),
        F.when(rich, t["type"]).alias("target_type"),
        F.when(rich, t["git_remote"]).alias("git_remote"),
        F.when(rich, t["git_branch"]).alias("git_branch"),
        F.when(rich, t["git_commit"]).alias("git_commit"),
        F.when(rich, F.coalesce(t["scan_duration_ms"], F.lit(0))).alias("scan_duration_ms"),
        F.when(rich, F.coalesce("summary.total_findings", "n_findings"))
        .otherwise(F.col("n_findings")).alias("total_findings"),
    )
    f = r.select("scan_id", rich.alias("rich"), F.explode("findings").alias("f"))
    findings = f.select(
        "scan_id", "f.rule_id", "f.rule_name",
        F.coalesce(F.when(F.col("rich"), F.col("f.location.file")), "f.file", F.lit("")
                   ).alias("file_path"),
        F.coalesce(F.when(F.col("rich"), F.col("f.location.line")), "f.line", F.lit(0)
                   ).alias("line_number"),
        F.coalesce(F.when(F.col("rich"), F.col("f.location.column")), "f.column", F.lit(0)
                   ).alias("column_number"),
        F.coalesce(F.when(F.col("rich"), F.col("f.secret_preview")), "f.secret", F.lit("")
                   ).alias("secret_preview"),
        F.col("f.context").alias("context"),
        F.lower(F.coalesce(F.when(F.col("rich"), F.col("f.verification.status")),
                           F.lit("pending"))).alias("verification_status"),
    )
    return scans, findings


def upsert_scans(current: DataFrame, incoming: DataFrame, order: Column) -> DataFrame:
    """Scans by ``scan_id``; of a scan imported again only ``total_findings`` is taken."""
    newest = latest(incoming, ["scan_id"], order)
    counts = newest.select("scan_id", F.col("total_findings").alias("again_"),
                           F.lit(True).alias("known_"))
    kept = current.join(counts, "scan_id", "left").withColumn(
        "total_findings", F.when(F.col("known_"), F.col("again_")).otherwise(
            F.col("total_findings"))).select(*current.columns)
    new = newest.join(current.select("scan_id").distinct(), "scan_id", "left_anti")
    return kept.unionByName(new.select(*current.columns))


def write_scans(scans: DataFrame, path: str) -> None:
    scans.withColumn("scan_date", F.to_date("timestamp")).write.mode("append").partitionBy(
        "scan_date").parquet(path)


def write_findings(findings: DataFrame, scans: DataFrame, path: str) -> None:
    """Append findings in the partition of their scan's day, clustered by rule."""
    days = scans.select("scan_id", F.to_date("timestamp").alias("scan_date"))
    # even files whatever the days hold: a day with most of the rows is split
    (skew_join(findings, days, ["scan_id"]).hint("rebalance", "scan_date")
     .sortWithinPartitions("scan_date", "rule_id").write.mode("append").partitionBy("scan_date").parquet(path))


# --- views -----------------------------------------------------------------------------


def _repository() -> Column:
    return F.coalesce("git_remote", "target_path")


_VERIFIED = {"active": "verified_active", "inactive": "verified_inactive",
             "pending": "pending_verification"}


def _counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings, and those of each verification status."""
    return findings.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.count_if(F.col("verification_status") == v).alias(c) for v, c in _VERIFIED.items()])


def scan_summary(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scan: rules triggered and findings by verification status."""
    return _summary(scans, _counts(findings, ["scan_id", "rule_id"]))


def _summary(scans: DataFrame, per_rule: DataFrame) -> DataFrame:
    per_scan = per_rule.groupBy("scan_id").agg(
        F.count("rule_id").alias("unique_rules_triggered"),
        *[F.sum(c).alias(c) for c in _VERIFIED.values()])
    return scans.select("scan_id", "timestamp", "target_path", "git_remote", "git_branch",
                        "total_findings").join(per_scan, "scan_id", "left").fillna(
        0, ["unique_rules_triggered", "verified_active", "verified_inactive",
            "pending_verification"])


def findings_by_repo(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository and rule: how often, first and last seen."""
    return _by_repo(scans, findings.groupBy("scan_id", "rule_id", "rule_name").agg(
        F.count("*").alias("n")))


def _by_repo(scans: DataFrame, reduced: DataFrame) -> DataFrame:
    where = scans.select("scan_id", "timestamp", _repository().alias("repository"))
    return reduced.join(where, "scan_id").groupBy("repository", "rule_id", "rule_name").agg(
        F.sum("n").alias("occurrence_count"), F.max("timestamp").alias("last_seen"),
        F.min("timestamp").alias("first_seen"))


def findings_with_scans(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Each finding with its scan.  One scan may hold much of the table."""
    return skew_join(findings, scans, ["scan_id"])


def bounty_candidates(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings confirmed active, of the rules that matter most, newest first."""
    chosen = findings.where(
        (F.col("verification_status") == "active")
        & F.col("rule_id").rlike("api-key|private-key|aws|database"))
    return findings_with_scans(scans.select("scan_id", "git_remote", "timestamp"), chosen).select(
        F.col("git_remote").alias("repository"), "rule_id", "rule_name", "file_path",
        "line_number", "secret_preview", "verification_status",
        F.col("timestamp").alias("scan_timestamp")).orderBy(F.desc("scan_timestamp"))


def security_stats(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per day: scans, findings, rules and repositories.

    ``total_findings`` counts each scan once.  ``total_findings_joined`` is the sum over
    the join of scans and findings, which counts a scan once per finding.  A scan has one
    row in ``scans`` and one here, so nothing but the repositories is counted distinct.
    """
    day = _days(scans, findings.groupBy("scan_id", "rule_id").agg(F.count("*").alias("n")))
    base, repos, rules = day["days"], day["day_repos"], day["day_rules"]
    return _stats(base, repos, rules)


def _days(scans: DataFrame, per_rule: DataFrame) -> dict[str, DataFrame]:
    """Sums per day, and which repositories and rules a day has."""
    per_scan = per_rule.groupBy("scan_id").agg(F.sum("n").alias("n"))
    day = F.date_trunc("day", "timestamp").alias("scan_date")
    dated = scans.select("scan_id", day, "total_findings", _repository().alias("repository"))
    base = dated.join(per_scan, "scan_id", "left").groupBy("scan_date").agg(
        F.count("*").alias("total_scans"),
        F.sum("total_findings").alias("total_findings"),
        F.sum(F.col("total_findings") * F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
              ).alias("total_findings_joined"))
    rules = per_rule.select("scan_id", "rule_id").join(
        dated.select("scan_id", "scan_date"), "scan_id").select("scan_date", "rule_id")
    return {"days": base, "day_rules": rules.distinct(),
            "day_repos": dated.select("scan_date", "repository").distinct()}


def _stats(days: DataFrame, repos: DataFrame, rules: DataFrame) -> DataFrame:
    seen = repos.groupBy("scan_date").agg(F.count("repository").alias("unique_repos"))
    fired = rules.groupBy("scan_date").agg(F.count("rule_id").alias("unique_rules"))
    return days.join(seen, "scan_date", "left").join(fired, "scan_date", "left").fillna(
        0, ["unique_repos", "unique_rules"])


# --- views that an import brings up to date ------------------------------------------------
#
# An import leaves what the views need of it, reduced: a row per scan, per repository and rule,
# and per day.  The views fold these, so nothing but new findings is ever read.  A scan comes
# whole in one import; an import that is repeated overwrites what it has left.

STATES = ["scan_states", "repo_states", "days", "day_repos", "day_rules"]


def add_import(scans: DataFrame, findings: DataFrame, path: str, number: int) -> None:
    """Write the states of import ``number``.

    The scans and findings are read once; all states come from the counts by scan and rule.
    """
    scans = stored(scans.select("scan_id", "timestamp", "target_path", "git_remote", "git_branch",
                                "total_findings"), "import-scans")
    named = stored(_counts(findings, ["scan_id", "rule_id", "rule_name"]), "import-names")
    per_rule = stored(named.groupBy("scan_id", "rule_id").agg(
        *[F.sum(c).alias(c) for c in ("n", *_VERIFIED.values())]), "import-rules")
    states = {"scan_states": _summary(scans, per_rule), "repo_states": _by_repo(scans, named),
              **_days(scans, per_rule)}
    for name in STATES:
        states[name].write.mode("overwrite").parquet(f"{path}/{name}/import={number}")


def read_states(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in STATES}


def fold_scan_summary(states: dict[str, DataFrame]) -> DataFrame:
    """``scan_summary`` of all imports; a scan imported again counts as it was last."""
    return latest(states["scan_states"], ["scan_id"], F.col("import")).drop("import")


def fold_findings_by_repo(states: dict[str, DataFrame]) -> DataFrame:
    return states["repo_states"].groupBy("repository", "rule_id", "rule_name").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.max("last_seen").alias("last_seen"),
        F.min("first_seen").alias("first_seen"))


def fold_security_stats(states: dict[str, DataFrame]) -> DataFrame:
    days = states["days"].groupBy("scan_date").agg(*[
        F.sum(c).alias(c) for c in ("total_scans", "total_findings", "total_findings_joined")])
    return _stats(days, states["day_repos"].drop("import").distinct(),
                  states["day_rules"].drop("import").distinct())
