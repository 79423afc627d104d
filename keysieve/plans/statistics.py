"""Statistics over a corpus of parsed reports and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions.identity import known_host, url_host

# Rules whose findings are of high value.
HIGH_VALUE_RULES = [
    "openai-api-key", "anthropic-api-key", "claude-3-api-key", "stripe-secret-key",
    "github-pat", "aws-access-key-id", "stripe-restricted-key",
]
# Which program takes which rules; all others go to "other".
PROGRAM_RULES = {
    "openai": ["openai-api-key", "openai-project-key"],
    "anthropic": ["anthropic-api-key", "claude-3-api-key"],
    "stripe": ["stripe-secret-key", "stripe-restricted-key"],
    "github": ["github-pat", "github-oauth", "github-app"],
    "aws": ["aws-access-key-id"],
    "gcp": ["gcp-service-account"],
    "azure": ["azure-sas-token"],
}


def share(n: Column, total: Column) -> Column:
    """Percent with one decimal."""
    return F.round(n * 100.0 / F.greatest(total, F.lit(1)), 1)


def corpus_statistics(reports: DataFrame) -> DataFrame:
    """Reports with and without findings, their share, findings per report."""
    n = F.count("*")
    hit = F.count_if(F.col("n_findings") > 0)
    found = F.coalesce(F.sum("n_findings"), F.lit(0))
    return reports.agg(
        n.alias("total_reports"), found.alias("total_findings"),
        hit.alias("reports_with_findings"), (n - hit).alias("reports_without_findings"),
        share(hit, n).alias("percent_with_findings"),
        F.round(found / F.greatest(n, F.lit(1)), 1).alias("average_per_report"))


def with_share(counts: DataFrame, n: str = "findings") -> DataFrame:
    """Adds each row's percentage to a table of counts of any size."""
    return counts.withColumn("percent", share(F.col(n), counts.agg(F.sum(n)).scalar()))


def by_rule(findings: DataFrame) -> DataFrame:
    return with_share(findings.groupBy(F.coalesce("rule_id", F.lit("unknown")).alias("rule_id")
                                       ).agg(F.count("*").alias("findings")))


def by_status(findings: DataFrame) -> DataFrame:
    return with_share(findings.groupBy("status").agg(F.count("*").alias("findings")))


def high_value(findings: DataFrame) -> DataFrame:
    """How many findings are of high value, and how many of those are active."""
    valued = F.col("rule_id").isin(HIGH_VALUE_RULES)
    return findings.agg(
        F.count_if(valued).alias("high_value_findings"),
        F.count_if(valued & (F.col("status") == "active")).alias("active_high_value_secrets"))


def high_value_sample(findings: DataFrame, order: list, n: int = 10) -> DataFrame:
    """The first findings of high value (filtered before they are cut off)."""
    return findings.where(F.col("rule_id").isin(HIGH_VALUE_RULES)).orderBy(*order).limit(n)


def by_platform(reports: DataFrame) -> DataFrame:
    """Reports per host of their target, whichever way the target is written."""
    host = F.when(F.col("target_object").isNotNull(), known_host(F.col("target_object.path"))
                  ).otherwise(url_host(F.col("target")))
    return reports.select(host.alias("platform")).where("platform is not null").groupBy(
        "platform").agg(F.count("*").alias("reports"))


def scan_period(reports: DataFrame) -> DataFrame:
    """First and last scan, and how many have a readable time."""
    ts = F.try_to_timestamp("timestamp")
    return reports.agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"),
                       F.count(ts).alias("total_scans"))


def program_of(rule_id: Column) -> Column:
    branches = [F.when(rule_id.isin(rules), name) for name, rules in PROGRAM_RULES.items()]
    return F.coalesce(*branches, F.lit("other"))


def active_by_program(findings: DataFrame) -> DataFrame:
    """Active findings with the program that takes them."""
    return findings.where(F.col("status") == "active").withColumn(
        "program", program_of(F.col("rule_id")))


def program_counts(findings: DataFrame) -> DataFrame:
    return active_by_program(findings).groupBy("program").agg(F.count("*").alias("findings"))


def write_by_program(findings: DataFrame, path: str) -> None:
    active_by_program(findings).write.mode("append").partitionBy("program").json(path)
