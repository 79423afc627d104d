"""The scan queue: repositories, findings, scan log, feeds and programs.

State is never updated in place.  It is derived from append-only logs: ``scan_log``
(repo_url, started_at, completed_at, status, findings), ``finding_events`` and
``repo_events``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.identity import repo_name
from keysieve.operators.skew import latest, skew_join
from keysieve.operators.topk import first_known

# The disclosure programs known from the start.
# name, platform, url, key_types, min_payout, max_payout
PROGRAMS = [
    ("OpenAI", "bugcrowd", "https://bugcrowd.com/openai", "openai-api-key,openai-project-key", 200, 100000),
    ("Anthropic", "direct", "https://www.anthropic.com/responsible-disclosure", "anthropic-api-key", None, None),
    ("Stripe", "hackerone", "https://hackerone.com/stripe", "stripe-secret-key,stripe-restricted-key", 500, 10000),
    ("GitHub", "hackerone", "https://hackerone.com/github", "github-pat,github-oauth,github-fine-grained", 500, 30000),
    ("GitLab", "hackerone", "https://hackerone.com/gitlab", "gitlab-pat,gitlab-pipeline,gitlab-runner", 500, 35000),
    ("Google", "direct", "https://bughunters.google.com/", "gcp-api-key,gemini-api-key", 100, 31337),
    ("Slack", "hackerone", "https://hackerone.com/slack", "slack-bot-token,slack-user-token", 500, 5000),
    ("Discord", "hackerone", "https://hackerone.com/discord", "discord-bot-token", 500, 5000),
    ("Twilio", "hackerone", "https://hackerone.com/twilio", "twilio-api-key", 500, 10000),
    ("SendGrid", "hackerone", "https://hackerone.com/sendgrid", "sendgrid-api-key", 500, 10000),
    ("npm", "hackerone", "https://hackerone.com/nodejs", "npm-token", 250, 2500),
    ("AWS", "direct", "https://aws.amazon.com/security/vulnerability-reporting/", "aws-access-key-id,aws-secret-key", None, None),
    ("HuggingFace", "direct", "https://huggingface.co/security", "huggingface-token,huggingface-model-token", None, None),
]


def programs(spark: SparkSession) -> DataFrame:
    names = ["program", "program_platform", "program_url", "key_types", "min_payout", "max_payout"]
    rows = [dict(zip(names, p), active=True) for p in PROGRAMS]
    schema = pa.schema([(n, pa.string()) for n in names[:4]] + [
        ("min_payout", pa.float64()), ("max_payout", pa.float64()), ("active", pa.bool_())])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


# --- queue -------------------------------------------------------------------------------


def next_repos(repos: DataFrame, n: int = 50, min_priority: int = 0) -> DataFrame:
    """What to scan next: the most urgent, then the longest known."""
    return (repos.where((F.col("status") == "pending") & (F.col("priority") >= min_priority))
            .orderBy(F.desc("priority"), "discovered_at", "url").limit(n))


def unscanned(urls: DataFrame, scanned: DataFrame) -> DataFrame:
    """Distinct URLs that were never scanned."""
    return urls.select("url").distinct().join(
        scanned.select("url").distinct(), "url", "left_anti")


def distinct_urls(urls: DataFrame) -> DataFrame:
    return urls.select("url").distinct().orderBy("url")


def roll_forward(repos: DataFrame, scan_log: DataFrame) -> DataFrame:
    """Repositories with the state that the scan log leaves them in."""
    done = scan_log.where(F.col("completed_at").isNotNull()).groupBy("repo_url").agg(
        F.count("*").alias("scans_"),
        F.max_by(F.struct("status", "findings", "completed_at"),
                 F.struct("completed_at", "scan_id")).alias("last_"))
    ok = F.when(F.col("last_.status") == "completed", "scanned").otherwise("error")
    return repos.join(done, repos["url"] == done["repo_url"], "left").select(
        "url", "platform", "owner", "name", "source", "priority", "discovered_at",
        F.when(F.col("last_").isNull(), F.col("status")).otherwise(ok).alias("status"),
        F.coalesce("scans_", F.lit(0)).alias("scan_count"),
        F.coalesce("last_.findings", F.lit(0)).alias("findings_count"),
        F.col("last_.completed_at").alias("last_scanned_at"))


def scan_durations(scan_log: DataFrame) -> DataFrame:
    """Whole seconds of each finished scan, in milliseconds."""
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return scan_log.where(F.col("completed_at").isNotNull()).withColumn(
        "duration_ms", seconds * 1000)


def feed_cursors(fetches: DataFrame) -> DataFrame:
    """Per feed: last cursor, last fetch and the repositories fetched so far."""
    return fetches.groupBy("name").agg(
        F.max_by("cursor", F.struct("fetched_at", "cursor")).alias("last_cursor"),
        F.max("fetched_at").alias("last_fetched_at"), F.sum("new").alias("repos_fetched"))


def apply_events(rows: DataFrame, events: DataFrame, key: str, order: Column) -> DataFrame:
    """The status a row's last event gave it, else its own."""
    last = latest(events.select(key, F.col("status").alias("new_"), "at"), [key], order)
    return rows.join(last, key, "left").withColumn(
        "status", F.coalesce("new_", "status")).drop("new_", "at")


def mark_reported(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with what their last report event says."""
    last = latest(events.select("finding_id", "reported_to", "reported_at"),
                  ["finding_id"], F.struct("reported_at", "reported_to"))
    return findings.drop("reported", "reported_to", "reported_at").join(
        last, "finding_id", "left").withColumn("reported", F.col("reported_at").isNotNull())


def batch_summary(runs: DataFrame) -> DataFrame:
    """Per batch of scans: total, succeeded, failed."""
    return runs.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("findings").alias("findings"))


def batch_rows(runs: DataFrame) -> DataFrame:
    """Per batch and repository, as the batch report lists it."""
    return runs.select("batch_id", "url", repo_name(F.col("url")).alias("name"), "status",
                       "findings")


def batch_documents(runs: DataFrame, at_most: int = 10_000) -> DataFrame:
    """One JSON summary per batch, of several parts if it lists very many repositories."""
    parts = F.ceil(F.col("total") / at_most)
    heads = batch_summary(runs).withColumn("part", F.explode(F.sequence(
        F.lit(1).cast("bigint"), parts)))
    sizes = heads.select("batch_id", parts.alias("n_"), "part")
    rows = skew_join(batch_rows(runs), sizes.where("part = 1").select("batch_id", "n_"),
                     ["batch_id"])
    listed = rows.withColumn("part", F.pmod(F.xxhash64("url"), F.col("n_")) + 1).groupBy(
        "batch_id", "part").agg(F.sort_array(F.collect_list(
            F.struct("url", "name", "status", "findings"))).alias("repos"))
    doc = F.struct("batch_id", F.col("repos"), F.struct("total", "success", "failed").alias("summary"))
    return heads.join(listed, ["batch_id", "part"], "left").select(
        "batch_id", "part", F.to_json(doc).alias("document"))


# --- dashboards ----------------------------------------------------------------------------


def repo_status(repos: DataFrame) -> DataFrame:
    s = F.col("status")
    return repos.agg(
        F.count("*").alias("total"), F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "scanned").alias("scanned"), F.count_if(s == "error").alias("errors"),
        F.count_if(F.col("findings_count") > 0).alias("with_findings"))


def finding_status(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count("*").alias("total"), F.count_if("verified").alias("verified"),
        F.count_if(~F.col("reported")).alias("unreported"))


def by_platform(repos: DataFrame) -> DataFrame:
    return repos.groupBy("platform").agg(
        F.count("*").alias("repos"), F.sum("findings_count").alias("findings"))


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("findings")).orderBy(
        F.desc("findings"), "rule_id").limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of name and count per table."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
              for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def list_repos(repos: DataFrame, where: Column | None = None, n: int = 100) -> DataFrame:
    chosen = repos if where is None else repos.where(where)
    return chosen.select(
        "url", "platform", F.concat("owner", F.lit("/"), "name").alias("repo"), "source",
        "priority", "status", "findings_count", "scan_count", "last_scanned_at", "discovered_at",
    ).orderBy(F.desc("priority"), F.desc("discovered_at"), "url").limit(n)


# --- findings with their repository ----------------------------------------------------------


def with_repos(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Each finding with its repository.  One repository may hold much of the table."""
    r = repos.select(F.col("url").alias("repo_url"), "platform", "owner",
                     F.col("name").alias("repo_name"))
    return skew_join(findings, r, ["repo_url"])


def _newest() -> list[Column]:
    return [F.desc("found_at"), F.asc("finding_id")]


def recent_findings(findings: DataFrame, repos: DataFrame, n: int = 5) -> DataFrame:
    """The newest findings of known repositories."""
    known = repos.select(F.col("url").alias("repo_url")).distinct()
    return first_known(findings, known, ["repo_url"], _newest(), n).select(
        "finding_id", "rule_id", "secret_preview", "repo_url", "found_at")


def list_findings(findings: DataFrame, repos: DataFrame, where: Column | None = None,
                  n: int = 100) -> DataFrame:
    chosen = findings if where is None else findings.where(where)
    # findings of unknown repositories take no place in the listing
    known = repos.select(F.col("url").alias("repo_url"), "platform")
    return first_known(chosen, known, ["repo_url"], _newest(), n).select(
        "finding_id", "rule_id", "secret_preview", "file_path", "line_number", "platform",
        F.substring("repo_url", 1, 50).alias("repo_url"), "found_at")


def active_findings(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings that were not reported yet."""
    return with_repos(findings.where(~F.col("reported")), repos).select(
        "finding_id", "rule_id", "rule_name", "file_path", "line_number", "secret_preview",
        "verified", "verification_status", "repo_url", "platform", "owner", "repo_name", "found_at")


def rule_programs(progs: DataFrame) -> DataFrame:
    """One row per rule and active program: a list of rule ids is an equi join in waiting."""
    return progs.where("active").withColumn("rule_id", F.explode(F.split("key_types", ","))).drop(
        "key_types", "active")


def bounty_eligible(findings: DataFrame, repos: DataFrame, progs: DataFrame) -> DataFrame:
    """Unreported findings that an active program takes."""
    # the join with the few program rules cuts the findings down before the other one
    taken = findings.where(~F.col("reported")).join(rule_programs(progs), "rule_id")
    return with_repos(taken, repos).select(
        "finding_id", "rule_id", "rule_name", "secret_preview", "verified",
        "verification_status", "repo_url", "program", "program_platform", "program_url",
        "min_payout", "max_payout")


def top_eligible(eligible: DataFrame, n: int = 50) -> DataFrame:
    return eligible.orderBy(F.desc_nulls_last("max_payout"), "finding_id", "program").limit(n)


def finding_detail(findings: DataFrame, repos: DataFrame, progs: DataFrame, which: Column
                   ) -> tuple[DataFrame, DataFrame]:
    """The chosen finding, and the programs that take it."""
    one = findings.where(which)
    return with_repos(one, repos), one.select("finding_id", "rule_id").join(
        rule_programs(progs), "rule_id")


def export(findings: DataFrame, repos: DataFrame) -> DataFrame:
    return with_repos(findings, repos).select(
        "finding_id", "rule_id", "rule_name", "file_path", "line_number", "secret_preview",
        "verified", "verification_status", "reported", "reported_to", "found_at", "repo_url",
        "platform", "owner", "repo_name")


def write_export(findings: DataFrame, repos: DataFrame, path: str) -> None:
    export(findings, repos).write.mode("append").json(path)
