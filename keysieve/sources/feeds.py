"""Repository URLs from landed feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.functions.identity import canonical_url, owner, platform, project

# The JSON keys of clone URLs in the payloads of code hosts.
URL_KEYS = ["clone_url", "http_url_to_repo", "href"]
NAME_KEY = "fullname"
# Links to repositories in free text.
LINK = r"https?://(?:github|gitlab)\.com/[a-zA-Z0-9_-]+/[a-zA-Z0-9_.-]+"


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines and comments are skipped."""
    return repo_list(spark.read.text(path))


def repo_list(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(
        F.col("value").alias("url"))


def payload_urls(payloads: DataFrame, keys=tuple(URL_KEYS)) -> DataFrame:
    """(source, payload) -> (source, url): the values of the URL keys, at any depth.

    ``href`` occurs on every link of a payload, so only clone links count there.
    """
    text = F.col("payload")
    found = []
    for key in keys:
        values = F.regexp_extract_all(text, F.lit(rf'"{key}"\s*:\s*"([^"]*)"'), F.lit(1))
        found.append(F.filter(values, lambda u: u.endswith(".git")) if key == "href" else values)
    urls = F.filter(F.concat(*found), lambda u: u != "")
    return payloads.select("source", F.explode(F.array_distinct(urls)).alias("url"))


def payload_names(payloads: DataFrame, base: str, key: str = NAME_KEY) -> DataFrame:
    """(source, payload) -> (source, url) for hosts that list names, not URLs."""
    names = F.regexp_extract_all("payload", F.lit(rf'"{key}"\s*:\s*"([^"]*)"'), F.lit(1))
    return payloads.select("source", F.explode(F.array_distinct(names)).alias("name")).select(
        "source", F.concat(F.lit(base + "/"), "name", F.lit(".git")).alias("url"))


def text_urls(texts: DataFrame) -> DataFrame:
    """(source, text) -> (source, url): canonical URLs of the repositories linked to."""
    links = F.transform(F.regexp_extract_all("text", F.lit(LINK), F.lit(0)), canonical_url)
    return texts.select("source", F.explode(F.array_distinct(links)).alias("url"))


def event_urls(events: DataFrame, base: str = "https://github.com") -> DataFrame:
    """(source, name) of owner/name form -> (source, url), each once."""
    return events.where(F.col("name").contains("/")).select(
        "source", F.concat(F.lit(base + "/"), "name", F.lit(".git")).alias("url")).distinct()


def cap_per_source(urls: DataFrame, cap: int, order: str = "url") -> DataFrame:
    """At most ``cap`` URLs of each source: the feature of a polite fetcher.

    Spark limits each task's rows per source before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("source").orderBy(order))
    return urls.withColumn("rank_", rank).where(F.col("rank_") <= cap).drop("rank_")


def as_repos(urls: DataFrame, priority: int = 5) -> DataFrame:
    """(source, url, discovered_at) -> rows of the repository queue."""
    url = F.col("url")
    return urls.select(
        url, platform(url).alias("platform"), owner(url).alias("owner"),
        project(url).alias("name"), "source", F.lit(priority).alias("priority"),
        F.lit("pending").alias("status"), "discovered_at")
