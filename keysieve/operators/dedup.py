"""Insert-or-ignore and upsert on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.operators.skew import latest

REPO_KEY = ["url"]
FINDING_KEY = ["repo_url", "rule_id", "file_path", "line_number", "secret_hash"]


def insert_new(incoming: DataFrame, known: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The rows to append: first of each key among the incoming, unknown so far.

    Duplicates are gone on both sides before the anti join, so no key is hot in it.
    """
    first = latest(incoming, key, order, last=False)
    return first.join(known.select(*key).distinct(), key, "left_anti").select(*incoming.columns)


def insert_counts(incoming: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Per feed, how many rows came in and how many of them were new."""
    seen = incoming.groupBy(by).agg(F.count("*").alias("total"))
    added = new.groupBy(by).agg(F.count("*").alias("new"))
    return seen.join(added, by, "left").select(
        by, "total", F.coalesce("new", F.lit(0)).alias("new"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: Column) -> DataFrame:
    """``current`` with the last incoming row of each key in place of its own."""
    newest = latest(incoming, key, order)
    kept = current.join(newest.select(*key), key, "left_anti")
    return kept.unionByName(newest.select(*current.columns))
