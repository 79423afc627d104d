"""Which of the matches on one line are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: two matches closer than this many columns compete.
NEAR = 15

_FIELDS = ["ord", "trig_ord", "rule_id", "rule_name", "kind", "specificity",
           "matched", "secret_raw", "col0"]


def first_per_rule(hits: Column) -> Column:
    """Of matches sorted by rule and trigger, the first of each rule."""
    return F.filter(hits, lambda h, i: (i == 0) | (
        F.get(hits, i - 1)["ord"] != h["ord"]))


def fold(hits: Column) -> Column:
    """Take matches in catalogue order and keep the most specific nearby.

    A kept match counts from its reported (one-based) column, a new one from its
    byte offset, so "near" is neither symmetric nor transitive: the order matters
    and no grouping can replace the fold.
    """
    def near(kept: Column, new: Column) -> Column:
        return F.abs(new["col0"] - (kept["col0"] + 1)) < NEAR

    def step(acc: Column, new: Column) -> Column:
        beaten = F.exists(acc, lambda k: near(k, new) & (k["specificity"] >= new["specificity"]))
        rest = F.filter(acc, lambda k: ~near(k, new) | (k["specificity"] > new["specificity"]))
        return F.when(beaten, acc).otherwise(F.concat(rest, F.array(new)))

    return F.aggregate(hits, F.slice(hits, 1, 0), step)


def resolve(matches: DataFrame, line_key: list[str], carry: list[str] = ()) -> DataFrame:
    """Matches -> findings.  ``line_key`` identifies a line of a file.

    A group holds the matches of one line, so the number of rules bounds it however
    large the file or repository is.  ``carry`` columns are equal within a line.
    Adds ``pos``, the order of the findings within their line.
    """
    hits = F.array_sort(F.collect_list(F.struct(*_FIELDS)))
    lines = matches.groupBy(*line_key).agg(
        hits.alias("hits"), *[F.first(c).alias(c) for c in carry])
    kept = lines.withColumn("hits", first_per_rule(F.col("hits"))).select(
        *line_key, *carry, F.posexplode_outer(fold(F.col("hits"))).alias("pos", "hit"))
    return kept.select(*line_key, *carry, "pos", "hit.*").drop("trig_ord")
