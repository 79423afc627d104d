"""Joins and groupings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.workspace import stored

SALTS = 64
HOT_SHARE = 1000  # a key with more than 1/1000 of the rows is hot, so at most 1000 are


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table with hot keys to one without.

    The rows of a hot key are dealt out over ``SALTS`` join keys, and its rows on the
    right side are repeated for each.  All other keys join as they are.  ``left`` is read
    twice, the first time for its keys only: give a table, not a long computation.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("n_"))
    total = counts.agg(F.sum("n_")).scalar()
    # at most HOT_SHARE rows by construction, whatever the size of the data
    hot = F.broadcast(counts.where((F.col("n_") > SALTS) & (F.col("n_") * HOT_SHARE > total))
                      .select(*on, F.lit(True).alias("hot_")))
    rest = [c for c in left.columns if c not in on]
    salt = F.pmod(F.xxhash64(*(rest or on)), F.lit(SALTS))
    salted = left.join(hot, on, "left").withColumn(
        "salt_", F.when(F.col("hot_"), salt).otherwise(F.lit(0).cast("long"))).drop("hot_")
    copies = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))
    dealt = right.join(hot, on, "left").withColumn(
        "salt_", F.explode(copies.cast("array<bigint>"))).drop("hot_")
    return salted.join(dealt, [*on, "salt_"], how).drop("salt_")


def latest(rows: DataFrame, key: list[str], order: Column, last: bool = True) -> DataFrame:
    """One row per key, the last (or first) in ``order``.

    An aggregation, not a window: each task reduces its own rows before the shuffle,
    so a hot key costs one row per task.  A tie is broken by the rows' contents, so that
    a task that runs again picks the same row.
    """
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c not in key]
    if rest:
        order = F.struct(order, F.xxhash64(*rest))
    return rows.groupBy(*key).agg(
        pick(F.struct(*rest), order).alias("row_")).select(*key, "row_.*")


def numbered(rows: DataFrame, by: list[str], path: str = "path", line: str = "line",
             order: tuple = ("pos",), name: str = "id") -> DataFrame:
    """Number the rows of each ``by`` group 1..n in the order of path, line and ``order``.

    Rows are dealt by ranges of that order, so a large group is cut into even ranges.
    Counts of the ranges, added up, give each its first number: one row per range and
    group, and no task sorts a whole group.
    """
    place = [*by, path, line, *order]
    ranged = stored(rows.repartitionByRange(*place).withColumn(
        "range_", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "range_").agg(F.count("*").alias("n_"))
    first = counts.withColumn("base_", F.coalesce(F.sum("n_").over(
        W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).drop("n_")
    rank = F.row_number().over(W.partitionBy(*by, "range_").orderBy(path, line, *order))
    return (ranged.withColumn("rank_", rank).join(first, [*by, "range_"])
            .withColumn(name, F.col("base_") + F.col("rank_")).drop("range_", "rank_", "base_"))
