"""Connected components of a table of links, by alternating stars.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node
it knows.  Minima are aggregated before they are shuffled, so a hub costs a row per task; the
links of a round are written to the shared folder, so no round depends on an earlier one's
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import stored


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("v"), F.least(a, b).alias("u")]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long).

    component is the smallest node reachable.  Links of a node with itself and repeated links
    change nothing; links with a null end are left out.
    """
    edges = stored(links.where("a <> b").select(*_ordered("a", "b")).distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(
            edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(
            "x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(
            F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = stored(large, "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        edges = stored(
            small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(
                low.select("v", F.col("m").alias("u"))).distinct(), "links")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
