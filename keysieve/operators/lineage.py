"""Ancestors in commit graphs with merges, by contracting the forest of first parents.

1. First parents make chains.  In each round, lists of commits with one child are cut out of the
   forest, each into the commit at its end, and then its leaves.  Of the children of a commit the
   one that is left longest goes on its chain, so a way down first parents meets a new chain at
   most once a round, and rounds are few: where lists are gone, half of the commits are leaves.
   Lists are followed by pointer doubling; of a large forest, one commit in ``SPARSE`` ends a list
   as well, so that no list is long and each round leaves a small part of the commits.  Put back
   in reverse, all get their chain and their depth, which is their position there.  Commits go by
   numbers meanwhile; all rounds together read and write a small multiple of the commits.
2. What a tip reaches on a chain is its lower part, so a claim (chain, up to which position)
   stands for any number of commits.  Claims spread over the few edges between chains: from a
   chain's lowest commit to its parent, and from merges to their further parents.  Only claims
   that the last round brought are told on.
3. A claim carries a label, the way that led to it: for each merge passed, its depth and the
   number of the parent taken.  Labels compare like words, and a commit takes its smallest one.
   With the commit's depth behind it, it is the commit's place: parents come before children,
   and what a merge brought in comes right before the merge.

Positions of a chain meet its claims by sorting, not in pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.workspace import stored

LAST = (1 << 31) - 1  # behind every number of a parent
ROUNDS = 40  # of doubling: no list has 2^40 commits
SPARSE, FEW = 16, 1 << 20  # one commit in SPARSE ends a list while there are more than FEW
CIRCLE = "the parents of some commits form a circle"


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ends(lists: DataFrame) -> DataFrame:
    """``lists`` (id, next, gap, up, w) with the end of its list for ``next``, a row that is none
    of them, and the way there for ``gap``."""
    open_, done = lists.withColumn("done", F.lit(False)), []
    for _ in range(ROUNDS):
        if open_.isEmpty():
            return _all([*done, open_]).drop("done")
        seen = _all([*done, open_]).select(
            F.col("id").alias("next"), F.col("next").alias("next_"), F.col("gap").alias("gap_"),
            F.col("done").alias("done_"))
        told = stored(open_.join(seen, "next", "left").select(
            "id", F.coalesce("next_", "next").alias("next"),
            (F.col("gap") + F.coalesce("gap_", F.lit(0))).alias("gap"), "up", "w",
            F.coalesce("done_", F.lit(True)).alias("done")), "pointers")
        done.append(told.where("done"))
        open_ = told.where("not done")
    raise ValueError(CIRCLE)


def _contracted(left: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Of each round, its leaves (id, up, w, chain) and its lists (id, next, gap).

    ``left``: id, up (null for the first commit), w (the way to ``up``).
    """
    rounds, none = [], F.lit(None).cast("long")
    cut = left.select("up", none.alias("chain")).limit(0)  # leaves of the round before
    while True:
        children = left.select(F.col("up").alias("id"), F.col("id").alias("next"),
                               F.col("w").alias("gap"), none.alias("chain")).union(
            cut.select("up", none, none, "chain")).where("id is not null")
        state = stored(left.join(children.groupBy("id").agg(
            F.count("next").alias("n"), F.max("next").alias("next"), F.max("gap").alias("gap"),
            F.max("chain").alias("chain")), "id", "left").select(
            "id", "up", "w", F.coalesce("n", F.lit(0)).alias("n"), "next", "gap",
            F.coalesce("chain", "id").alias("chain")), "forest")
        ends = F.col("n") != 1
        if state.count() > FEW:
            ends |= F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(SPARSE)) == 0
        lists = _ends(state.where(~ends).select("id", "next", "gap", "up", "w"))
        far = lists.groupBy(F.col("next").alias("id")).agg(
            F.max_by("up", "gap").alias("up_"),
            (F.max("gap") + F.max_by("w", "gap")).alias("w_"))
        rest = stored(state.where(ends).join(far, "id", "left").select(
            "id", F.when(F.col("w_").isNull(), F.col("up")).otherwise(F.col("up_")).alias("up"),
            F.coalesce("w_", "w").alias("w"), "n", "chain"), "forest")
        leaves, left = rest.where("n = 0"), rest.where("n > 0").select("id", "up", "w")
        rounds.append((leaves, lists))
        if left.isEmpty():
            return rounds
        if leaves.isEmpty():
            raise ValueError(CIRCLE)
        cut = leaves.select("up", "chain")


def chains(commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The commits by number (id, repo, commit), their links (id, nth, parent) and their places:
    id, chain, depth (first parents below)."""
    named = stored(commits.select("repo", "commit", "parents").repartition(
        "repo", "commit").dropDuplicates(["repo", "commit"]).withColumn(
        "id", F.monotonically_increasing_id()), "commits")
    there = named.select("repo", F.col("commit").alias("parent_"), F.col("id").alias("parent"))
    links = stored(named.select("repo", "id", F.posexplode("parents").alias("nth", "parent_")).join(
        there, ["repo", "parent_"]).select("id", "nth", "parent"), "links")
    first = links.where("nth = 0").select("id", F.col("parent").alias("up"))
    rounds = _contracted(named.select("id").join(first, "id", "left").select(
        "id", "up", F.col("up").isNotNull().cast("long").alias("w")))
    known = []
    for leaves, lists in reversed(rounds):
        deep = leaves.select("id", "chain", "up", "w")
        if known:
            deep = deep.join(_all(known).select(
                F.col("id").alias("up"), F.col("depth").alias("below")), "up", "left")
        else:
            deep = deep.withColumn("below", F.lit(0))
        known.append(stored(deep.select("id", "chain", (F.coalesce(
            "below", F.lit(0)) + F.col("w")).alias("depth")), "depths"))
        end = _all(known).select(F.col("id").alias("next"), "chain", "depth")
        known.append(stored(lists.select("id", "next", "gap").join(end, "next").select(
            "id", "chain", (F.col("depth") - F.col("gap")).alias("depth")), "depths"))
    return named.select("id", "repo", "commit"), links, _all(known)


def _first_of(rows: DataFrame, place: str, claims: DataFrame) -> DataFrame:
    """``rows`` with the smallest label of the claims of their chain that reach ``place``."""
    columns = [F.col(c) for c in rows.columns if c != "chain"]
    told = claims.select("chain", F.col("upto").alias("at_"), "label",
                         F.lit(None).alias("row_"))
    asked = rows.select("chain", F.col(place).alias("at_"),
                        F.lit(None).cast("array<bigint>").alias("label"),
                        F.struct(*columns).alias("row_"))
    # down the chain, a claim before the rows at its end
    down = W.partitionBy("chain").orderBy(
        F.desc("at_"), F.col("row_").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return told.unionByName(asked).withColumn("label", F.min("label").over(down)).where(
        "row_ is not null and label is not null").select("chain", "label", "row_.*")


def _unbeaten(claims: DataFrame) -> DataFrame:
    """Without claims that reach no further than one with a smaller label."""
    further = W.partitionBy("chain").orderBy(F.desc("upto")).rowsBetween(
        W.unboundedPreceding, -1)
    return claims.withColumn("least_", F.min("label").over(further)).where(
        "least_ is null or label < least_").drop("least_")


def lineage(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """repo, commit, place of all commits that a tip (repo, commit) of their repository reaches.

    ``commits``: repo, commit, parents.  Parents that are not in the table end the history there.
    """
    named, links, at = chains(commits)

    def end(name: str) -> DataFrame:
        return at.select(*[F.col(c).alias(f"{c}_{name}") for c in at.columns])

    edges = links.join(end("a"), F.expr("id = id_a")).join(end("b"), F.expr("parent = id_b"))
    # along a chain nothing needs to be told
    edges = stored(edges.where("nth > 0 or chain_a <> chain_b").select(
        F.col("chain_a").alias("chain"), F.col("depth_a").alias("from"), "chain_b", "depth_b",
        F.when(F.col("nth") > 0, F.array(F.col("depth_a"), F.col("nth").cast("long"))).otherwise(
            F.array().cast("array<bigint>")).alias("step")), "edges")

    def best(claims: DataFrame) -> DataFrame:
        return claims.groupBy("chain", "upto").agg(
            F.min_by(F.struct("label", "new"), F.struct("label", "new")).alias("c")).select(
            "chain", "upto", "c.*")

    # new: brought by the last round
    claims = stored(best(tips.select("repo", "commit").join(named, ["repo", "commit"]).join(
        at, "id").select(
        "chain", F.col("depth").alias("upto"),
        F.array().cast("array<bigint>").alias("label"), F.lit(True).alias("new"))), "claims")
    while True:
        fresh = claims.where("new")
        if fresh.isEmpty():
            break
        told = _first_of(edges, "from", fresh.drop("new"))
        new = told.select(F.col("chain_b").alias("chain"), F.col("depth_b").alias("upto"),
                          F.concat("label", "step").alias("label"), F.lit(True).alias("new"))
        # an equal claim that was there is not new
        claims = stored(_unbeaten(best(claims.withColumn("new", F.lit(False)).union(
            new))), "claims")
    own = _first_of(at, "depth", claims.drop("new")).select("id", F.concat("label", F.array(
        F.col("depth"), F.lit(LAST).cast("long"))).alias("place"))
    return own.join(named, "id").select("repo", "commit", "place")
