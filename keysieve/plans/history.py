"""Secrets across a repository's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.operators.detect import gate_sql
from keysieve.operators.skew import skew_join
from keysieve.plans.scan import scan_files
from keysieve.sources.files import scannable
from keysieve.sources.history import graph_heads, on_branch, reachable, tree
from keysieve.sources.rules import load_rules
from keysieve.workspace import stored

KEY = ["repo", "rule_id", "secret_id"]


def scan_versions(versions: DataFrame, rules=None, only=None, exclude=None,
                  filter_paths: bool = True, inside: DataFrame | None = None, **options
                  ) -> DataFrame:
    """Findings of every version of every file.

    Histories repeat contents far more often than they bring new ones: each distinct content
    is scanned once, under its digest, and its findings are given to all its versions.
    ``inside`` chooses versions by its columns.  Versions meet it by their digests; contents are
    reduced to the distinct ones where they are read, and are never shuffled per version.
    """
    rules = (rules or load_rules()).subset(only, exclude)
    kept = versions.where(F.col("change") != "D")
    if filter_paths:
        kept = kept.where(scannable(F.col("path")))
    places = ["repo", "commit", "ts", "branch", "path"]
    # exploded, so that the gate is not computed from the content's expression, many times
    kept = kept.select(*places, F.explode(F.array("content")).alias("content")).where(
        F.expr(gate_sql("content", rules, stops=" \\n"))).withColumn("digest", F.sha2("content", 256))
    chosen, texts = kept.select(*places, "digest"), contents(kept)
    if inside is not None:
        chosen = chosen.join(inside, inside.columns, "left_semi")
    places = stored(chosen, "places")
    if inside is not None:
        texts = texts.join(places.select(F.col("digest").alias("path")).distinct(), "path",
                           "left_semi")
    found = stored(scan_files(texts, rules, context_lines=0, filter_paths=False, **options),
                   "content-findings")
    return skew_join(places, found.withColumnRenamed("path", "digest"), ["digest"]).drop("digest")


def contents(versions: DataFrame) -> DataFrame:
    """(path, content): every distinct content once, its ``digest`` for a path."""
    return versions.select(F.col("digest").alias("path"), "content").distinct()


def scan_branch(versions: DataFrame, branch: str, rules=None, **options) -> DataFrame:
    """Findings of the versions committed to one branch."""
    return scan_versions(on_branch(versions, branch), rules, **options)


def scan_tree(versions: DataFrame, branch: str, rules=None, base: str | None = None, **options
              ) -> DataFrame:
    """Findings of a branch as it is now, in files inherited from ``base`` as well."""
    return scan_versions(tree(versions, branch, base), rules, **options)


def scan_graph_branch(versions: DataFrame, commits: DataFrame, tips: DataFrame, rules=None,
                      **options) -> DataFrame:
    """Findings of all versions in the history of each repository's tip, merges included."""
    inside = reachable(commits, tips).select("repo", "commit")
    return scan_versions(versions, rules, inside=inside, **options)


def scan_graph_tree(versions: DataFrame, commits: DataFrame, tips: DataFrame, rules=None,
                    **options) -> DataFrame:
    """Findings of the files as they are at each repository's tip, merges included."""
    inside = stored(graph_heads(versions, commits, tips), "heads")
    return scan_versions(versions, rules, inside=inside, **options)


def lifetimes(history: DataFrame, present: DataFrame) -> DataFrame:
    """Each secret of the history: when it was seen, how often, and if it is there now.

    ``present`` lists the file versions (repo, path, commit) of the current tree.  One
    pass over the findings tells both; a secret with countless copies is reduced in each
    task before the shuffle.
    """
    now = present.select("repo", "path", "commit").withColumn("live_", F.lit(True))
    return history.join(now, ["repo", "path", "commit"], "left").groupBy(*KEY).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("occurrences"),
        F.coalesce(F.bool_or("live_"), F.lit(False)).alias("present"))


def removed_secrets(history: DataFrame, present: DataFrame) -> DataFrame:
    """Secrets that some commit holds and the present files do not."""
    return lifetimes(history, present).where(~F.col("present")).drop("present")
