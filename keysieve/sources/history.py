"""Commit history as a table of file versions.

Columns: repo, commit, ts, branch, path, change (A, M, D or R), content, and for renames
old_path.  The commit graph is a table of its own: repo, commit, parents (an array, the first
parent first), so that merges need neither branch labels nor time stamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.operators.lineage import lineage
from keysieve.operators.skew import latest, skew_join
from keysieve.workspace import stored


def added_paths(versions: DataFrame) -> DataFrame:
    """Every path that was ever added."""
    return versions.where(F.col("change") == "A").select("repo", "path").distinct()


def on_branch(versions: DataFrame, branch: str, base: str | None = None) -> DataFrame:
    """The versions a branch is made of: its own, and those of ``base`` before its first one."""
    own = versions.where(F.col("branch") == branch)
    if base is None:
        return own
    fork = own.groupBy("repo").agg(F.min("ts").alias("fork_"))
    inherited = skew_join(versions.where(F.col("branch") == base), fork, ["repo"])
    return own.unionByName(inherited.where("ts < fork_").select(*versions.columns))


def heads(versions: DataFrame, branch: str, base: str | None = None) -> DataFrame:
    """(repo, path, commit) of the files of a branch as they are now."""
    on = on_branch(versions, branch, base)
    seen = on.select("repo", "path", "commit", "ts", "change")
    if "old_path" in versions.columns:  # a rename ends the file's old path
        seen = seen.union(on.where("change = 'R' and old_path <> path").select(
            "repo", "old_path", "commit", "ts", F.lit("D")))
    # a commit that renames one file away and writes another to its path keeps the path
    last = latest(seen, ["repo", "path"], F.struct("ts", "commit", F.col("change") != "D"))
    return last.where("change <> 'D'").select("repo", "path", "commit")


def tree(versions: DataFrame, branch: str, base: str | None = None) -> DataFrame:
    """The files of a branch as they are now, with those it still has from ``base``.

    Contents are joined to the chosen versions, not dragged through the choice.
    """
    return on_branch(versions, branch, base).join(
        heads(versions, branch, base), ["repo", "path", "commit"], "left_semi")


# --- by the commit graph ----------------------------------------------------------------------


def reachable(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """repo, commit, place: the history of each tip (repo, commit), and the order of its commits.

    ``place`` is an array that grows from parent to child.  What a merge brought in stands right
    before the merge.
    """
    return lineage(commits, tips)


def graph_heads(versions: DataFrame, commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo, path, commit) of the files as they are at each repository's tip.

    A path is as the last commit left it that changed it.  Where two sides of a merge changed
    it and the merge did not, the merged branch counts.
    """
    placed = versions.join(reachable(commits, tips), ["repo", "commit"])
    if "old_path" in versions.columns:
        own = F.struct("path", "change")
        gone = F.struct(F.col("old_path").alias("path"), F.lit("D").alias("change"))
        touched = F.when(F.expr("change = 'R' and old_path <> path"), F.array(own, gone)).otherwise(
            F.array(own))
        placed = placed.select("repo", "commit", "place", F.inline(touched))
    seen = placed.select("repo", "path", "commit", "place", "change")
    last = latest(seen, ["repo", "path"], F.struct("place", F.col("change") != "D"))
    return last.where("change <> 'D'").select("repo", "path", "commit")


def graph_tree(versions: DataFrame, commits: DataFrame, tips: DataFrame) -> DataFrame:
    """The versions that are the files at each repository's tip."""
    chosen = stored(graph_heads(versions, commits, tips), "heads")
    return versions.join(chosen, ["repo", "path", "commit"], "left_semi")
