"""Commit graphs with merges, contents scanned once, files in byte ranges, crowded files."""

import random

import pytest
from pyspark.sql import functions as F
from samples import token as A

from keysieve.plans import history as H
from keysieve.plans import scan as P
from keysieve.sources import files as S
from keysieve.sources import history as V

COMMITS = "repo string, commit string, parents array<string>"
VERSIONS = ("repo string, commit string, ts timestamp, branch string, path string, change string, "
            "content string, old_path string")


def graph(rng, n):
    """A random history: parents by number, most with one, some with two or three, some with none."""
    parents = {}
    for i in range(n):
        k = min(i, rng.choice([1, 1, 1, 1, 2, 2, 3]))
        recent = [max(0, i - 1 - int(rng.expovariate(.5))) for _ in range(k)]
        parents[i] = list(dict.fromkeys(recent))
        if i and rng.random() < .02:
            parents[i] = []
    return parents


def ancestors(parents, tip):
    seen, todo = set(), [tip]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents[c]
    return seen


def test_lineage_is_the_history_in_order(spark):
    rng = random.Random(0)
    repos = {f"r{j}": graph(rng, rng.choice([1, 5, 60, 100])) for j in range(40)}
    name = {r: rng.sample(range(1000, 9999), len(g)) for r, g in repos.items()}
    rows = [(r, f"c{name[r][c]}", [f"c{name[r][p]}" for p in ps])
            for r, g in repos.items() for c, ps in g.items()]
    tips = [(r, f"c{name[r][len(g) - 1]}") for r, g in repos.items()]
    rows += rows[:3] + [("r0", "orphan", ["not in the table"]), ("r99", "alone", None)]
    got = {}
    for r in V.reachable(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(
            tips + [("r98", "unknown")], "repo string, commit string")).collect():
        assert (r.repo, r.commit) not in got
        got[r.repo, r.commit] = r.place
    want = {(r, f"c{name[r][c]}") for r, g in repos.items() for c in ancestors(g, len(g) - 1)}
    assert set(got) == want
    for (repo, commit), place in got.items():
        for parent in next(p for r, c, p in rows if (r, c) == (repo, commit)):
            assert got[repo, parent] < place


def test_rounds_do_not_grow_with_the_branches(spark, monkeypatch):
    """Forty branches, named before main's commits, that leave it and are merged one after another."""
    from keysieve.operators import lineage

    rows, last = [("r", "m000", [])], "m000"
    for i in range(1, 41):
        rows += [("r", f"a{i:03}", [last]), ("r", f"n{i:03}", [last]),
                 ("r", f"o{i:03}", [f"n{i:03}"]), ("r", f"p{i:03}", [f"o{i:03}", f"a{i:03}"])]
        last = f"p{i:03}"
    names, plain = [], lineage.stored

    def counted(df, name):
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(lineage, "stored", counted)
    got = V.reachable(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(
        [("r", last)], "repo string, commit string")).orderBy("place").collect()
    # each branch comes right before its merge
    assert [r["commit"] for r in got] == ["m000"] + [
        f"{x}{i:03}" for i in range(1, 41) for x in "noap"]
    assert names.count("claims") <= 5


def test_lineage_of_forests_with_more_commits_than_few(spark, monkeypatch):
    """Some commits of a list end it: places are those of the lists as they are."""
    from keysieve.operators import lineage

    rng = random.Random(7)
    rows, tips = [], []
    for r, g in enumerate([{i: [i - 1] if i else [] for i in range(150)}, graph(rng, 120),
                           graph(rng, 1), {0: [], 1: [0], 2: [1], 3: [1], 4: [2, 3]}]):
        rows += [(f"r{r}", f"c{c}", [f"c{p}" for p in ps]) for c, ps in g.items()]
        tips.append((f"r{r}", f"c{len(g) - 1}"))
    commits = spark.createDataFrame(rows, COMMITS)
    tips = spark.createDataFrame(tips, "repo string, commit string")
    want = sorted(map(str, V.reachable(commits, tips).collect()))
    monkeypatch.setattr(lineage, "FEW", 0)
    assert sorted(map(str, V.reachable(commits, tips).collect())) == want


def test_rows_written_follow_the_commits(spark, monkeypatch):
    """One chain of 2,000 commits: what all rounds write does not grow with their number."""
    from keysieve.operators import lineage

    n, written, plain = 2000, [], lineage.stored

    def counted(df, name):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(lineage, "stored", counted)
    monkeypatch.setattr(lineage, "FEW", 300, raising=False)
    commits = spark.createDataFrame(
        [("r", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)], COMMITS)
    lineage.chains(commits)
    assert sum(written) < 13 * n  # more than 24 n by doubling pointers of all commits


def test_a_circle_beside_a_history_is_an_error(spark):
    from keysieve.operators import lineage

    rows = [("r", "a", ["b"]), ("r", "b", ["a"]), ("r", "c", ["a"]), ("s", "d", []), ("s", "e", ["d"])]
    with pytest.raises(ValueError, match="circle"):
        lineage.chains(spark.createDataFrame(rows, COMMITS))


def test_a_circle_of_parents_is_an_error(spark, monkeypatch):
    from keysieve.operators import lineage

    monkeypatch.setattr(lineage, "ROUNDS", 4)
    circle = spark.createDataFrame([("r", "a", ["b"]), ("r", "b", ["a"])], COMMITS)
    with pytest.raises(ValueError, match="circle"):
        lineage.chains(circle)


def test_trees_across_merges(spark):
    """f changes on main, g on a branch that is merged; time stamps are all the same."""
    def version(commit, path, change="M", text="x", old=None):
        return ("r", commit, None, "any", path, change, f"password = '{A(12)}{text}'", old)

    commits = [("r", "c1", []), ("r", "c2", ["c1"]), ("r", "b1", ["c1"]), ("r", "b2", ["b1"]),
               ("r", "m", ["c2", "b2"]), ("r", "c3", ["m"]), ("r", "late", ["c1"])]
    versions = [version("c1", "f", "A"), version("c1", "g", "A"), version("c1", "h", "A"),
                version("c2", "f", text="main"), version("c2", "h", "D"),
                version("b1", "g", text="branch"), version("b2", "i", "A"),
                version("c3", "j", "R", old="i"), version("late", "k", "A")]
    tips = [(f"r-{tip}", tip) for tip in ("c3", "m", "b2")]
    commits = spark.createDataFrame([(r, *c[1:]) for r, _ in tips for c in commits], COMMITS)
    versions = spark.createDataFrame([(r, *v[1:]) for r, _ in tips for v in versions], VERSIONS)
    tips = spark.createDataFrame(tips, "repo string, commit string")
    found = {}
    for x in V.graph_heads(versions, commits, tips).collect():
        found.setdefault(x.repo, set()).add((x.path, x.commit))
    assert found == {
        "r-c3": {("f", "c2"), ("g", "b1"), ("j", "c3")},
        "r-m": {("f", "c2"), ("g", "b1"), ("i", "b2")},
        "r-b2": {("f", "c1"), ("g", "b1"), ("h", "c1"), ("i", "b2")}}


def test_each_content_is_scanned_once(spark, monkeypatch):
    """Findings of 3,000 versions from 4 contents, a third of them the same."""
    texts = [f"password = '{A(12)}{i}'\n" for i in range(3)] + ["prose"]
    rows = [("r", f"c{i}", None, "main", "node_modules/x" if i == 7 else f"f{i % 9}.txt",
             "D" if i == 4 else "M", texts[0 if i % 3 == 0 else i % 4], None) for i in range(3000)]
    versions, seen = spark.createDataFrame(rows, VERSIONS), []
    plain = H.scan_files

    def counted(files, *args, **options):
        seen.append(files.count())
        return plain(files, *args, **options)

    monkeypatch.setattr(H, "scan_files", counted)
    got = H.scan_versions(versions, keep_raw=True).select(
        "repo", "commit", "path", "line", "column", "rule_id", "secret_raw")
    want = P.scan_files(versions.where("change <> 'D'").select("repo", "commit", "path", "content"),
                        context_lines=0, keep_raw=True).select(got.columns)
    assert seen == [3] and got.count() > 2000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_contents_are_computed_once_and_hashed(spark, monkeypatch):
    """A content that is an expression is not repeated for each test of the gate, and equal
    contents meet without sorting all versions."""
    rows = [("r", f"c{i}", None, "main", f"f{i % 9}.txt", "M", f"password = '{A(12)}{i % 3}'", None)
            for i in range(60)]
    versions = spark.createDataFrame(rows, VERSIONS).withColumn(
        "content", F.concat("content", F.lit("#mark#"), F.col("path").substr(1, 0)))
    plans, plain = {}, H.stored

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(H, "stored", kept)
    assert H.scan_versions(versions).count() == 60
    marked = [line for line in plans["places"].split("\n") if "#mark#" in line]
    assert sum(line.count("#mark#") for line in marked) == 1
    assert "SortAggregate" not in plans["content-findings"]


def test_versions_inside_a_history(spark):
    rows = [(r, f"c{i}", None, "main", f"f{i % 4}.txt", "D" if i == 5 else "M",
             f"password = '{A(12)}{i % 6}'", None) for r in "rs" for i in range(24)]
    versions = spark.createDataFrame(rows + rows[:2], VERSIONS)
    inside = spark.createDataFrame([("r", f"c{i}") for i in (0, 3, 5, 9)] + [("r", "c0")],
                                   "repo string, commit string")
    columns = ["repo", "commit", "path", "line", "rule_id", "secret_id"]
    got = H.scan_versions(versions, inside=inside).select(columns)
    want = H.scan_versions(versions.join(inside, ["repo", "commit"], "left_semi")).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4


# --- files in byte ranges ------------------------------------------------------------------------


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_files_are_scanned_like_small_ones(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    lines = ["", "x = 1", "é" * 30, "password = '%s'" % A(12), "token = \"%s\"" % A(24),
             "see %s" % A(12), "y" * 300]
    endings = {"unix.py": "\n", "dos.py": "\r\n", "mixed.py": None}
    for name, end in endings.items():
        text = "".join(rng.choice(lines) + (end or rng.choice(["\n", "\r\n"])) for _ in range(120))
        (tmp_path / name).write_text(text, newline="")
        (tmp_path / f"open-{name}").write_text(text + "password = '%s'" % A(9), newline="")
        (tmp_path / f"cr-{name}").write_text(text + "password = '%s'\r" % A(9), newline="")
    (tmp_path / "mark.py").write_text("﻿password = '%s'\nx\n" % A(12))
    (tmp_path / "mark-open.py").write_text("﻿password = '%s'" % A(12))
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "lf.py").write_text("\n\n")
    (tmp_path / "b c+d%20.py").write_text("password = '%s'\n" % A(12))
    (tmp_path / "binary.py").write_bytes(b"password = '" + A(12).encode() + b"'\n\xff\xfe\n" * 50)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("password = '%s'\n" % A(12))

    def rows(found):
        found = found.withColumn("line", F.col("line").cast("long"))
        return sorted((r.path, r.line, r.column, r.pos, r.rule_id, r.secret_raw,
                       tuple(map(tuple, r.context))) for r in found.collect())

    root = str(tmp_path)
    whole = P.scan_files(S.text_files(S.read_tree(spark, root)), context_lines=3, keep_raw=True)
    cut = P.scan_large(spark, root, context_lines=3, keep_raw=True)
    want = rows(whole)
    assert rows(cut) == want and len(want) > 200
    assert rows(P.scan_tree(spark, root, whole=2000, context_lines=3, keep_raw=True)) == want
    ranges = S.line_ranges(S.read_lines(spark, root)).groupBy("path").count().collect()
    assert max(r["count"] for r in ranges) > 20


def test_no_task_reads_a_large_file_whole(spark, tmp_path):
    """40 MB of one file in ranges of 1 MB."""
    filler = "x = 1  # nothing to see here, and that for quite a while\n" * 1000
    with open(tmp_path / "big.py", "w") as out:
        for i in range(700):
            out.write(filler)
            out.write(f"password = '{A(12)}{i}'\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        found = P.scan_large(spark, str(tmp_path), context_lines=1, keep_raw=True).collect()
        ranges = S.line_ranges(S.read_lines(spark, str(tmp_path)))
        most = ranges.agg(F.max("n"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line, r.secret_raw) for r in found) == [
        (1001 * (i + 1), f"{A(12)}{i}") for i in range(700)]
    assert all(len(r.context) == (2 if r.line == 700 * 1001 else 3) for r in found)
    assert most[1] >= 38 and most[0] < 25_000


# --- crowded files ---------------------------------------------------------------------------------


def test_crowded_files_are_hidden_like_others(spark, monkeypatch):
    rng = random.Random(8)
    secrets = [A(8)[:n] + str(i) for i in range(40) for n in (4, 7, 8)]
    lines = []
    for i in range(600):
        s = rng.choice(secrets)
        lines.append(rng.choice([f"password = '{s}ab'", f"use {s}ab and {rng.choice(secrets)}ab",
                                 f"token = \"{A(24)}{i % 50}\"", "", "short"]))
    files = spark.createDataFrame(
        [("r", "big", "\n".join(lines)), ("r", "small", "\n".join(lines[:20]))],
        "repo string, path string, content string")

    def rows(**options):
        return sorted((r.path, r.line, r.pos, r.rule_id, tuple(map(tuple, r.context)))
                      for r in P.scan_files(files, context_lines=2, **options).collect())

    want = rows()
    assert rows(crowded=True) == want and len(want) > 200
    monkeypatch.setattr(P, "MANY", 50)
    assert rows(crowded=True) == want
