import json
import time

from samples import token as A
from pyspark.sql import functions as F

from keysieve.operators.skew import latest, numbered, skew_join
from keysieve.plans import queue as Q
from keysieve.plans import report as R
from keysieve.plans import statistics as S
from keysieve.plans import warehouse as W
from keysieve.plans.scan import scan_files
from keysieve.sources import feeds
from keysieve.sources.reports import parse_reports, read_documents


def hot(spark):
    """A third of the rows share one key."""
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("v"))


def test_skew_join_equals_a_plain_join(spark):
    left = hot(spark)
    right = spark.range(-1, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        a = skew_join(left, right, ["k"], how)
        b = left.join(right, "k", how)
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_skew_join_deals_a_hot_key_out(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.range(-1, 4000).select(F.col("id").alias("k"))
        parts = skew_join(hot(spark), right, ["k"]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbered_is_dense_in_a_hot_group(spark):
    rows = hot(spark).select(
        "k", F.concat(F.lit("f"), F.col("v") % 7).alias("path"), (F.col("v") % 9000).alias("line"),
        F.col("v").alias("pos"))
    got = numbered(rows, ["k"]).groupBy("k").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct("id").alias("d"),
        F.count("*").alias("n"))
    assert got.where("a <> 1 or b <> n or d <> n").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert sorted(map(tuple, latest(df, ["k"], F.col("t")).collect())) == [("a", 2, "y"), ("b", 1, "z")]


def scanned(spark, n=60):
    text = "\n".join("k%d = 'ghp_%s%04d'" % (i, A(32), i) for i in range(n))
    files = spark.createDataFrame([("s1", "a.py", text), ("s2", "b.py", "password = " + A(9)),
                                   ("s3", "c.py", "nothing")],
                                  "scan_id string, path string, content string")
    return scan_files(files, context_lines=1).cache()


def test_large_scan_becomes_several_documents(spark):
    docs = R.json_documents(scanned(spark), ["scan_id"], at_most=10).collect()
    big = [json.loads(d.document) for d in docs if d.scan_id == "s1"]
    assert 3 <= len(big) <= 6
    assert sorted(f["line"] for d in big for f in d["findings"]) == list(range(1, 61))
    assert [d.parts for d in docs if d.scan_id == "s2"] == [1]


def test_report_round_trip(spark, tmp_path):
    scans = spark.createDataFrame(
        [(s, "2024-05-01T10:00:00Z", "/x/" + s, "directory", "main", None, None, 7)
         for s in ("s1", "s2", "s3")],
        """scan_id string, timestamp string, path string, type string, git_branch string,
           git_commit string, git_remote string, scan_duration_ms bigint""")
    docs = R.report_documents(scanned(spark), scans)
    one = {d.scan_id: json.loads(d.document) for d in docs.collect()}
    assert one["s1"]["summary"]["findings_by_rule"] == {"github-pat": 60}
    assert one["s1"]["summary"]["findings_by_category"] == {"github": 60}
    assert one["s1"]["summary"]["severity_breakdown"] == {"high": 0, "medium": 0, "low": 60}
    assert [f["id"] for f in one["s1"]["findings"]] == list(range(1, 61))
    assert one["s3"]["findings"] == []
    for s, d in one.items():
        (tmp_path / f"{s}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "bad.json").write_text('{"findings": [')
    (tmp_path / "old.json").write_text(json.dumps(
        {"version": "1.0", "findings": [{"rule_id": "x", "file": "f", "line": 2, "column": 1, "secret": "*"}]}))
    reports = parse_reports(read_documents(spark, str(tmp_path)))
    s, f = W.import_reports(reports)
    assert sorted(r.total_findings for r in s.collect()) == [0, 1, 1, 60]
    assert f.count() == 62 and f.where("verification_status <> 'pending'").count() == 0
    assert S.corpus_statistics(reports).first().reports_with_findings == 3
    W.write_scans(s, str(tmp_path / "scans"))
    W.write_findings(f, s, str(tmp_path / "findings"))
    assert spark.read.parquet(str(tmp_path / "findings")).count() == 62


def test_sarif(spark):
    d = json.loads(R.sarif_documents(scanned(spark, 1), ["scan_id"]).where("scan_id = 's1'").first().document)
    result = d["runs"][0]["results"][0]
    assert d["version"] == "2.1.0" and result["ruleId"] == "github-pat"
    assert result["message"]["text"] == "Potential GitHub Personal Access Token detected"
    assert result["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 7}


def test_files_written(spark, tmp_path):
    found = scanned(spark, 2)
    R.write_documents(R.json_documents(found, ["scan_id"]), str(tmp_path / "docs"), ["scan_id"])
    assert (tmp_path / "docs" / "scan_id=s1").is_dir()
    f = spark.createDataFrame([("github-pat", "active"), ("npm-token", "active"), ("x", "unknown")],
                              "rule_id string, status string")
    S.write_by_program(f, str(tmp_path / "programs"))
    assert sorted(p.name for p in (tmp_path / "programs").glob("program=*")) == [
        "program=github", "program=other"]


def test_repo_list(spark, tmp_path):
    (tmp_path / "repos.txt").write_text("# c\n\nhttps://github.com/o/r\nhttps://gitlab.com/o/r\n")
    assert feeds.read_repo_list(spark, str(tmp_path / "repos.txt")).count() == 2


def test_programs(spark):
    progs = Q.rule_programs(Q.programs(spark))
    assert Q.programs(spark).count() == 13
    assert {r.rule_id for r in progs.where("program = 'GitHub'").collect()} == {
        "github-pat", "github-oauth", "github-fine-grained"}


def test_finding_detail(spark):
    from registry.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    f = t["queue_findings"]
    one = f.where("rule_id = 'github-pat'").agg(F.min("finding_id")).first()[0]
    detail, programs = Q.finding_detail(f, t["repos"], Q.programs(spark), F.col("finding_id") == one)
    assert detail.count() == 1 and "platform" in detail.columns
    assert [r.program for r in programs.collect()] == ["GitHub"]


def test_first_known_needs_no_join_of_all(spark):
    """Enough, too few and no survivors; ties; the last resort is the join of all."""
    from keysieve.operators.topk import first_known

    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 50).alias("k"),
                                    (F.col("id") % 7).alias("o"))
    order = [F.desc("o"), F.asc("id")]
    for known in (range(50), [3, 49], [], [77]):
        table = spark.createDataFrame([(k, f"n{k}") for k in known], "k long, name string")
        got = first_known(rows, table, ["k"], order, 10).select("id", "name").collect()
        want = sorted(((-(i % 7), i) for i in range(5000) if i % 50 in known))[:10]
        assert [(r.id, r.name) for r in got] == [(i, f"n{i % 50}") for _, i in want]
    rare = spark.createDataFrame([(k, "x") for k in (11,)], "k long, name string")
    assert [r.id for r in first_known(rows.where("id < 12 or k <> 11"), rare, ["k"], order, 3
                                      ).collect()] == [11]


def test_reports_of_any_size_have_one_shape(spark, tmp_path):
    """A scan of 60,000 findings, one of one and one of none, over several files."""
    findings = spark.range(60_001).select(
        F.when(F.col("id") == 60_000, "small").otherwise("big").alias("scan_id"),
        F.concat(F.lit("f"), F.col("id") % 900).alias("path"), F.col("id").cast("int").alias("line"),
        F.lit(1).alias("column"), F.lit(0).alias("pos"),
        F.concat(F.lit("rule-"), F.col("id") % 3).alias("rule_id"), F.lit("Rule").alias("rule_name"),
        F.lit("a...\n\"z").alias("secret"),
        F.array(F.struct(F.lit(1).alias("line"), F.lit("x").alias("content"))).alias("context"))
    scans = spark.createDataFrame(
        [(s, "t", "/p", "directory", None, None, None, 0) for s in ("big", "small", "none")],
        "scan_id string, timestamp string, path string, type string, git_branch string, "
        "git_commit string, git_remote string, scan_duration_ms long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.write_rows(R.report_rows(findings, scans), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = R.read_rows(spark, str(tmp_path)).orderBy("scan_id", "part", "line").collect()
    texts = {}
    for r in lines:
        texts[r.scan_id] = texts.get(r.scan_id, []) + [r.text]
    parsed = {s: json.loads("".join(t)) for s, t in texts.items()}
    assert {s: len(d["findings"]) for s, d in parsed.items()} == {"big": 60_000, "small": 1, "none": 0}
    assert [f["id"] for f in parsed["big"]["findings"]] == list(range(1, 60_001))
    assert parsed["big"]["summary"]["total_findings"] == 60_000 and parsed["none"]["scan_id"] == "none"
    whole = json.loads(R.report_documents(findings, scans, at_most=10 ** 6).where(
        "scan_id = 'small'").first().document)
    assert parsed["small"] == whole
    assert spark.read.parquet(f"{tmp_path}/index").select("part").distinct().count() > 1


def test_what_was_written_leaves_no_shuffle_and_no_copy(spark, tmp_path, monkeypatch):
    """The disk that writing reports takes is free afterwards, without the driver's garbage collection."""
    from keysieve import workspace

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (blocks.apply(i).getName() for i in range(blocks.size()))
        return {n for n in names if n.startswith("shuffle_")}

    rows = spark.range(3000).select((F.col("id") % 7).cast("string").alias("scan_id"),
                                    F.col("id").alias("nth"), F.lit("text").alias("text"))
    for module in (workspace, R):
        monkeypatch.setattr(module, "workspace", lambda _, name: f"{tmp_path}/{name}", raising=False)
    before = shuffles()
    R.write_rows(rows, str(tmp_path / "out"))
    copy = workspace.stored(rows.repartition(20, "scan_id"), "copy")
    assert sorted(f.name for f in tmp_path.iterdir()) == ["copy", "out"]
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(.2)
    assert not left and copy.count() == 3000
    assert R.read_rows(spark, str(tmp_path / "out")).count() == 3000


def test_an_import_that_is_repeated_counts_once(spark, tmp_path):
    scans = spark.createDataFrame(
        [(f"s{i}", f"2024-01-0{1 + i % 3}", "/p", None if i % 2 else "url", "main", 2) for i in range(9)],
        "scan_id string, timestamp string, target_path string, git_remote string, "
        "git_branch string, total_findings int").withColumn("timestamp", F.to_timestamp("timestamp"))
    findings = spark.createDataFrame(
        [(f"s{i % 9}", f"rule{i % 4}", "Rule", "active") for i in range(40)],
        "scan_id string, rule_id string, rule_name string, verification_status string")
    for number, chosen in ((0, "scan_id < 's4'"), (1, "scan_id >= 's4'"), (1, "scan_id >= 's4'")):
        W.add_import(scans.where(chosen), findings.where(chosen), str(tmp_path), number)
    states = W.read_states(spark, str(tmp_path))
    for fold, view in ((W.fold_scan_summary, W.scan_summary), (W.fold_security_stats, W.security_stats),
                       (W.fold_findings_by_repo, W.findings_by_repo)):
        want = view(scans, findings)
        assert sorted(map(str, fold(states).select(want.columns).collect())) == sorted(
            map(str, want.collect()))


def test_an_import_reads_its_findings_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(rule):
        read.add(1)
        return rule

    scans = spark.sql("SELECT 's' || id AS scan_id, timestamp'2024-01-01' AS timestamp, '/p' AS target_path, "
                      "null AS git_remote, 'main' AS git_branch, 2 AS total_findings FROM range(9)")
    findings = spark.range(40).select(
        F.expr("'s' || id % 9").alias("scan_id"), seen(F.expr("'rule' || id % 4")).alias("rule_id"),
        F.lit("Rule").alias("rule_name"), F.lit("active").alias("verification_status"))
    W.add_import(scans, findings, str(tmp_path), 0)
    assert read.value == 40
    assert spark.read.parquet(f"{tmp_path}/day_rules").count() == 4
