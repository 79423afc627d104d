from samples import token as A
from pyspark.sql import functions as F

from keysieve.plans.scan import scan_files
from keysieve.sources import files as S


def table(spark, *rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_context_is_clamped_and_blotted(spark):
    text = "a\npassword = '%s'\nb\ntoken = '%s'\nuse %s" % (A(12), A(24), A(12))
    found = scan_files(table(spark, ("r", "f", text)), context_lines=1, hide="own")
    rows = {r.rule_id: [(c.line, c.content, c.is_match) for c in r.context]
            for r in found.collect()}
    assert rows["generic-password"] == [
        (1, "a", False), (2, "password = 'a1b...5f6'", True), (3, "b", False)]
    assert [c[0] for c in rows["generic-token"]] == [3, 4, 5]
    assert A(12) in rows["generic-token"][2][1]


def test_context_hides_all_secrets_in_view(spark):
    text = "password = '%s'\ntoken = '%s'" % (A(12), A(24))
    found = scan_files(table(spark, ("r", "f", text)), context_lines=3).collect()
    assert len(found) == 2
    for r in found:
        assert all(A(12) not in c.content for c in r.context)


def test_findings_carry_no_raw_secret(spark):
    found = scan_files(table(spark, ("r", "f", "password = " + A(12))))
    assert "secret_raw" not in found.columns
    assert A(12) not in str(found.collect())


def test_line_endings(spark):
    f = table(spark, ("r", "f", "a\r\nb\n\nc\r"), ("r", "g", ""), ("r", "h", "x\n"))
    got = [(r.path, r.line, r.text) for r in S.explode_lines(f).orderBy("path", "line").collect()]
    assert got == [("f", 1, "a"), ("f", 2, "b"), ("f", 3, ""), ("f", 4, "c\r"), ("h", 1, "x")]


def test_paths(spark):
    paths = {
        "src/a.py": True, ".env": True, "a/.env": True, "node_modules/x.js": False,
        "a/node_modules": False, "a/.hidden/b.txt": False, "./a.txt": True, "../b.txt": True,
        "yarn.lock": False, "a/Yarn.lock": True, "x.PNG": False, ".png": True, "a.b.tar": False,
        "a/build/x": False, "builds/x": True, ".git/config": False, "a.": True, "o": True, "b.o": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.ok for r in df.select("path", S.scannable(F.col("path")).alias("ok")).collect()}
    assert got == paths


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("password = '%s'" % A(12))
    (tmp_path / "src" / "b.bin").write_bytes(b"password = '\xff" + A(12).encode() + b"'")
    (tmp_path / "node_modules" / "x.js").write_text("password = '%s'" % A(12))
    found = scan_files(S.text_files(S.read_tree(spark, str(tmp_path))), context_lines=0).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["a.py"]


def test_large_file(spark):
    """1,100 secrets in one file, all found."""
    lines = []
    for i in range(1100):
        lines += ["x = %d" % i, "key%d = 'ghp_%s%04d'" % (i, A(32), i), "note"]
    found = scan_files(table(spark, ("r", "f", "\n".join(lines))), context_lines=0)
    assert found.select("line").distinct().count() == 1100


def test_plan_reads_the_corpus_once(spark):
    """No join or second scan for context; one shuffle to resolve, one to blot."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "source AS repo", "cast(doc_id as string) AS path", "text AS content")
    plan = scan_files(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan


def test_pieces_change_nothing(spark, monkeypatch):
    """Lines and contexts of a file searched in pieces are those of the whole file."""
    from keysieve.plans import scan

    lines = [f"password = '{A(12)}{i}'" if i % 3 else f"line {i}" for i in range(23)]
    files = table(spark, ("r", "f", "\n".join(lines)), ("r", "g", lines[1]), ("r", "h", ""))

    def found(context_lines):
        rows = scan_files(files, context_lines=context_lines, keep_raw=True)
        return sorted(map(str, rows.collect()))

    whole = [found(n) for n in (0, 1, 3)]
    assert len(whole[0]) == 16
    for piece in (1, 2, 5, 23):
        monkeypatch.setattr(scan, "PIECE", piece)
        assert [found(n) for n in (0, 1, 3)] == whole
