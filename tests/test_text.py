from pyspark.sql import functions as F

from keysieve.functions import identity as I
from keysieve.functions import text as T


def values(spark, fn, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_redact(spark):
    assert values(spark, T.redact, ["abc", "1234567890", "12345678901", "é" * 11, "a" * 16 + "b" * 4]) == [
        "***", "*" * 10, "12...01", "éé...éé", "aaaa...bbbb"]


def test_elide(spark):
    assert values(spark, lambda c: T.elide(c, 5), ["abcde", "abcdef", ""]) == ["abcde", "ab…ef", ""]
    assert values(spark, lambda c: T.elide(c, 1), ["a", "ab"]) == ["a", "…"]


def test_placeholders(spark):
    yes = ["changeme", "ROOT", "${X}", "{{y}}", "<z>", "a...b", "put_it_here", "your-thing", "my_x",
           "a_example", "process.env.X", "env(A)", "xxx", "XXXXXXXX", "ghp_xxxxxxxx", "u:pass@h",
           "x@example.com"]
    no = ["", "xx", "rooted", "example1", "a_examples", "ghp_xxxxxxx", "xxxy", "hello world"]
    assert values(spark, T.is_placeholder, yes) == [True] * len(yes)
    assert values(spark, T.is_placeholder, no) == [False] * len(no)


def test_code(spark):
    assert values(spark, T.is_code_pattern, ["a.get(x", "x.value", "a->b", "f(x)", "self.x", "x['a"]) == [True] * 6
    assert values(spark, T.is_code_pattern, ["a(b", "myself.x", "abc"]) == [False] * 3
    yes = ["a.b", "a[0", "f(", "$X", "@x", "#x", "*x", "a_b", "_"]
    no = ["http.x", "ya29.x", "eyJ.x", "abc", "a_B", "a_1", ""]
    assert values(spark, T.looks_like_code, yes) == [True] * len(yes)
    assert values(spark, T.looks_like_code, no) == [False] * len(no)


def test_sql_and_column_forms_agree(spark):
    rows = ["changeme", "a.b", "f(x)", "a_b", "http://x.y", "LOCALHOST", "$x", "", "é_ü", "eyJ.a"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    v = F.col("v")
    for sql, col in [(T.placeholder_sql, T.is_placeholder), (T.code_pattern_sql, T.is_code_pattern),
                     (T.looks_like_code_sql, T.looks_like_code), (T.localhost_sql, T.is_localhost)]:
        assert df.where(F.expr(sql("v")) != col(v)).count() == 0


def test_names(spark):
    urls = ["https://github.com/o/r.git", "https://github.com/o/r///", "git@github.com:o/r.git",
            "git@host:r", "host:a@b", "plain", "https://x/.git"]
    assert values(spark, I.repo_name, urls) == ["r", "r", "r", "r", None, None, None]


def test_canonical(spark):
    urls = ["https://github.com/o/r/issues/3", "https://github.com/o/r.git",
            "https://gitlab.com/g/p/-/x", "https://github.com/o/r#top"]
    assert values(spark, I.canonical_url, urls) == [
        "https://github.com/o/r.git", "https://github.com/o/r.git",
        "https://gitlab.com/g/p.git", "https://github.com/o/r.git"]


def test_json_escape(spark):
    assert values(spark, T.json_escape, ['a"b\\c\n\td']) == ['a\\"b\\\\c\\n\\td']
