from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keysieve.operators.resolve import resolve


def plain_fold(hits):
    kept = []
    for h in sorted(hits):
        near = [k for k in kept if abs(h[1] - (k[1] + 1)) < 15]
        if any(k[2] >= h[2] for k in near):
            continue
        kept = [k for k in kept if k not in near] + [h]
    return kept


_line = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 4)), min_size=1, max_size=8)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_line, min_size=40, max_size=60))
def test_fold_equals_a_plain_one(spark, lines):
    rows, want = [], {}
    for n, hits in enumerate(lines):
        full = [(i, col, spec) for i, (col, spec) in enumerate(hits)]
        want[n] = [h[0] for h in plain_fold(full)]
        rows += [(n, i, 0, f"r{i}", "R", "prefix", spec, "m", "s", col) for i, col, spec in full]
    df = spark.createDataFrame(rows, """line int, ord int, trig_ord int, rule_id string,
        rule_name string, kind string, specificity int, matched string, secret_raw string,
        col0 int""")
    got = {}
    for r in resolve(df, ["line"]).orderBy("line", "pos").collect():
        got.setdefault(r.line, []).append(r.ord)
    assert got == want


def test_first_trigger_of_a_rule_counts(spark):
    rows = [(1, 5, 1, "r", "R", "keyvalue", 3, "second", "s", 0),
            (1, 5, 0, "r", "R", "keyvalue", 3, "first", "s", 40)]
    df = spark.createDataFrame(rows, """line int, ord int, trig_ord int, rule_id string,
        rule_name string, kind string, specificity int, matched string, secret_raw string,
        col0 int""")
    assert [r.matched for r in resolve(df, ["line"]).select(F.col("matched")).collect()] == ["first"]
