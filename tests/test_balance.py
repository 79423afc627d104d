"""Tables of narrow rows are spread by rows, not by bytes."""

from keysieve.sources import files as S


def test_tasks_have_few_rows_whatever_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 1000)
    for n, tasks in ((500, 8), (40_500, 41)):
        path = str(tmp_path / str(n))
        spark.range(n).coalesce(1).write.parquet(path)
        spread = S.balance(spark.read.parquet(path))
        assert spread.rdd.getNumPartitions() == tasks
        assert spread.count() == n and spread.distinct().count() == n


def test_rows_are_dealt_without_sorting_the_splits(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(S, "ROWS", 1000)
    path = str(tmp_path / "t")
    spark.range(40_000).selectExpr("if(id % 2 = 0, null, id) AS a", "1 AS b").coalesce(1).write.parquet(path)
    spread = S.balance(spark.read.parquet(path))
    spread.explain()
    assert "RoundRobin" not in capsys.readouterr().out
    assert max(spread.rdd.glom().map(len).collect()) < 1500  # also where rows are equal
    assert spread.columns == ["a", "b"] and spread.where("a is null").count() == 20_000
