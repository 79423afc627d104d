from samples import token as A
from pyspark.sql import functions as F

from keysieve.streaming import monitor as M


def land(spark, folder, name, urls):
    rows = [(u, f"2024-01-01 00:00:{i:02d}") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "url string, found_at string").coalesce(1).write.json(f"{folder}/{name}")


def test_cycles_carry_over_and_scan_once(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    files = spark.createDataFrame(
        [(f"u{i}", "a.py", "password = " + A(9)) for i in range(7)],
        "repo string, path string, content string")

    def cycle():
        urls = spark.readStream.schema("url string, found_at timestamp").json(f"{feed}/*")
        M.monitor(urls, state, files=files, per_cycle=3).awaitTermination()

    land(spark, feed, "b0", [f"u{i}" for i in range(5)])
    cycle()
    land(spark, feed, "b1", ["u0", "u5", "u6", "u1"])
    cycle()
    scanned = [r.url for r in M.read_state(spark, state, "scanned").orderBy("batch", "url").collect()]
    assert len(scanned) == len(set(scanned)) == 6
    assert set(scanned[:3]) == {"u0", "u1", "u2"}
    cycles = [(r.queued, r.scanned, r.reports) for r in M.read_state(spark, state, "cycles").orderBy("batch").collect()]
    assert cycles == [(2, 3, 3), (1, 3, 3)]
    assert tuple(M.summary(spark, state).first()) == (1, 6, 2, 6)
    assert M.read_state(spark, state, "findings").select("repo").distinct().count() == 6
    assert M.read_state(spark, state, "discovered").count() == 7


def test_scan_stream_is_the_batch_scan(spark, tmp_path):
    land_dir, home = str(tmp_path / "files"), str(tmp_path / "home")
    rows = [("r", f"f{i}.py", "x\npassword = " + A(9)) for i in range(10)]
    schema = "repo string, path string, content string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(land_dir)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land_dir)
    M.scan_stream(stream, f"{home}/t", f"{home}/c", context_lines=1).awaitTermination()
    got = spark.read.parquet(f"{home}/t")
    assert got.count() == 10 and got.select("batch").distinct().count() == 3
    assert got.where(F.size("context") != 2).count() == 0
