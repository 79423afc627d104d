"""Tables of a monitor that stay compact, a bounded seen set, a loop that is stopped and restarted."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from samples import token as A

from keysieve.streaming import monitor as M
from keysieve.streaming.ledger import Ledger

ROWS = "url string, n long"


def add(spark, ledger, number, urls, gone=()):
    rows = spark.createDataFrame([(u, number) for u in urls], ROWS)
    ledger.commit(number, rows, spark.createDataFrame([(u,) for u in gone], "url string"))


def left(ledger, number):
    return sorted((r.url, r.n) for r in ledger.before(number).collect())


def test_a_ledger_is_read_in_constant_time(spark, tmp_path):
    """Twenty batches that add and remove; some are removed and come back."""
    ledger, want, files = Ledger(spark, str(tmp_path), ROWS, "url", buckets=4, compact=5), {}, []
    for number in range(20):
        urls = [f"u{number}-{i}" for i in range(3)] + (["again"] if number % 4 == 0 else [])
        gone = [f"u{number - 2}-0"] + (["again"] if number % 4 == 2 else [])
        files.append(len(ledger.before(number).inputFiles()))
        add(spark, ledger, number, urls, gone)
        want |= {u: number for u in urls}
        want = {u: n for u, n in want.items() if u not in gone}
        if number in (3, 4, 5, 19):
            assert left(ledger, number + 1) == sorted(want.items())
    # a snapshot, and fewer than five folders of added and removed rows in four buckets
    assert max(files) <= 4 * (1 + 2 * 5) and max(files[10:]) <= max(files[:10])
    keys = spark.createDataFrame([("u19-1",)], "url string")
    assert len(ledger.before(20, keys).inputFiles()) <= 11
    assert ("u19-1", 19) in [(r.url, r.n) for r in ledger.before(20, keys).collect()]
    gone = ledger.expire(19)
    assert gone and left(ledger, 20) == sorted(want.items())
    assert ledger.expire(19) == []


def test_a_batch_that_fails_inside_a_compaction_runs_again(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path), ROWS, "url", buckets=2, compact=3)
    for number in range(2):
        add(spark, ledger, number, [f"u{number}", f"v{number}"])
    write = Ledger._write

    def broken(self, rows, kind, number):
        write(self, rows, kind, number)
        if kind == "snapshot":
            raise RuntimeError("lost")

    monkeypatch.setattr(Ledger, "_write", broken)
    with pytest.raises(RuntimeError):
        add(spark, ledger, 2, ["u2", "half"], ["v0"])
    monkeypatch.setattr(Ledger, "_write", write)
    add(spark, ledger, 2, ["u2"], ["v0"])  # the batch brings other rows now, and they count
    assert left(ledger, 3) == [("u0", 0), ("u1", 1), ("u2", 2), ("v1", 1)]
    add(spark, ledger, 3, ["u3"])
    assert len(left(ledger, 4)) == 5


def land(spark, folder, name, urls):
    rows = [(u, f"2024-01-01 00:00:{i:02d}") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "url string, ts string").coalesce(1).write.json(f"{folder}/{name}")


def test_a_bounded_seen_set_forgets_the_oldest(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")

    def cycle(n, urls):
        land(spark, feed, f"b{n}", urls)
        stream = spark.readStream.schema("url string, ts timestamp").json(f"{feed}/*")
        M.first_seen_bounded(stream, state, most=6, kept=3).awaitTermination()
        rows = spark.read.parquet(f"{state}/new").where(f"batch = {n}").collect()
        return sorted(r.url for r in rows)

    assert cycle(0, ["a", "b", "c", "d"]) == ["a", "b", "c", "d"]
    assert cycle(1, ["a", "e", "f", "a"]) == ["e", "f"]          # six, so none is forgotten
    assert cycle(2, ["d", "g"]) == ["g"]                          # seven: e, f, g stay
    assert cycle(3, ["f", "a", "g", "d"]) == ["a", "d"]           # forgotten, so new again
    seen = M.Ledger(spark, f"{state}/seen", "url string, ts timestamp", "url")
    assert {r.url for r in seen.before(4).collect()} == {"a", "d", "e", "f", "g"}


def test_the_loop_ends_by_a_failing_batch_and_goes_on(spark, tmp_path, monkeypatch):
    """The interval trigger, a batch that fails after it has queued, and a restart."""
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    files = spark.createDataFrame([(f"u{i}", "a.py", "password = " + A(9)) for i in range(9)],
                                  "repo string, path string, content string")
    plain, calls = M.scan_files, []

    def fails_once(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("scanner lost")
        return plain(*args, **options)

    monkeypatch.setattr(M, "scan_files", fails_once)

    def start():
        urls = spark.readStream.schema("url string, found_at timestamp").option(
            "maxFilesPerTrigger", 1).json(f"{feed}/*")
        return M.monitor(urls, state, files=files, per_cycle=4, once=False, interval="1 second")

    def land(name, urls):
        rows = [(u, f"2024-01-01 00:00:{i:02d}") for i, u in enumerate(urls)]
        spark.createDataFrame(rows, "url string, found_at string").coalesce(1).write.json(
            f"{feed}/{name}")

    land("b0", [f"u{i}" for i in range(5)])
    loop = start()
    until = time.time() + 60
    while not loop.lastProgress and time.time() < until:
        time.sleep(0.5)
    land("b1", ["u0", "u5", "u6"])
    with pytest.raises(StreamingQueryException, match="scanner lost"):
        loop.awaitTermination(60)
    loop = start()
    try:
        land("b2", ["u7", "u8", "u1"])
        until = time.time() + 60
        while time.time() < until and M.read_state(spark, state, "cycles").count() < 3:
            time.sleep(1)
    finally:
        loop.stop()
    scanned = [r.url for r in M.read_state(spark, state, "scanned").collect()]
    assert sorted(scanned) == [f"u{i}" for i in range(9)]
    found = [r.repo for r in M.read_state(spark, state, "findings").collect()]
    assert sorted(found) == sorted(scanned)
    rows = M.read_state(spark, state, "cycles").orderBy("batch").collect()
    assert [(r.queued, r.scanned, r.reports) for r in rows] == [(1, 4, 4), (0, 3, 3), (0, 2, 2)]
