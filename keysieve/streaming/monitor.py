"""Continuous discovery and scanning with Structured Streaming.

Every table a stream writes has one folder per micro-batch, which a repeated batch
overwrites.  A batch reads only what batches before it wrote.  So a batch that runs
again after a failure gives the same result, and nothing is written twice.

What a cycle has to know of earlier ones, the URLs it has seen and those still queued, it reads
from ledgers, which stay compact; the folders of cycles are for reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keysieve.operators.skew import latest
from keysieve.plans.scan import scan_files
from keysieve.sources.rules import RuleSet
from keysieve.streaming.ledger import Ledger

INTERVAL = "30 minutes"
PER_CYCLE = 50


def _start(stream: DataFrame, each, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(
        processingTime=interval)
    return writer.start()


def _write(df: DataFrame, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def _create(spark: SparkSession, table: str, schema: str) -> None:
    """An empty first batch, so that the table can be read from the start."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{table}/batch=-1")


# --- scanning arriving files ------------------------------------------------------------


def scan_stream(files: DataFrame, table: str, checkpoint: str, rules: RuleSet | None = None,
                once: bool = True, interval: str = INTERVAL, **options) -> StreamingQuery:
    """Scan files as they arrive and append their findings to ``table``.

    A file arrives whole, in one row, so each batch is a scan like any other.
    """
    def each(batch: DataFrame, number: int) -> None:
        _write(scan_files(batch, rules, **options), table, number)

    return _start(files, each, checkpoint, once, interval)


# --- the seen set -------------------------------------------------------------------------


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_on_disk(spark: SparkSession) -> None:
    """Streams started from here on keep their state in RocksDB, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def first_seen(urls: DataFrame) -> DataFrame:
    """Each URL once, ever.  The state grows with the number of URLs: see ``state_on_disk``."""
    return urls.dropDuplicates(["url"])


def first_seen_within(urls: DataFrame, memory: str = "90 days", ts: str = "ts") -> DataFrame:
    """Each URL once, until it was not seen for ``memory``: bounded state."""
    return urls.withWatermark(ts, memory).dropDuplicatesWithinWatermark(["url"])


MOST, KEPT = 100_000, 50_000


def first_seen_bounded(urls: DataFrame, state: str, most: int = MOST, kept: int = KEPT,
                       once: bool = True, interval: str = INTERVAL) -> StreamingQuery:
    """Each URL of the arriving (url, ts) once, until it is forgotten.

    When more than ``most`` URLs are remembered, only the ``kept`` that came last stay: a URL
    that was forgotten is new again.  ``new`` has the new URLs of each batch.
    """
    seen = Ledger(urls.sparkSession, f"{state}/seen", "url string, ts timestamp", "url")

    def each(batch: DataFrame, number: int) -> None:
        first = latest(batch.select("url", "ts"), ["url"], F.col("ts"), last=False)
        known = seen.before(number, first)
        _write(first.join(known, "url", "left_anti"), f"{state}/new", number)
        new = seen.spark.read.parquet(f"{state}/new/batch={number}")
        seen.commit(number, new, most=most, keep=kept, order=("ts", "url"))

    return _start(urls, each, f"{state}/checkpoint", once, interval)


# --- the monitor: discover, queue, scan -----------------------------------------------------

_DISCOVERED = "url string, found_at timestamp, priority int"
_SCANNED = "url string"
_CYCLES = "queued long, scanned long, reports long"


def monitor(urls: DataFrame, state: str, files: DataFrame | None = None,
            rules: RuleSet | None = None, per_cycle: int = PER_CYCLE, once: bool = True,
            interval: str = INTERVAL) -> StreamingQuery:
    """Queue the new ones of the arriving (url, found_at) and scan some each cycle.

    At most ``per_cycle`` repositories are scanned per cycle, the most urgent first (by
    ``priority``, if the feed has one), then the longest known; the others stay queued.  A repository is scanned once, whatever comes of it.
    ``files`` (repo, path, content) holds what is scanned, if given.  ``cycles`` counts the
    repositories still queued, those scanned, and those of them with a report of findings.
    """
    spark = urls.sparkSession
    found_table, done_table = f"{state}/discovered", f"{state}/scanned"
    _create(spark, found_table, _DISCOVERED)
    _create(spark, done_table, _SCANNED)
    _create(spark, f"{state}/cycles", _CYCLES)

    seen = Ledger(spark, f"{state}/seen", "url string", "url")
    waiting = Ledger(spark, f"{state}/queue", _DISCOVERED, "url")

    def each(batch: DataFrame, number: int) -> None:
        rank = F.col("priority") if "priority" in batch.columns else F.lit(5)
        first = latest(batch.select("url", "found_at", rank.cast("int").alias("priority")),
                       ["url"], F.col("found_at"), last=False)
        _write(first.join(seen.before(number, first), "url", "left_anti"), found_table, number)
        new = spark.read.schema(_DISCOVERED).parquet(f"{found_table}/batch={number}")
        queue = waiting.before(number).drop("batch").unionByName(new)
        _write(queue.orderBy(F.desc("priority"), "found_at", "url").limit(per_cycle).select("url"),
               done_table, number)
        chosen = spark.read.schema(_SCANNED).parquet(f"{done_table}/batch={number}")
        seen.commit(number, new)
        waiting.commit(number, new, chosen)
        reports = chosen.limit(0)
        if files is not None:
            # Spark sees how few they are, if they are few
            todo = files.join(chosen, files["repo"] == chosen["url"], "left_semi")
            _write(scan_files(todo, rules), f"{state}/findings", number)
            reports = spark.read.parquet(f"{state}/findings/batch={number}").select(
                "repo").distinct()
        left = waiting.before(number + 1)
        both = left.select(F.lit(0).alias("done")).unionByName(
            chosen.select(F.lit(1).alias("done"))).unionByName(
            reports.select(F.lit(2).alias("done")))
        _write(both.agg(F.count_if(F.col("done") == 0).alias("queued"),
                        F.count_if(F.col("done") == 1).alias("scanned"),
                        F.count_if(F.col("done") == 2).alias("reports")), f"{state}/cycles", number)

    return _start(urls, each, f"{state}/checkpoint", once, interval)


def read_state(spark: SparkSession, state: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{state}/{table}").where(F.col("batch") >= 0)


def summary(spark: SparkSession, state: str) -> DataFrame:
    """Where the monitor stands: repositories queued, scanned and reported, cycles run."""
    return read_state(spark, state, "cycles").agg(
        F.max_by("queued", "batch").alias("queued"), F.sum("scanned").alias("scanned"),
        F.count("*").alias("cycles"), F.sum("reports").alias("reports"))
