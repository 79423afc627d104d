"""A table that micro-batches add rows to and remove keys from, read in constant time.

Rows live in hash buckets of their key.  A batch writes what it adds and removes into folders
of its own; every ``COMPACT`` batches these and the last snapshot become a new snapshot.  The
batch's manifest names the snapshot and the folders that make up the table behind it, so a
batch reads one manifest, one snapshot and fewer than ``COMPACT`` folders, and of these only
the buckets of its keys, however many batches there were.

A batch reads the manifest of the batch before it and nothing that a batch overwrites is named
there, so a batch that runs again after a failure, in the middle of a compaction too, leaves
the same table.  Folders of old snapshots stay until ``expire`` is called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = 8
BUCKETS = 64
_MANIFEST = "snapshot long, folders array<bigint>, n long"


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    root: str
    schema: str  # of the rows; the key is one of the columns
    key: str
    buckets: int = BUCKETS
    compact: int = COMPACT

    # --- what a batch reads ---------------------------------------------------------------

    def manifest(self, number: int):
        """The manifest of the table as batch ``number`` finds it: snapshot, folders, n."""
        if number <= 0:
            return None, [], 0
        row = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/at={number - 1}").first()
        return row.snapshot, list(row.folders), row.n

    def _read(self, kind: str, numbers: list, schema: str, only: list | None) -> DataFrame:
        columns = f"{schema}, batch long, at long, bucket int"
        paths = [f"{self.root}/{kind}/at={n}" for n in numbers]
        rows = (self.spark.read.schema(columns).option("basePath", f"{self.root}/{kind}")
                .parquet(*paths) if paths else self.spark.createDataFrame([], columns)).drop("at")
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def before(self, number: int, keys: DataFrame | None = None) -> DataFrame:
        """The rows that batches before ``number`` left, with the batch that added them.

        ``keys`` (a table with the key column) restricts the reading to the buckets they are in:
        the rows that come back hold all rows of these keys, and others.
        """
        snapshot, folders, _ = self.manifest(number)
        only = None if keys is None else [r.b for r in keys.select(
            self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        rows = self._read("added", folders, self.schema, only)
        if snapshot is not None:
            rows = rows.unionByName(self._read("snapshot", [snapshot], self.schema, only))
        if not folders:
            return rows.drop("bucket")
        gone = self._read("removed", folders, f"{self.key} string", only).groupBy(self.key).agg(
            F.max("batch").alias("gone_"))
        return rows.join(gone, self.key, "left").where(
            "gone_ is null or gone_ < batch").drop("bucket", "gone_")

    # --- what a batch writes -----------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        # a bucket's rows in one file, unless Spark's adaptive execution splits it
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}/at={number}")

    def commit(self, number: int, added: DataFrame, removed: DataFrame | None = None,
               most: int | None = None, keep: int | None = None, order: tuple = ()) -> None:
        """Add rows and remove keys as batch ``number``.

        If more than ``most`` rows are left, only the ``keep`` newest stay: those of the last
        batches, and of the oldest of these the last ones in ``order``.
        """
        names = self.spark.createDataFrame([], self.schema).columns
        self._write(added.select(*names, F.lit(number).cast("long").alias("batch")),
                    "added", number)
        if removed is None:
            removed = added.select(self.key).limit(0)
        self._write(removed.select(self.key, F.lit(number).cast("long").alias("batch")),
                    "removed", number)
        snapshot, folders, _ = self.manifest(number)
        self._note(number, snapshot, [*folders, number], 0)
        rows = self.before(number + 1)
        n = rows.count() if most is not None else 0
        if most is not None and n > most:
            self._write(_newest(rows, keep, order), "snapshot", number)
            self._note(number, number, [], keep)
        elif len(folders) + 1 >= self.compact:
            self._write(rows, "snapshot", number)
            self._note(number, number, [], n)
        elif n:
            self._note(number, snapshot, [*folders, number], n)

    def _note(self, number: int, snapshot, folders: list, n: int) -> None:
        self.spark.createDataFrame([(snapshot, folders, n)], _MANIFEST).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.root}/manifest/at={number}")

    def expire(self, number: int) -> list[str]:
        """Delete what neither the manifest of batch ``number`` nor the one before it names."""
        used = {"manifest": {number, number - 1}, "snapshot": set(), "added": set()}
        for at in (number, number + 1):
            snapshot, folders, _ = self.manifest(at)
            used["snapshot"] |= {snapshot} - {None}
            used["added"] |= set(folders)
        used["removed"] = used["added"]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for kind, numbers in used.items():
            folder = path(f"{self.root}/{kind}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                name = f.getPath().getName()
                at = int(name.removeprefix("at="))
                if at not in numbers and at <= number:
                    fs.delete(f.getPath(), True)
                    gone.append(f"{kind}/{name}")
        return sorted(gone)


def _newest(rows: DataFrame, keep: int, order: tuple) -> DataFrame:
    """The ``keep`` newest rows: whole batches by their counts, and the rest of one batch."""
    counts = rows.groupBy("batch").agg(F.count("*").alias("n")).orderBy(F.desc("batch")).collect()
    left, cut = keep, None
    for r in counts:
        if r.n > left:
            cut = r.batch
            break
        left -= r.n
    if cut is None:
        return rows
    part = rows.where(F.col("batch") == cut).orderBy(*[F.desc(c) for c in order]).limit(left)
    return rows.where(F.col("batch") > cut).unionByName(part)
