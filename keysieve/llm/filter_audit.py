"""What each filter removes in every order of filters, kept up to date by a stream.

All files of the documents arrive as micro-batches of an available-now stream.

1. Each task judges texts: bits of the filters that a text fails by itself, and a digest.
   Of equal texts in an Arrow batch only those with the smallest doc_id go on to the state;
   the others fail ``E`` whatever still comes, so their masks are final.
2. State is kept per text (its SHA-256): the smallest doc_id so far and the rows that have it.
   A smaller one retracts the earlier rows' masks (-1) and counts them again with ``E`` (+1).
   Some ``TEXTS`` texts share one entry of the state store, whatever the size of the table,
   because Python is called once per entry.
3. Every micro-batch writes these changes to a folder of its own, which a repeated batch
   overwrites; their sums by part, mask and label are the counters.  The report of all 120
   orders is arithmetic on the counters: 32 masks and four kinds of labels a part.

Null texts are empty, null languages are ''; a document is good (toxic) if any of its rows in
``labels`` says so.  Rows that share doc_id and text do not make each other fail ``E``; a
null doc_id is no smaller than any and never fails ``E``.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import marshal
import math
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keysieve.llm.shared import chunks, raw, workspace

FILTERS = "ABCDE"
E = 1 << FILTERS.index("E")
ROUNDS = 8  # micro-batches, however large the table is
NO_ID = 1 << len(FILTERS)  # marks the mask of a row without doc_id
TEXTS = 256  # texts per entry of the state store
_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
_JUDGED = "slot long, key binary, doc_id long, part string, mask int, final boolean"
_CHANGES = "doc_id long, part string, mask int, n long"
_STEPS = "array<struct<filter_order: string, step: int, own: int, earlier: int>>"


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _UPPER))
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
            | (100 * capitals > 10 * points) << 2
            | (len(text.translate(None, _SIGNS)) < len(text)) << 3)


def judged(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Rows for the state, and final changes, of batches of (doc_id, text, part)."""
    for batch in chunks(batches):
        ids, parts, least, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), {}, []
        for doc, text, part in zip(ids, raw(batch.column(1)), parts):
            text = text or b""
            key = hashlib.sha256(text).digest()
            if key not in least:
                least[key] = [failures(text), doc]
            elif doc is not None and (least[key][1] is None or doc < least[key][1]):
                least[key][1] = doc
            rows.append((key, doc, part))
        out = []
        for nth, (key, doc, part) in enumerate(rows):
            (mask, first), slot = least[key], int.from_bytes(key[:8])
            if doc is None:  # pandas would make the ids of a column with nulls inexact
                out.append(((slot + nth) % slots, key, 0, part, mask | NO_ID, True))
            elif doc > first:  # needs no state, so it may go anywhere
                out.append(((slot + nth) % slots, key, doc, part, mask | E, True))
            else:
                out.append((slot % slots, key, doc, part, mask, False))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else
            [pa.array([], k) for k in kinds], ["slot", "key", "doc_id", "part", "mask", "final"])


def retract(texts: dict, rows) -> list[tuple]:
    """Changes of the counters by rows (key, doc_id, part, mask); ``texts`` holds the smallest
    doc_id of each text so far, its mask, and how many rows of each part have it."""
    out = []
    for key, doc, part, mask in rows:
        first, _, held = texts.get(key, (None, 0, None))
        if first is not None and doc > first:
            out.append((doc, part, mask | E, 1))
            continue
        if doc != first:
            for p, m in (held or {}).items():
                out += [(first, p, mask, -m), (first, p, mask | E, m)]
            held = {}
            texts[key] = (doc, mask, held)
        held[part] = held.get(part, 0) + 1
        out.append((doc, part, mask, 1))
    return out


def update(slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    texts, out = marshal.loads(state.get[0]) if state.exists else {}, []
    for rows in parts:
        final = rows["final"].to_numpy()
        columns = [rows[c] for c in ("key", "doc_id", "part", "mask")]
        out += zip(*(c[final].tolist() for c in columns[1:]), [1] * int(final.sum()))
        out += retract(texts, zip(*(c[~final].tolist() for c in columns)))
    state.update((marshal.dumps(texts),))
    yield pd.DataFrame(out, columns=["doc_id", "part", "mask", "n"])


def changes(spark: SparkSession, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, part, mask, n: changes of all micro-batches; their sums are the counts."""
    docs = spark.read.parquet(path)
    folder = workspace(spark, "filter-audit")
    spark.createDataFrame([], _CHANGES).write.parquet(f"{folder}/changes/batch=-1")
    files = len(docs.inputFiles())
    # as a pattern, because a stream takes a plain path for a folder
    arriving = (spark.readStream.schema(docs.schema)
                .option("maxFilesPerTrigger", max(1, math.ceil(files / rounds)))
                .parquet(f"{path[:-1]}[{path[-1]}]"))
    rows = arriving.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                           F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    slots = max(64, math.ceil(docs.count() / TEXTS))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return judged(batches, slots)

    changed = rows.mapInArrow(judge, _JUDGED).groupBy("slot").applyInPandasWithState(
        update, _CHANGES, "texts binary", "update", GroupStateTimeout.NoTimeout)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    stream = (changed.writeStream.foreachBatch(each).outputMode("update")
              .option("checkpointLocation", f"{folder}/checkpoint")
              .trigger(availableNow=True).start())
    stream.awaitTermination()
    return spark.read.schema(f"{_CHANGES}, batch int").parquet(f"{folder}/changes").select(
        F.when(F.col("mask") < NO_ID, F.col("doc_id")).alias("doc_id"), "part",
        (F.col("mask") % NO_ID).alias("mask"), "n")


def counters(changed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # what a retraction has cancelled is gone before the labels are joined
    left = changed.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    return left.join(known, left["doc_id"] == known["labelled"], "left").groupBy(
        "part", "mask", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    steps = []
    for order in permutations(FILTERS):
        earlier = 0
        for nth, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            steps.append({"filter_order": "".join(order), "step": nth, "own": own,
                          "earlier": earlier})
            earlier |= own
    # 600 steps and at most 128 counters a part
    each = F.explode(F.from_json(F.lit(json.dumps(steps)), _STEPS)).alias("s")
    mask, own, earlier = (F.col(c) for c in ("mask", "own", "earlier"))
    fails, before = mask.bitwiseAND(own) != 0, mask.bitwiseAND(earlier) != 0

    def total(when, weight: str = "n"):
        return F.sum(F.when(when, F.col(weight)).otherwise(0))

    lost = counts.withColumn("good", F.col("good") * F.col("n")).withColumn(
        "toxic", F.col("toxic") * F.col("n"))
    rows = lost.select("*", each).select("*", "s.*").groupBy(
        "part", "filter_order", "step", "own").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"), total(mask == own).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"))
    shares = rows.groupBy(F.col("part").alias("p_"), F.col("own").alias("o_")).agg(
        F.sum("removed").alias("shapley"))
    return rows.join(shares, (F.col("part") == F.col("p_")) & (F.col("own") == F.col("o_"))).drop(
        "p_", "o_", "own")


def audit(spark: SparkSession, path: str, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley: all orders of the filters over the documents at ``path``."""
    return report(counters(changes(spark, path, rounds), labels))
