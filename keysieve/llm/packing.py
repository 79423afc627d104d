"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens.  In each round a queue earns its quantum,
which is its share of a window; it is served one lump whenever its deficit covers a lump,
and keeps the rest of the deficit for the next round, whichever window or partition that
falls in.  The lumps form one stream that is cut into windows, so all windows are full but
the last.  A queue that has run dry leaves its turns to the others.

With lumps of one size the state of the round-robin has a closed form: after round r, queue
s has been served floor(r * quantum / lump) lumps or all it has.  So each task places its
own documents from the totals of the queues alone, of which there are at most
``1 / LEAST_SHARE`` + 1 by construction, and no task walks the stream.

Nulls and repeats: a null text is empty (its document is the end id alone), rows without
source are a queue of their own, repeated rows are packed as often as they stand there.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks, stored
from keysieve.llm.tokens import encoder

LEAST_SHARE = 0.001  # sources with less of the tokens share one queue, unless named
UNIT = 1024  # quanta are counted in parts of a token

_ROWS = "part int, doc_id long, source string, n long, before long, ids binary"
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, queue int")


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """One row per document: its ids, and the tokens of its source earlier in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], coder.type).tobytes()
        for batch in chunks(batches):
            ids = [coder.encode(t) + end for t in batch.column(2).to_pylist()]
            n, before = [len(x) // coder.type.itemsize for x in ids], []
            sources = batch.column(1).to_pylist()
            for s, k in zip(sources, n):
                before.append(seen.get(s, 0))
                seen[s] = before[-1] + k
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), batch.column(0),
                 pa.array(sources, pa.string()), pa.array(n, pa.int64()),
                 pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "doc_id", "source", "n", "before", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"),
                       F.col("text").cast("string")).mapInArrow(run, _ROWS)


def _queues(sums: DataFrame, mixture: Mapping[str, float] | None):
    """(source, queue) of the sources with a queue of their own, tokens and shares by queue.

    Queue 0 holds all other sources.  Without a mixture, the share of a queue is its share
    of the tokens, so that all run dry together.
    """
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    if mixture is None:
        own = totals.where(F.col("n") >= LEAST_SHARE * whole)
    else:
        if len(mixture) > 1 / LEAST_SHARE:
            raise ValueError(f"a mixture names at most {1 / LEAST_SHARE:.0f} sources")
        own = totals.where(F.col("source").isin(list(mixture)))
    own = sorted(own.collect(), key=lambda r: (r.source is None, r.source or ""))
    tokens = np.array([whole - sum(r.n for r in own), *[r.n for r in own]], np.int64)
    if mixture is None:
        shares = tokens / max(whole, 1)
    else:
        given = [mixture[r.source] for r in own]
        shares = np.array([max(0.0, 1 - sum(given)), *given])
        shares = shares / max(shares.sum(), 1e-9)
    return [(r.source, i + 1) for i, r in enumerate(own)], tokens, shares


class Schedule:
    """Where in the stream each lump of each queue stands."""

    def __init__(self, tokens: np.ndarray, shares: np.ndarray, window: int, lump: int):
        self.tokens, self.lump = tokens, lump
        self.quantum = np.maximum(1, np.rint(shares * window * UNIT)).astype(np.int64)
        # rounds until a queue is dry; later ones would only make the products overflow
        self.dry = -(-(tokens + lump) * UNIT // self.quantum)

    def served(self, rounds: np.ndarray, q=slice(None)) -> np.ndarray:
        """Tokens of the queues served by the end of each round."""
        rounds = np.minimum(rounds[:, None], self.dry[None, q])
        lumps = rounds * self.quantum[None, q] // (self.lump * UNIT)
        return np.minimum(lumps * self.lump, self.tokens[None, q])

    def positions(self, queue: int, lumps: np.ndarray) -> np.ndarray:
        """Position in the stream of the first token of each lump of a queue."""
        out = np.empty(len(lumps), np.int64)
        for i in range(0, len(lumps), 4096):
            j = lumps[i:i + 4096]
            r = -(-(j + 1) * self.lump * UNIT // self.quantum[queue])
            out[i:i + 4096] = (self.served(r, slice(0, queue)).sum(1) + j * self.lump
                               + self.served(r - 1, slice(queue + 1, None)).sum(1))
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048,
         lump: int = 256, mixture: Mapping[str, float] | None = None,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in windows that keep to the target proportions.

    ``mixture`` names sources and their shares of a window; what it leaves goes to all
    other sources together.  A piece ends where its document, its lump or its window does.
    ``queue`` tells which queue served it, ``ids`` (if asked for) its ids as 32-bit numbers.
    """
    if window % lump:
        raise ValueError("a window holds a whole number of lumps")
    rows = stored(token_rows(docs, tokenizer, end_id), "tokens")
    sums = stored(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "queues")
    names, tokens, shares = _queues(sums, mixture)
    # at most 1 / LEAST_SHARE rows by construction
    names = F.broadcast(docs.sparkSession.createDataFrame(names, "source string, queue int"))
    per = sums.join(names, sums.source.eqNullSafe(names.source), "left").select(
        "part", sums.source, F.coalesce("queue", F.lit(0)).alias("queue"), "n")
    earlier = (W.unboundedPreceding, -1)
    parts = per.groupBy("queue", "part").agg(F.sum("n").alias("n")).select(
        "queue", "part", F.coalesce(F.sum("n").over(
            W.partitionBy("queue").orderBy("part").rowsBetween(*earlier)), F.lit(0))
        .alias("base"))
    within = per.withColumn("own", F.coalesce(F.sum("n").over(
        W.partitionBy("queue", "part").orderBy("source").rowsBetween(*earlier)), F.lit(0)))
    base = stored(within.join(parts, ["queue", "part"]).select(
        "part", "source", "queue", (F.col("base") + F.col("own")).alias("base")), "bases")
    plan = Schedule(tokens, shares, window, lump)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoder(tokenizer).type
        for batch in chunks(batches):
            yield _cut(batch, plan, window, size, with_ids)

    b = base.select(F.col("part").alias("p_"), F.col("source").alias("s_"), "queue", "base")
    placed = rows.join(b, (rows.part == b.p_) & rows.source.eqNullSafe(b.s_)).select(
        "doc_id", "n", (F.col("base") + F.col("before")).alias("at"), "queue", "ids")
    return placed.mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def _cut(batch: pa.RecordBatch, plan: Schedule, window: int, size: np.dtype,
         with_ids: bool) -> pa.RecordBatch:
    n, at, queue = (batch.column(i).to_numpy() for i in (1, 2, 3))
    lump = plan.lump
    first, last = at // lump, (at + n - 1) // lump
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    start = np.maximum(j * lump, at[doc])
    length = np.minimum((j + 1) * lump, (at + n)[doc]) - start
    pos = np.empty(len(doc), np.int64)
    for q in np.unique(queue):
        mine = queue[doc] == q
        lumps, back = np.unique(j[mine], return_inverse=True)
        pos[mine] = plan.positions(int(q), lumps)[back]
    pos += start - j * lump
    start -= at[doc]
    # a lump is no longer than a window, so at most one border falls inside
    left = np.minimum(length, window - pos % window)
    doc = np.concatenate([doc, doc[left < length]])
    rest = left < length
    pos, start, length = (np.concatenate(x) for x in (
        (pos, (pos + left)[rest]), (start, (start + left)[rest]), (left, (length - left)[rest])))
    order = np.lexsort((start, doc))
    doc, pos, start, length = doc[order], pos[order], start[order], length[order]
    new = np.ones(len(doc), bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + length[:-1])
               | (pos[1:] // window != pos[:-1] // window))
    heads = np.flatnonzero(new)
    length = np.add.reduceat(length, heads) if len(heads) else length
    doc, pos, start = doc[heads], pos[heads], start[heads]
    ids = [np.frombuffer(x, size).astype("<u4") for x in batch.column(4).to_pylist()]
    cut = [ids[d][s:s + k] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
    columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
               pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[doc]),
               pa.array(pos // window), pa.array(pos % window),
               pa.array(queue[doc].astype(np.int32))]
    if with_ids:
        columns.append(pa.array([x.tobytes() for x in cut], pa.binary()))
    return pa.RecordBatch.from_arrays(
        columns, [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids)
