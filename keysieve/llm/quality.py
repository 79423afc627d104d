"""Text quality: random Fourier features, ridge regression, isotonic calibration.

Each text becomes some twenty statistics of its characters, words and lines.  They are
standardised and mapped to random Fourier features, whose products approximate a Gaussian
kernel.  Tasks send sums (moments, then normal equations), Spark adds them up, and the driver
solves a system whose size is the number of features.  Raw ridge scores are calibrated by
isotonic regression on counts per score bin, again added up over all training rows.

Only the text decides a score.  A null text is empty.  Null labels are ignored.  Without
training rows of both labels every score is 1, so nothing is rejected.  Repeated rows count
as often as they stand there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from keysieve.llm.shared import chunks, raw, stored

FOURIER, RIDGE, BINS, CUT = 160, 1.0, 1000, 0.7
WIDTH = 3.0  # of the kernel, in standard deviations of a statistic times sqrt(their number)

_KIND = np.zeros(256, np.int64)  # of a byte
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"()-", b"!?",
                                b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 8
_SIGN_END = re.compile(rb"[#$%&*+/<=>@^|~!?]$")
STATISTICS = 22


def statistics(text: bytes | None) -> np.ndarray:
    """Numbers that describe a text, all of moderate size; zeros for an empty one."""
    out = np.zeros(STATISTICS)
    if not text or not (found := text.split()):
        return out
    n, size = len(found), len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=9) / size
    sizes = np.fromiter(map(len, found), np.int64, n)
    seen = Counter(found)
    most = max(seen.values())
    pairs = len(set(zip(found, found[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    out[:8] = kinds[1:]
    out[8:] = (
        np.log1p(n), sizes.mean() / 10, min(sizes.std(), 50) / 10, (sizes <= 2).mean(),
        (sizes >= 20).mean(), len(seen) / n, most / n,
        sum(map(bytes.__eq__, found, found[1:])) / n, pairs / max(1, n - 1),
        sum(map(bytes.isupper, found)) / n,
        sum(1 for w in found if _SIGN_END.search(w)) / n,
        np.log1p(len(lines)), ends / len(lines), np.log1p(n / len(lines)))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray   # of 1, the statistics and the Fourier features
    edges: np.ndarray     # calibration: raw scores and the probability at each
    values: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.turns + self.shifts) * np.sqrt(2 / FOURIER)
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.ones(len(x))
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def _sums(rows: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum of the vectors ``per_batch`` makes of (statistics, labels) of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, STATISTICS)
                total += per_batch(x, batch.column(1).to_numpy().astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         ["at", "n"])

    found = rows.mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(size)
    for r in found.collect():  # at most ``size`` rows
        total[r["at"]] = r["n"]
    return total


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([statistics(t).tobytes()
                                            for t in raw(batch.column(1))], pa.binary())],
                ["doc_id", "statistics"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, statistics binary")


def held_out(of: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def fit(rows: DataFrame) -> Model:
    """The model of a table (statistics, label)."""
    rng = np.random.default_rng(11)
    turns = rng.normal(0, 1, (STATISTICS, FOURIER)) / (WIDTH * np.sqrt(STATISTICS) / 2)
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(1), np.empty(0),
                  np.empty(0), turns, rng.uniform(0, 2 * np.pi, FOURIER))
    s = STATISTICS

    def moments(x, y):
        return np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])

    m = _sums(rows, moments, 2 + 2 * s)
    n, ones = m[:2]
    if not 0 < ones < n:
        return model
    model.mean = m[2:2 + s] / n
    model.scale = np.sqrt(np.maximum(m[2 + s:] / n - model.mean ** 2, 1e-12))
    model.scale[model.scale < 1e-5] = 1.0
    d = 1 + s + FOURIER

    def equations(x, y):
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    e = _sums(rows, equations, d * d + d)
    penalty = np.full(d, RIDGE)
    penalty[0] = 0
    model.weights = np.linalg.solve(e[:d * d].reshape(d, d) + np.diag(penalty), e[d * d:])

    def histogram(x, y):
        at = np.clip(((model.raw(x) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    model.edges, model.values = isotonic(*np.split(_sums(rows, histogram, 2 * BINS), 2))
    return model


def isotonic(count: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw scores and the shares of ones, which never fall."""
    pools: list[list[float]] = []  # ones, count, first bin, last bin
    for i in np.flatnonzero(count):
        pools.append([ones[i], count[i], i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    edges = [(x + 0.5) * 2 / BINS - 0.5 for p in pools for x in (p[2] - 0.5, p[3] + 0.5)]
    return np.array(edges), np.repeat([p[0] / p[1] for p in pools], 2)


def trained(known: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on the labelled rows of a table (doc_id, statistics)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("quality").cast("int").alias("label")).where(
        "label in (0, 1)")
    rows = known.where(~held_out()).join(marks, "doc_id").select("statistics", "label")
    return fit(stored(rows, "labelled"))


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    known = stored(described(docs), "statistics")
    model = trained(known, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))],
                                             ["doc_id", "score"])

    scored = known.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents, all columns, whose score reaches ``cut``.

    Texts are described once: the statistics stand beside the documents until they are judged.
    """
    own = "statistics"
    while own in docs.columns:
        own += "_"
    names = docs.columns
    at = names.index("text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = pa.array([statistics(t).tobytes() for t in raw(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, own])

    known = stored(docs.mapInArrow(describe, StructType(
        [*docs.schema.fields, StructField(own, BinaryType())])), "described")
    model = trained(known.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 F.col(own).alias("statistics")), labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, found = batch.columns
            x = np.frombuffer(b"".join(found.to_pylist())).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays(columns, names).filter(
                pa.array(model.score(x) >= cut))

    return known.mapInArrow(judge, docs.schema)
