"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies) the
vectors of its letters, each permuted (rolled) once for every place it stands from the end;
a text bundles (adds) the vectors of its n-grams, and a language's prototype bundles those of
its training texts.  A text's language is that of the prototype with the largest cosine.

Bundles are sums, so the product of a text with a prototype is the sum of its n-grams'
products with it, which are computed once for all n-grams of the alphabet and sent to the
tasks.  The n-grams' vectors are random and nearly orthogonal, so the length of a bundle of
counts c in D dimensions is taken as sqrt(D sum(c^2)), its expected value.

Letters are a to z, the other letters fall into 36 more signs by code point, and all else
parts words.  Training reads text and language of the rows outside the held-out fold; a
prototype needs only n-gram counts per language, which Spark adds up.

A text that is null or has no letter is ``und`` with score 0, as is every text if no language
was learned.  Ties go to the first language in order.  There are at most ``LANGUAGES``
languages, or the fit raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks, stored

SIGNS, GRAM = 64, 3
GRAMS = SIGNS ** GRAM
DIMENSIONS, LANGUAGES, UNKNOWN = 2048, 256, "und"

ENOUGH = 100  # training rows of a language and length that tell how like it its texts are

_SIGNS: list[np.ndarray] = []


def _signs() -> np.ndarray:
    """Sign of each code point, 0 for all that are no letters."""
    if not _SIGNS:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c - 96 if 97 <= c <= 122 else 27 + c % 36
        _SIGNS.append(table)
    return _SIGNS[0]


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a text; empty if it has no letter.  A word's ends count as a sign."""
    if not text:
        return np.empty(0, np.int64)
    signs = _signs()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    if not signs.any():
        return np.empty(0, np.int64)
    signs = np.concatenate([[0], signs, [0]]).astype(np.int64)
    signs = signs[np.append(True, (signs[1:] != 0) | (signs[:-1] != 0))]
    found = signs[:-2] * SIGNS * SIGNS + signs[1:-1] * SIGNS + signs[2:]
    return found[signs[1:-1] != 0]


def gram_vectors(found: np.ndarray) -> np.ndarray:
    """(n, DIMENSIONS) vectors of n-grams."""
    letters = np.where(np.random.default_rng(5).random((SIGNS, DIMENSIONS)) < 0.5, -1, 1
                       ).astype(np.int8)
    once, twice = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
    return twice[found // (SIGNS * SIGNS)] * once[found // SIGNS % SIGNS] * letters[found % SIGNS]


@dataclass
class Profiles:
    names: list[str]
    products: np.ndarray  # (GRAMS, languages): cosine of each n-gram with each prototype

    def best(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        at, count = np.unique(found, return_counts=True)
        cosines = (count @ self.products[at]) / np.sqrt((count.astype(float) ** 2).sum())
        k = int(np.argmax(cosines))
        return self.names[k], float(min(1.0, max(0.0, cosines[k])))


def held_out(of: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def fit(docs: DataFrame) -> Profiles:
    """Profiles of the languages of the training rows of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def rows(lang: str) -> pa.RecordBatch:
            total = totals.pop(lang)
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(total[at])], ["lang", "gram", "n"])

        for batch in chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, count = np.unique(grams(text), return_counts=True)
                if lang not in totals:
                    if len(totals) >= 16:  # bounds the task's memory
                        yield rows(next(iter(totals)))
                    totals[lang] = np.zeros(GRAMS, np.int64)
                totals[lang][at] += count
        for lang in list(totals):
            yield rows(lang)

    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = stored(rows.mapInArrow(run, "lang string, gram int, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n")), "grams")
    names = sorted(r.lang for r in sums.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.zeros((GRAMS, len(names)))
    for k, name in enumerate(names):  # at most GRAMS rows each
        part = sums.where(F.col("lang") == name).select("gram", "n").toPandas()
        counts[part["gram"], k] = part["n"]
    return Profiles(names, _products(counts))


def _products(counts: np.ndarray) -> np.ndarray:
    products = np.zeros(counts.shape, np.float32)
    used = np.flatnonzero(counts.any(1))
    share = counts / np.maximum(1, counts.sum(0))
    prototypes = np.zeros((counts.shape[1], DIMENSIONS))
    for at in np.array_split(used, len(used) // 4096 + 1):
        prototypes += share[at].T @ gram_vectors(at).astype(np.float32)
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.maximum(lengths, 1e-12)).astype(np.float32)
    everything = np.arange(GRAMS)
    for at in np.array_split(everything, GRAMS // 8192):
        products[at] = gram_vectors(at).astype(np.float32) @ unit.T / np.sqrt(DIMENSIONS)
    return products


def predict(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            best = [shared.value.best(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b[0] for b in best], pa.string()),
                 pa.array([b[1] for b in best], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _length_class(text: str | None) -> int:
    """Texts of like lengths have like cosines: the binary digits of their n-gram count."""
    return len(grams(text)).bit_length()


def least_cosines(docs: DataFrame, shared, spread: float = 3.0) -> dict[tuple[str, int], float]:
    """By language and class of length, the cosine below which a text is none of it.

    From the training rows whose own language is the nearest: their median and their lowest
    hundredth, and ``spread`` times that distance below the latter.  Classes with fewer than
    ``ENOUGH`` such rows have none, so nothing is rejected there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, cosine = shared.value.best(text)
                if name == lang:
                    out.append((name, _length_class(text), cosine))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()),
                 pa.array([r[1] for r in out], pa.int32()),
                 pa.array([r[2] for r in out], pa.float64())], ["lang", "size", "cosine"])

    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, "lang string, size int, cosine double").groupBy(
        "lang", "size").agg(F.count("*").alias("n"), F.percentile_approx(
            "cosine", [0.01, 0.5], 1000).alias("q")).where(F.col("n") >= ENOUGH)
    # a row per language and class of length: 256 times 40 at most
    return {(r.lang, r["size"]): r.q[0] - spread * (r.q[1] - r.q[0]) for r in found.collect()}


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are in a learned language.

    A text goes if it has no letter, or if it is less like the nearest language than texts of
    that language and its length are (``least_cosines``).
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(fit(docs))
    limits = context.broadcast(least_cosines(docs, shared))
    at = docs.columns.index("text")

    def known(text: str | None) -> bool:
        name, cosine = shared.value.best(text)
        return name != UNKNOWN and cosine >= limits.value.get((name, _length_class(text)), -1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array([known(t) for t in batch.column(at).to_pylist()],
                                        pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
