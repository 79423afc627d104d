"""A hidden Markov language model trained by Baum-Welch over partitions.

Latent states emit word classes: each of the most frequent words is a class of its own, the
others fall into classes by their last letters, and the end of a text is a class.  Within a
class a word has its smoothed unigram probability, so

    P(word | state) = P(class | state) * P(word) / P(class)

with P(word) = (c + 0.1) / (N + 0.1 (V + 1)) from counts over the whole training text.  Each
class also holds one unknown word.  Words that are not among the frequent ones get their
counts by a join, so no task and no broadcast grows with the vocabulary.

Training starts from states that differ from the class shares at random and runs ``PASSES``
rounds of Baum-Welch, each over all training documents: each task sends its expected counts,
which Spark adds up.  The scaled forward recursion gives the exact likelihood of a sequence of
classes.

A null text is empty: its only token is the end.  Rows with a null doc_id are training text.
Repeated rows count as often as they stand there.  Without training rows all tokens are
unknown and states are uniform.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks, raw, stored, words

HEAD = 65_536        # words whose counts every task holds
OWN = 4_096          # of them, words that are a class of their own
SUFFIXES = 4_096     # classes of all other words
END = OWN + SUFFIXES
CLASSES = END + 1
STATES, PASSES = 8, 4
GROUP = 400_000      # tokens whose recursions run side by side


def suffix_class(word: bytes) -> int:
    x = 0
    for c in word[-4:]:
        x = (x * 257 + c) % 1_000_003
    return OWN + x % SUFFIXES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; the end of texts is not among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()).cast(pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in chunks(batches):
            for text in raw(batch.column(0)):
                seen.update(words(text))
            if len(seen) > 400_000:  # bounds the task's memory; Spark adds the parts up
                yield rows()
                seen = Counter()
        yield rows()

    return docs.select(F.col("text").cast("string")).mapInArrow(
        run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Sequences:
    """Sequences of classes, laid out so that one step treats a token of each."""

    def __init__(self, found: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in found], kind="stable")
        sizes = np.array([len(found[i]) for i in self.order])
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.repeat(np.arange(len(sizes)), sizes)
        self.time = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.first[self.time] + rank
        self.obs = np.empty(len(rank), np.int64)
        self.obs[self.place] = np.concatenate([found[i] for i in self.order])


class Model:
    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = (
            np.ascontiguousarray(x, np.float32) for x in (start, moves, emits.T))

    def forward(self, s: Sequences, keep: bool = False):
        """Natural logarithm of each sequence's probability, in the layout's order; with
        ``keep`` also the scaled forward rows, the emissions and the scales."""
        b = self.emits[s.obs]
        scales = np.empty(len(s.obs), np.float32)
        rows = np.empty_like(b) if keep else None
        a = None
        for at, n in zip(s.first.tolist(), s.active.tolist()):
            # a step is a few calls on rows that stand next to each other, without copies
            here = b[at:at + n]
            into = rows[at:at + n] if keep else here
            if a is None:
                np.multiply(self.start, here, out=into)
            else:
                np.multiply(a[:n] @ self.moves, here, out=into)
            c = np.add.reduce(into, 1, out=scales[at:at + n])
            into /= c[:, None]
            a = into
        # places are in the order of time, so their sequences are counted up in each step
        rank = np.arange(len(s.obs)) - np.repeat(s.first[:-1], s.active)
        score = np.bincount(rank, np.log(scales.astype(np.float64)), len(s.order))
        return (score, rows, b, scales) if keep else score

    def expected(self, s: Sequences):
        """Expected starts, moves and emissions of the sequences, and their log-likelihood."""
        score, alpha, b, scales = self.forward(s, keep=True)
        beta = np.ones_like(b)
        ahead = np.divide(b, scales[:, None], out=b)
        back = np.ascontiguousarray(self.moves.T)
        first, active = s.first.tolist(), s.active.tolist()
        for t in range(len(active) - 2, -1, -1):
            n, at, nxt = active[t + 1], first[t], first[t + 1]
            x = ahead[nxt:nxt + n]
            x *= beta[nxt:nxt + n]
            np.matmul(x, back, out=beta[at:at + n])
        # a token's predecessor stands as many places before it as that step has tokens
        later = np.flatnonzero(s.time)
        now = s.place[later]
        before = now - s.active[s.time[later] - 1]
        moves = self.moves * (np.take(alpha, before, 0).T @ np.take(ahead, now, 0))
        gamma = np.multiply(alpha, beta, out=beta)
        emits = np.stack([np.bincount(s.obs, gamma[:, k], CLASSES)
                          for k in range(gamma.shape[1])])
        return gamma[:s.active[0]].sum(0), moves, emits, score.sum()


def _groups(found: list[np.ndarray]) -> Iterator[tuple[list[int], Sequences]]:
    """Sequences of like lengths side by side."""
    order = sorted(range(len(found)), key=lambda i: -len(found[i]))
    group, size = [], 0
    for i in order:
        group.append(i)
        size += len(found[i])
        if size >= GROUP:
            yield group, Sequences([found[j] for j in group])
            group, size = [], 0
    if group:
        yield group, Sequences([found[j] for j in group])


def _estimate(start, moves, emits, share: np.ndarray) -> Model:
    """Maximum likelihood with a little of the prior shares, so that nothing is impossible."""
    k = len(start)
    start = (start + 1) / (start.sum() + k)
    moves = (moves + 1) / (moves.sum(1, keepdims=True) + k)
    emits = (emits + 20 * share) / (emits.sum(1, keepdims=True) + 20)
    return Model(start, moves, emits)


def _first_model(share: np.ndarray, states: int) -> Model:
    rng = np.random.default_rng(7)
    emits = share * np.exp(rng.normal(0, 0.5, (states, CLASSES)))
    moves = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(moves, 0.95)
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True),
                 emits / emits.sum(1, keepdims=True))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def _trained(coded: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One pass of Baum-Welch over all training sequences."""
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states + states * states + states * CLASSES)
        for batch in batches:
            for _, s in _groups(_arrays(batch.column(0))):
                start, moves, emits, _ = model.expected(s)
                total += np.concatenate([start, moves.ravel(), emits.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         ["at", "n"])

    sums = coded.where("not held_out").select("classes").mapInArrow(run, "at int, n double")
    # one row per parameter of the model, however large the corpus is
    rows = sums.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(states + states * states + states * CLASSES)
    total[rows["at"]] = rows["n"]
    start, moves, emits = np.split(total, [states, states + states * states])
    return _estimate(start, moves.reshape(states, states), emits.reshape(states, CLASSES),
                     share)


def score(docs: DataFrame, held_out_of: int = 10, states: int = STATES, passes: int = PASSES
          ) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"), held.alias("held_out"))
    train = texts.where("not held_out")
    counts = stored(word_counts(train), "counts")
    n_words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n, v = n_words + ends, types + (ends > 0)
    z = n + 0.1 * (v + 1)
    head = sorted(((r.word.encode(), r.c) for r in _frequent(counts).collect()),
                  key=lambda x: (-x[1], x[0]))
    known = spark.sparkContext.broadcast(
        {word: (i if i < OWN else suffix_class(word), c) for i, (word, c) in enumerate(head)})
    mass = _class_mass(counts, known, ends) / z
    share = mass / mass.sum()
    coded = stored(_coded(texts, known, z, ends), "sequences")
    tail = coded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    tail = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / z)).alias("tail_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    model = _first_model(share, states)
    for _ in range(passes):
        model = _trained(coded, model, share)
    shared = spark.sparkContext.broadcast((model, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_mass = shared.value
        for batch in batches:
            found = _arrays(batch.column(1))
            out = np.empty(len(found))
            for group, s in _groups(found):
                out[np.array(group)[s.order]] = model.forward(s) / np.log(10)
            out -= [log_mass[c].sum() for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["row", "gain"])

    gain = coded.select("row", "classes").mapInArrow(run, "row long, gain double")
    return coded.drop("classes", "tail").join(tail, "row", "left").join(gain, "row").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
    "gain").withColumn("score", F.col("base_score") + F.col("gain")).drop("gain")


def _frequent(counts: DataFrame) -> DataFrame:
    """The words above a count, ``HEAD`` of them at most.

    The count is found from a histogram of their logarithms, some 3,000 rows however many words
    there are, so that nothing has to be sorted or sent that is not kept.
    """
    level = F.floor(64 * F.log2(F.col("c").cast("double")))
    cut, left = None, HEAD
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(
            F.desc("level")).collect():
        left -= r.n
        if left < 0:
            break
        cut = r.level
    return counts.where(level >= cut) if cut is not None else counts.limit(0)


def _class_mass(counts: DataFrame, known, ends: int) -> np.ndarray:
    """Sum of (c + 0.1) over the words of each class and its unknown word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = known.value, np.zeros(CLASSES)
        for batch in batches:
            for word, c in zip(raw(batch.column(0)), batch.column(1).to_pylist()):
                total[head[word][0] if word in head else suffix_class(word)] += c + 0.1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         ["at", "n"])

    rows = counts.mapInArrow(run, "at int, n double").groupBy("at").agg(
        F.sum("n").alias("n")).collect()  # one row per class
    mass = np.zeros(CLASSES)
    for r in rows:
        mass[r["at"]] = r["n"]
    # The end is never unknown once it was seen, and a frequent word's class has it alone.
    mass[OWN:END] += 0.1
    mass[:OWN][mass[:OWN] == 0] = 0.1
    mass[END] = ends + 0.1
    return mass


def _coded(texts: DataFrame, known, z: float, ends: int) -> DataFrame:
    """One row per document: its classes, what frequent words score, and the other words."""
    schema = ("row long, doc_id long, held_out boolean, n_tokens long, head_known long, "
              "head_score double, classes binary, tail array<struct<word:string,n:long>>")
    names = [x.strip().split()[0] for x in
             "row, doc_id, held_out, n_tokens, head_known, head_score, classes".split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, part, nth = known.value, TaskContext.get().partitionId(), 0
        # one number a word: its place among the frequent words, or its class behind them
        class_of = np.array([k for k, _ in head.values()] + list(range(CLASSES)), np.uint16)
        logs = np.log10((np.array([c for _, c in head.values()]) + 0.1) / z)
        end = float(np.log10((ends + 0.1) / z))

        class Suffixes(dict):
            def __missing__(self, suffix: bytes) -> int:
                k = len(head) + suffix_class(suffix)
                if len(self) < 300_000:
                    self[suffix] = k
                return k

        suffixes = Suffixes()

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                return suffixes[word[-4:]]

        numbers = Numbers((w, i) for i, w in enumerate(head))
        for batch in chunks(batches):
            out, tails = [], []
            for doc_id, text, held in zip(batch.column(0).to_pylist(), raw(batch.column(1)),
                                          batch.column(2).to_pylist()):
                found = words(text)
                at = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                rare = at >= len(head)
                rest = Counter(map(found.__getitem__, np.flatnonzero(rare).tolist()))
                value, seq = float(logs[at[~rare]].sum()) + end, class_of[at]
                out.append(((part << 33) + nth, doc_id, held, len(found) + 1,
                            len(found) - rest.total() + (ends > 0), value,
                            np.append(seq, np.uint16(END)).astype("<u2").tobytes()))
                tails.append(rest)
                nth += 1
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(),
                     pa.binary()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            at = np.cumsum([0, *map(len, tails)]).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array([w for r in tails for w in r], pa.binary()).cast(pa.string()),
                 pa.array([c for r in tails for c in r.values()], pa.int64())], ["word", "n"])
            columns.append(pa.ListArray.from_arrays(pa.array(at), flat))
            yield pa.RecordBatch.from_arrays(columns, [*names, "tail"])

    return texts.mapInArrow(run, schema)
