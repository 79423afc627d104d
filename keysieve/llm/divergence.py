"""How the sources of a language differ, from a single-pass in-memory index.

1. Each task indexes documents into a block: per (lang, source) the occurrences of each term
   and the documents that hold it.  When a block holds ``BLOCK`` postings it is spilled: its
   terms are dealt by hash to shards and written, sorted, as one run per shard.
2. A shard merges its runs with a heap, term by term, into frequencies.  A language keeps the
   terms that at least ``least`` of its documents hold.
3. A term's share in a group is p = 1 + floor(10^9 (count + 2) / (N + 2 V)).  The divergence of
   two groups sums f(p, q) = floor((p - q)^2 / (p + q)) over all kept terms.  With p0 the share
   of a term a group lacks, that sum is taken apart exactly:

       V f(p0, q0)  +  sum over g's terms of f(p, q0) - f(p0, q0), by count, and the same for h
       +  sum over the terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

   so only groups that share a term meet for it; each task adds its corrections up by pair.

Null texts, languages and sources are read as ''.  A group without terms takes part with a
share of zero counts; a language without kept terms has value 0 throughout and no ranked
terms.  Repeated rows count as often as they occur.  All sums are exact while a language has
fewer than 2.8 * 10^14 occurrences.  The groups (not the terms) are sent to every task: their
squares are the result, so they are few.
"""

from __future__ import annotations

import heapq
import marshal
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks, no_cycles, raw, stored

BLOCK = 1_000_000  # postings of a block; some 150 MB
SHARD_BYTES = 16 << 20  # of text, per shard
CHUNK = 2048  # terms of a run that are decoded at a time
# 10^9 = HIGH * LOW, so that no product passes 64 bits
HIGH, LOW = 31250, 32000
# Anything but letters A-Z, a-z and what is beyond ASCII separates terms.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def share(count, size, kept):
    """1 + floor(10^9 (count + 2) / (size + 2 kept)); of numpy arrays or numbers."""
    all_ = size + 2 * kept
    high = (count + 2) * HIGH
    return 1 + high // all_ * LOW + high % all_ * LOW // all_


def distance(p, q):
    return (p - q) * (p - q) // (p + q)


def _share(count: Column, size: Column, kept: Column) -> Column:
    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    all_, high = size + 2 * kept, (count + 2) * HIGH
    return 1 + div(high, all_) * LOW + div(high % all_ * LOW, all_)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# --- blocks and runs ------------------------------------------------------------------------


def _spill(block: dict, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, run): the groups of the block, then chunks of (term, [group, count, documents, ...])
    in the order of the terms."""
    groups, found = list(block), defaultdict(list)
    for nth, group in enumerate(groups):
        counts, documents = block[group]
        for term, n in counts.items():
            found[term] += (nth, n, documents[term])
    runs = defaultdict(list)
    for term in sorted(found):
        runs[zlib.crc32(term) % shards].append((term, found[term]))
    packer = zstandard.ZstdCompressor(level=1)
    for shard, run in runs.items():
        parts = [packer.compress(marshal.dumps(run[i:i + CHUNK]))
                 for i in range(0, len(run), CHUNK)]
        yield shard, marshal.dumps((groups, parts))


def runs(docs: DataFrame, shards: int, block_size: int = BLOCK) -> DataFrame:
    """shard, run: term-sorted runs of the blocks of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict = {}

        def spilled():
            with no_cycles():
                rows = list(_spill(block, shards))
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()),
                 pa.array([r for _, r in rows], pa.binary())], ["shard", "run"])

        for batch in chunks(batches, 200):
            for text, *group in zip(*map(raw, batch.columns)):
                found = terms(text)
                if found:
                    counts, documents = block.setdefault(tuple(group), (Counter(), Counter()))
                    counts.update(found)
                    documents.update(set(found))
            if sum(len(c) for c, _ in block.values()) >= block_size:
                yield spilled()
                block = {}
        if block:
            yield spilled()

    return docs.mapInArrow(run, "shard int, run binary")


def _read(run: bytes, known: dict) -> Iterator[tuple[bytes, list]]:
    """(term, [(group, count, documents), ...]) of a run; groups get numbers of ``known``."""
    groups, parts = marshal.loads(run)
    ids = [known.setdefault(g, len(known)) for g in groups]
    unpacker = zstandard.ZstdDecompressor()
    for part in parts:
        for term, flat in marshal.loads(unpacker.decompress(part)):
            yield term, zip(map(ids.__getitem__, flat[::3]), flat[1::3], flat[2::3])


def merge(table: pa.Table, least: int) -> pa.Table:
    """Frequencies of a shard's kept terms: one row per language and term."""
    known: dict = {}
    merged = heapq.merge(*(_read(r, known) for r in table["run"].to_pylist()), key=itemgetter(0))
    rows = []
    for term, entries in groupby(merged, key=itemgetter(0)):
        counts, documents = Counter(), Counter()
        for _, postings in entries:
            for group, n, d in postings:
                counts[group] += n
                documents[group] += d
        names = list(known)
        langs = Counter()
        for group, d in documents.items():
            langs[names[group][0]] += d
        for lang, d in langs.items():
            if d >= least:
                own = sorted((names[g][1], n) for g, n in counts.items() if names[g][0] == lang)
                rows.append((lang, term, sum(n for _, n in own), [s for s, _ in own],
                             [n for _, n in own]))
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    made = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.table([made[0].cast(pa.string()), made[1].cast(pa.string()), made[2],
                     made[3].cast(pa.list_(pa.string())), made[4]],
                    ["lang", "term", "total", "sources", "counts"])


def frequencies(docs: DataFrame, least: int = 10, block_size: int = BLOCK,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, term, total, sources, counts of the terms that ``least`` documents of a language
    hold; sources and counts name the groups in which the term occurs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(max(64, size // shard_bytes), 100_000)

    def merged(t: pa.Table) -> pa.Table:
        with no_cycles():
            return merge(t, least)

    return runs(docs, shards, block_size).groupBy("shard").applyInArrow(
        merged, "lang string, term string, total long, sources array<string>, counts array<long>")


# --- divergence --------------------------------------------------------------------------------


def _corrections(found: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h, value: sums over terms of both groups (g < h), as far as a task goes."""
    number, by_lang = {}, defaultdict(list)
    for r in groups.orderBy("lang", "nth").collect():
        number[r.lang, r.source] = r.nth
        by_lang[r.lang].append(r.size)
    size = {lang: np.array(n, np.int64) for lang, n in by_lang.items()}
    kept = {r.lang: r.kept for r in groups.select("lang", "kept").distinct().collect()}

    def add(lang: str, lists: pa.ListArray, values: np.ndarray, total: Counter) -> None:
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        names = lists.flatten().dictionary_encode()
        g = np.array([number[lang, s] for s in names.dictionary.to_pylist()], np.int64)[
            names.indices.to_numpy()]
        n, v = size[lang], kept[lang]
        p, p0 = share(values, n[g], v), share(0, n, v)
        count = np.diff(at)
        # posting i meets the postings behind it of the same term
        behind = np.repeat(at[1:], count) - np.arange(len(g)) - 1
        for lo, hi in _spans(behind, 1 << 20):
            b = behind[lo:hi]
            left = np.repeat(np.arange(lo, hi), b)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(b) - b, b)
            x, y = g[left], g[right]
            value = (distance(p[left], p[right]) - distance(p[left], p0[y])
                     - distance(p0[x], p[right]) + distance(p0[x], p0[y]))
            low, high = np.minimum(x, y), np.maximum(x, y)
            pair = low * len(n) + high
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            if len(first):
                sums = np.add.reduceat(value[order], first)
                for k, s in zip(pair[order][first].tolist(), sums.tolist()):
                    total[lang, k // len(n), k % len(n)] += s

    def rows(total: Counter) -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()),
             *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)),
             pa.array(list(total.values()), pa.int64())], ["lang", "g", "h", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lang in set(t["lang"].to_pylist()):
                own = t.filter(pc.equal(t["lang"], lang)).combine_chunks()
                if own.num_rows:
                    add(lang, own["sources"].combine_chunks(),
                        own["counts"].combine_chunks().flatten().to_numpy(), total)
            if len(total) > BLOCK:
                yield rows(total)
                total = Counter()
        yield rows(total)

    return found.select("lang", "sources", "counts").mapInArrow(
        run, "lang string, g int, h int, value long").groupBy("lang", "g", "h").agg(
        F.sum("value").alias("value"))


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum to about ``most``."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def divergence(docs: DataFrame, least: int = 10, top: int = 10, block_size: int = BLOCK,
               shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the divergence from each other source of the language.  Part ``term``: the
    ``top`` terms that are commoner in the group than in its language, by their share of the
    divergence from it.  Ranks go by value, then by the bytes of the item.
    """
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    found = stored(frequencies(docs, least, block_size, shard_bytes), "frequencies")
    each = found.select("lang", "term", "total", F.explode(
        F.arrays_zip("sources", "counts")).alias("s")).select(
        "lang", "term", "total", F.col("s.sources").alias("source"), F.col("s.counts").alias("n"))
    langs = found.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all_"))
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = stored(
        docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(
            langs, "lang", "left").select(
            "lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c)
                                for c in ("size", "kept", "all_")],
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("nth")),
        "groups")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    full = groups.where("kept > 0")
    p, q = _share(F.col("n"), F.col("size"), F.col("kept")), _share(
        F.col("total"), F.col("all_"), F.col("kept"))
    ranked = each.join(full, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where(
        "p > q").select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(f"source_{name}"),
                             F.col("size").alias(f"size_{name}"), F.col("nth").alias(name), "kept")

    pairs = side("g").join(side("h").drop("kept"), "lang").where("g <> h")
    one, two = (F.col(f"size_{x}") for x in "gh")
    kept, zero = F.col("kept"), F.lit(0).cast("long")
    nothing = F.when(kept > 0, _distance(_share(zero, one, kept), _share(zero, two, kept)))
    # what g's own terms add against a group that lacks them, by how often they occur
    often = stored(each.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).select(
        "lang", F.col("source").alias("source_g"), "n", "terms"), "counts")
    alone = often.join(pairs, ["lang", "source_g"]).withColumn(
        "value", F.col("terms") * (_distance(_share(F.col("n"), one, kept), _share(
            zero, two, kept)) - nothing)).groupBy("lang", "g", "h").agg(
        F.sum("value").alias("value"))
    alone = stored(alone, "alone")
    turned = alone.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")
    both = stored(_corrections(found, full), "corrections")
    added = alone.union(turned).union(both).union(
        both.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")).groupBy(
        "lang", "g", "h").agg(F.sum("value").alias("more"))
    pair = pairs.join(added, ["lang", "g", "h"], "left").select(
        "lang", F.col("source_g").alias("source"), F.col("source_h").alias("item"),
        (F.coalesce(kept * nothing, zero) + F.coalesce("more", zero)).alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(by_value))

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pair, "pair").union(part(ranked, "term"))
