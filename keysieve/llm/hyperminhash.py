"""Near-copies among texts by HyperMinHash, confirmed on full shingle sets.

A text's shingles are dealt by the first bits of their digests to ``REGISTERS`` buckets.  A
register keeps what HyperMinHash keeps of its bucket's smallest digest: the count of leading
zeros and ``MANTISSA`` bits behind the first one, 16 bits in all.

1. Texts with equal sets are one class; its smallest doc_id stands for it from here on.
2. Registers are banded.  Two classes with a Jaccard similarity of 0.85 share no band with a
   probability of (1 - 0.85^4)^32, about 5e-11.  A band whose registers are all empty is
   skipped; in a small set few bands are in use, and those that differ are fewer still.
3. In each band's bucket, every class is compared with the most central member: first by the
   Jaccard similarity estimated from the registers, corrected for collisions, then on the full
   sets.  A pair at the threshold fails the first test with a probability of at most ``MISS``
   (the exact binomial tail for the registers in use).
4. Links found become components.  A bucket all of whose members are in one component is
   done.  In the others the members outside the central member's component are compared
   with all members, in tiles of bounded size: estimates first, then full sets, a pair only
   in the first band it shares.  A tile returns a spanning forest of its links.  A side of a
   tile holds up to ``TILE`` classes or ``TILE_SHINGLES`` shingles, so members are copied for
   every some thousand others, not for every one.  Within a tile only pairs of like size are
   looked at; where these are more than the tile's shingles, only those of them that share one
   of their rarest shingles, which any pair at the threshold does.  Small buckets share a tile.

So a large group of near-copies costs a row per member and band, not a row per pair.  In all, a
pair at a similarity of 0.85 is missed with a probability of 5e-11 + 1e-12.

Empty and null texts have no shingles, link with nothing and are kept.  Rows that share a
doc_id are one document: it links to what any of its texts links to, each text compared by its
own set, whatever the order of the rows; each row reports the size of its own set.  A null
doc_id has no component and is never linked, its component_id is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from keysieve.llm.components import components
from keysieve.llm.shared import WordHashes, chunks, mix, raw, shingles, stored, words

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
TILE, TILE_SHINGLES = 4096, 1 << 21  # on either side of a tile
PAIRS = 1 << 15  # compared at a time
MISS = 1e-12
_U = np.uint64


def registers(found: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit digests; 0: empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(found):
        return out
    bits = REGISTERS.bit_length() - 1
    bucket = (found >> _U(64 - bits)).astype(np.int64)
    first = np.ones(len(found), bool)
    first[1:] = bucket[1:] != bucket[:-1]  # sorted: the first of a bucket is its smallest
    rest = found[first] << _U(bits)
    zeros = 53 - np.frexp((rest >> _U(11)).astype(float))[1]
    tail = ((rest << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)).astype(np.int64)
    out[bucket[first]] = ((zeros << MANTISSA) | tail) + 1
    return out


def band_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, BANDS) keys of bands of (n, REGISTERS) registers, and which hold anything."""
    packed = np.ascontiguousarray(signatures).view(_U).reshape(len(signatures), BANDS)
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=_U))).view(np.int64), packed != 0


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m shingles are equal.

    A bucket's smallest digest lies in [2^-(k+1), 2^-k) with exp(-l 2^-(k+1)) - exp(-l 2^-k)
    for l shingles a bucket, and there in one of 2^MANTISSA equal parts.
    """
    k = np.arange(40)

    def share(size):
        rate = np.maximum(size, 1)[:, None] / REGISTERS
        hit = np.exp(-rate * 0.5 ** (k + 1)) - np.exp(-rate * 0.5 ** k)
        return hit / -np.expm1(-rate)

    return (share(n) * share(m)).sum(1) / (1 << MANTISSA)


@lru_cache(maxsize=8)
def least_equal(percent: int) -> np.ndarray:
    """By registers in use, how many are equal in sets of this similarity, but for ``MISS``."""
    p, out = percent / 100, []
    for n in range(REGISTERS + 1):
        below, k = 0.0, 0
        while k <= n and below + comb(n, k) * p ** k * (1 - p) ** (n - k) <= MISS:
            below += comb(n, k) * p ** k * (1 - p) ** (n - k)
            k += 1
        out.append(k)
    return np.array(out)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = 85):
    """Collision-corrected Jaccard estimates of rows of registers, and the least ones that sets
    with a similarity of ``percent`` in a hundred may have."""
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    c = collisions(np.atleast_1d(n), np.atleast_1d(m))

    def corrected(equal):
        return (equal / np.maximum(used, 1) - c) / (1 - c)

    return corrected(same), corrected(least_equal(percent)[used])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, registers, keys of bands in use."""
    schema = "doc_id long, n_shingles long, digest string, registers binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in chunks(batches):
            sets = [shingles(known.array(words(t)), width) for t in raw(batch.column(1))]
            regs = np.stack([registers(s) for s in sets]) if sets else np.zeros(
                (0, REGISTERS), np.uint16)
            keys, used = band_keys(regs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                 pa.array([r.tobytes() for r in regs], pa.binary()),
                 pa.array([k[u].tolist() for k, u in zip(keys, used)], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "registers", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, schema)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """node and its sorted shingles, of rows (node, digest, text) whose set has that digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in chunks(batches):
            nodes, out = [], []
            for node, digest, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)),
                                          raw(batch.column(2))):
                found = shingles(known.array(words(text)), width)
                if xxhash.xxh3_128_hexdigest(found.tobytes()) == digest:
                    nodes.append(node)
                    out.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


@F.pandas_udf(BooleanType())
def _possible(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series,
              least: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
    percent = int(least.iloc[0]) if len(least) else 0
    j, lowest = estimate(x, y, n.to_numpy(), m.to_numpy(), percent)
    size = np.minimum(n, m) / np.maximum(n, m)  # no similarity exceeds it
    return pd.Series((j >= lowest) & (100 * size >= percent - 1e-7))


def _linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def near_copies(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked if their sets share at least
    ``percent`` of a hundred of their union; kept is the smallest doc_id of a component."""
    sigs = stored(signatures(docs, width), "signatures")
    filled = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("digest").agg(
        F.min_by(F.struct("doc_id", "n_shingles", "registers", "bands"), "doc_id").alias("r")
    ).select("digest", "r.*"), "classes")
    # A class goes by its smallest doc_id; if several do by the same one (a doc_id with several
    # texts), by a negative digest.
    shared = stored(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "doc_id", F.lit(True).alias("shared")), "shared")
    classes = classes.join(shared, "doc_id", "left").withColumn(
        "node", F.when(F.col("shared"), F.xxhash64("digest").bitwiseOR(F.lit(-1 << 63)))
        .otherwise(F.col("doc_id"))).drop("shared")
    if not shared.isEmpty():
        classes = stored(classes, "classes")
    names = classes.select("digest", "node", F.col("doc_id").alias("rep"))
    links = _links(docs, classes, width, percent)
    if not shared.isEmpty():
        odd = names.where("node <> rep").select("node", "rep")
        for end in ("a", "b"):
            links = links.join(odd.withColumnRenamed("node", end), end, "left").withColumn(
                end, F.coalesce("rep", end)).drop("rep")
    # the texts of one doc_id belong together
    several = filled.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")
                                           ).where("x <> y").select("doc_id")
    several = stored(several, "several")
    more = filled.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(
        names.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"),
                                                        F.col("rep").alias("b"))
    found = components(links.select("a", "b").union(more))
    named = names.select("digest", F.col("rep").alias("node")).join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("c_"))
    out = sigs.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0),
                                       F.col("c_")).otherwise(F.col("doc_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the nodes of classes that join every pair of linked ones."""
    banded = classes.select("node", F.posexplode("bands").alias("nth", "key")).drop("nth")
    # Of a bucket: its size and its central member, which is the one in most shared buckets.
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(sizes, "key"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = stored(members.join(central, "node"), "members")
    centres = members.groupBy("key").agg(
        F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    stars = stored(members.join(centres, "key").select("key", "node", "centre", "size"), "stars")
    light = classes.select("node", "n_shingles", "registers")
    pairs = stars.where("node <> centre").groupBy(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(
        F.count("*").alias("n_"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{c}_{name}" if c != "node" else name)
                             for c in rows.columns])

    close = pairs.join(side(light, "a"), "a").join(side(light, "b"), "b").where(_possible(
        "registers_a", "registers_b", "n_shingles_a", "n_shingles_b", F.lit(percent)))
    close = stored(close.select("a", "b"), "close")
    # Full sets only of classes that some estimate or an undecided bucket asks for.
    wanted = classes.select("node", "doc_id", "digest").join(
        stars.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        wanted, "doc_id").groupBy("doc_id", "node", "digest", F.xxhash64("text").alias("h_")).agg(
        F.first("text").alias("text")).select("node", "digest", "text")
    sets = stored(_sets(texts, width).dropDuplicates(["node"]), "sets")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    first = stored(close.join(side(sets, "a"), "a").join(side(sets, "b"), "b").where(
        _linked(shared, F.size("shingles_a"), F.size("shingles_b"), percent)).select("a", "b"),
        "first-links")
    return first.union(_rest(stars, first, sets, light, percent))


def _rest(stars: DataFrame, first: DataFrame, sets: DataFrame, light: DataFrame,
          percent: int) -> DataFrame:
    """Links in buckets whose members are not all in their centre's component."""
    comp = stored(components(first), "components")
    of = comp.select("node", "component")
    owned = stars.join(of, "node", "left").select(
        "key", "node", "centre", "size", F.coalesce("component", "node").alias("own"))
    hub = comp.select(F.col("node").alias("centre"), F.col("component").alias("c_"))
    marked = owned.join(hub, "centre", "left").withColumn(
        "out", F.col("own") != F.coalesce("c_", "centre")).drop("c_")
    marked = stored(marked, "marked")
    # A bucket of two whose pair was compared is done.
    open_ = marked.where("out and size > 2").select("key").distinct()
    inside = stored(marked.join(open_, "key").join(light.select("node", "n_shingles"), "node"),
                    "open")

    def cuts(which) -> Column:
        """Into how many parts the chosen members of a bucket go."""
        return F.greatest(F.ceil(F.count_if(which) / TILE), F.ceil(
            F.sum(F.when(which, F.col("n_shingles")).otherwise(0)) / TILE_SHINGLES)).cast("int")

    tiles = inside.groupBy("key").agg(cuts(F.lit(True)).alias("blocks"), cuts(F.col("out")).alias(
        "outs"))
    inside = inside.join(tiles, "key")
    # Buckets of one tile go to Python several at a time, their members once each.
    n, total = inside.where("blocks = 1 and outs = 1").agg(
        F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    packs = 1 + int(max(n / TILE, total / TILE_SHINGLES) * 4)
    one = inside.where("blocks = 1 and outs = 1").select(
        F.pmod(F.xxhash64("key"), F.lit(packs)).alias("home"), F.lit(-1).alias("i"),
        F.lit(-1).alias("j"), "key", "node", "own", F.col("out").alias("left"),
        F.lit(True).alias("right"))
    inside = inside.where("blocks > 1 or outs > 1")
    deal = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    left = inside.where("out").select(
        F.col("key").alias("home"), (deal % F.col("outs")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "key", "node", "own",
        F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = inside.select(
        F.col("key").alias("home"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"),
        (deal % F.col("blocks")).cast("int").alias("j"), "key", "node", "own",
        F.lit(False).alias("left"), F.lit(True).alias("right"))
    rows = one.unionByName(left).unionByName(right).join(light, "node").join(sets, "node")

    def compare(t: pa.Table) -> pa.Table:
        return _tile(t, percent)

    return rows.select("home", "i", "j", "key", "node", "own", "left", "right", "n_shingles",
                       "registers", "shingles").groupBy("home", "i", "j").applyInArrow(
        compare, "a long, b long")


def _ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, x) for every x in [lo[k], hi[k]), a bounded number at a time, a k never cut."""
    count = np.maximum(hi - lo, 0)
    ends = np.cumsum(count)
    k = 0
    while k < len(lo):
        most = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        c = count[k:most]
        which = np.repeat(np.arange(k, most), c)
        yield which, np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c) + lo[which]
        k = most


def _prefixes(rows: np.ndarray, flat: np.ndarray, at: np.ndarray, percent: int):
    """(row, code) of each row's rarest shingles, as many as linked sets cannot all lack.

    Linked sets share ``percent`` of a hundred of the larger one at least.  So in any one order of
    all shingles they share one among the first n - ceil(n percent / 100) + 1 of either.
    """
    n = (at[1:] - at[:-1])[rows]
    who = np.repeat(np.arange(len(rows)), n)
    first = np.cumsum(n) - n
    _, code, count = np.unique(flat[np.arange(len(who)) - first[who] + at[rows][who]],
                               return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], who))
    kept = np.arange(len(who)) - first[who] <= (n + -percent * n // 100)[who]
    return rows[who[kept]], code[order][kept]


def _pairs(key: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, flat: np.ndarray,
           at: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows of a bucket, some at a time: all those that may be linked by their sizes,
    or, where these are more than the shingles, only those that share a rare shingle."""
    step = np.int64(1) << 40  # beyond any size
    cols = np.flatnonzero(right)
    cols = cols[np.lexsort((n[cols], key[cols]))]
    place = key[cols] * step + n[cols]
    rows = np.flatnonzero(left)
    lo = np.searchsorted(place, key[rows] * step + n[rows] * percent // 100, "left")
    hi = np.searchsorted(place, key[rows] * step + -(-100 * n[rows] // percent), "right")
    here = np.bincount(key[rows], hi - lo, minlength=key.max() + 1)
    dense = here > np.bincount(key, n, minlength=key.max() + 1)
    few = ~dense[key[rows]]
    for k, x in _ranges(lo[few], hi[few]):
        yield rows[few][k], cols[x]
    for k in np.flatnonzero(dense):
        row, code = _prefixes(np.flatnonzero(key == k), flat, at, percent)
        other = right[row]
        order = np.argsort(code[other], kind="stable")
        listed, codes = row[other][order], code[other][order]
        mine, own = row[left[row]], code[left[row]]
        lo_, hi_ = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
        if (hi_ - lo_).sum() > here[k]:  # rare ones are as common as others
            chosen = key[rows] == k
            for i, x in _ranges(lo[chosen], hi[chosen]):
                yield rows[chosen][i], cols[x]
            continue
        for i, x in _ranges(lo_, hi_):
            both = np.unique(mine[i] * len(key) + listed[x])
            yield both // len(key), both % len(key)


def _tile(t: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between the left and right rows of the buckets of a tile."""
    left, right = (t[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
    ids, own, n = (t[c].to_numpy() for c in ("node", "own", "n_shingles"))
    regs = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    keys, used = band_keys(regs)
    columns = t["shingles"].combine_chunks()
    flat, at = columns.flatten().to_numpy(), columns.offsets.to_numpy() - columns.offsets[0].as_py()
    named = t["key"].to_numpy()
    _, key = np.unique(named, return_inverse=True)
    band = np.argmax((keys == named[:, None]) & used, 1)
    least = least_equal(percent)
    root = {int(c): int(c) for c in np.unique(own)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for r, o in _pairs(key, n, left, right, flat, at, percent):
        # of two rows that are on both sides, one pair
        new = (own[r] != own[o]) & ~(left[o] & right[r] & (o < r))
        r, o = r[new], o[new]
        # pairs that share an earlier band were compared there
        new = ~((keys[r] == keys[o]) & used[r] & used[o] & (
            np.arange(BANDS) < band[r][:, None])).any(1)
        r, o = r[new], o[new]
        # an estimate is below the least one if too few registers are equal
        x, y = regs[r], regs[o]
        new = ((x == y) & (x != 0)).sum(1) >= least[((x != 0) | (y != 0)).sum(1)]
        r, o = r[new], o[new]
        if not len(r):
            continue
        j, lowest = estimate(regs[r], regs[o], n[r], n[o], percent)
        ratio = np.minimum(n[r], n[o]) / np.maximum(n[r], n[o])
        new = (j >= lowest) & (ratio >= percent / 100 - 1e-9)
        for k, l in zip(r[new].tolist(), o[new].tolist()):
            x, y = find(int(own[k])), find(int(own[l]))
            if x == y:
                continue
            mine, theirs = flat[at[k]:at[k + 1]], flat[at[l]:at[l + 1]]
            same = len(np.intersect1d(mine, theirs, assume_unique=True))
            if _linked(same, len(mine), len(theirs), percent):
                root[x] = y
                a.append(int(ids[k]))
                b.append(int(ids[l]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
