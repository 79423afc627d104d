"""Passages that an earlier document already has, by range-partitioned suffixes.

A byte is removed if a string of ``window`` bytes that covers it also starts in a document with
a smaller doc_id.

1. Of the GRAM-byte strings in a window the one with the smallest hash (the first, if several)
   is its anchor.  Equal windows have their anchors at the same place, so it is enough to sort
   the suffixes that begin at anchors, one in about 19.  A suffix goes with the bytes before it,
   as far as windows with this anchor reach.
2. Splitters, quantiles of a sample of suffixes, cut the suffixes by their first 16 bytes into
   ranges.  Suffixes that begin like a splitter, of which there may be any number, are dealt
   out over both of its sides, or over all ranges between equal splitters.
3. A range sorts its suffixes by multikey quicksort, eight bytes a character.  Common prefixes
   of neighbours, and those of the bytes before the anchor, tell which windows are equal;
   each gets the smallest doc_id of its range.
4. Windows whose equals may lie in another range, because their suffix shares its beginning
   with a splitter, are compared across boundaries: each range sends its smallest document of
   such a window, and where a smaller one is found, that document's bytes go too.

Documents are taken as UTF-8 bytes, null texts as empty.  Rows that share a doc_id are one
document: none removes bytes of another.  A null doc_id neither removes nor is removed from.
Long texts are cut into overlapping segments, so a task holds ``FLUSH`` bytes of text at a time.

The sample takes one stretch of 4 KiB in ``RATE`` of them at most, so it is 16 bytes in some
200 KB of text on the driver; the splitters sent to tasks are at most ``MOST_RANGES`` times 16
bytes.  Beyond 2 TB of text ranges grow instead of their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks, mix, raw, stored

GRAM = 12
RANGE = 100_000  # suffixes of a range
LEAST_RANGES, MOST_RANGES = 64, 1_000_000
STRETCH, RATE, STRETCHES = 4096, 1000, 400
SEGMENT, FLUSH, STEP = 4 << 20, 8 << 20, 1 << 18
CUTOFF = 4096  # pieces that quicksort leaves to a plain sort
_U = np.uint64
_SIGN = _U(1 << 63)
_PAD = 128
_ITEMS = ("doc", "key", "at", "offset", "windows")


def anchors(text: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first, last, anchor) of runs of windows with one anchor.

    ``text`` is padded by ``_PAD`` bytes, ``valid`` marks the starts of windows.
    """
    grams, n = window - GRAM + 1, len(valid)
    first, last, anchor = [], [], []
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        size = hi - lo + grams - 1
        view = np.lib.stride_tricks.as_strided(text[lo:], (size + GRAM - 8, 8), (1, 1))
        word = np.ascontiguousarray(view).view("<u8").ravel()
        h = word[:size] * _U(0x9E3779B97F4A7C15) ^ word[GRAM - 8:] * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        h *= _U(0x94D049BB133111EB)
        h &= _U(0xFFFFFFFF00000000)
        low = h | np.arange(size, dtype=_U)
        span = 1
        while span * 2 <= grams:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < grams:
            low = np.minimum(low[:len(low) - (grams - span)], low[grams - span:])
        at = (low & _U(0xFFFFFFFF)).astype(np.int64)
        ok = valid[lo:hi]
        cut = at[1:] != at[:-1]
        begins, ends = ok.copy(), ok.copy()
        begins[1:] &= cut | ~ok[:-1]
        ends[:-1] &= cut | ~ok[1:]
        begins = np.flatnonzero(begins)
        first.append(begins + lo)
        last.append(np.flatnonzero(ends) + lo)
        anchor.append(at[begins] + lo)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last, anchor))


def _bytes_from(text: np.ndarray, at: np.ndarray, n_words: int, length: np.ndarray,
                back: bool = False) -> list[np.ndarray]:
    """Big-endian words of the ``length`` bytes from ``at`` on (back: before it, reversed),
    zeros behind."""
    windows = np.lib.stride_tricks.sliding_window_view(text, 8)
    out = []
    for j in range(n_words):
        word = windows[at - 8 * (j + 1)].view("<u8") if back else windows[at + 8 * j].view(">u8")
        word = word.ravel().astype(_U)
        drop = np.clip(8 * (j + 1) - length, 0, 8).astype(_U)
        keep = ~_U(0) << np.minimum(drop * _U(8), _U(63))
        out.append(np.where(drop == 8, _U(0), word & keep))
    return out


def multikey_quicksort(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by ``words``: parts below and above a pivot go on with the same
    character, equal ones with the next."""
    order = np.arange(len(words[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(words):
            continue
        rows = order[lo:hi]
        if hi - lo <= CUTOFF:
            order[lo:hi] = rows[np.lexsort([w[rows] for w in reversed(words[depth:])])]
            continue
        word = words[depth][rows]
        pivot = np.sort(word[::max(1, len(word) // 9)])[4]
        less, same = word < pivot, word == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum() + same.sum())
        order[lo:hi] = np.concatenate([rows[less], rows[same], rows[~(less | same)]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _common(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it in ``order``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for word in words:
        differ = word[order[open_]] ^ word[order[open_ - 1]]
        same = differ == 0
        rest = np.ascontiguousarray(differ[~same].astype(">u8")).view(np.uint8).reshape(-1, 8)
        out[open_[~same]] += (rest != 0).argmax(1)
        open_ = open_[same]
        out[open_] += 8
        if not len(open_):
            break
    return out


# --- suffixes and their ranges ------------------------------------------------------------------


class _Suffixes:
    """Suffixes of a task's documents, given out in blobs of one range."""

    def __init__(self, window: int, splitters: np.ndarray):
        self.window, self.splitters = window, splitters
        self.clear()

    def clear(self):
        self.texts, self.docs, self.size = [], [], 0

    def add(self, doc: int, key: int, text: bytes) -> Iterator[tuple[int, bytes]]:
        for lo in range(0, max(0, len(text) - self.window + 1), SEGMENT):
            part = text[lo:lo + SEGMENT + self.window - 1]
            self.texts.append(part)
            self.docs.append((doc, key, lo, len(part)))
            self.size += len(part)
            if self.size >= FLUSH:
                yield from self.flush()

    def found(self):
        """text, anchors, and for each: doc, key, at, offset, windows."""
        text = np.frombuffer(b"".join(self.texts) + bytes(_PAD), np.uint8)
        doc, key, base, length = np.array(self.docs, np.int64).reshape(-1, 4).T
        ends = np.cumsum(length)
        mark = np.zeros(self.size + 1, np.int8)
        np.add.at(mark, ends - length, 1)
        np.add.at(mark, ends - self.window + 1, -1)
        valid = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        first, last, anchor = anchors(text, valid, self.window)
        of = np.searchsorted(ends, anchor, "right")
        at = anchor - (ends - length)[of] + base[of]
        return text, anchor, (doc[of], key[of], at, anchor - first, last - first + 1)

    def keys(self, text, anchor, offset, windows) -> list[np.ndarray]:
        length = self.window - (offset - windows + 1)
        return _bytes_from(text, anchor, 2, np.minimum(length, 16))

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.texts:
            return
        text, anchor, items = self.found()
        self.clear()
        if not len(anchor):
            return
        doc, _, at, offset, windows = items
        one, two = self.keys(text, anchor, offset, windows)
        order = np.lexsort((two, one))
        one, two, anchor = one[order], two[order], anchor[order]
        items = [x[order] for x in items]
        doc, _, at, offset, windows = items
        place = self.ranges(one, two, mix(doc.view(_U) ^ mix(at.view(_U))))
        order = np.argsort(place, kind="stable")
        place, start = place[order], (anchor - offset)[order]
        items = [x[order] for x in items]
        length = self.window + items[4] - 1
        widest = int(length.max())
        view = np.lib.stride_tricks.sliding_window_view(text, widest)
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        packer = zstandard.ZstdCompressor(level=3)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            body = view[start[lo:hi]][np.arange(widest) < length[lo:hi, None]]
            planes = [np.ascontiguousarray(x[lo:hi].astype("<i8").view(np.uint8).reshape(-1, 8).T)
                      for x in items[:3]]
            small = [x[lo:hi].astype(np.uint8) for x in items[3:]]
            yield int(place[lo]), packer.compress(b"".join(
                [np.int64(hi - lo).tobytes(), *(x.tobytes() for x in (*planes, *small, body))]))

    def ranges(self, one, two, deal) -> np.ndarray:
        """The range of each of the sorted keys."""
        s1, s2 = self.splitters[:, 0], self.splitters[:, 1]
        lo, hi = np.searchsorted(one, s1, "left"), np.searchsorted(one, s1, "right")
        below, upto = lo.copy(), lo.copy()  # rows below a splitter, and with those equal to it
        for i in np.flatnonzero(lo < hi).tolist():
            part = two[lo[i]:hi[i]]
            below[i] += np.searchsorted(part, s2[i], "left")
            upto[i] += np.searchsorted(part, s2[i], "right")
        step = np.zeros(len(one) + 1, np.int64)
        np.add.at(step, upto, 1)  # splitters at most as large as a row's key, with it ...
        high = np.cumsum(step[:-1])
        equal = np.zeros(len(one) + 1, np.int64)
        np.add.at(equal, below, 1)
        np.add.at(equal, upto, -1)  # ... and those equal to it
        same = np.cumsum(equal[:-1])
        return high + (deal % (same + 1).astype(_U)).astype(np.int64)


def _unpacked(blobs: list[bytes], window: int):
    """text (padded on both sides), anchors, items of the suffixes of a range."""
    unpacker, bodies, items = zstandard.ZstdDecompressor(), [], []
    for blob in blobs:
        flat = np.frombuffer(unpacker.decompress(blob), np.uint8)
        n, at, own = int(flat[:8].view("<i8")[0]), 8, []
        for _ in range(3):
            planes = flat[at:at + 8 * n].reshape(8, n).T
            own.append(np.ascontiguousarray(planes).view("<i8").ravel())
            at += 8 * n
        for _ in range(2):
            own.append(flat[at:at + n].astype(np.int64))
            at += n
        bodies.append(flat[at:])
        items.append(own)
    pad = np.zeros(_PAD, np.uint8)
    text = np.concatenate([pad, *bodies, pad])
    items = [np.concatenate(x) for x in zip(*items)]
    length = window + items[4] - 1
    anchor = _PAD + np.cumsum(length) - length + items[3]
    return text, anchor, items


def compare(blobs: list[bytes], below, above, window: int) -> pa.Table:
    """Spans to remove and windows to compare across boundaries, of the suffixes of a range.

    ``below`` and ``above`` are the splitters at its ends, None at the ends of all.
    """
    text, anchor, (doc, key, at, offset, windows) = _unpacked(blobs, window)
    least = offset - windows + 1
    right = _bytes_from(text, anchor, -(-window // 8), window - least)
    left = _bytes_from(text, anchor, -(-(window - GRAM) // 8), offset, back=True)
    order = multikey_quicksort([*right, *left, (offset * 256 + least).astype(_U),
                                doc.view(_U) ^ _SIGN])
    right, left = [x[order] for x in right], [x[order] for x in left]
    doc, key, at, offset, least, anchor = (x[order] for x in (doc, key, at, offset, least, anchor))
    n = len(order)
    plain = np.arange(n)
    ahead, behind = _common(right, plain), _common(left, plain)
    fresh = np.ones(n, bool)  # first of the suffixes with equal bytes and windows
    fresh[1:] = ((ahead[1:] < 8 * len(right)) | (behind[1:] < 8 * len(left))
                 | (offset[1:] != offset[:-1]) | (least[1:] != least[:-1]))
    head = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    later = doc > doc[head][run]
    covered = _covered([x[head] for x in right], [x[head] for x in left], ahead[head],
                       doc[head], offset[head], least[head], window)
    # whole suffixes with a smaller document, and single windows of the smallest ones
    whole = (_U(2) << offset.astype(_U)) - (_U(1) << least.astype(_U))
    bits = np.where(later, whole, covered[run])
    out = [_spans(bits, doc, key, at, window)]
    if below is not None or above is not None:
        shared = np.zeros(n, np.int64)
        for splitter in (below, above):
            if splitter is not None:
                ends = [np.append(np.array([s], _U), w) for s, w in zip(splitter, right[:2])]
                both = np.zeros(n, np.int64)
                one, two = ends[0][1:] ^ ends[0][0], ends[1][1:] ^ ends[1][0]
                for word, more in ((one, 0), (two, 8)):
                    bytes_ = np.ascontiguousarray(word.astype(">u8")).view(np.uint8).reshape(-1, 8)
                    lead = np.where(word == 0, 8, (bytes_ != 0).argmax(1))
                    both = np.where(both == more, more + lead, both)
                shared = np.maximum(shared, both)
        # a window with ``o`` bytes before the anchor has window - o behind it
        open_ = whole & ~bits
        reach = np.where(shared >= 16, 0, window - shared)
        open_ &= ~((_U(1) << np.clip(reach, 0, 63).astype(_U)) - _U(1))
        open_[later | (shared < GRAM)] = 0
        out.append(_windows(open_, text, anchor, doc, key, at, window))
    return pa.concat_tables(out)


def _covered(right, left, ahead, doc, offset, least, window: int) -> np.ndarray:
    """Bits of the windows, by their bytes before the anchor, that a smaller document has.

    The suffixes are distinct and sorted; ``ahead``: what each has in common with the last.
    """
    n = len(doc)
    bits = np.zeros(n, _U)
    if n < 2:
        return bits
    gram = [right[0], right[1] >> _U(8 * (16 - GRAM))]
    by_left = np.lexsort([*reversed(left), *reversed(gram)])
    behind = _common(left, by_left)
    for g in gram:
        behind[1:][g[by_left[1:]] != g[by_left[:-1]]] = -1
    behind[0] = -1
    ahead = ahead.copy()
    ahead[0] = -1
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    most_ahead = np.maximum(ahead, np.append(ahead[1:], -1))
    most_behind = np.maximum(behind, np.append(behind[1:], -1))[place]
    lo, hi = np.maximum(least, window - most_ahead), np.minimum(offset, most_behind)
    some = np.flatnonzero(lo <= hi)
    for o in range(window - GRAM + 1):
        rows = some[(lo[some] <= o) & (o <= hi[some])]
        if len(rows) < 2:
            continue
        group = (np.cumsum(ahead < window - o)[rows] * (n + 1)
                 + np.cumsum(behind < o)[place[rows]])
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        smallest = np.repeat(np.minimum.reduceat(doc[rows][order], first),
                             np.diff(np.append(first, len(rows))))
        bits[rows[order][doc[rows][order] > smallest]] |= _U(1 << o)
    return bits


_KINDS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()),
                    ("stop", pa.int64()), ("bytes", pa.binary())])


def _spans(bits, doc, key, at, window: int) -> pa.Table:
    """A row per run of set bits; bit o is the window that starts o bytes before the anchor."""
    rows = np.flatnonzero(bits)
    bits = bits[rows]
    parts = []
    while len(rows):
        low = bits & (~bits + _U(1))
        first = np.log2(low.astype(float)).astype(np.int64)
        grown = bits + low  # the lowest run of ones becomes one higher bit
        end = grown & ~bits
        end = np.log2((end & (~end + _U(1))).astype(float)).astype(np.int64)
        parts.append((rows, at[rows] - end + 1, at[rows] - first + window))
        bits = bits & grown
        more = bits != 0
        rows, bits = rows[more], bits[more]
    if not parts:
        return _KINDS.empty_table()
    row, start, stop = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc[row]))
    row, start, stop = row[order], start[order], stop[order]
    return pa.table([pa.array(doc[row]), pa.array(key[row]), pa.array(start), pa.array(stop),
                     pa.nulls(len(row), pa.binary())], schema=_KINDS)


def _windows(bits, text, anchor, doc, key, at, window: int) -> pa.Table:
    """A row per set bit, with the bytes of the window."""
    tables = []
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    for o in range(window - GRAM + 1):
        rows = np.flatnonzero(bits & _U(1 << o))
        if len(rows):
            flat = np.ascontiguousarray(view[anchor[rows] - o])
            data = pa.py_buffer(flat)
            ends = pa.py_buffer(np.arange(0, window * (len(rows) + 1), window, dtype=np.int32))
            tables.append(pa.table(
                [pa.array(doc[rows]), pa.array(key[rows]), pa.array(at[rows] - o),
                 pa.array(at[rows] - o + window),
                 pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, data])],
                schema=_KINDS))
    return pa.concat_tables(tables) if tables else _KINDS.empty_table()


# --- the operator -----------------------------------------------------------------------------------


def _splitters(texts: DataFrame, n_bytes: int, ranges: int, window: int) -> np.ndarray:
    """Quantiles of the first 16 bytes of suffixes in sampled stretches of the texts."""
    rate = max(1, min(RATE, n_bytes // (STRETCH * STRETCHES)))
    chosen = F.expr(f"""filter(sequence(0, (octet_length(text) - 1) div {STRETCH}),
                        i -> pmod(xxhash64(doc_id, i), {rate}) = 0)""")
    parts = texts.where("octet_length(text) > 0").select(
        F.explode(chosen).alias("i"), "text").select(
        F.substring("text", F.col("i") * STRETCH + 1, F.lit(STRETCH)).alias("part"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Suffixes(window, np.zeros((0, 2), _U))
            found.texts = [p for p in batch.column(0).to_pylist() if len(p) >= window]
            found.docs = [(0, 0, 0, len(p)) for p in found.texts]
            found.size = sum(map(len, found.texts))
            if found.texts:
                text, anchor, items = found.found()
                pair = found.keys(text, anchor, *items[3:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in pair], ["one", "two"])

    sample = parts.mapInArrow(keys, "one long, two long").toArrow()
    one, two = (sample[c].to_numpy().view(_U) for c in ("one", "two"))
    order = np.lexsort((two, one))
    at = order[(np.arange(1, ranges) * len(order)) // ranges] if len(order) else order
    return np.stack([one[at], two[at]], 1)


def spans(texts: DataFrame, window: int = 50, range_size: int = RANGE,
          least_ranges: int = LEAST_RANGES) -> DataFrame:
    """doc_id, key, start, stop: bytes of (doc_id, key, text) to remove; spans may overlap."""
    texts = texts.where("doc_id is not null")
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    per_range = range_size * (window - GRAM + 2) // 2
    ranges = min(max(least_ranges, n_bytes // per_range), MOST_RANGES)
    splitters = _splitters(texts, n_bytes, ranges, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Suffixes(window, splitters)

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in found], pa.int32()),
                 pa.array([b for _, b in found], pa.binary())], ["range", "suffixes"])

        for batch in chunks(batches, 200):
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                      batch.column(2).to_pylist()):
                found = list(held.add(doc, key, text))
                if found:
                    yield rows(found)
        found = list(held.flush())
        if found:
            yield rows(found)

    def one_range(group: tuple, t: pa.Table) -> pa.Table:
        nth = group[0].as_py()
        below = splitters[nth - 1] if nth > 0 else None
        above = splitters[nth] if nth < len(splitters) else None
        return compare(t["suffixes"].to_pylist(), below, above, window)

    found = texts.select("doc_id", "key", "text").mapInArrow(
        cut, "range int, suffixes binary").groupBy("range").applyInArrow(
        one_range, "doc_id long, key long, start long, stop long, bytes binary")
    found = stored(found, "spans")
    # A range has sent its smallest document of a window only.
    across = found.where("bytes is not null")
    smallest = across.groupBy("bytes").agg(F.min("doc_id").alias("least"))
    more = across.join(smallest, "bytes").where("doc_id > least")
    return found.where("bytes is null").drop("bytes").union(
        more.select("doc_id", "key", "start", "stop"))


def remove_repeats(docs: DataFrame, window: int = 50, range_size: int = RANGE,
                   least_ranges: int = LEAST_RANGES) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs: start, stop), kept (bytes left)."""
    texts = docs.select(F.col("doc_id").cast("long"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
                        .alias("text")).withColumn("digest", F.xxhash64("text"))
    # Only a doc_id with several texts needs more than itself to name a text.
    several = stored(texts.groupBy("doc_id").agg(
        F.min("digest").alias("a"), F.max("digest").alias("b")).where(
        "a <> b and doc_id is not null").select(F.col("doc_id").alias("several")), "several")
    texts = texts.join(several, texts["doc_id"] == several["several"], "left").select(
        "doc_id", F.when(F.col("several").isNotNull(), F.col("digest")).otherwise(0).alias("key"),
        "text")
    gone = spans(texts, window, range_size, least_ranges).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(
                    [packer.compress(t) for t in batch.column(2).to_pylist()], pa.binary())],
                ["doc_id", "key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in chunks(batches, 200):
            lengths, out, kept = [], [], []
            lists = batch.column(2)
            for i, packed_ in enumerate(batch.column(1).to_pylist()):
                text = unpacker.decompress(packed_)
                found = lists[i].values
                merged = [] if found is None else _merged(
                    found.field("start").to_numpy(), found.field("stop").to_numpy())
                at, parts = 0, []
                for start, stop in merged:
                    parts.append(text[at:start])
                    at = stop
                lengths.append(len(text))
                out.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(out, runs),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    small = texts.mapInArrow(packed, "doc_id long, key long, text binary")
    return small.join(gone, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def _merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return list(zip(start[np.append(0, cut)].tolist(),
                    reach[np.append(cut - 1, len(start) - 1)].tolist()))
