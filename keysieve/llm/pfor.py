"""Token ids in shards of patched frame-of-reference blocks.

A block holds 128 ids (the last of a shard fewer): its minimum is subtracted, the rest is
packed at the width that ``PERCENTILE`` of a block's values fit into, and the values above
it stand in full in a list of exceptions.  A shard is

    blocks      minimum u32, width u8, exceptions u8; packed 64-bit words;
                exceptions as positions u8 and values u32 (less the minimum)
    index       start of each block, u64
    documents   doc_id i64, is null u8, first id in the shard u64
    trailer     ids, blocks, documents, start of the index: u64 each; magic

all little-endian.  Shards hold ascending doc_id; the table of shards (``write``'s result) is
what tells which files count.  Nulls: a null text is empty; a null doc_id is kept and comes
first.  Repeated rows are kept.  Equal doc_ids are ordered by a digest of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks, new_file, open_file, stored, workspace
from keysieve.llm.tokens import encoder

BLOCK, PERCENTILE, MAGIC = 128, 90, b"PFORBLK1"
GROUP = 4096  # blocks encoded or decoded at once
_HEAD = 6
_FILES = "shard int, path string, n_documents long, n_tokens long, n_bytes long"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(k, 128) numbers to (k, words) packed words."""
    v = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((-(-BLOCK * width // 64), v.shape[1]), np.uint64)
    for i in range(BLOCK if width else 0):
        at, bit = divmod(i * width, 64)
        out[at] |= v[i] << np.uint64(bit)
        if bit + width > 64:
            out[at + 1] |= v[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.T)
    out, mask = np.zeros((BLOCK, w.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        at, bit = divmod(i * width, 64)
        x = w[at] >> np.uint64(bit)
        if bit + width > 64:
            x = x | w[at + 1] << np.uint64(64 - bit)
        out[i] = x & mask
    return np.ascontiguousarray(out.T).astype(np.uint32)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks as bytes and the start of each; a short last block is filled with its minimum."""
    k = -(-len(ids) // BLOCK)
    if not k:
        return b"", np.empty(0, np.int64)
    rows = np.full(k * BLOCK, ids[(k - 1) * BLOCK:].min(), np.uint32)
    rows[:len(ids)] = ids
    rows = rows.reshape(k, BLOCK)
    low = rows.min(1)
    delta = rows - low[:, None]
    chosen = np.partition(delta, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.frexp(chosen.astype(float))[1]
    over = (delta >> np.minimum(width, 31)[:, None].astype(np.uint32)) > (width == 32)[:, None]
    extra = over.sum(1)
    n_words = -(-BLOCK * width // 64)
    size = _HEAD + 8 * n_words + 5 * extra
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(k, 4)
    out[start + 4], out[start + 5] = width, extra
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        keep = delta[mine] & np.uint32((1 << int(w)) - 1)
        packed = _pack(keep, int(w)).astype("<u8").view(np.uint8).reshape(len(mine), -1)
        if w:
            out[(start[mine] + _HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    block, at = np.nonzero(over)
    list_at = start + _HEAD + 8 * n_words
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    out[list_at[block] + nth] = at
    values = delta[block, at].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(list_at[block] + extra[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes(), start


def decode_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``start`` in ``data`` (bytes), 128 for each."""
    k = len(start)
    low = np.ascontiguousarray(data[start[:, None] + np.arange(4)]).view("<u4")[:, 0]
    width, extra = data[start + 4].astype(int), data[start + 5].astype(int)
    rows = np.empty((k, BLOCK), np.uint32)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        n = 8 * -(-BLOCK * int(w) // 64)
        words = np.ascontiguousarray(
            data[(start[mine] + _HEAD)[:, None] + np.arange(n)]).view("<u8")
        rows[mine] = _unpack(words, int(w)) if w else 0
    list_at = start + _HEAD + 8 * -(-BLOCK * width // 64)
    at = data[_ragged(list_at, extra)]
    values = np.ascontiguousarray(data[(np.repeat(list_at + extra, extra) + 4 * (
        _ragged(np.zeros(k, int), extra)))[:, None] + np.arange(4)]).view("<u4")[:, 0]
    rows[np.repeat(np.arange(k), extra), at] = values
    return (rows + low[:, None]).ravel()


class ShardWriter:
    """Appends documents to one shard."""

    def __init__(self, stream):
        self.stream, self.size, self.tokens = stream, 0, 0
        self.buffer, self.held = [], 0
        self.starts, self.doc_ids, self.firsts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.firsts.append(self.tokens)
        self.tokens += len(ids)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= GROUP * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.empty(0, np.uint32)
        for i in range(0, n, GROUP * BLOCK):
            data, starts = encode_blocks(ids[i:min(n, i + GROUP * BLOCK)])
            self.starts.append(starts + self.size)
            self.size += len(data)
            self.stream.write(data)
        self.buffer, self.held = [ids[n:]], len(ids) - n

    def close(self) -> int:
        self._flush(self.held)
        starts = np.concatenate(self.starts) if self.starts else np.empty(0, np.int64)
        index = starts.astype("<u8").tobytes()
        null = np.array([d is None for d in self.doc_ids], np.uint8).tobytes()
        docs = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        firsts = np.array(self.firsts, "<u8").tobytes()
        trailer = np.array([self.tokens, len(starts), len(self.doc_ids), self.size], "<u8")
        for part in (index, docs, null, firsts, trailer.tobytes(), MAGIC):
            self.stream.write(part)
            self.size += len(part)
        self.stream.close()
        return self.size


class ShardReader:
    """Documents of a shard, all in order or single ones by their place."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.tokens, blocks, docs, at = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        rest = file.read_at(size - 40 - at, at)
        cut = np.cumsum([8 * blocks, 8 * docs, docs])
        self.starts = np.append(np.frombuffer(rest[:cut[0]], "<u8").astype(np.int64), at)
        ids = np.frombuffer(rest[cut[0]:cut[1]], "<i8")
        null = np.frombuffer(rest[cut[1]:cut[2]], np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.firsts = np.append(np.frombuffer(rest[cut[2]:], "<u8").astype(np.int64),
                                self.tokens)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1 of the shard; the index gives the blocks to read."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        at = self.starts[a:b + 1]
        data = np.frombuffer(self.file.read_at(int(at[-1] - at[0]), int(at[0])), np.uint8)
        return decode_blocks(data, at[:-1] - at[0])[first - a * BLOCK:last - a * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of all documents, with some thousand blocks decoded at once."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(
                self.firsts, self.firsts[i] + GROUP * BLOCK, "right")) - 1)
            j = min(j, n)
            base = int(self.firsts[i])
            ids = self.ids(base, int(self.firsts[j]))
            for k in range(i, j):
                yield k, ids[self.firsts[k] - base:self.firsts[k + 1] - base]
            i = j


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None
          ) -> DataFrame:
    """Write shards of ascending doc_id to a shared folder; returns the table of shards."""
    folder = folder or workspace(docs.sparkSession, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, writer = encoder(tokenizer), np.array([end_id], np.uint32), None
        for batch in chunks(batches):
            if writer is None:
                part = TaskContext.get().partitionId()
                path, stream = new_file(folder, f"part-{part:06d}")
                writer = ShardWriter(stream)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(coder.encode(text), coder.type).astype(np.uint32)
                writer.add(doc_id, np.append(ids, end))
        if writer is not None:
            n_docs, n_tokens = len(writer.doc_ids), writer.tokens
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([part], pa.int32()), "path": [path],
                "n_documents": [n_docs], "n_tokens": [n_tokens], "n_bytes": [writer.close()]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", F.xxhash64("text"))
    return stored(dealt.mapInArrow(run, _FILES), "shard-list")


def read(files: DataFrame) -> DataFrame:
    """The documents of the shards a table of shards names.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    first = F.coalesce(F.sum("n_tokens").over(  # one row per shard
        W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = stored(files.select("shard", "path", first.alias("first")), "shard-starts")
    n = max(1, min(listed.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
                with open_file(path) as file:
                    shard = ShardReader(file)
                    crc = [zlib.crc32(ids.astype("<u4")) for _, ids in shard.documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.firsts[:-1] + base),
                     pa.array(np.diff(shard.firsts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(n, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
