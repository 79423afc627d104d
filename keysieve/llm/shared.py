"""Helpers of the operators: files that all executors share, Arrow batches, words, hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession

from keysieve.workspace import stored, workspace

__all__ = ["stored", "workspace"]

U64 = np.uint64
_MIX1, _MIX2, _STEP = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by a URI or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, name: str):
    """(path, stream) of a file no other attempt of the task writes to.

    A task returns the path; only paths that a finished task returned count, so what an
    attempt that was lost has left behind is never read.
    """
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    full = f"{path}/{name}-{uuid.uuid4().hex}"
    return f"{folder.rstrip('/')}/{full.rsplit('/', 1)[1]}", fs.open_output_stream(full)


def open_file(uri: str):
    folder, name = uri.rsplit("/", 1)
    fs, path = open_folder(folder)
    return fs.open_input_file(f"{path}/{name}")


def raw(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type)
                       else pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    r"""Lower-cased (A-Z only) words ``[^\x20\x09-\x0D]+``; none in a null text."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit digests of words, kept while there are fewer than ``most``."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def array(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), U64, len(found))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct digests of ``width`` consecutive words; of all, if they are fewer."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    x = np.full(n, width, U64)
    for i in range(width):
        x = mix((x + _STEP) ^ hashes[i:i + n])
    return np.unique(x)


def chunks(batches: Iterable[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, so that a batch of long texts is small."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


@contextmanager
def no_cycles():
    """For code that makes very many lists and no cycles: Python does not search them for any."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
