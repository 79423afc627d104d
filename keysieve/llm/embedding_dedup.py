"""Near-copies among embeddings: int8 tile products with rigorous error bounds.

A vector x of length one is held as s * q with q in int8, and its error e = |x - s q| is
computed, not estimated.  For two vectors, |x.y - s_x s_y q_x.q_y| <= e_x |s_y q_y| + e_y.
A pair is recomputed in double precision only if the int8 product plus this bound reaches the
threshold, so no pair at or above it is lost, and every link rests on a double-precision
cosine.

Vectors with the same label and equal components are one class from the start, counted with
its copies.  The classes of a label are dealt into even blocks: of about ``TILE``, and in a
label of very many into about ``BLOCKS`` until they hold ``TILE_MOST``, because each vector is
sent once per block.  Each pair of blocks is one tile of one task, so a label that holds most
vectors is many even tiles.  Vectors travel in the precision they came in.  A tile returns the
number of links per vector and a spanning forest of them, never the pairs.

Null, zero and non-finite vectors and rows without label link with nothing.  Rows repeated
under one vec_id with the same label and vector count as one vector; of a vec_id with several
vectors or labels each row reports the links of its own one, and all of them are in one
component.  Vectors of different lengths never link.  A null vec_id is kept with no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from keysieve.llm.components import components
from keysieve.llm.shared import chunks, stored

TILE, TILE_MOST, BLOCKS = 1024, 8192, 24
SLACK = 1e-9  # rounding of the double-precision bounds themselves

_ROWS = ("vec_id long, label string, digest string, vector binary, quantised binary, "
         "scale double, error double, reach double")


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, s, |x - s q|, |s q| of rows of length one."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def _prepared(vectors: DataFrame, kind: type) -> DataFrame:
    """Rows as numbers; digest is null for vectors that link with nothing."""
    names = [x.split()[0] for x in _ROWS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(),
             pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4000):
            out = []
            for vec_id, label, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.array([np.nan if a is None else a for a in v or [0.0]], float) + 0.0
                digest = xxhash.xxh3_128_hexdigest(x.tobytes())  # + 0.0: -0.0 becomes 0.0
                if kind is float:  # by a power of two, so that no square overflows or vanishes
                    x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
                length = np.sqrt(x @ x)
                if label is None or vec_id is None or not np.isfinite(length) or length == 0:
                    out.append((vec_id, label, None, None, None, None, None, None))
                    continue
                q, s, e, r = quantise(x[None] / length)
                out.append((vec_id, label, digest, x.astype(kind).tobytes(), q.tobytes(), s[0],
                            e[0], r[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"),
        F.col("embedding").cast("array<double>")).mapInArrow(run, _ROWS)


def near_copies(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked at a cosine of ``threshold``."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = np.float32 if single else float
    rows = stored(_prepared(vectors, kind), "vectors")
    once = rows.where("digest is not null").groupBy("vec_id", "label", "digest").agg(
        F.any_value(F.struct("vector", "quantised", "scale", "error", "reach")).alias("r"))
    classes = stored(once.groupBy("label", "digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
        F.any_value("r").alias("r")).select("label", "digest", "rep", "copies", "r.*"),
        "classes")
    # A class goes by its smallest vec_id; if several do by the same one, by a negative digest.
    shared = stored(classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(
        "rep", F.lit(True).alias("shared")), "shared")
    odd = not shared.isEmpty()
    classes = classes.withColumn("first_id", F.col("rep"))
    if odd:
        classes = stored(classes.join(shared, "rep", "left").withColumn("rep", F.when(
            F.col("shared"), F.xxhash64("label", "digest").bitwiseOR(F.lit(-1 << 63))).otherwise(
            F.col("rep"))).drop("shared"), "classes")
    names = classes.select("label", "digest", "rep", "first_id", "copies")
    n = F.count("*")
    side = F.greatest(F.lit(tile), F.least(F.lit(max(tile, TILE_MOST)), n / BLOCKS))
    blocks = classes.groupBy("label").agg(F.ceil(n / side).cast("int").alias("n_"))
    dealt = classes.join(blocks, "label").withColumn(
        "at_", F.pmod(F.xxhash64("rep"), F.col("n_")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_") - 1))).select(
        "label", F.least("at_", "other").alias("i"), F.greatest("at_", "other").alias("j"),
        (F.col("at_") <= F.col("other")).alias("first"), "rep", "copies", "vector",
        "quantised", "scale", "error", "reach")

    def compare(t: pa.Table) -> pa.Table:
        return _tile(t, threshold, kind)

    found = stored(tiles.groupBy("label", "i", "j").applyInArrow(
        compare, "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(
        F.sum("n").alias("n_"))
    links = found.where("b is not null").select("a", "b")
    if odd:
        ids = names.where("rep <> first_id").select("rep", "first_id")
        for end in ("a", "b"):
            links = links.join(ids.withColumnRenamed("rep", end), end, "left").withColumn(
                end, F.coalesce("first_id", end)).drop("first_id")
    # the vectors of one vec_id belong together
    several = stored(once.groupBy("vec_id").agg(F.count("*").alias("n")).where(
        "n > 1 and vec_id is not null").select("vec_id"), "several")
    more = once.select("vec_id", "label", "digest").join(several, "vec_id", "left_semi").join(
        names, ["label", "digest"]).select(F.col("vec_id").alias("a"), F.col("first_id").alias("b"))
    named = components(links.select("a", "b").union(more))
    known = names.join(counts, "rep", "left").join(
        named.withColumnRenamed("node", "first_id"), "first_id", "left").select(
        "label", "digest", (F.coalesce("n_", F.lit(0)) + F.col("copies") - 1).alias("links_"),
        F.coalesce("component", "first_id").alias("component_"))
    out = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    return out.select(
        "vec_id", F.coalesce("links_", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tile(t: pa.Table, threshold: float, kind: type) -> pa.Table:
    """Rows (vector, null, links) and (a, b, null) of a forest of a tile's links."""
    on_first = t["first"].to_numpy(zero_copy_only=False)
    same = t["i"][0].as_py() == t["j"][0].as_py()
    rep, copies, scale, error, reach = (t[c].to_numpy() for c in (
        "rep", "copies", "scale", "error", "reach"))
    length = np.array([len(x) for x in t["quantised"].to_pylist()])
    links, a, b = np.zeros(len(rep), np.int64), [], []
    root = np.arange(len(rep))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for d in np.unique(length):
        mine = np.flatnonzero(length == d)
        rows = mine[on_first[mine]]
        cols = mine if same else mine[~on_first[mine]]
        if not len(rows) or not len(cols):
            continue
        q = np.zeros((len(rep), d), np.float32 if d <= 1024 else np.float64)  # exact sums
        q[mine] = np.frombuffer(b"".join(t["quantised"].take(pa.array(mine)).to_pylist()),
                                np.int8).reshape(-1, d)
        x = np.zeros((len(rep), d))
        x[mine] = np.frombuffer(b"".join(t["vector"].take(pa.array(mine)).to_pylist()),
                                kind).reshape(-1, d)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        for k in range(0, len(rows), 256):
            r = rows[k:k + 256]
            near = (q[r] @ q[cols].T) * scale[r][:, None] * scale[cols]
            bound = error[r][:, None] * reach[cols] + error[cols] + SLACK
            u, v = np.nonzero(near + bound >= threshold)
            u, v = r[u], cols[v]
            if same:
                u, v = u[u < v], v[u < v]
            for m in range(0, len(u), 100_000):
                p, s = u[m:m + 100_000], v[m:m + 100_000]
                exact = np.einsum("ij,ij->i", x[p], x[s]) / (norm[p] * norm[s])
                p, s = p[exact >= threshold], s[exact >= threshold]
                np.add.at(links, p, copies[s])
                np.add.at(links, s, copies[p])
                for y, z in zip(p.tolist(), s.tolist()):
                    f, g = find(y), find(z)
                    if f != g:
                        root[f] = g
                        a.append(int(rep[y]))
                        b.append(int(rep[z]))
    hit = np.flatnonzero(links)
    return pa.table({
        "a": pa.array([*rep[hit].tolist(), *a], pa.int64()),
        "b": pa.array([*[None] * len(hit), *b], pa.int64()),
        "n": pa.array([*links[hit].tolist(), *[None] * len(a)], pa.int64())})
