"""WARC files of web pages, read back by verifying the chain of record boundaries.

``write`` makes one file per task: a ``response`` record for the first page with a payload,
a ``revisit`` without payload for each later page with the same one.

``read`` cuts the files into byte ranges.  Each task looks for the magic ``WARC/1.0`` in its
range and emits every candidate with the offset of its successor, also those inside
payloads; a header may be of any length.  Then pointers jump: each candidate knows the first
candidate of a later range that its chain leads to, pointers are doubled round by round, and
what the file's start reaches is kept.  Magic inside a payload is on no such chain.  Payloads
are read and hashed afterwards, of the records that are left only.  A file with another number
of records than its table of files says is an error.

A null html is an empty payload, a null url leaves out the header, a null page_id is written
as a record without a page and read back as null; it refers to others but is only referred
to if no page with the payload has an id.  Rows repeated with the smallest page_id of a
payload are all responses.  An empty table gives no file and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import new_file, open_file, raw, stored, workspace

MAGIC = b"WARC/1.0\r\n"
RANGE = 8 << 20  # bytes of a file that one task searches
PIECE = 4 << 20  # bytes of a payload that are hashed at a time
_AHEAD = 1 << 16  # bytes read behind a range; more, if a header is longer
_RECORDS = ("path string, offset long, next long, page_id long, payload_bytes long, "
            "payload_digest string, record_type string, refers_to long")


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record: WARC header, HTTP header, and for a response the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {
        len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/"
                    "identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write pages as WARC files; returns the table of files (path, n_bytes, n_records).

    Payloads of fewer than ``least`` bytes are always written in full.
    """
    folder = folder or workspace(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.unhex(F.sha1(F.encode("html", "utf-8")))
    keyed = rows.withColumn("sha_", sha)
    first = rows.where(F.octet_length("html") >= least).groupBy(sha.alias("sha_")).agg(
        F.min("page_id").alias("first_"), F.count("*").alias("n_"))
    # Payloads that occur once need no partner: this side is the repeated ones only.  It is
    # stored, so Spark knows its size and sends it to the pages rather than shuffle them,
    # as long as it is small enough for that.
    first = stored(first.where("n_ > 1").drop("n_"), "repeated")
    decided = keyed.join(first, "sha_", "left").select(
        "page_id", "url", "html", "first_",
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_")) & F.col("first_").isNotNull(),
                   F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, size = None, 0, 0
        for batch in batches:
            if path is None:
                path, stream = new_file(folder, "pages")
            for page, url, html, to, again in zip(
                    *(batch.column(i).to_pylist() for i in (0, 1)), raw(batch.column(2)),
                    *(batch.column(i).to_pylist() for i in (3, 4))):
                data = record(page, url, html, to, again)
                stream.write(data)
                n, size = n + 1, size + len(data)
        if path is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size],
                                              "n_records": [n]})

    return stored(decided.mapInArrow(run, "path string, n_bytes long, n_records long"),
                  "warc-list")


def parse(data: bytes, at: int) -> tuple | None:
    """(next, fields, body start) of a candidate record at ``at``; None if it is none.

    ``next`` may lie beyond ``data``.
    """
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = _fields(data[at:end])
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return end + 4 + int(fields["content-length"]) + 4, fields, end + 4


def _number(fields: dict, name: str) -> int | None:
    value = fields.get(name, "")
    return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) else None


def _candidates(path: str, start: int, end: int) -> list[tuple]:
    """Candidates whose magic begins in [start, end)."""
    found = []
    with open_file(path) as file:
        size = file.size()
        # Records begin a file or follow an empty line, so no two headers overlap.
        back = min(4, start)
        start -= back
        data = file.read_at(min(size, end + _AHEAD) - start, start)
        at = data.find(MAGIC, back)
        while 0 <= at < end - start:
            if start + at > 0 and data[at - 4:at] != b"\r\n\r\n":
                at = data.find(MAGIC, at + 1)
                continue
            while data.find(b"\r\n\r\n", at) < 0 and start + len(data) < size:
                data += file.read_at(min(len(data), size - start - len(data)), start + len(data))
            got = parse(data, at)
            if got and start + got[0] <= size:
                nxt = got[0]
                # only the closing bytes are read: what stands between may be no record at all
                tail = data[nxt - 4:nxt] if nxt <= len(data) else (
                    file.read_at(4, start + nxt - 4))
                if tail == b"\r\n\r\n":
                    found.append((path, start + at, start + nxt))
            at = data.find(MAGIC, at + 1)
    return found


def _tasks(files: DataFrame, size: int) -> int:
    total = files.agg(F.sum(F.ceil(F.col("n_bytes") / size))).first()[0] or 1
    return max(1, min(int(total), 100_000))


def candidates(files: DataFrame, size: int = RANGE) -> DataFrame:
    """path, offset, next: all candidate records, each with its successor's offset."""
    ranges = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(size).cast("long"))).alias("at"))
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("next", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n, at in zip(*(batch[c].to_pylist() for c in ("path", "n_bytes", "at"))):
                rows = _candidates(path, at, min(n, at + size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)],
                    schema.names)

    return ranges.repartition(_tasks(files, size), "path", "at").mapInArrow(
        run, "path string, offset long, next long")


def _exits(found: DataFrame, size: int) -> DataFrame:
    """path, offset, first offset in a later range its chain leads to.

    The chain inside a range is followed in the task that has the range's candidates.
    """
    def run(pdf):
        nxt = dict(zip(pdf["offset"], pdf["next"]))
        end = (pdf["offset"].iloc[0] // size + 1) * size
        out = {}
        for at in sorted(nxt, reverse=True):
            out[at] = nxt[at] if nxt[at] >= end else out.get(nxt[at], -1)
        pdf["exit"] = pdf["offset"].map(out).astype(np.int64)
        return pdf[["path", "offset", "exit"]]

    return found.select("path", "offset", "next", F.floor(F.col("offset") / size).alias("r")
                        ).groupBy("path", "r").applyInPandas(
        run, "path string, offset long, exit long")


def reachable(found: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, offset) of the candidates that the chain from the file's start reaches."""
    jump = stored(_exits(found, size), "exits")
    # Only entries of ranges jump: offsets some exit points to, and the file's start.
    targets = jump.select("path", F.col("exit").alias("offset")).where("offset > 0").union(
        jump.select("path", F.lit(0).cast("long").alias("offset"))).distinct()
    step = jump.join(targets, ["path", "offset"])
    reach = step.where("offset = 0").select("path", "offset")
    step, reach = stored(step, "jumps"), stored(reach, "entries")
    seen = -1
    while (n := reach.count()) != seen:
        seen = n
        further = reach.join(step, ["path", "offset"]).select(
            "path", F.col("exit").alias("offset"))
        exists = step.select("path", "offset")
        reach = stored(reach.union(further.join(exists, ["path", "offset"], "left_semi")
                                   ).distinct(), "entries")
        twice = step.select("path", "offset", F.col("exit").alias("mid")).join(
            step.select("path", F.col("offset").alias("mid"), "exit"), ["path", "mid"], "left")
        step = stored(twice.select("path", "offset", F.coalesce("exit", F.lit(-1).cast("long"))
                                   .alias("exit")), "jumps")
    # inside a range, the chain from its entry to its exit
    def walk(pdf):
        nxt = dict(zip(pdf["offset"], pdf["next"]))
        at, keep = pdf.loc[pdf["entry"], "offset"], set()
        for x in at:
            while x in nxt and x not in keep:
                keep.add(x)
                x = nxt[x]
        return pdf.loc[pdf["offset"].isin(keep), ["path", "offset"]]

    entry = reach.withColumn("entry", F.lit(True))
    marked = found.select("path", "offset", "next").join(entry, ["path", "offset"], "left")
    return marked.select("path", "offset", "next", F.coalesce("entry", F.lit(False)).alias(
        "entry"), F.floor(F.col("offset") / size).alias("r")).groupBy("path", "r").applyInPandas(
        walk, "path string, offset long")


def _record(file, offset: int, nxt: int) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record.

    The payload is hashed in pieces, so a task holds ``PIECE`` bytes of it at a time.
    """
    data, at = b"", offset
    while (end := data.find(b"\r\n\r\n")) < 0:
        data += file.read_at(min(max(len(data), 4096), nxt - at), at)
        at = offset + len(data)
    fields, body, stop = _fields(data[:end]), offset + end + 4, nxt - 4
    http = data[end + 4:max(end + 4, stop - offset)]
    at = body + len(http)
    while (cut := http.find(b"\r\n\r\n")) < 0 and at < stop:
        http += file.read_at(min(max(len(http), 4096), stop - at), at)
        at = body + len(http)
    start = body + cut + 4 if cut >= 0 else stop  # a block without that line is all header
    kind = fields.get("warc-type")
    if kind == "revisit":
        length = _number(_fields(http[:cut] if cut >= 0 else http), "content-length")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        length, sha = stop - start, hashlib.sha1()
        for lo in range(start, stop, PIECE):
            sha.update(file.read_at(min(PIECE, stop - lo), lo))
        digest = base64.b32encode(sha.digest()).decode()
    return (_number(fields, "warc-page-id"), length, digest, kind,
            _number(fields, "warc-refers-to-page"))


def details(chain: DataFrame, tasks: int, size: int = RANGE) -> DataFrame:
    """What the records (path, offset, next) hold; the records of a range in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64())
                            for x in _RECORDS.split(", ")])
        for batch in batches:
            rows, name, file = [], None, None
            for path, offset, nxt in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, open_file(path)
                rows.append((path, offset, nxt, *_record(file, offset, nxt)))
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                schema.names)

    dealt = chain.withColumn("r", F.floor(F.col("offset") / size)).repartition(
        tasks, "path", "r").sortWithinPartitions("path", "offset").drop("r")
    return dealt.select("path", "offset", "next").mapInArrow(run, _RECORDS)


def read(files: DataFrame, size: int = RANGE) -> DataFrame:
    """The records of the files in a table of files, one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, path, offset.
    """
    found = stored(candidates(files, size), "candidates")
    chain = stored(found.join(reachable(found, size), ["path", "offset"], "left_semi"), "chain")
    lost = files.join(chain.groupBy("path").agg(F.count("*").alias("n_")), "path", "left").where(
        F.coalesce("n_", F.lit(0)) != F.col("n_records")).first()
    if lost:
        raise ValueError(f"{lost.path}: {lost.n_ or 0} of {lost.n_records} records can be read")
    return details(chain, _tasks(files, size), size).drop("next").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path",
        "offset")
