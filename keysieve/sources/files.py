"""Files and their lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What is never scanned.
SKIPPED_DIRS = [
    "node_modules", "target", "vendor", "dist", "build", "__pycache__", ".git", ".svn",
    ".hg", "venv", ".venv", ".tox", ".pytest_cache", ".mypy_cache", "coverage", ".coverage",
]
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "ico", "bmp", "webp", "svg", "woff", "woff2", "ttf",
    "eot", "otf", "mp3", "mp4", "avi", "mov", "webm", "ogg", "wav", "zip", "tar", "gz",
    "bz2", "xz", "7z", "rar", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe",
    "dll", "so", "dylib", "o", "a", "pyc", "pyo", "class", "jar", "war", "wasm", "db",
    "sqlite", "sqlite3",
]
LOCK_FILES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "Gemfile.lock",
    "composer.lock", "poetry.lock", "Pipfile.lock", "go.sum",
]


WHOLE = 64 << 20  # bytes up to which a file is one row


def _own_path() -> Column:
    """The path of a row's file, as it is written: not as a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _below(root: str) -> Column:
    return F.regexp_replace(
        _own_path(), "(?s)\\A.*?" + re.escape(re.sub(r"\A\w+:/*", "/", root.rstrip("/"))) + "/", "")


def read_tree(spark: SparkSession, root: str, path_glob: str | None = None,
              up_to: int | None = None) -> DataFrame:
    """The scannable files below ``root`` as (path, content), content still binary.

    Paths are tested below the root, so a hidden root hides nothing, and before a file is
    opened, so a skipped file may be of any length.  So may files of more than ``up_to``
    bytes, which are left to ``read_lines``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    files = reader.load(root).where(scannable(_below(root)))
    if up_to is not None:
        files = files.where(F.col("length") <= up_to)
    return files.select("path", "content")


def read_lines(spark: SparkSession, root: str, path_glob: str | None = None,
               over: int = -1) -> DataFrame:
    """The lines of the scannable files of more than ``over`` bytes: path, size, start, id, text.

    Spark cuts a file into byte ranges (``spark.sql.files.maxPartitionBytes``) and each task
    reads the lines that begin in its range.  ``start`` is the range; ``id`` grows with the
    lines of a range without gaps.  A carriage return before the line feed is left on.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    lines = reader.text(root).where((F.col("_metadata.file_size") > over) & scannable(_below(root)))
    return lines.select(
        F.regexp_replace(_own_path(), "\\Afile:/+", "file:/").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def line_ranges(lines: DataFrame) -> DataFrame:
    """The ranges of ``read_lines``: path, start, first (id), n, base (lines of the file before
    it), total (lines of the file), and of the file: text (valid UTF-8), marked (it begins with
    a byte order mark, which Spark leaves out), open (its last line has no line feed).

    One row per range, so a file of any length is a short list here.
    """
    of_range = lines.groupBy("path", "start").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"),
        F.sum(F.octet_length("text") + 1).alias("bytes"),
        F.bool_and(F.is_valid_utf8("text")).alias("valid"))
    file = W.partitionBy("path")
    missing = F.col("size") - F.sum("bytes").over(file)
    return of_range.select(
        "path", "start", "first", "n",
        F.coalesce(F.sum("n").over(file.orderBy("start").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(file).alias("total"), F.bool_and("valid").over(file).alias("text"),
        (missing >= 2).alias("marked"), missing.isin(-1, 2).alias("open"))


def line_text(text: Column, line: Column, total: Column, marked: Column, open_: Column) -> Column:
    """A line as ``split_lines`` gives it: without its ending, with the byte order mark."""
    body = F.when(text.endswith("\r") & ~((line == total) & open_),
                  F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when((line == 1) & marked, F.concat(F.lit("\ufeff"), body)).otherwise(body)


ROWS = 100_000  # of a task, where each row becomes a file or a report


def balance(read: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores, or in splits of many rows.

    Meant for a plain read, before any join or aggregation.  Narrow rows are packed so well that
    a split of the usual size has millions of them; a task gets some ``ROWS`` instead, whatever
    the size of the table.  A corpus of long texts has more splits than that and passes through
    untouched.  Rows are dealt by a number each has: to deal them in turn, Spark would sort every
    split, however large.
    """
    tasks = max(read.sparkSession.sparkContext.defaultParallelism, -(-read.count() // ROWS))
    if read.rdd.getNumPartitions() >= tasks:
        return read
    return read.repartition(tasks, F.monotonically_increasing_id())


def valid_text(content: Column) -> Column:
    """True for files that are text at all."""
    return F.is_valid_utf8(content.cast("string"))


def text_files(files: DataFrame) -> DataFrame:
    """Drop binary contents, decode the rest."""
    return files.where(valid_text(F.col("content"))).withColumn(
        "content", F.col("content").cast("string"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def in_skipped_dir(path: Column) -> Column:
    """Any component, the file's own name included, is a skipped name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def in_hidden_dir(path: Column) -> Column:
    """A directory on the path starts with a dot; hidden files stay."""
    return path.rlike(r"(?:\A|/)\.(?!\.?/)[^/]*/")


def has_binary_extension(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))
    return extension.isin(BINARY_EXTENSIONS)


def is_lock_file(path: Column) -> Column:
    return file_name(path).isin(LOCK_FILES)


def scannable(path: Column) -> Column:
    return ~(in_skipped_dir(path) | in_hidden_dir(path)
             | has_binary_extension(path) | is_lock_file(path))


def tracked_only(files: DataFrame, tracked: DataFrame, on=("repo", "path")) -> DataFrame:
    """Only the files listed in ``tracked``."""
    return files.join(tracked.select(*on), list(on), "left_semi")


def split_lines(content: Column) -> Column:
    """Lines as an array: one ending is cut off each, and the last one starts no line.

    Null for an empty file.
    """
    n = F.length(content)
    body = (F.when(content.endswith("\r\n"), F.substring(content, F.lit(1), n - 2))
            .when(content.endswith("\n"), F.substring(content, F.lit(1), n - 1))
            .otherwise(content))
    return F.when(content != "", F.split(body, "\r?\n"))


def explode_lines(files: DataFrame) -> DataFrame:
    """(…, content) -> (…, line, text), numbered from one."""
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, F.posexplode(split_lines(F.col("content"))).alias("pos", "text")
                        ).select(*kept, (F.col("pos") + 1).alias("line"), "text")
