"""From documents to packed sequences: five stages, each an operator on all its input.

Each stage gets what the one before has kept; all but the last return the columns of
``documents``.  Stages that drop documents:

    quality          score below 0.7
    language         no letter, or no learned language
    near_duplicates  five-word shingles, Jaccard similarity of 0.8 or more: the smallest
                     doc_id of each group stays
    decontamination  holds 80 % or more of a benchmark item's five-word shingles

Nulls, empty tables and repeated rows are treated as the operators' docstrings say; rows that
share a doc_id share their fate, and a row without doc_id is never a near-copy or a leak.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import decontaminate, hyperminhash, langid, packing, quality
from keysieve.llm.queries import tokenizer
from keysieve.llm.shared import stored, table


BATCH = 1000  # rows that go to Python together
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with whole texts sent to Python by ``BATCH`` rows: each task holds its batch
    several times, in the JVM and in Python.  The session keeps the setting, because the stage's
    result is computed after its return."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH:
            spark.conf.set(_BATCH, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``; Spark sees the size of that table."""
    gone = stored(ids.select(F.col("doc_id").cast("long").alias("gone_")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, hyperminhash.near_copies(docs, 5, 80).where("not kept"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.contained(docs, table(spark, sf_dir, "benchmark")))


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

# Models are fitted and ids made by a tokenizer on the way; a test runs the stages against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that every stage keeps."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
