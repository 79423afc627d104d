"""Short test items inside long documents: size-partitioned MinHash containment search.

All steps are DataFrame expressions.  An item is contained in a document if the document has
at least ``threshold`` of the item's distinct shingles.

1. Items are partitioned by the number n of their shingles, class c holding n from 2^c to
   2^(c+1) - 1.  The MinHash sketch of an item is its k smallest digests, with
   k = u - ceil(threshold * u) + 1 for the largest n = u of its class.  A document that
   contains the item lacks at most n - ceil(threshold * n) < k of its shingles, so it has one
   of the sketch: the search loses no pair, however long the document is.
2. The sketches meet the shingles of all documents; pairs that share a digest are candidates.
3. Candidates are verified with the shingles' words themselves, not with digests.

An item with fewer words than a shingle has is one shingle of its own width, and documents are
searched for shingles of each width that some item has (five widths at most), so short items
are found inside long texts too.  Null and empty texts have none and match nothing.  A null doc_id or item_id is not reported.  Rows that share an id count as
one document or item with the shingles of all of them.  Ties in a sketch are equal shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import stored


def word_list(text: str) -> Column:
    r"""Lower-cased words ``[^\x20\x09-\x0D]+`` of a text column."""
    cut = F.split(F.lower(F.col(text).cast("string")), "[ \\t\\n\\x0B\\f\\r]+")
    return F.filter(cut, lambda w: w != "")


def _places(words: str, width: int) -> str:
    """Positions at which a shingle begins."""
    return (f"CASE WHEN size({words}) >= {width} THEN sequence(0, size({words}) - {width})"
            " ELSE array() END")


def shingle_digests(words: str, width: int) -> str:
    """Digest of the shingle at each position of an array column of words."""
    parts = ", ".join(f"get(h_, i + {j})" for j in range(width))
    return (f"transform(array(transform({words}, w -> xxhash64(w))), h_ -> "
            f"transform({_places(words, width)}, i -> xxhash64({parts})))[0]")


def shingle_texts(words: str, width: int) -> str:
    return (f"transform({_places(words, width)}, "
            f"i -> concat_ws(' ', slice({words}, i + 1, {width})))")


def _of_widths(make, words: str, widths) -> Column:
    """Distinct shingles of all the widths."""
    return F.expr(f"array_distinct(concat({', '.join(make(words, w) for w in widths)}))")


def _of_own_width(make, words: str, width: int) -> Column:
    """Distinct shingles of ``width`` words; the whole text if it has fewer."""
    cases = " ".join(f"WHEN {w} THEN {make(words, w)}" for w in range(1, width + 1))
    return F.expr(f"array_distinct(CASE least(size({words}), {width}) {cases} END)")


def contained(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8
              ) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of all pairs at or above threshold."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"),
                         word_list("text").alias("words_")).where(
        "item_id is not null and size(words_) > 0")
    words = stored(words, "item-words")
    widths = sorted(r.w for r in words.select(  # five at most
        F.least(F.size("words_"), F.lit(width)).alias("w")).distinct().collect()) or [width]
    listed = words.select("item_id", F.explode(_of_own_width(
        shingle_texts, "words_", width)).alias("shingle")).groupBy("item_id").agg(
        F.collect_set("shingle").alias("shingles"))
    listed = stored(listed.withColumn("n_item", F.size("shingles")), "items")
    sketched = words.select("item_id", F.explode(_of_own_width(
        shingle_digests, "words_", width)).alias("h")).groupBy("item_id").agg(
        F.sort_array(F.collect_set("h")).alias("all_"))
    size = F.col("size_class")
    upper = F.pow(F.lit(2), size + 1) - 1
    sketches = sketched.withColumn(
        "size_class", F.floor(F.log2(F.size("all_").cast("double")))).withColumn(
        "k", (upper - F.ceil(upper * threshold - 1e-9) + 1).cast("int")).select(
        "item_id", F.explode(F.slice("all_", F.lit(1), F.col("k"))).alias("h"))
    sketches = stored(sketches, "sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    # Not cut by a row's size: the rows of one doc_id may hold an item together.
    found = texts.where("doc_id is not null").select(
        "doc_id", word_list("text").alias("words_")).select("doc_id", F.explode(
            _of_widths(shingle_digests, "words_", widths)).alias("h"))
    candidates = stored(found.join(sketches, "h").select("doc_id", "item_id").distinct(),
                        "candidates")
    asked = candidates.join(listed, "item_id")
    own = _of_widths(shingle_texts, "words_", widths)
    ids = stored(candidates.select("doc_id").distinct(), "candidate-ids")  # Spark sees how few
    # Rows of one doc_id are judged together: their shared shingles are united.
    verified = texts.join(ids, "doc_id", "left_semi").join(asked, "doc_id").select(
        "doc_id", "item_id", "n_item", "shingles", word_list("text").alias("words_")).select(
        "doc_id", "item_id", "n_item", F.array_intersect("shingles", own).alias("both_"))
    united = verified.groupBy("doc_id", "item_id", "n_item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("both_")))).alias("n_shared"))
    return united.select(
        "doc_id", "item_id", F.col("n_shared").cast("long"), F.col("n_item").cast("long"),
        (F.col("n_shared") / F.col("n_item")).alias("containment")).where(
        F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))
