"""The stages of the pipeline one after another, against brute force."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from test_operators import brute_groups, ids_of, prose  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 60), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(300 + i, prose(rng, 40).replace(" ", "### $$$ "), "en", "s0", 0) for i in range(60)]
    rows += [(400 + i, rows[7][1] + " end" * i, "en", "s1", 0) for i in range(4)]
    rows += [(500, rows[9][1] + " " + item, "en", "s2", 0), (501, None, "en", "s2", 0)]
    cut = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cut).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int("###" not in r[1])) for r in rows if r[1]],
                          "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    left = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.createDataFrame([], cut).dtypes
        kept = {r.doc_id for r in docs.collect()}
        if name == "quality":
            assert set(range(200)) <= kept and not kept & set(range(300, 360))
        elif name == "language":
            want = {d for d in left if left[d]}
            assert kept == want & set(left)
        elif name == "near_duplicates":
            groups = brute_groups(list(left.items()), 5, 80)
            assert kept == {d for d, (_, c) in groups.items() if d == c}
        else:
            assert kept == set(left) - {500}
        left = {d: left[d] for d in kept}
        names.append(name)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    sizes = pieces.groupby("doc_id")["length"].sum().to_dict()
    assert sizes == {d: len(ids_of("word_bpe_49k.json", t, 1)) for d, t in left.items()}


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 5000, 1, 1).selectExpr(
        "id AS doc_id", "'some words of a text ' || id AS text", "'en' AS lang", "'s' AS source", "20 AS n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    try:
        corpus_pipeline.known_language(spark, docs, str(tmp_path))
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 1000
    finally:
        spark.conf.set(name, before)
