"""One registered query per operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import (
    decontaminate, divergence, embedding_dedup, filter_audit, hmm, html_text, hyperminhash, langid, packing, pfor,
    quality, suffix_dedup, warc,
)
from keysieve.llm.shared import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query()
def op2_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pfor.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pfor.read(files)


@query("""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b,
                      sha1(encode(coalesce(html, ''))) AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
    -- base 32: eight groups of five bits of every five bytes
    d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                 ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::HUGEINT >> (35 - 5 * (i % 8)))
                  & 31) AS INT), 1), '' ORDER BY i) AS digest
          FROM f, range(32) t(i) GROUP BY h)
    SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (h) JOIN d USING (h)""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_copies(table(spark, sf_dir, "documents"))


@query("""
    WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text),
                      '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
    b AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text),
                 '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark),
    k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
    ds AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - k + 2),
                  lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, k
           WHERE len(w) >= k),
    bs AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                  lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
    n AS (SELECT id, count(*) AS n_item FROM bs GROUP BY id)
    SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item,
           count(*) / any_value(n_item) AS containment
    FROM ds JOIN bs USING (s) JOIN n ON n.id = bs.id
    GROUP BY ds.id, bs.id HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "benchmark"))


@query()
def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


@query("""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                         WHERE label IS NOT NULL),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b USING (label)
          WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
    c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id,
           coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


@query("""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang,
                      coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text,
                 '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
    v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS size FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term)
          GROUP BY ALL),
    s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM g
          LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (s.size + 2 * v.v) AS p,
                 1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.size + 2 * v.v) AS q
          FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN s USING (lang, source)
          LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
    pv AS (SELECT a.lang, a.source, b.source AS item,
                  sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
           GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                    coalesce(value, 0)::BIGINT AS value
             FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN pv ON (pv.lang, pv.source, pv.item) = (a.lang, a.source, b.source)),
    term AS (SELECT lang, source, 'term' AS part, term AS item,
                    ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                                      ORDER BY value DESC, encode(item)) AS INT) AS rank
    FROM (FROM pair UNION ALL FROM term)
    QUALIFY part = 'pair' OR rank <= 10""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      list_filter(string_split_regex(coalesce(text, ''),
                                  '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
               FROM documents),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g'))
                        > 10 * length(text))::INT
                 + 8 * regexp_matches(text, '[#$%&*|]')::INT
                 + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < d.doc_id, false)::INT
                 AS mask
          FROM d LEFT JOIN l USING (doc_id)),
    n AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
          FROM f a, f b, f c, f d, f e
          WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f,
                 list_sum(list_transform(string_split(substr(filter_order, 1, step), ''),
                                         lambda x: 1 << (ascii(x) - 65)))::INT AS upto
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    b AS (SELECT *, 1 << (ascii(f) - 65) AS own, upto - (1 << (ascii(f) - 65)) AS earlier
          FROM s),
    r AS (SELECT part, filter_order, step, f,
                 sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT
                 AS removed,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT
                 AS redundant,
                 sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n * good
                     ELSE 0 END)::BIGINT AS good_lost,
                 sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n * toxic
                     ELSE 0 END)::BIGINT AS toxic_lost
          FROM n, b GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails,
           good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM r""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query()
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
