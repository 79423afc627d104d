"""The operators against brute force: nulls, empty and long texts, ties, clashing columns."""

import base64
import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keysieve.llm import (
    decontaminate, embedding_dedup, hmm, html_text, hyperminhash, langid, packing, pfor, quality,
    warc,
)
from keysieve.llm.components import components
from keysieve.llm.queries import tokenizer
from keysieve.llm.tokens import Encoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, n string"


def prose(rng, n):
    return " ".join(rng.choice(("the of and " * 3 + "tion er ing hath onre wha").split())
                    + rng.choice(["", "", "er", "tion", str(rng.randrange(90))])
                    for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = prose(rng, 120)
    out = [(i, prose(rng, rng.choice([1, 2, 3, 30, 300])), "en", f"s{i % 4}") for i in range(60)]
    out += [(100 + i, base, "en", "s0") for i in range(20)]
    out += [(200 + i, base + f" more{i}", "en", "s0") for i in range(20)]
    out += [(300, None, "en", None), (301, "", None, "s1"), (302, " \n\t", "fr", "s1"),
            (None, "no id at all", "en", "s2"), (303, prose(rng, 9000), "en", "s3"),
            (304, "Ça va  bien\n\nà tous.", "fr", "s3"), (5, out[5][1], "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 7, "x") for r in rows], DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_equals_plain_encoding(name):
    coder, rng = Encoder(tokenizer(name)), random.Random(1)
    parts = ["a", "The", "it's", " ", "  ", "\n", "\t", ".", "é", "İ", "ß", "Σ", "ς", " ",
             " ", "\x1c", "\x85", "12", "'ll", "<|endoftext|>", "é", "漢", "Hello, ",
             "word$$$", "ab.\nCd"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert coder.encode(text) == coder.plain(text), ascii(text)


def test_packing(spark, docs, rows):
    got = packing.pack(docs, tokenizer(WORD), window=256, lump=32, with_ids=True).toPandas()
    want = collections.Counter((d, ids_of(WORD, t, 1).tobytes()) for d, t, *_ in rows)
    assert got["length"].sum() == sum(len(i) // 4 * n for (_, i), n in want.items())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert (sizes == 256).sum() >= len(sizes) - 1 and sizes.index.max() == len(sizes) - 1
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    whole = dict(((d, len(t) // 4), t) for d, t in want)
    for (d, n), s in got[got.doc_id.notna()].groupby(["doc_id", "doc_tokens"]):
        if d != 5:
            joined = b"".join(s.sort_values("start")["ids"])
            assert joined == whole[d, n]
    assert packing.pack(empty(spark), tokenizer(WORD)).count() == 0


def test_packing_keeps_to_the_mixture(docs):
    got = packing.pack(docs, tokenizer(WORD), window=256, lump=32,
                       mixture={"s0": 0.5, "s3": 0.25}).toPandas()
    served = got[got.sequence_id < 10].groupby("queue")["length"].sum()
    assert abs(served[1] - 1280) <= 64 and abs(served[2] - 640) <= 64


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 50_000, 2 ** 32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.05] = 2 ** 32 - 1
            data, starts = pfor.encode_blocks(ids)
            if n:
                back = pfor.decode_blocks(np.frombuffer(data, np.uint8), starts)[:n]
                assert (back == ids).all()


def test_shards(spark, docs, rows):
    got = pfor.read(pfor.write(docs, tokenizer(BYTE))).toPandas()
    got = got.sort_values("start")
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    ids = got.doc_id.dropna().tolist()
    assert ids == sorted(ids) and len(got) == len(rows)
    assert collections.Counter(got.ids_crc32) == collections.Counter(
        zlib.crc32(ids_of(BYTE, t, 2)) for _, t, *_ in rows)
    assert pfor.read(pfor.write(empty(spark), tokenizer(BYTE))).count() == 0


def test_decontamination(spark, rows):
    item = prose(random.Random(9), 30)
    words = item.split()
    texts = [(1, "before " + item.upper() + " after"), (2, " ".join(words[:27])),
             (3, " ".join(words[:15])), (4, None), (5, ""), (None, item), (6, "a b"),
             (1, "x"), (7, "long " * 5000 + item),
             (8, " ".join(words[:14])), (8, " ".join(words[10:24])), (8, " ".join(words[20:]))]
    docs = spark.createDataFrame([(*t, "q") for t in texts], "doc_id long, text string, h string")
    items = spark.createDataFrame([(10, item), (11, "a b"), (12, None), (13, ""), (10, item)],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contained(docs, items).collect()}
    n = len({tuple(words[i:i + 5]) for i in range(26)})
    assert got == {(1, 10): n, (2, 10): len({tuple(words[i:i + 5]) for i in range(23)}),
                   (7, 10): n, (8, 10): n, (6, 11): 1}
    assert decontaminate.contained(docs.limit(0), items).count() == 0
    assert decontaminate.contained(docs, items.limit(0)).count() == 0


def test_hmm(spark, docs, rows):
    got = hmm.score(docs, states=3).toPandas()
    counts = collections.Counter()
    for d, t, *_ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t, *_ in rows:
        found = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found)
        want[d, len(found), sum(counts[w] > 0 for w in found), round(base, 4)] += 1
    assert collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.n_tokens,
                                r.n_known, round(r.base_score, 4))
                               for r in got.itertuples()) == want
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all()
    assert hmm.score(empty(spark), states=2).count() == 0


def test_hmm_trains_on_all_rows(spark):
    """Every round is Baum-Welch over all training texts, of more than 2048 tokens too."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh" if i % 3 else "stuvwxyz") for _ in range(
        rng.choice([5, 200, 2500]))) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in hmm.score(df, states=2, passes=3).collect()}
    train = [t.split() for i, t in enumerate(texts) if not got[i].held_out]
    counts = collections.Counter(w for t in train for w in t)
    rank = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    mass = np.full(hmm.CLASSES, 0.1)
    for w, k in rank.items():
        mass[k] += counts[w]
    mass[hmm.END] += len(train)
    z = sum(counts.values()) + len(train) + 0.1 * (len(counts) + 2)
    share = mass / mass.sum()
    model = hmm._first_model(share, 2)
    sequences = [np.array([*(rank[w] for w in t), hmm.END]) for t in train]
    for _ in range(3):
        start, moves, emits, _ = model.expected(hmm.Sequences(sequences))
        model = hmm._estimate(start, moves, emits, share)
    for i, t in enumerate(texts):
        found = np.array([*(rank[w] for w in t.split()), hmm.END])
        gain = model.forward(hmm.Sequences([found]))[0] / np.log(10) - np.log10(
            mass / z)[found].sum()
        assert abs(got[i].score - got[i].base_score - gain) < 1e-3 * max(1, abs(gain))


def test_hmm_forward_is_a_probability():
    """All continuations of a sequence have the probability of the sequence."""
    rng = np.random.default_rng(0)
    emits = rng.random((3, hmm.CLASSES))
    moves = rng.random((3, 3))
    model = hmm.Model(np.full(3, 1 / 3), moves / moves.sum(1, keepdims=True),
                      emits / emits.sum(1, keepdims=True))
    all_of = [np.array([5, c]) for c in range(hmm.CLASSES)]
    longer = np.exp(model.forward(hmm.Sequences(all_of))).sum()
    assert abs(longer - np.exp(model.forward(hmm.Sequences([np.array([5])])))[0]) < 1e-4 * longer


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [(i, base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.08]), i % 3)
               for i in range(300)]
    table = [(i, [float(x) for x in np.float32(v)], k) for i, v, k in vectors]
    table += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1),
              (903, table[0][1], None), (904, [None] * 16, 1), (905, [], 1),
              (906, table[0][1][:8], 0), (7, table[7][1], table[7][2])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id)
           for r in embedding_dedup.near_copies(df, tile=20).collect()}
    x = np.array([v for _, v, _ in table[:300]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(300) % 3
    link = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(300, dtype=bool)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(link, comp[None], 999).min(1))
    assert {i: got[i] for i in range(300)} == {
        i: (int(link[i].sum()), int(comp[i])) for i in range(300)}
    assert all(got[i] == (0, i) for i in range(900, 907))
    assert embedding_dedup.near_copies(df.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    """Double-precision vectors whose squares overflow or vanish."""
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.01e-200]), (3, [3.0, 3.0]), (4, [1e200, -1e200]),
            (5, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "k") for r in rows],
                               "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_copies(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [
        (i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1100)] + [(3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_warc(spark):
    trap = "x\r\n\r\n" + warc.record(77, "u", b"trap", None, False).decode() + "y"
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)] + [
        (60, None, None), (61, "a b\r\nX: y", trap), (62, "u", ""), (63, "u", trap + "2"),
        (None, "u", "<p>only</p>"), (None, "u", "<p>1</p>" * 50), (64, "é", "é" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    files = warc.write(df)
    for size in (700, 1 << 20):
        got = collections.Counter(
            (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
            for r in warc.read(files, size).collect())
        first = {}
        for i, _, h in pages:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        want = collections.Counter()
        for i, _, h in pages:
            h = h or ""
            again = h in first and i != first[h]
            want[i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
                 "revisit" if again else "response", first[h] if again else None] += 1
        assert got == want
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_headers_of_any_length(spark):
    long = "http://h/" + "x" * 200_000
    pages = [(0, long, "<p>0</p>"), (1, " " * 70_000, "<p>1</p>" * 99)] + [
        (i, long if i % 5 == 0 else "http://h/", f"<p>{i % 9}</p>") for i in range(2, 30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    files = warc.write(df)
    for size in (150_000, 1 << 20):
        assert sorted(r.page_id for r in warc.read(files, size).collect()) == list(range(30))
    more = files.selectExpr("path", "n_bytes", "n_records + 1 AS n_records")
    with pytest.raises(ValueError, match="30 of 31 records"):
        warc.read(more)


PAGE = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var a="</p>";</script>
<body><header class="page-header"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use the cookies of the site and of others for you and for us, with
all that is needed for it and to be on the safe side of the law as it is.</div><!-- <p>x</p> -->
<main><article><header><h1>Title &amp; more</h1></header><p>The first   paragraph of<br>it.
<p>Short.<ul><li>One<li>Two &eacute;</ul><aside>See also</aside><form><p>Mail</p></form></article>
<section id="comments"><article class="comment"><p>I like the text of it and that is that.</p>
</article></section></main><div id=sidebar><p>Popular</p></div><footer><p>&copy; the site</footer>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == (
        "Title & more\n\nThe first paragraph of it.\n\nShort.\n\nOne\n\nTwo é")
    long = "It is the best of all that was and has been for the people of this town. " * 3
    bare = f"<div><a href=a>Home</a> <a href=b>News</a></div><p>{long}</p><p>So.</p><p>{long}</p>"
    assert html_text.main_text(bare) == f"{long.strip()}\n\nSo.\n\n{long.strip()}"
    odd = [None, "", "plain", "<", "<p", "<p class='x", "</p></p>", "<!--", "<script>", "&#0;<b>"]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)],
                               "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert len(got) == len(odd) and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("open_tag", [
    '<article class="post category-social">', '<article class="hentry tag-cookies">',
    '<article class="comment-open sponsored">', '<div class="main with-sidebar">',
    '<div id="search-engines-explained">', '<div class="header-large post">',
    '<div class="hentry category-breaking-notice">', '<section class="content-sidebar">',
    '<div class="cookie-banner">', '<div id="comments">', '<div class="left_sidebar">'])
def test_hints_count_only_where_they_name_the_element(open_tag):
    text = ("It is the best of all that was and has been for the people of this town. " * 3).strip()
    dropped = any(x in open_tag for x in ("cookie-banner", '"comments"', "left_sidebar"))
    close = "</" + open_tag[1:].split()[0] + ">"
    page = f"<body>{open_tag}<p>{text}</p>{close}</body>"
    assert html_text.main_text(page) == ("" if dropped else text)


def test_quality(spark):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = prose(rng, 80)
        texts.append((i, text.replace(" ", "### $$$ ") if bad else text, "c"))
        marks.append((i, 0 if bad else 1))
    texts += [(900, None, "c"), (901, "", "c"), (None, "x", "c"), (3, "again", "c")]
    df = spark.createDataFrame(texts, "doc_id long, text string, statistics string")
    labels = spark.createDataFrame(marks + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(df, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == (i % 5 != 0) for i in held) >= 0.97 * len(held)
    assert all(got[i].held_out == (i in held) for i in range(600))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= set(got)
    assert {r.score for r in quality.score(df, labels.limit(0)).collect()} == {1.0}
    assert quality.score(df.limit(0), labels).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 5, quality.BINS).astype(float)
    ones = np.floor(count * rng.random(quality.BINS))
    edges, values = quality.isotonic(count, ones)
    assert (np.diff(values) >= 0).all() and (np.diff(edges) >= 0).all()


def test_languages(spark):
    rng = random.Random(6)
    sounds = {"aa": ["the", "thing", "with"], "bb": ["être", "queux", "leau"],
              "cc": ["schön", "keit", "ung"]}
    texts = [(i, " ".join(rng.choice(sounds[k]) for _ in range(25)), k)
             for i in range(150) for k in [rng.choice(list(sounds))]]
    texts += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (None, "the thing", None)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in texts[:150])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred == "aa"
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.count() == 151
    assert langid.predict(df.limit(0)).count() == 0


def brute_groups(rows, width, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_copies(spark, docs, rows, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in hyperminhash.near_copies(docs, width, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_groups(rows, width, percent)
    assert hyperminhash.near_copies(empty(spark)).count() == 0


def test_near_copies_of_a_dense_group(spark, monkeypatch):
    """Copies around the threshold: buckets whose members are not all linked to the centre."""
    monkeypatch.setattr(hyperminhash, "TILE", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in hyperminhash.near_copies(df).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_texts_with_a_common_line_are_not_compared_in_pairs(monkeypatch):
    """A bucket of texts that share a third of their shingles: its work follows them, not pairs."""
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2 ** 64 - 1, n, dtype=np.uint64)
    line = draw(20)
    sets = [np.unique(np.r_[line, draw(rng.integers(25, 45))]) for _ in range(400)]
    for i in range(0, 60, 3):  # some are near-copies
        sets[i + 1] = np.unique(np.r_[sets[i], draw(2)])
    regs = [hyperminhash.registers(s) for s in sets]
    sets = [s.view(np.int64) for s in sets]
    rows = [*range(400)] * 2
    t = pa.table({
        "key": pa.array([7] * 800), "node": pa.array(rows), "own": pa.array(rows),
        "left": pa.array([True] * 400 + [False] * 400), "right": pa.array([False] * 400 + [True] * 400),
        "n_shingles": pa.array([len(sets[i]) for i in rows]),
        "registers": pa.array([regs[i].tobytes() for i in rows]),
        "shingles": pa.array([sets[i] for i in rows], pa.list_(pa.int64()))})
    first = np.arange(hyperminhash.BANDS)[None] == 0  # the band that all share
    monkeypatch.setattr(hyperminhash, "band_keys", lambda r: (
        np.full((len(r), hyperminhash.BANDS), 7), np.repeat(first, len(r), 0)))
    compared, plain = [0], hyperminhash.estimate

    def counted(a, b, *args):
        compared[0] += max(len(a), len(b)) if a.ndim == b.ndim else len(a)
        return plain(a, b, *args)

    monkeypatch.setattr(hyperminhash, "estimate", counted)
    found = hyperminhash._tile(t, 85)
    got = {frozenset(p) for p in zip(found["a"].to_pylist(), found["b"].to_pylist())}
    want = {frozenset((i, j)) for i in range(400) for j in range(i) if hyperminhash._linked(
        n := len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)}
    assert got == want and len(want) == 20
    assert compared[0] < 1000  # of 159,600


def test_small_buckets_of_a_tile_are_kept_apart():
    """Members of two buckets that share a tile are not compared with each other."""
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 2 ** 63 - 1, 60, dtype=np.int64)) for _ in range(2)]
    regs = [hyperminhash.registers(s.view(np.uint64)) for s in sets]
    keys, _ = hyperminhash.band_keys(np.stack(regs))
    which = [0, 0, 1, 1]

    def links(key):
        t = pa.table({
            "key": pa.array([int(k) for k in key]), "node": pa.array(range(4)), "own": pa.array(range(4)),
            "left": pa.array([True] * 4), "right": pa.array([True] * 4),
            "n_shingles": pa.array([60] * 4), "registers": pa.array([regs[i].tobytes() for i in which]),
            "shingles": pa.array([sets[i] for i in which], pa.list_(pa.int64()))})
        found = hyperminhash._tile(t, 85)
        return {frozenset(p) for p in zip(found["a"].to_pylist(), found["b"].to_pylist())}

    assert links([keys[i, 0] for i in which]) == {frozenset((0, 1)), frozenset((2, 3))}
    assert links([keys[0, 0], keys[1, 0], keys[1, 0], keys[1, 0]]) == {frozenset((2, 3))}


def test_registers_estimate():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(400):
        both, left, right = (rng.integers(0, 2 ** 64 - 1, n, dtype=np.uint64)
                             for n in (800, 100, 100))  # digests use all 64 bits
        a, b = np.sort(np.r_[both, left]), np.sort(np.r_[both, right])
        x, y = hyperminhash.registers(a)[None], hyperminhash.registers(b)[None]
        j, _ = hyperminhash.estimate(x, y, np.array([900]), np.array([900]))
        errors.append(j[0] - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_hyperminhash_of_two_texts_under_one_id(spark):
    """doc_id 1 links to what either of its texts links to, in any order of the rows."""
    rng = random.Random(6)
    a, b, c = prose(rng, 200), prose(rng, 200), prose(rng, 200)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (0, b), (0, c), (7, c + " more"),
            (9, prose(rng, 50))]
    for order in (rows, rows[::-1], rng.sample(rows, len(rows))):
        df = spark.createDataFrame([(d, t, "en", "s", 0, 7, "x") for d, t in order], DOCS)
        got = {(r.doc_id, r.component_id) for r in hyperminhash.near_copies(df).collect()}
        assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (7, 0), (9, 9)}


def test_hyperminhash_bound_is_the_binomial_tail():
    for percent in (80, 85):
        p, least = percent / 100, hyperminhash.least_equal(percent)
        for n in (0, 1, 16, 128):
            tail = [math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)]
            assert sum(tail[:least[n]]) <= 1e-12 < sum(tail[:least[n] + 1])


def test_hmm_expectations_equal_all_state_paths():
    """Likelihood and expected counts of short sequences, by enumeration of every path."""
    import itertools

    rng = np.random.default_rng(4)
    states = 3
    model = hmm._first_model(rng.random(hmm.CLASSES), states)
    emits = model.emits.T.astype(float)
    found = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 4, 6, 6)]
    start, moves = np.zeros(states), np.zeros((states, states))
    seen, total = np.zeros((states, hmm.CLASSES)), 0.0
    for seq in found:
        paths = []
        for path in itertools.product(range(states), repeat=len(seq)):
            p = float(model.start[path[0]]) * emits[path[0], seq[0]]
            for a, b, c in zip(path, path[1:], seq[1:]):
                p *= float(model.moves[a, b]) * emits[b, c]
            paths.append((path, p))
        whole = sum(p for _, p in paths)
        total += math.log(whole)
        for path, p in paths:
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
            for a, c in zip(path, seq):
                seen[a, c] += p / whole
    got = model.expected(hmm.Sequences(found))
    for mine, want in zip(got, (start, moves, seen, total)):
        assert np.allclose(mine, want, rtol=1e-4, atol=1e-5)


def test_hmm_statistics_copy_no_rows():
    rng = np.random.default_rng(3)
    model = hmm._first_model(rng.random(hmm.CLASSES), 8)
    seqs = hmm.Sequences([rng.integers(0, hmm.CLASSES, n) for n in [1] * 50 + [400] * 500])
    tracemalloc.start()
    try:
        start, moves, emits, _ = model.expected(seqs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # five tables of eight single-precision states and indexes
    assert peak < 240 * len(seqs.obs)
    assert np.isclose(start.sum(), 550, rtol=1e-4)
    assert np.isclose(moves.sum(), len(seqs.obs) - 550, rtol=1e-4)
    assert np.isclose(emits.sum(), len(seqs.obs), rtol=1e-4)
    alone = hmm.Sequences([np.array([7])])  # a sequence of one step has no moves
    assert model.expected(alone)[1].sum() == 0


def test_hmm_frequent_words(spark, monkeypatch):
    """Words above a count: never more than ``HEAD``, whole levels of the count only."""
    counts = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1)) for i in range(500)],
                                   "word string, c long")
    for head in (500, 100, 20, 1):
        monkeypatch.setattr(hmm, "HEAD", head)
        got = [r.c for r in hmm._frequent(counts).collect()]
        assert len(got) <= head and (len(got) == 500 or min(got) > 1)
        assert sorted(got, reverse=True) == sorted(
            (r.c for r in counts.collect()), reverse=True)[:len(got)]


def test_decontamination_finds_items_of_few_words(spark):
    docs = spark.createDataFrame(
        [(1, "one Two three four five six seven"), (2, "two three"), (3, "three two"),
         (4, "seven"), (5, "a four five six seven b"), (6, "two, three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "four five six seven"), (3, "SEVEN"),
                                   (4, "one two three four five"), (5, "nothing of this")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (4, 3), (5, 2), (5, 3)}


def test_schedule_does_not_overflow():
    """Ten trillion tokens, mixtures that end long before a queue does, and tiny shares."""
    for shares in ([1.0, 0.0], [1 - 1e-9, 1e-9], [0.5, 0.5]):
        tokens = np.array([10 ** 13, 10 ** 12 + 5], np.int64)
        plan = packing.Schedule(tokens, np.array(shares), 2048, 256)
        for q in (0, 1):
            lumps = np.unique(np.linspace(0, (tokens[q] - 1) // 256, 1000).astype(np.int64))
            at = plan.positions(q, lumps)
            assert (np.diff(at) > 0).all() and at[0] >= 0 and at[-1] < tokens.sum()


def test_languages_reject_what_is_like_none(spark):
    """Random letters go, every clean text stays, and so do texts too short to tell."""
    rng = random.Random(8)
    sounds = {"aa": ["the", "thing", "with", "and", "other"], "bb": ["être", "queux", "leau", "dans"]}
    rows = [(i, " ".join(rng.choice(sounds[k]) for _ in range(rng.randrange(20, 90))), k)
            for i in range(1500) for k in [rng.choice(list(sounds))]]
    noise = [(5000 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6))
                                 for _ in range(40)), None) for i in range(20)]
    short = [(6000, "qqq", None)]
    df = spark.createDataFrame(rows + noise + short, "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.keep_known(df).collect()} == {r[0] for r in rows + short}


def test_warc_reads_no_payload_of_a_false_record(spark, monkeypatch):
    """Magic in a payload that claims all that follows, closed as a record should be."""
    claim = ("x\r\n\r\nWARC/1.0\r\nContent-Length: %d\r\n\r\n" + "y" * 5000 + "\r\n\r\nend")
    rows = [(i, "u", claim % n, "t") for i, n in enumerate((5000, 4000, 10 ** 17, 0))]
    rows += [(10, "u", "z" * 20_000, "t"), (11, None, "", "t"), (12, "u", None, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    files = warc.write(pages.coalesce(1))
    for size in (300, 1 << 20):
        found = warc.candidates(files, size)
        assert found.columns == ["path", "offset", "next"] and found.count() > len(rows)
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(files, size).collect()}
        assert got == {i: (len(h or ""), base64.b32encode(hashlib.sha1((h or "").encode()).digest())
                           .decode()) for i, _, h, _ in rows}


def test_quality_equals_explicit_equations(spark):
    """Normal equations of all labelled rows at once, pooled by repeated passes."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(5, 60)) if i % 3 else "### $$$ " * rng.randrange(1, 9)
             + prose(rng, rng.randrange(9))) for i in range(120)] + [(500, ""), (501, None)]
    labels = [(i, int(i % 3 > 0) if rng.random() > .1 else 1) for i in range(0, 120, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(
        labels, "doc_id long, quality int")).collect()}
    texts = dict(rows)
    train = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    x = np.stack([quality.statistics((texts[d] or "").encode()) for d, _ in train])
    y = np.array([y for _, y in train], float)
    draw = np.random.default_rng(11)
    turns = draw.normal(0, 1, (quality.STATISTICS, quality.FOURIER)) / (
        quality.WIDTH * np.sqrt(quality.STATISTICS) / 2)
    shifts = draw.uniform(0, 2 * np.pi, quality.FOURIER)
    scale = x.std(0)
    scale[scale < 1e-5] = 1

    def features(x):
        z = np.clip((x - x_mean) / scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z,
                          np.cos(z @ turns + shifts) * np.sqrt(2 / quality.FOURIER)])

    x_mean = x.mean(0)
    f = features(x)
    ridge = np.eye(f.shape[1]) * quality.RIDGE
    ridge[0, 0] = 0
    weights = np.linalg.solve(f.T @ f + ridge, f.T @ y)
    at = np.clip(((f @ weights + .5) * quality.BINS / 2).astype(int), 0, quality.BINS - 1)
    order = sorted(set(at.tolist()))
    pools = [[b, b, y[at == b].sum(), (at == b).sum()] for b in order]
    while any(a[2] * b[3] >= b[2] * a[3] for a, b in zip(pools, pools[1:])):
        i = next(i for i, (a, b) in enumerate(zip(pools, pools[1:])) if a[2] * b[3] >= b[2] * a[3])
        a, b = pools[i], pools.pop(i + 1)
        pools[i] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    edges = [e * 2 / quality.BINS - .5 for p in pools for e in (p[0], p[1] + 1)]
    values = [p[2] / p[3] for p in pools for _ in (0, 1)]
    for d, t in rows:
        raw = features(quality.statistics((t or "").encode())[None]) @ weights
        want = float(np.interp(raw, edges, values)[0])
        assert abs(got[d].score - want) < 0.02, (d, got[d].score, want)
    kept = quality.keep_good(docs.withColumn("statistics", F.lit("own")), spark.createDataFrame(
        labels, "doc_id long, quality int"))
    assert kept.columns == ["doc_id", "text", "statistics"]
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def test_languages_equal_explicit_bundles(spark):
    """Bundles of the n-gram vectors of whole texts, and their cosines with the prototypes."""
    rng = random.Random(13)
    sounds = {"aa": ["the", "thing", "with"], "bb": ["être", "queux", "leau"], "cc": ["und", "keit"]}
    rows = [(i, " ".join(rng.choice(sounds[k]) + rng.choice(["", "s"]) for _ in range(30)), k)
            for i in range(60) for k in [rng.choice(list(sounds))]]
    rows += [(90, "the the the", None), (91, "x", None), (92, rows[0][1] * 40, None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(
        rows, "doc_id long, text string, lang string").repartition(3)).collect()}

    def bundle(text):
        return langid.gram_vectors(langid.grams(text)).astype(float).sum(0)

    prototypes = {}
    for d, t, k in rows:
        if k and zlib.crc32(str(d).encode()) % 3 != 1:
            prototypes[k] = prototypes.get(k, 0) + bundle(t)
    errors = []
    for d, t, _ in rows:
        b = bundle(t)
        cosines = {k: b @ p / np.linalg.norm(b) / np.linalg.norm(p) for k, p in prototypes.items()}
        best = max(cosines, key=cosines.get)
        assert got[d].lang_pred == best
        errors.append(abs(got[d].score - max(0, cosines[best])))
    assert max(errors) < 0.1 and np.mean(errors) < 0.03


def test_embeddings_of_several_vectors_under_one_id(spark):
    """Each row reports its own links; the vectors of an id are in one component."""
    rng = np.random.default_rng(21)
    base = {k: rng.normal(size=16) for k in "abc"}

    def near(k, i):
        return (base[k] + 0.01 * rng.normal(size=16) * i).tolist()

    rows = [(1, near("a", 0), 0), (1, near("b", 0), 0), (2, near("a", 1), 0), (3, near("b", 1), 0),
            (4, near("c", 0), 0), (5, near("c", 1), 1), (6, near("a", 1), 1)]
    schema = "vec_id long, embedding array<double>, label int, rep long, first_id long"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, 7, 8) for r in order], schema)
        got = sorted(map(tuple, embedding_dedup.near_copies(df).collect()))
        assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False),
                       (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
