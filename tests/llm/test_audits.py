"""Source divergence, filter audit and suffix deduplication against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from keysieve.llm import divergence, filter_audit, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n long, key string, start long"


def frame(spark, rows, parts=5):
    """Rows (doc_id, text, lang, source), with further columns whose names the operators use."""
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["ab", "Cd", "ééé", "naïve", "x", "Über", "漢字", "zz", "Q", "the", "and", "of"]
    out = []
    for i in range(300):
        text = " ".join(rng.choice(words[:rng.randrange(2, 13)]) + rng.choice(["", "", ",", "7#"])
                        for _ in range(rng.choice([0, 1, 5, 40, 160])))
        out.append((rng.randrange(200) if i % 20 else None, text, rng.choice(["en", "de", None, ""]),
                    rng.choice(["s0", "s0", "s1", "é", None])))
    same = [(400 - i, "all the same text", "en", "s0") for i in range(30)]
    return out + same + [(900, None, "en", "s1"), (901, "", "fr", "s9"), (902, "1 2 3", "xx", None),
                         (903, "the of " * 3000, "en", "s1"), out[0], out[0], same[3]]


# --- divergence -------------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(
            r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[group].update(found)
        documents[group[0]].update(set(found))
    kept = {lang: [t for t, n in documents[lang].items() if n >= least] for lang, _ in groups}
    out = []
    for lang, source in groups:
        terms, total = kept[lang], Counter()
        for g in groups:
            if g[0] == lang:
                total.update(count[g])

        def shares(c):
            size = sum(c[t] for t in terms)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (size + 2 * len(terms)) for t in terms}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = shares(count[lang, source]), shares(total)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                o = shares(count[other])
                pairs.append((sum(f(p[t], o[t]) for t in terms), other[1]))
        ranked = [(f(p[t], q[t]), t) for t in terms if count[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", ranked, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, rank)
                    for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_size", [7, 1_000_000])
def test_divergence(spark, rows, block_size):
    got = divergence.divergence(frame(spark, rows), least=4, top=3, block_size=block_size)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 4, 3)


def test_divergence_of_none(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    got = divergence.divergence(frame(spark, [(1, None, None, "a"), (2, "few", None, "b")]))
    assert sorted(map(tuple, got.collect())) == [("", "a", "pair", "b", 0, 1),
                                                 ("", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_large_counts():
    for count, size, kept in ((0, 10 ** 14, 10 ** 9), (10 ** 14 - 7, 10 ** 14, 12345), (3, 5, 2)):
        assert divergence.share(count, size, kept) == 1 + 10 ** 9 * (count + 2) // (size + 2 * kept)
        many = divergence.share(np.array([count]), np.array([size]), kept)
        assert many[0] == 1 + 10 ** 9 * (count + 2) // (size + 2 * kept)


# --- filter audit ---------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    masks = defaultdict(Counter)
    for doc, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 bool(re.search(r"[#$%&*|]", text)),
                 doc is not None and first[text] < doc)
        good, toxic = (any(x[i] == 1 for x in labels if x[0] == doc and doc is not None)
                       for i in (1, 2))
        masks[lang or ""][fails, good, toxic] += 1
    out = []
    for part, found in masks.items():
        share, steps = Counter(), []
        for order in permutations(range(5)):
            gone = set()
            for step, f in enumerate(order):
                fail = {m: n for m, n in found.items() if m[0][f]}
                left = {m: n for m, n in fail.items() if m not in gone}
                share[f] += sum(left.values())
                steps.append(["".join("ABCDE"[x] for x in order), step + 1, f, sum(
                    n for m, n in found.items() if m not in gone and m not in left),
                    sum(left.values()), sum(fail.values()) - sum(left.values()),
                    sum(n for m, n in fail.items() if sum(m[0]) == 1),
                    sum(n for m, n in left.items() if m[1]),
                    sum(n for m, n in left.items() if m[2])])
                gone |= set(left)
        out += [(part, order, step, *rest, share[f]) for order, step, f, *rest in steps]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
         "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("order", ["down", "mixed"])
def test_filter_audit(spark, rows, tmp_path, order):
    """Smaller doc_ids that arrive later take earlier masks back."""
    rng = random.Random(2)
    if order != "mixed":
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=True)
    labels = [(rng.randrange(400), rng.choice([0, 1, None]), rng.choice([0, 1, None]))
              for _ in range(150)] + [(None, 1, 1)]
    path = str(tmp_path / "documents.parquet")
    for lo in range(0, len(rows), 80):  # five files, so five micro-batches
        spark.createDataFrame([(*r, 1, "k", 2) for r in rows[lo:lo + 80]], DOCS).coalesce(
            1).write.mode("append").parquet(path)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, path, known, rounds=5).select(*AUDIT).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)


def test_filter_audit_of_none(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    frame(spark, []).write.parquet(path)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, path, none).count() == 0


# --- suffixes -----------------------------------------------------------------------------------


def brute_repeats(rows, window=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1 if doc is not None else 0):
            part = data[i:i + window]
            first[part] = min(doc, first.get(part, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1 if doc is not None else 0):
            if first[data[i:i + window]] < doc:
                gone[i:i + window] = b"\1" * window
        runs = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((doc, len(data), tuple(runs), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def spans_of(frame, **sizes):
    return sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept))
                   for r in suffix_dedup.remove_repeats(frame, **sizes).collect()), key=repr)


@pytest.mark.parametrize("seed,range_size,least", [(0, 100_000, 1), (1, 50, 64), (2, 100_000, 400)])
def test_suffix_dedup(spark, seed, range_size, least):
    """Few and many ranges: equal windows meet across the boundaries of ranges."""
    rng = random.Random(seed)

    def prose(n):
        return " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
                        for _ in range(n))

    common = [prose(14) for _ in range(4)] + ["x" * 70, " " * 90, "ab" * 40]
    rows = []
    for _ in range(150):
        text = prose(rng.choice([0, 3, 20, 60]))
        for _ in range(rng.randrange(3)):
            part = rng.choice(common)
            part, at = part[rng.randrange(8):len(part) - rng.randrange(8)], rng.randrange(
                len(text) + 1)
            text = text[:at] + part + text[at:]
        rows.append((rng.randrange(120) if rng.random() < .95 else None, text))
    rows += [(500 + i, rows[7][1]) for i in range(5)] + [rows[0], rows[0]]
    rows += [(600, None), (601, ""), (602, "\0" * 120), (3, "\0" * 60), (610, "z" * 49),
             (611, "z" * 50), (612, "z" * 51), (-5, rows[9][1])]
    docs = frame(spark, [(d, t, "en", "s") for d, t in rows])
    want = brute_repeats(rows)
    assert spans_of(docs, range_size=range_size, least_ranges=least) == want
    assert sum(len(r[2]) > 0 for r in want) > 50


def test_suffix_dedup_of_long_texts_and_none(spark, monkeypatch):
    assert spans_of(frame(spark, [])) == []
    assert spans_of(frame(spark, [(None, None, None, None)])) == [(None, 0, (), b"")]
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, text), (2, text[5000:25_000] + "!" + text[:300]), (3, text[::-1])]
    for name, value in (("SEGMENT", 700), ("FLUSH", 4000), ("STEP", 256)):
        monkeypatch.setattr(suffix_dedup, name, value)
    held, blobs = suffix_dedup._Suffixes(50, np.zeros((0, 2), np.uint64)), []
    for doc, part in rows:
        blobs += held.add(doc, 0, part.encode())
    blobs += held.flush()
    assert len(blobs) > 10
    found = suffix_dedup.compare([b for _, b in blobs], None, None, 50).to_pandas()
    for doc, _, runs, _ in brute_repeats(rows):
        own = found[found.doc_id == doc]
        assert tuple(suffix_dedup._merged(own.start.to_numpy(), own.stop.to_numpy())) == runs


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, k, 20_000).astype(np.uint64) for k in (3, 5, 1000)]
    order = suffix_dedup.multikey_quicksort(words)
    got = np.stack([w[order] for w in words], 1).tolist()
    assert got == sorted(np.stack(words, 1).tolist()) and sorted(order) == list(range(20_000))


def test_no_cycles_are_searched_while_runs_are_merged(monkeypatch):
    import gc

    from keysieve.llm.shared import no_cycles

    assert gc.isenabled()
    try:
        with no_cycles():
            assert not gc.isenabled()
            raise KeyError
    except KeyError:
        pass
    assert gc.isenabled()


def test_suffixes_of_few_bytes_are_held_at_a_time(monkeypatch):
    from keysieve.llm import suffix_dedup as S

    flushed = []
    monkeypatch.setattr(S._Suffixes, "flush", lambda self: iter([flushed.append(self.size), self.clear()]))
    held = S._Suffixes(50, None)
    for i in range(40):
        list(held.add(i, 0, bytes(1 << 20)))
    assert len(flushed) == 5 and max(flushed) <= 9 << 20
