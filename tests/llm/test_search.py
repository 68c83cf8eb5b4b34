"""Phrases, languages and ranked search against brute force and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_id, phrase_mining, ranked_search

RANDOM = random.Random(11)
WORDS = ["".join(RANDOM.choice("abcdeé") for _ in range(RANDOM.randint(1, 4))) for _ in range(60)]
SCHEMA = "doc_id long, text string, lang string, id string, chunk int, term string"


def sentence(n):
    return " ".join(RANDOM.choice(WORDS[: RANDOM.choice((4, 60))]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Phrases in common, copies, ties, nulls, a long text, repeated ids, and columns of names needed on the way."""
    fixed = ["New York City hall", "new york\tcity", "The, New York; City hall of", "a b a b a b a b"]
    texts = [f"{sentence(RANDOM.randint(0, 30))}{RANDOM.choice('.,; ')}{RANDOM.choice(fixed)} {sentence(5)}\n{sentence(3)}" for _ in range(120)]
    texts += [texts[0]] * 7 + ["", None, " \t\n.", "x", sentence(20_000), "ÀB àb É", "q" * 50_000]
    rows = [(k, t, RANDOM.choice(("en", "de", None)), "i", 1, "t") for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "i", 1, "t"), (None, texts[4], "en", "i", 1, "t"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def expected_phrases(rows, least, first, share=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {key: x for key, x in f.items() if x >= least}
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            longer = [x for (other, q), x in f.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * x >= share * a for x in longer):
                s, k = min(cuts)
                out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, rank, p.decode(), -a, l, r, m, -s) for lang, x in out.items() for rank, (s, a, p, l, r, m) in enumerate(sorted(x)[:first], 1))


@pytest.mark.parametrize("least, first, share, sent", [(5, 2000, 100, 1 << 20), (3, 25, 60, 0), (100, 2000, 100, 0)])
def test_phrases_equal_brute_force(spark, docs, monkeypatch, least, first, share, sent):
    monkeypatch.setattr(phrase_mining, "CHUNK", 500)  # several chunks of a language
    monkeypatch.setattr(phrase_mining, "BROADCAST_ROWS", sent)  # names broadcast, and joined
    want = expected_phrases([(r.lang, r.text) for r in docs.collect()], least, first, share)
    got = phrase_mining.phrases(docs, least, first=first, share=share).drop("cut")
    assert sorted(map(tuple, got.collect())) == want and want


def test_phrases_without_rows_or_frequent_words(spark, docs):
    assert not phrase_mining.phrases(docs.limit(0)).count()
    assert not phrase_mining.phrases(docs, least=10**9).count()
    assert not phrase_mining.phrases(docs.where("text IS NULL OR text = 'x'"), least=1).count()


def test_scores_are_exact(spark):
    cases = [(10**12, 9 * 10**12, 10**12, 10**12), (7, 10, 9, 8), (100, 3 * 10**18, 10**9, 10**9 + 7), (100, 100, 100, 100)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").withColumn("s", phrase_mining.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    assert [r.s for r in df.collect()] == [1000 * a * n // (l * r) for a, n, l, r in cases]


def expected_ranking(rows, items, k=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    texts = [(i, words(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in texts:
            tf = Counter(w)
            if w:
                m = 100 - 50 + 50 * len(w) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if tf[t])
                if s > 0:
                    scored.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "new york city, a B"), (2, "É à"), (3, None), (4, ""), (5, "nothing-like-this"), (6, " ".join(WORDS)), (6, "ab " + WORDS[3]), (None, "hall of"), (7, " ".join(f"w{k}" for k in range(500)) + " york")]


@pytest.mark.parametrize("k, chunk, blocks", [(50, 1 << 14, 1024), (3, 40, 1024), (5, 64, 2)])
def test_ranking_equals_brute_force(spark, docs, monkeypatch, k, chunk, blocks):
    monkeypatch.setattr(ranked_search, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", blocks)  # two items a block: the whole index, in several blocks
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.ranked(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()]
    want = expected_ranking([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)
    assert sorted(got, key=str) == want


def test_ranking_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not ranked_search.ranked(docs.limit(0), items).count()
    assert not ranked_search.ranked(docs, items.limit(0)).count()
    assert not ranked_search.ranked(docs.where("text IS NULL"), items).count()


def test_bit_sliced_arithmetic():
    r = np.random.default_rng(3)
    value = lambda bits: sum(np.unpackbits(row.view(np.uint8), bitorder="little").astype(object) << b for b, row in enumerate(bits))
    numbers = r.integers(0, 2**63, (13, 9, 4)).astype(np.uint64)
    assert (value(ranked_search.total(numbers)) == sum(value(x) for x in numbers)).all()
    assert (value(ranked_search.added(numbers[0], numbers[1][:5])) == value(numbers[0]) + value(numbers[1][:5])).all()
    w = np.array([0, 1, 13, 23_000])
    assert (value(ranked_search.times(numbers[2], w)) == value(numbers[2]) * np.repeat(w, 64).astype(object)).all()
    ids = list(range(256))[::-1]
    sums = value(numbers[3])
    want = sorted(((-int(s), i) for s, i in zip(sums, ids) if s))[:20]
    assert sorted((-s, i) for i, s in ranked_search.best(numbers[3], ids, 20)) == want


def test_viterbi_equals_exhaustive_search():
    r = np.random.default_rng(4)
    sizes = np.array([5, 0, 1, 6, 3])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    score = -r.integers(0, 20, (sizes.sum(), 3)).astype(np.float32)
    got = language_id.viterbi(score, starts, sizes, 7.0)
    for a, n in zip(starts, sizes):
        worth = lambda path: sum(score[a + t, x] for t, x in enumerate(path)) - 7 * sum(x != y for x, y in zip(path, path[1:]))
        paths = [[k // 3**t % 3 for t in range(n)] for k in range(3**n)]
        assert worth(got[a : a + n].tolist()) == max(map(worth, paths))


def test_languages_of_held_out_documents(spark, data):
    out = language_id.op12_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 20
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_is_cut_into_spans(spark):
    english, russian, french = "the house on the hill was old and very quiet", "старый дом стоял на холме очень тихо", "la maison sur la colline est vieille et calme"
    rows = [(k, text, lang) for k, (text, lang) in enumerate(((english, "en"), (russian, "ru"), (french, "fr")) * 12)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, f"{english}, {russian}; {french}", "x"), (2, None, "x"), (3, "12 + 3 !", "x"), (4, "", "x"), (5, "ქართული ენა", "x"), (None, french, "x"), (6, "la maison " * 30_000, "x"), (6, russian, "x")]
    labelled = {(r.doc_id, r.lang_pred): r for r in language_id.label(spark.createDataFrame(odd, "doc_id long, text string, spans string"), model).collect()}
    mixed = next(r for (i, _), r in labelled.items() if i == 1)
    assert [(s.lang, s["first"], s["last"]) for s in mixed.spans] == [("en", 0, 9), ("ru", 10, 16), ("fr", 17, 25)]
    assert all((i, "und") in labelled and labelled[i, "und"].score == 0 for i in (2, 3, 4))
    assert (None, "fr") in labelled and (6, "fr") in labelled and (6, "ru") in labelled and labelled[6, "fr"].score == 1
    nobody = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.label(spark.createDataFrame(odd, "doc_id long, text string, spans string"), nobody).collect()} == {"und"}
