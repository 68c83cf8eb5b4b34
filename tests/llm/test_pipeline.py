"""The whole pipeline against brute force, on a small table with copies, near copies, near lines and odd rows."""

import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gridloom.llm import personal_data  # noqa: E402
from gridloom.llm.pack_windows import WordTokenizer  # noqa: E402
from tests.llm.test_documents import groups, levenshtein, prose, shingle_set  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    r = random.Random(77)
    lines = [prose(r.randint(14, 26), r) for _ in range(34)]
    text = lambda ks: "\n".join(lines[k] for k in ks)
    typo = lambda t: t.replace(" ", " x ", 1)
    near = lines[4].split(" ")
    near[5] = "zz"
    texts = [
        text(range(0, 5)), text(range(5, 9)), text(range(9, 13)), text(range(13, 17)), text([17, 18, 19, 9]), text(range(5, 9)), typo(lines[20]) + "\n" + text([21, 22, 23]),
        text([20, 24, 25, 26]), text([0, 1, 2, 27]), "too short", "", None, "buy now " * 80, text([28, 29, 30]) + "\nwrite to a.b@mail.example.com or +1 (555) 123-4567 now please",
        " ".join(near) + "\n" + text([31, 32, 33]),
    ]
    return [(k, t, "en", "web", len(t) if t is not None else None) for k, t in enumerate(texts)] + [(5, texts[5], "en", "web", len(texts[5])), (None, texts[2].upper(), "en", "web", len(texts[2]))]


def quality(rows):
    kept = []
    for row in rows:
        t = row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        cover = {k + d for k, w in enumerate(wins) if wins.count(w) > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        letters, upper, n = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t)), len(words)
        size = sum(map(len, words))
        fails = [n < 50, 100 * len(cover) > 50 * n, 100 * len(re.findall(r"[#*$%&|<>]", t)) > 10 * n, letters > 0 and 100 * upper > 60 * letters, 100 * t.count("!") > 20 * n, 100 * (len(lines) - len(set(lines))) > 80 * len(lines), size > 25 * n, size < 2 * n]
        if not any(fails):
            kept.append(row)
    return kept


def lines_gone(rows):
    found = [(row, k, raw) for row in dict.fromkeys(rows) for k, raw in enumerate((row[1] or "").split("\n")) if raw.strip()]
    norms = [" ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", raw.lower())) or raw.strip() for _, _, raw in found]
    links = []
    for a in range(len(found)):
        for b in range(a):
            most = max(len(norms[a]), len(norms[b])) // 10
            if norms[a] == norms[b] or abs(len(norms[a]) - len(norms[b])) <= most and len(set(norms[a].split()) & set(norms[b].split())) > 4 and levenshtein(norms[a], norms[b]) <= most:
                links.append((a, b))
    of, first, drop = groups(len(found), links), {}, {}
    order = lambda k: (found[k][0][0] is not None, found[k][0][0] or 0, found[k][1])
    for k in range(len(found)):
        first[of[k]] = min(first.get(of[k], k), k, key=order)
    for k, (row, line, _) in enumerate(found):
        if first[of[k]] != k:
            drop.setdefault(row, set()).add(line)
    out = []
    for row in rows:
        rest = "\n".join(x for k, x in enumerate(row[1].split("\n")) if k not in drop.get(row, ()))
        if rest == row[1] or rest.strip():
            out.append((row[0], rest, *row[2:4], len(rest)))
    return out


def near_gone(rows):
    sets = [shingle_set(row[1]) for row in rows]
    of = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[of[k]] = min(least.get(of[k], row[0]), row[0])
    return list(dict.fromkeys(row for k, row in enumerate(rows) if row[0] is not None and least[of[k]] == row[0])) + [row for row in rows if row[0] is None]


def private_gone(rows):
    return [(row[0], personal_data.redacted(row[1]), *row[2:4], len(personal_data.redacted(row[1]))) for row in rows]


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, lines_gone, near_gone, private_gone)):
        docs, want = stage(spark, docs, str(tmp_path)), brute(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str), name
    assert 6 <= len(want) < len(quality(rows)) - 1 and any("[EMAIL]" in t for _, t, *_ in want)
    own = WordTokenizer(P.path("word_bpe_49k.json"))
    ids = {row[0]: np.r_[own([row[1]])[0], 1] for row in want}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {k: len(v) for k, v in ids.items()}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()
