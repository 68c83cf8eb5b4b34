"""Text operators against brute force, on small tables with odd rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import doc_fingerprints, line_dedup, lm_scoring, ngram_join, personal_data, quality_rules, toxicity
from gridloom.llm._common import components

RANDOM = random.Random(5)
VOCAB = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 9))) for _ in range(300)]


def prose(n, r=RANDOM):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, share, r=RANDOM):
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with copies, near copies, shared lines, nulls, repeats, and columns with clashing names."""
    base = [prose(RANDOM.randint(1, 120)) for _ in range(40)]
    texts = [*base, base[3], base[3].upper(), *[edited(base[7], 0.02) for _ in range(12)], *[edited(base[8], 0.06) for _ in range(12)], "", None, " \n\t", "one two", "ONE  two", "w " * 400, base[5] + "\n" + base[6] + "\n" + base[5]]
    rows = [(k * 3, t, "x", 1, "y") for k, t in enumerate(texts)] + [(0, base[0], "x", 1, "y"), (None, base[3], "x", 1, "y"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, h int, key string").cache()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, k) for k in range(n)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(330)] + [(500, k) for k in range(501, 600)]
    want = groups(600, links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: want[k] for a, b in links if a != b for k in (a, b)}
    assert not components(spark.createDataFrame([], "a long, b long")).count()


def test_ngram_join_equals_brute_force(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = groups(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[of[k]] = min(least.get(of[k], i), i)
    want = sorted(((i, len(s), least.get(of[k])) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(corpus).collect()), key=str)
    assert got == want
    assert not ngram_join.similar_documents(corpus.limit(0)).count()


def test_prefix_orders_keep_linked_pairs():
    r = np.random.default_rng(1)
    orders = ngram_join.Orders(r.integers(0, 50, 2 * ngram_join.ROW).astype(np.uint32))
    for _ in range(300):
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (r.integers(1, 80), r.integers(0, 12), r.integers(0, 12)))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        if ngram_join.linked(x, y):
            assert all(len(np.intersect1d(orders.prefix(x, k), orders.prefix(y, k))) for k in range(3))


def test_ledger_measures(spark, corpus):
    def measured(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        cover = {k + d for k, w in enumerate(wins) if wins.count(w) > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(cover)

    got = quality_rules.ledger(corpus).collect()
    assert [(r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in got] == [measured(r.text) for r in got]
    assert all((r.fail_bits & 1 != 0) == (r.n_words < 50) for r in got)
    ledger = quality_rules.ledger(corpus)
    failed = {r.rule: r.failed for r in quality_rules.ablation(ledger).collect()}
    assert failed["too_few_words"] == sum(r.n_words < 50 for r in got)
    kept = quality_rules.stage(spark, corpus, "")
    assert kept.columns == corpus.columns and kept.count() == sum(r.fail_bits == 0 for r in got)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_keeps_one_of_each_group(spark):
    r = random.Random(9)
    base = [prose(30, r) for _ in range(12)]
    one_off = lambda t: t[:40] + "q" + t[41:]
    docs = [(1, "\n".join(base[:4])), (2, base[0].upper() + "!\n" + base[5]), (3, one_off(base[1]) + "\n\n" + base[6]), (4, base[7] + "\n" + base[7]), (5, None), (6, ""), (None, base[8]), (7, base[8]), (2, base[0].upper() + "!\n" + base[5]), (8, "***\n***")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    got = {}
    for row in line_dedup.dedup(df).collect():
        got.setdefault(row.doc_id, []).append(row.text)
    assert got[1] == [docs[0][1]] and got[2] == [base[5], base[5]] and got[4] == [base[7]] and got[5] == [None] and got[6] == [""] and got[8] == ["***"]
    assert got[3] == ["\n" + base[6]] and {tuple(got[None]), tuple(got[7])} == {(base[8],), ("",)}
    assert levenshtein(base[1], one_off(base[1])) <= 1
    assert not line_dedup.dedup(df.limit(0)).count()


def test_personal_data_base_spans():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")), "card": 12 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    r = random.Random(2)
    parts = [*"0123456789" * 3, *"..@@+-- ()ab%é\n", "4111111111111111", "a.b@c.de", "+1 (555) 123-4567", " 10.0.0.1 "]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        want = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text) if holds(k, m[0])]
        assert personal_data.base_spans(text) == sorted(want, key=lambda x: (x[1], list(kinds).index(x[0])))


def test_personal_data_context_and_redaction(spark):
    said = lambda t: [k for k, *_ in personal_data.spans(t)]
    assert said("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"] and said("IBAN DE88 3704 0044 0532 0130 00") == []
    assert said("ssn 123-45-6789") == ["ssn"] and said("part no 123-45-6789") == [] and said(None) == []
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    df = spark.createDataFrame([(1, "write a@b.de now"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    assert [r.text for r in personal_data.redact(df).collect()] == ["write [EMAIL] now", None, "", ""]
    assert [len(r.personal_data or []) for r in personal_data.find(df).collect()] == [1, 0, 0, 0]


def test_fingerprints(spark, corpus):
    rows = sorted(((r.doc_id, r.text or "") for r in corpus.collect() if r.doc_id is not None), key=lambda x: x[0])
    clean = spark.createDataFrame([x for k, x in enumerate(rows) if not k or rows[k - 1] != x], "doc_id long, text string")
    want = {}
    plain = sorted(clean.collect(), key=lambda r: r.doc_id)
    for k, r in enumerate(plain):
        after, half = plain[(k + 1) % len(plain)].text, len(r.text) // 2
        want[r.doc_id] = r.text[: len(r.text) - half] + after[:half]
    import hashlib

    got = {r.doc_id: r for r in doc_fingerprints.edited_pairs(clean).collect()}
    assert {i: r.edited_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    by_text = {}
    for r in plain:
        by_text.setdefault(r.text, set()).add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.05
    bits = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, r in got.items():
        near = sum((bits[i] ^ b).bit_count() <= doc_fingerprints.RADIUS for b in bits.values())
        assert r.n_near == (near if i % 100 == 0 else None)
    assert doc_fingerprints.edited_pairs(corpus).count() == corpus.count()
    assert not doc_fingerprints.edited_pairs(clean.limit(0)).count()


def test_block_tables_find_all_within_the_radius(spark):
    r = random.Random(4)
    signed = lambda x: x - (1 << 64) * (x >> 63)
    base = [r.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randint(1, 9))) for b in base for _ in range(4)]
    frame = lambda xs: spark.createDataFrame([(signed(x & (1 << 64) - 1), signed(x >> 64)) for x in xs], "fp0 long, fp1 long")
    got = doc_fingerprints.neighbours(frame(every), frame(base)).count()
    assert got == sum((a ^ b).bit_count() <= doc_fingerprints.RADIUS for a in base for b in set(every))


def test_toxicity_learns_and_leaves_held_out_labels_alone(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out())
    got = {r.toxic: r for r in scored.groupBy("toxic").agg(F.avg("score").alias("mean"), F.avg("predicted").alias("share")).collect()}
    assert got[1].share > 0.6 and got[0].share < 0.01 and got[1].mean > got[0].mean + 0.5
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x y"), (2, "x y")], "doc_id long, text string")
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(odd, model).collect()] == [0.5] * 4


def test_lm_scoring_prefers_the_target(spark):
    r = random.Random(8)
    a, b = VOCAB[:150], VOCAB[150:]
    docs = spark.createDataFrame([(k, " ".join(r.choice(a if k % 2 else b) for _ in range(200))) for k in range(60)] + [(98, None), (99, ""), (None, "abc"), (1, "abc abc")], "doc_id long, text string")
    got = lm_scoring.score(docs, spark.createDataFrame([(k,) for k in range(1, 41, 2)] * 2 + [(None,)], "doc_id long")).collect()
    odd, even = ([x.score for x in got if x.doc_id is not None and x.doc_id < 60 and x.n_tokens == 200 and x.doc_id % 2 == k] for k in (1, 0))
    assert len(got) == 64 and max(odd) < min(even) and all(math.isfinite(x.score) for x in got)
    assert {(x.n_tokens, x.score) for x in got if x.doc_id in (98, 99)} == {(0, 0.0)}
    none = spark.createDataFrame([], "doc_id long")
    assert {x.score for x in lm_scoring.score(docs, none).collect()} == {0.0} and not lm_scoring.score(docs.limit(0), none).count()


def test_line_groups_equal_brute_force_over_all_pairs(spark):
    r = random.Random(21)

    def typo(line, n):
        for _ in range(n):
            k = r.randrange(len(line))
            line = r.choice([line[:k] + r.choice("qxz ") + line[k + 1 :], line[:k] + line[k + 1 :], line[:k] + r.choice("qxz") + line[k:]])
        return line

    lines = [prose(n, r) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 16, 20, 30, 60) for _ in range(3)]
    lines += [typo(x, max(1, round(len(x) * share))) for x in lines for share in (0.0, 0.03, 0.06, 0.09, 0.1, 0.12)]
    evenly = lambda x, n: "".join("q" if k % n == n - 1 else c for k, c in enumerate(x))
    lines += [evenly(x, n) for x in lines[:42] for n in (10, 11)]
    norms = [" ".join(re.findall(r"[a-z0-9]+", x.lower())) for x in lines]
    links = [(a, b) for a in range(len(norms)) for b in range(a) if abs(len(norms[a]) - len(norms[b])) * 10 <= max(len(norms[a]), len(norms[b])) and levenshtein(norms[a], norms[b]) <= max(len(norms[a]), len(norms[b])) // 10]
    of = groups(len(lines), links)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {row.doc_id for row in line_dedup.duplicate_lines(df, exhaustive=True).collect()}
    assert got == {k for k in range(len(lines)) if of[k] != k}


def test_long_lines_may_differ_in_a_tenth(spark):
    r = random.Random(22)
    line = prose(500, r)
    edits = lambda share: "".join("q" if r.random() < share else c for c in line)
    rows = [(1, line), (2, edits(0.085)), (3, prose(500, r))]
    assert len(line) > 2500 and sum(a != b for a, b in zip(line, rows[1][1])) > 200
    got = {x.doc_id: list(x.lines) for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [0]}


def test_lines_with_a_tenth_of_their_words_edited_are_found(spark):
    r = random.Random(23)
    rows, want = [], {}
    for k in range(120):
        words = prose(r.randint(14, 90), r).split(" ")
        rows.append((2 * k, " ".join(words)))
        other = list(words)
        for at in sorted(r.sample(range(len(words)), len(words) // 10), reverse=True):
            other[at : at + 1] = r.choice([[], [other[at][::-1]], [other[at], "q"]])
        rows.append((2 * k + 1, " ".join(other)))
        a, b = rows[-2][1], rows[-1][1]
        if levenshtein(a, b) <= max(len(a), len(b)) // 10:
            want[2 * k + 1] = [0]
    got = {x.doc_id: list(x.lines) for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 60 and got == want


def test_line_search_misses_no_pair_of_the_test_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    drops = lambda x: {r.doc_id: list(r.lines) for r in line_dedup.duplicate_lines(docs, exhaustive=x).collect()}
    assert drops(False) == drops(True)


def test_line_rows_with_odd_ids_names_and_lengths(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(None, "only here one two three\nshared line of text", "a"), (None, "another text\nshared line of text", "b"), (4, long, "c"), (4, long + " end", "d"), (5, "一二三四五六七八九十" * 30, "e"), (6, "一二三四五六七八九十" * 29 + "一二三四五六七八十", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __rid0 string").withColumn("h", F.lit(1))
    got = {r["__rid0"]: r.text for r in line_dedup.dedup(df).collect()}
    assert sorted([got["a"], got["b"]]) in (["another text", rows[0][1]], ["another text\nshared line of text", "only here one two three"])
    assert sorted([got["c"], got["d"]], key=len)[0] == "" and sorted([got["e"], got["f"]], key=len)[0] == ""


def test_line_stage_keeps_what_stands_nowhere_else(spark):
    r = random.Random(24)
    lines = [prose(20, r) for _ in range(9)]
    own = prose(4, r)
    rows = [(1, "\n".join(lines[:6])), (2, "\n".join([*lines[:5], own])), (3, "\n".join([lines[0], *lines[6:]])), (4, None), (5, ""), (6, lines[2] + "\n \n" + lines[3]), (7, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {x.doc_id: x for x in line_dedup.stage(spark, df, "").collect()}
    assert {k: x.text for k, x in got.items()} == {1: rows[0][1], 2: own, 3: "\n".join(lines[6:]), 4: None, 5: "", 7: " \n"}
    assert got[3].n_chars == len(got[3].text) and got[4].n_chars is None
    bare = df.drop("n_chars").withColumn("rid", F.lit(1))
    assert {x.doc_id: x.text for x in line_dedup.stage(spark, bare, "").collect()} == {k: x.text for k, x in got.items()}
    assert personal_data.stage(spark, bare, "").columns == bare.columns


def test_lines_with_characters_edited_anywhere_are_found(spark):
    """Recall over the relation itself: characters replaced at random places, up to nearly a tenth of them."""
    r = random.Random(31)
    rows, kind = [], {}
    for share in (0.02, 0.04, 0.06, 0.08, 0.095):
        for size in range(7, 121):
            line = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((2, 3, 5, 7, 9)))) for _ in range(size))
            at = [k for k, c in enumerate(line) if c != " "]
            other = list(line)
            for k in r.sample(at, min(len(at), int(len(line) * share))):
                other[k] = r.choice("qrstuvwxyz")
            kind[len(rows) + 1] = share
            rows += [(len(rows), line), (len(rows) + 1, "".join(other))]
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= kind.keys()
    for share in set(kind.values()):
        planted = [k for k, s in kind.items() if s == share]
        assert sum(k in got for k in planted) >= 0.9 * len(planted), share


def test_copies_of_a_text_do_not_add_up_votes(spark, monkeypatch):
    monkeypatch.setattr(doc_fingerprints, "PAIR", 1 << 27)
    text = "one two three four five"
    prints = lambda n: [tuple(x) for x in doc_fingerprints.fingerprints(spark.createDataFrame([("k", text)] * n, "k string, text string"), "k").collect()]
    assert prints(200) == prints(1)


def test_lm_scoring_equals_counts_of_the_other_documents(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "CHUNK", 3000)
    r = random.Random(31)
    words = [f"w{k}" for k in range(5000)] * 2 + [f"v{k % 40}" for k in range(5000)]
    r.shuffle(words)
    texts = [" ".join(words[k : k + 300]) for k in range(0, len(words), 300)] + ["once only", "w1 W2 w1 w2 new", "", "long " * 9000]
    texts.append(texts[3])
    good = set(range(0, 20))
    tokens = [t.lower().split() for t in texts]
    vocabulary = len({w for t in tokens for w in t})
    size = {m: sum(len(t) for k, t in enumerate(tokens) if (k in good) == m) for m in (True, False)}
    want = [[] for _ in texts]
    for target in (True, False):
        chosen = [k for k in range(len(texts)) if (k in good) == target]
        one, two = Counter(w for k in chosen for w in tokens[k]), Counter(p for k in chosen for p in zip(["<s>", *tokens[k]], tokens[k]))
        scale = min(size.values()) / size[target]
        for k, own in enumerate(tokens):
            inside = (k in good) == target
            mine, pairs = Counter(own), Counter(zip(["<s>", *own], own))
            count = lambda w: (len(chosen) - inside if w == "<s>" else one[w] - inside * mine[w]) * scale  # noqa: B023, E731
            base = lambda w: (count(w) + lm_scoring.ALPHA) / ((size[target] - inside * len(own)) * scale + lm_scoring.ALPHA * (vocabulary + 1))  # noqa: B023, E731
            losses = [-math.log(((two[a, b] - inside * pairs[a, b]) * scale + lm_scoring.KAPPA * base(b)) / (count(a) + lm_scoring.KAPPA)) for a, b in zip(["<s>", *own], own)]
            want[k].append(np.mean(losses) if losses else 0.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("target", F.lit("x"))
    got = {x.doc_id: x for x in lm_scoring.score(docs, spark.createDataFrame([(k,) for k in good], "doc_id long")).collect()}
    for k, (t, b) in enumerate(want):
        assert got[k].n_tokens == len(tokens[k]) and math.isclose(got[k].target_loss, t, rel_tol=1e-9) and math.isclose(got[k].background_loss, b, rel_tol=1e-9)


def test_personal_data_query_equals_brute_force(spark, data):
    import hashlib

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")), "card": 12 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in personal_data.op9_personal_data(spark, data).collect()}
    assert got.keys() == texts.keys() and sum(r.n_email for r in got.values())
    for i, text in texts.items():
        want = sorted(((m.start(), list(kinds).index(k), m.end(), k) for k, p in kinds.items() for m in re.finditer(p, text) if holds(k, m[0])))
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) - {""} <= set(r.spans.split(","))
        assert len(r.scores.split(",")) == len(r.spans.split(","))


def test_secrets_need_an_announcement():
    said = lambda t: [k for k, *_ in personal_data.spans(t)]
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert said(f'api_key = "{key}"') == said(f'x = "{key}"') == ["secret"] and said(f"commit {key} of it") == [] == said("key 0123456789012345678901234567890123456789x")


def test_fingerprints_equal_brute_force(spark):
    import struct

    import xxhash

    r = random.Random(41)
    texts = ["", None, "one", "One  two", *[prose(r.randint(3, 80), r) for _ in range(12)], "long " * 20000 + "end"]
    long = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)

    def fingerprint(text):
        words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
        seeds = {k: xxhash.xxh64_intdigest(struct.pack("<i", k), 42) for k in (1, 2, 3, 4)}
        out = 0
        for word in (0, 1):
            votes = np.zeros(64, np.int64)
            for terms, weight in (([long(x, seeds[1 + word]) for x in words], doc_fingerprints.SINGLE), ([long(b, long(a, seeds[3 + word])) for a, b in zip(words, words[1:])], doc_fingerprints.PAIR)):
                for h in terms:
                    votes += weight * np.unpackbits(np.frombuffer(struct.pack("<Q", h), np.uint8), bitorder="little").astype(np.int64)
            total = doc_fingerprints.SINGLE * len(words) + doc_fingerprints.PAIR * max(0, len(words) - 1)
            out |= sum(1 << j for j in range(64) if 2 * votes[j] > total) << 64 * word
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    mask = (1 << 64) - 1
    got = {x.k: x.fp0 & mask | (x.fp1 & mask) << 64 for x in doc_fingerprints.fingerprints(df, "k").collect()}
    assert got == {k: fingerprint(t) for k, t in enumerate(texts)}


def test_ledger_takes_columns_of_any_name(spark):
    df = spark.createDataFrame([("a b c a b c", 1, "x", None)], "text string, __t int, __w string, n_words long")
    row = quality_rules.ledger(df).first()
    assert (row["__t"], row["__w"], row.n_words, row.n_repeat_words) == (1, "x", 6, 6)


def test_ftrl_equals_a_plain_loop():
    """The array version of the learner against the published update, coordinate by coordinate."""
    r = np.random.default_rng(8)
    rows = [np.unique(r.integers(0, 40, r.integers(1, 12))) for _ in range(60)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    own = toxicity.Ftrl(alpha=0.7, beta=1.3, l1=0.4, l2=0.2, epochs=3)
    got, got_bias = own.learn(rows, labels, seed=5)
    z, n, bias, bias_n = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= own.l1 else (math.copysign(own.l1, z[i]) - z[i]) / ((own.beta + math.sqrt(n[i])) / own.alpha + own.l2)
    order = np.random.default_rng(5)
    for _ in range(own.epochs):
        for k in order.permutation(len(rows)):
            at = rows[k].tolist()
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[k]
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / own.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + math.sqrt(bias_n))
    assert got_bias == pytest.approx(bias) and got[:40] == pytest.approx([weight(i) for i in range(40)]) and not got[40:].any()
    assert 0 < np.count_nonzero(got) < 40  # L1 leaves some at zero


def test_features_equal_a_plain_loop():
    import xxhash

    words = [b"don't", b"stop", b"\xc3\xa9t\xc3\xa9", b"stop", b"a"]
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    wide = (1 << 64) - 1
    p, q, r = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
    single, pairs, skips = [x * p & wide for x in h], [a * q + b * r & wide for a, b in zip(h, h[1:])], [a * r + b * p & wide for a, b in zip(h, h[2:])]
    want = [((x ^ x >> 31) * q & wide) >> 44 for x in (*single, *pairs, *skips)]
    assert toxicity.features("Don't STOP, \u00e9t\u00e9 stop a").tolist() == want


def test_toxicity_of_odd_texts(spark):
    bad, good = "you are a filthy rotten zorg", "a quiet walk along the river"
    docs = [(k, f"{bad} {k}" if k % 2 else f"{good} {k}", "x", 1) for k in range(300)] + [(300, None, None, None), (301, "", "x", 1), (302, f"{good} " * 40_000 + bad, "x", 1), (1, f"{bad} again", "x", 1), (None, good, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, id int").withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(300)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels, learner=toxicity.Ftrl(l1=0.5))
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 300)
    none = {r.doc_id: r.score for r in rows if r.doc_id in (300, 301)}
    assert none[300] == none[301] and not toxicity.score(df.limit(0), model).count()
    blank = toxicity.train(df.limit(0), labels)
    assert {r.score for r in toxicity.score(df, blank).collect()} == {0.5}


def test_personal_data_of_odd_rows(spark):
    long = "x " * 100_000 + "write to a.b@mail.example.com now"
    rows = [(1, long, "a"), (2, None, None), (2, "ip 10.0.0.1", "b"), (2, "ip 10.0.0.1", "b"), (None, "ip 10.0.0.1", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, personal_data string").withColumn("spans", F.lit("x"))
    got = [(r.doc_id, r.text) for r in personal_data.redact(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "x " * 100_000 + "write to [EMAIL] now"), (2, None), (2, "ip [IP]"), (2, "ip [IP]"), (None, "ip [IP]")], key=str)
    assert not personal_data.redact(df.limit(0)).count()


def test_fingerprints_of_repeated_ids_and_clashing_names(spark):
    r = random.Random(6)
    rows = [(7, prose(r.randint(5, 60), r), "x", 1, "y") for _ in range(40)] + [(k, prose(30, r), "x", 1, "y") for k in (1, 7, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string, fp0 int, __row string").withColumn("next_sha", F.lit(1))
    got = doc_fingerprints.edited_pairs(df).collect()
    assert len(got) == len(rows) and sum(x.doc_id == 7 for x in got) == 41
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 and len(x.fingerprint) == 32 for x in got)
    plain = {(x.doc_id, x.n_chars, x.fingerprint, x.edited_sha256) for x in doc_fingerprints.edited_pairs(df.select("doc_id", "text")).collect()}
    assert plain == {(x.doc_id, x.n_chars, x.fingerprint, x.edited_sha256) for x in got}


def test_a_shingle_of_many_classes_and_very_long_texts(spark):
    """A sentence that three hundred texts share links none of them; two long texts with few edits are linked."""
    r = random.Random(12)
    shared = "this very sentence stands in all of these texts"
    rows = [(k, prose(r.randint(20, 60), r) + " " + shared) for k in range(300)]
    long = prose(60_000, r).split(" ")
    other = list(long)
    for at in range(0, len(long), 2000):
        other[at] = "zz"
    rows += [(300, " ".join(long)), (301, " ".join(other)), (302, " ".join(reversed(long)))]
    got = {x.doc_id: x for x in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[301].component_id == 300 and all(x.component_id == k for k, x in got.items() if k != 301)
    assert got[300].n_shingles == len(shingle_set(rows[300][1]))


def test_long_lines_have_few_line_blocks(spark):
    r = random.Random(32)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(200)]
    common = [" ".join(r.choice(("of", "the", "a", "in", "to")) for _ in range(17)) + f" {k}end" for k in range(200)]
    blocks = lambda x: line_dedup._blocks(spark.createDataFrame(list(enumerate(x)), "h long, norm string"), False)
    assert blocks(lines).count() < 0.37 * 200 * 60
    sizes = [row["count"] for row in blocks(common).where("h >= 0").groupBy("key").count().collect()]
    assert max(sizes) < 200


def test_line_texts_are_staged_once_and_letters_are_counted(spark, monkeypatch):
    r = random.Random(5)
    lines = [prose(n, r) for n in (8, 20, 40) for _ in range(4)]
    rows = list(enumerate(lines + [x.replace("e", "é", 1) for x in lines] + ["zz top! 日本", "e" * 300]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = []
    call = line_dedup.Scratch.__call__
    monkeypatch.setattr(line_dedup.Scratch, "__call__", lambda self, x: texts.append("norm" in x.columns) or call(self, x))
    assert line_dedup.duplicate_lines(df).count() == len(lines) and sum(texts) == 1
    norms = line_dedup._lines(df)
    of = {x.h: x.norm for x in norms.collect()}
    for x in line_dedup._lettered(norms).collect():
        counts = b"".join(c.to_bytes(7 if k < 3 else 5, "little") for k, c in enumerate((x.c0, x.c1, x.c2, x.c3)))
        assert list(counts) == [min(255, of[x.h].count(c)) for c in line_dedup._COMMON]
        assert x.rare == "".join(c for c in of[x.h] if c not in " " + line_dedup._COMMON[: line_dedup._DENSE]) and x.size == len(of[x.h])


def test_unrelated_lines_of_one_language_are_told_apart_by_their_short_forms(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "in", "re", "ed", "nd", "ha", "es", "st", "en", "at", "ti", "or", "ble", "tion", "ly", "wh", "ou")) for _ in range(r.choice((1, 1, 2, 3))))
    lines = [" ".join(word() for _ in range(n)) for n in (30, 60, 90) for _ in range(40)]
    edited = ["".join(r.choice("eta") if c != " " and r.random() < 0.08 else c for c in x) for x in lines]
    df = spark.createDataFrame(list(enumerate(lines + edited)), "h long, norm string")
    short, n = line_dedup._lettered(df), len(lines)
    other = spark.createDataFrame([(a, b) for k in range(0, n, 40) for a in range(k, k + 40) for b in range(k, a)], "a long, b long")
    assert line_dedup._near(other, short, True).count() < 0.02 * other.count()
    copies = [(k, n + k) for k in range(n) if levenshtein(lines[k], edited[k]) <= max(len(lines[k]), len(edited[k])) // 10]
    got = {(x.a, x.b) for known in (True, False) for x in line_dedup._near(spark.createDataFrame(copies, "a long, b long"), short, known).collect()}
    assert len(copies) > 60 and got == set(copies)
