"""Codecs and counts against the libraries, packing against its own rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from gridloom.llm.pack_windows import WordTokenizer, fullest, pack, plan  # noqa: E402
from gridloom.llm.piece_codec import BacktrackCodec, encode_decode  # noqa: E402
from gridloom.llm.token_counts import RaggedMerger, token_counts  # noqa: E402

MODEL, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ALPHABET = [*"abcdefth  e  nn\n\t.,!1239▁▁éßñ中日😀\x00\x01‍﻿\xa0<s>/'’Σςİ\x1c\x85　\x0b\r", "</s>", "<|endoftext|>", "<0x0A>", " the", "     ", "ing", "'ll"]
EDGES = ["", " ", "  ", "\n", " \n ", "▁", "a" * 700, " " * 40, "\n\n\n", "x \n\n y", "word " * 3000]


def texts(n=2000):
    r = random.Random(3)
    return EDGES + ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_codec_equals_the_library():
    own, library = BacktrackCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in texts():
        want = [1, *library.encode(text), 2]
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want[1:-1]
        assert own.decode(np.array(want)) == library.decode(want).encode()


def test_counts_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert RaggedMerger(MODEL).count(texts()) == [len(library.encode(t)) for t in texts()]


def test_long_texts_without_spaces_equal_the_library():
    r, library, own, codec = random.Random(5), sentencepiece.SentencePieceProcessor(model_file=MODEL), RaggedMerger(MODEL), BacktrackCodec(MODEL)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "".join(chr(r.randint(0x4E00, 0x5E00)) for _ in range(200_000)), "the" * 5000, "ab" * 3000 + "=" * 2000, "a" * 6000]
    want = [library.encode(t) for t in long]
    assert own.count(long) == [len(x) for x in want]
    assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in long] == want


def test_words_equal_the_library():
    own = WordTokenizer(WORDS)
    for text, ids in zip(texts(), own(texts())):
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids


#: An id that a double can't hold.
ID = (1 << 60) + 1


def odd(spark):
    return spark.createDataFrame([(ID, "a b", 1), (ID, "a b", 1), (None, None, None), (2, "", 2), (3, "word " * 5000, 3)], "doc_id long, text string, n_tokens int")


def test_odd_rows(spark):
    got = encode_decode(odd(spark), MODEL, texts=True).collect()
    assert sorted((r.doc_id or 0, r.decoded[:3]) for r in got) == [(0, ""), (2, ""), (3, "wor"), (ID, "a b"), (ID, "a b")]
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    counts = {(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts(odd(spark), MODEL).collect()}
    assert counts == {(ID, 3, False), (None, 0, False), (2, 0, False), (3, 25000, True)}
    assert encode_decode(odd(spark).limit(0), MODEL).count() == token_counts(odd(spark).limit(0), MODEL).count() == 0


def test_fullest_is_the_best_subset():
    from collections import Counter
    from itertools import combinations

    r = random.Random(1)
    for _ in range(200):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        goal = r.randint(1, 60)
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= goal)
        got = fullest(Counter(items), goal)
        assert sum(n * k for n, k in got.items()) == best and all(Counter(items)[n] >= k for n, k in got.items())


def test_plan_uses_every_unit_once():
    r = random.Random(2)
    for lengths in ([], [5], [64] * 10, [r.randint(1, 63) for _ in range(500)], [33] * 101):
        seen = [set() for _ in lengths]
        for row in plan(lengths, 64):
            size = sum(n for _, _, n in row)
            assert size <= 64 and not size & (size - 1)
            for item, start, n in row:
                new = set(range(start, start + n))
                assert not new & seen[item]
                seen[item] |= new
        assert [len(s) for s in seen] == lengths


def test_packed_pieces_make_up_the_documents(spark):
    rows = pack(odd(spark), WORDS, with_ids=True).collect()
    own = WordTokenizer(WORDS)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    by_doc = {}
    for r in sorted((r for r in rows if r.doc_id in (2, 3)), key=lambda r: r.start):
        assert r.start == len(by_doc.setdefault(r.doc_id, []))
        by_doc[r.doc_id] += r.ids
    assert by_doc[2] == [1] and by_doc[3] == [*own(["word " * 5000])[0].tolist(), 1]
    windows = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and not n & (n - 1) for n in windows.values())
    assert pack(odd(spark).limit(0), WORDS).count() == 0


def test_pools_that_overflow_and_many_partitions(spark, monkeypatch):
    """Every id lies in one piece, windows are gapless and full but for powers of two, whatever the pool holds."""
    import importlib

    monkeypatch.setattr(importlib.import_module("gridloom.llm.pack_windows"), "POOL_IDS", 5000)
    r = random.Random(4)
    docs = [(k, " ".join(r.choice(("word", "day", "xyzzy", "é")) for _ in range(r.randint(0, 900)))) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = pack(df, WORDS).collect()
    own = WordTokenizer(WORDS)
    sizes, seen, windows = {k: len(own([t])[0]) + 1 for k, t in docs}, {}, {}
    for x in sorted(rows, key=lambda x: (x.doc_id, x.start)):
        assert x.start == seen.get(x.doc_id, 0) and x.doc_tokens == sizes[x.doc_id]
        seen[x.doc_id] = x.start + x.length
    assert seen == sizes
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == windows.get(x.sequence_id, 0)
        windows[x.sequence_id] = x.offset + x.length
    assert all(n <= 2048 and not n & (n - 1) for n in windows.values()) and len(windows) > sum(sizes.values()) // 2048
