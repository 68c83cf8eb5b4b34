"""Exact merge-type encoding by backtracking, and decoding, for sentencepiece BPE models.

A sequence of pieces is the encoding exactly if each adjacent pair is what merging gives for the two
together. So a text is covered from the left with the longest pieces that an Aho-Corasick automaton
finds; a piece stands if merging its neighbour and it again gives the same two; if no piece fits, the
last one is taken back and a bit marks the position as one from which the rest can't be covered.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import by_batch, documents
from gridloom.llm._pieces import BAR, Pieces, segments, spelled

#: Bounds of a worker's memory: cached segments, and cached pairs of pieces. Beyond them a cache starts anew.
SEGMENTS, PAIRS = 500_000, 500_000


class BacktrackCodec:
    def __init__(self, model_file: str):
        import ahocorasick

        self.pieces = m = Pieces.of(model_file)
        runs = {p: i for p, i in m.id.items() if set(p) == {BAR} and len(p) > 1}
        self.run_id = {len(p): i for p, i in runs.items()}
        assert len({m.score[p] for p in runs}) < 2, "runs of bars must score alike, below all other pieces"
        self.score = {p: s for p, s in m.score.items() if p not in runs}
        self.find = ahocorasick.Automaton()
        self.rank = {p: r for r, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]))}
        self.halves: dict[str, tuple[str, str]] = {}
        kept = [p for p in self.score if self.merged(p) == [p]]
        assert all(h in self.rank for p in kept for h in self.halves.get(p, ())), "pieces are made of pieces"
        for p in kept:
            self.find.add_word(p, len(p))
        self.find.make_automaton()
        known = set(kept)
        #: For each piece the length of the longest shorter piece that it starts with, else 0.
        self.shorter = {p: next((n for n in range(len(p) - 1, 0, -1) if p[:n] in known), 0) for p in kept}
        self.characters = {p for p in kept if len(p) == 1}
        self.pair: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as the model defines it: the best scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            score, k = max((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if score == -np.inf:
                break
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether merging a and b together gives a and b again.

        Re-merging is followed backwards: the later made of the two is taken apart, and at each step no
        merge across the border may come before the one that is taken back.
        """
        known = self.pair.get((a, b))
        if known is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            known = self.pair[a, b] = self._fit(a, b)
        return known

    def _fit(self, a: str, b: str) -> bool:
        rank, halves = self.rank, self.halves
        limit = len(rank)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if ra > rb:  # of equal merges the left one comes first, and so stays below the border's
                limit, a = ra, halves[a][1]
            elif rb >= 0:
                limit, b = rb + 1, halves[b][0]
            else:
                return True

    def covered(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        longest = [0] * len(text)
        for end, n in self.find.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        out: list[str] = []
        failed = bytearray(len(text) // 8 + 1)  # bit k: position k does not lead to the end
        at, n = 0, longest[0]
        while at < len(text):
            piece = text[at : at + n]
            while n and (failed[at + n >> 3] >> (at + n & 7) & 1 or (out and not self.fit(out[-1], piece))):
                n = self.shorter[piece]
                piece = piece[:n]
            if n:
                out.append(piece)
                at += n
                n = longest[at] if at < len(text) else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                n = len(out[-1])
                at -= n
                out.pop()
        return out

    def run(self, bars: int) -> list[int]:
        """Lengths of the pieces of a run of bars: all score alike, so the leftmost pair that can merges."""
        out: list[int] = []
        for _ in range(bars):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.run_id:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def ids(self, segment: str) -> list[int]:
        """Ids of one segment: runs of bars by their own rule, unknown characters as bytes."""
        text = spelled(segment)
        m, out = self.pieces, []
        bars = len(text) - len(text.lstrip(BAR))
        found = self._stretches(text[max(0, bars - 1) :] if bars else text)
        if bars > 1:
            alone = bool(found) and found[0] == m.id[BAR]
            found, bars = (found[1:], bars) if alone else (found, bars - 1)
            out = [self.run_id.get(n, m.id[BAR]) for n in self.run(bars)]
        return out + found

    def _stretches(self, text: str) -> list[int]:
        m, out, start = self.pieces, [], 0
        if text and self.characters.issuperset(text):
            return [m.id[p] for p in self.covered(text)]
        for k, c in enumerate([*text, "\n"]):
            if c not in self.shorter or k == len(text):
                if k > start:
                    out += [m.id[p] for p in self.covered(text[start:k])]
                if k < len(text):
                    out += [m.byte[b] for b in c.encode()]
                start = k + 1
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a text, without begin and end, as little-endian unsigned 32-bit integers."""
        cache, parts = self.cache, segments(text)
        for s in set(parts).difference(cache):
            if len(s) > 256:
                continue
            cache[s] = array("I", self.ids(s)).tobytes()
        try:
            found = b"".join([cache[s] for s in parts])
        except KeyError:  # segments too long to keep
            found = b"".join([cache[s] if s in cache else np.array(self.ids(s), "<u4").tobytes() for s in parts])
        if len(cache) > SEGMENTS:
            cache.clear()
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8: control ids stand for nothing, one space in front goes."""
        raw = self.pieces.raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return text.removeprefix(b" ").decode("utf-8", "replace").encode()


_codecs: dict[str, BacktrackCodec] = {}


def codec(model_file: str) -> BacktrackCodec:
    """One codec for each worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = BacktrackCodec(model_file)
    return _codecs[model_file]


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """For each row its id, n_tokens, ids_sha256 and decoded_sha256, with begin and end ids; texts: also
    the ids and the decoded text.

    A null text counts as empty: two ids, an empty decoded text. Each row is worked on by itself, so ties,
    repeated rows, null ids and other columns of any name don't matter; an empty table gives none. A text may be of
    any length, with spaces or without. Needs no shuffle.
    """

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * texts]

    def run(source: Iterator[dict]) -> Iterator[dict]:
        own = codec(model_file)
        begin, end = (np.array([i], "<u4").tobytes() for i in (own.pieces.bos, own.pieces.eos))
        for batch in source:
            out = {name: [] for name in names}
            for text in batch["text"]:
                ids = begin + own.encode(text or "") + end
                n = np.frombuffer(ids, "<u4")
                back = own.decode(n)
                row = (len(n), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), *((n.tolist(), back.decode()) if texts else ()))
                for name, value in zip(names, row):
                    out[name].append(value)
            yield {"id": batch["id"], **out}

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return by_batch(source, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * texts).withColumnRenamed("id", id_col)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document with the 32k BPE model."""
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_piece_codec": op6_piece_codec}
