"""Token counts by rank-synchronous merging: the pre-tokens of a batch lie end to end in numpy arrays, and
in each round every pre-token merges its best ranked pair wherever it stands; what survives is counted.

A pair's occurrences merge in one round where nothing that a merge makes could come before them (checked when
the model is read); else only the leftmost one does. Only the neighbours of merges are looked up again. Long
pre-tokens are first cut between characters that stand side by side in no piece. So a text without spaces
takes as many rounds as it has different pairs to merge, not as many as it has merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import by_batch, documents
from gridloom.llm._pieces import Pieces, segments, spelled

#: Bounds of a worker's memory: cached segments, symbols merged at a time.
SEGMENTS, SYMBOLS = 300_000, 1_000_000


class RaggedMerger:
    def __init__(self, model_file: str):
        m = Pieces.of(model_file)
        symbols = dict.fromkeys([*m.id, *(c for p in m.id for c in p)])
        self.symbol = {p: k for k, p in enumerate(symbols)}
        #: Beyond them: one symbol for any other character; it merges with nothing.
        self.other = len(symbols)
        #: Tokens that a symbol counts: one for a piece, its bytes for any other character.
        self.weight = np.array([1 if p in m.id else len(p.encode()) for p in symbols] + [0], np.int64)
        order = {p: r for r, p in enumerate(sorted(m.id, key=lambda p: -m.score[p]))}
        #: Equal scores share a rank, so that the leftmost of them merges first.
        rank_of = {s: r for r, s in enumerate(sorted({*m.score.values()}, reverse=True))}
        keys, ranks, made = [], [], []
        for p in order:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * (self.other + 1) + b)
                    ranks.append(rank_of[m.score[p]])
                    made.append(self.symbol[p])
        place = np.argsort(np.array(keys))
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[place] for x in (keys, ranks, made))
        #: Ranks of which a merge can make a pair that ranks no worse: their merges go one by one.
        own = np.full(self.other + 1, -1, np.int64)
        own[self.made] = self.ranks
        self.single = np.zeros(len(rank_of) + 1, bool)
        for part in (own[self.keys // (self.other + 1)], own[self.keys % (self.other + 1)]):
            self.single[part[part >= self.ranks]] = True
        self.inner = {p[k : k + 2] for p in m.id for k in range(len(p) - 1)}
        self.cache: dict[str, int] = {}

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each spelled word; all of them are merged together, a pair a round."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbol, other = self.symbol, self.other
        flat = np.array([symbol.get(c, other) for w in words for c in w], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        total = np.zeros(len(words), np.int64)
        strange = [(k, len(c.encode())) for k, w in enumerate(words) if not all(c in symbol for c in w) for c in w if c not in symbol]
        for k, n in strange:
            total[k] += n
        never = np.int64(len(self.single) - 1)
        base = np.int64(self.other + 1)

        def looked_up(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Table rows and ranks of the pairs that begin at these places."""
            key = flat[left] * base + flat[left + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return at, np.where((self.keys[at] == key) & (word[left] == word[left + 1]), self.ranks[at], never)

        def ends() -> np.ndarray:
            return np.flatnonzero(np.r_[True, word[1:] != word[:-1]])

        if len(flat) > 1:
            at, rank = (np.r_[x, none] for x, none in zip(looked_up(np.arange(len(flat) - 1)), (0, never)))
        while len(flat) > 1:
            first = ends()
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(flat)])
            hit = np.flatnonzero((rank == np.repeat(best, size)) & (rank < never))
            # of hits side by side every other one merges; where merges go one by one only a word's first
            start = np.r_[True, np.diff(hit) != 1] if len(hit) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            new = np.r_[True, word[hit][1:] != word[hit][:-1]] if len(hit) else start
            hit = hit[np.where(self.single[rank[hit]], new, (np.arange(len(hit)) - run) % 2 == 0)]
            flat[hit] = self.made[at[hit]]
            # words without a pair are done: their symbols are counted and leave the arrays
            keep = np.repeat(best < never, size)
            np.add.at(total, word[~keep], self.weight[flat[~keep]])
            changed = np.zeros(len(flat), bool)
            changed[hit] = True
            keep[hit + 1] = False
            flat, word, at, rank, changed = (x[keep] for x in (flat, word, at, rank, changed))
            if len(flat) < 2:
                break
            touched = np.flatnonzero(changed)
            touched = np.union1d(touched, touched[touched > 0] - 1)
            rank[-1] = never
            touched = touched[touched < len(flat) - 1]
            at[touched], rank[touched] = looked_up(touched)
        np.add.at(total, word, self.weight[flat])
        return total

    def cut(self, spelled_segment: str) -> list[str]:
        """A long segment's parts between which nothing merges."""
        parts, start = [], 0
        for k in range(1, len(spelled_segment)):
            if spelled_segment[k - 1 : k + 1] not in self.inner:
                parts.append(spelled_segment[start:k])
                start = k
        return [*parts, spelled_segment[start:]]

    def count(self, texts: list[str]) -> list[int]:
        cut = [segments(t) for t in texts]
        cache = self.cache
        new = list({s for parts in cut for s in parts}.difference(cache))
        long = {}
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size < SYMBOLS):
                size += len(new[end]) + 1
                end += 1
            parts = [[spelled(s)] if len(s) <= 64 else self.cut(spelled(s)) for s in new[at:end]]
            found = self.counts([x for own in parts for x in own])
            sums = np.add.reduceat(found, np.cumsum([0, *map(len, parts[:-1])]))
            for s, n in zip(new[at:end], sums.tolist()):
                (cache if len(s) <= 256 else long)[s] = n
            at = end
        known = cache if not long else {**cache, **long}
        out = [sum([known[s] for s in parts]) for parts in cut]
        if len(cache) > SEGMENTS:
            cache.clear()
        return out


_mergers: dict[str, RaggedMerger] = {}


def token_counts(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", at_once: int = 512) -> DataFrame:
    """For each row its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Each row is worked on by itself, so ties, repeated
    rows, null ids and other columns of any name don't matter; an empty table gives none. Needs no shuffle.
    """

    def run(source: Iterator[dict]) -> Iterator[dict]:
        own = _mergers.get(model_file) or _mergers.setdefault(model_file, RaggedMerger(model_file))
        for batch in source:
            texts = [t or "" for t in batch["text"]]
            counts = [n for k in range(0, len(texts), at_once) for n in own.count(texts[k : k + at_once])]
            yield {"id": batch["id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return by_batch(source, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k BPE model."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op7_token_counts": op7_token_counts}
