"""Packing by minimum bin slack: windows are filled one after the other, each with the multiset of
remaining lengths that comes closest to its capacity, found by a subset-sum over bitsets.

A document longer than a window gives whole windows and a rest. Rests wait in a pool of bounded size;
when it is full, and at the end of a partition, it is packed: for the longest rest, a dynamic program
over the distinct lengths (a Python integer is the set of reachable sums) picks its company, counts are
backtracked, and the pattern is used as often as the stock allows. A window that no whole rest can fill
is filled by cutting one; what is left at the end of a pool is cut into powers of two, which need no
padding. A partition packs its own rows, so there is no shuffle and nothing global to hold: a retried
task packs the same rows the same way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import by_batch, documents

#: Bounds of a worker's memory: ids in a pool of rests, cached words.
POOL_IDS, WORDS = 8_000_000, 700_000


#: Lower-case Latin letters in composed form, with a full stop or commas after them: the pre-tokens are plain.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,]*)")


class WordTokenizer:
    """ids of a tokenizers file for lower-cased words: merges never cross ASCII white space, so each word
    is encoded once, many words at a time. Plain words need neither normalizer nor pattern; they go to the
    same model joined by spaces, and the word-end mark of its tokens tells them apart again.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        rest, plain, parts, counts = [], [], [], []
        for w in new:
            found = _PLAIN.fullmatch(w.decode())
            if found:
                plain.append(w)
                parts += [x for x in found.groups() if x]
                counts.append(1 + bool(found[2]))
            else:
                rest.append(w)
        cache = self.cache
        for w, got in zip(rest, self.library.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            cache[w] = np.array(got.ids, "<u4").tobytes()
        if plain:
            ids = np.array(self.plain.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids])[np.cumsum(counts) - 1] + 1
            raw = ids.tobytes()
            at = 0
            for w, end in zip(plain, (stop * 4).tolist()):
                cache[w] = raw[at:end]
                at = end

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # the normalizer lower-cases too; only the special tokens' own strings must stay as they are
        cut = [(t.encode() if "<|" in t else t.encode().lower()).split() for t in texts]
        cache = self.cache
        if len(cache) > WORDS:
            cache.clear()
        new = list({w for words in cut for w in words}.difference(cache))
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join([cache[w] for w in words]), "<u4") for words in cut]


_tokenizers: dict[str, WordTokenizer] = {}


def fullest(stock: Counter, capacity: int) -> Counter:
    """The multiset of lengths in stock whose sum is the largest up to capacity."""
    goal, reach, steps = 1 << capacity, 1, []
    mask = (goal << 1) - 1
    for length in sorted((n for n in stock if n <= capacity), reverse=True):
        left, take = min(stock[length], capacity // length), 1
        while left and not reach & goal:  # counts by doubling: 1, 2, 4, ... and the rest
            k = min(take, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            take *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    out: Counter = Counter()
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] += k
            total -= length * k
    return out


def plan(lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows over items 0..n-1 of the given lengths (each 1 to window): lists of (item, start, length).

    Every unit of every item lies in exactly one window. All windows are full, but the last ones, whose
    sizes are falling powers of two.
    """
    items: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, n in enumerate(lengths):
        items[n].append((item, 0))
    stock = Counter({n: len(x) for n, x in items.items()})
    total = sum(lengths)

    def take(n: int) -> tuple[int, int, int]:
        stock[n] -= 1
        if not stock[n]:
            del stock[n]
        return (*items[n].pop(), n)

    def put(item: int, start: int, n: int) -> None:
        items[n].append((item, start))
        stock[n] += 1

    while total >= window:
        longest = max(stock)
        stock[longest] -= 1
        company = fullest(+stock, window - longest)
        stock[longest] += 1
        company[longest] += 1
        slack = window - sum(n * k for n, k in company.items())
        for _ in range(min(stock[n] // k for n, k in company.items()) if not slack else 1):
            row = [take(n) for n, k in sorted(company.items(), reverse=True) for _ in range(k)]
            if slack:  # all that is left is longer than the slack: one is cut
                item, start, n = take(min(x for x in stock if x > slack))
                row.append((item, start, slack))
                put(item, start + slack, n - slack)
            total -= window
            yield row
    while total:
        size = 1 << (total.bit_length() - 1)
        row, room = [], size
        while room:
            whole = [n for n in stock if n <= room]
            item, start, n = take(max(whole) if whole else min(stock))
            row.append((item, start, min(n, room)))
            if n > room:
                put(item, start + room, n - room)
            room -= row[-1][2]
        total -= size
        yield row


def pack(df: DataFrame, tokenizer_file: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also ids.

    A null or empty text is its end id alone. Repeated rows are packed each by itself; null ids stay null;
    other columns are ignored; an empty table gives no rows. sequence_id is unique in the result: the
    partition times 2 ** 33 plus a count. window must be a power of two.
    """

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(source: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        encode = _tokenizers.get(tokenizer_file) or _tokenizers.setdefault(tokenizer_file, WordTokenizer(tokenizer_file))
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        pool: list[tuple] = []  # (id, start in the document, ids, tokens of the document)
        waiting, rows = 0, []

        def piece(key, start, ids, tokens, at):
            row = (key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, at)
            rows.append((*row, ids.tolist()) if with_ids else row)

        def settle():
            nonlocal sequence, waiting
            for windowful in plan([len(x[2]) for x in pool], window):
                at = 0
                for item, start, n in windowful:
                    key, first, ids, tokens = pool[item]
                    piece(key, first + start, ids[start : start + n], tokens, at)
                    at += n
                sequence += 1
            pool.clear()
            waiting = 0

        def made():
            out = dict(zip(names, map(list, zip(*rows))))
            rows.clear()
            return out

        for batch in source:
            texts = [t or "" for t in batch["text"]]
            for low in range(0, len(texts), 256):
                for key, ids in zip(batch["id"][low : low + 256], encode(texts[low : low + 256])):
                    ids = np.concatenate([ids, end])
                    whole = len(ids) // window * window
                    for start in range(0, whole, window):
                        piece(key, start, ids[start : start + window], len(ids), 0)
                        sequence += 1
                    if whole < len(ids):
                        pool.append((key, whole, ids[whole:], len(ids)))
                        waiting += len(ids) - whole
                    if waiting >= POOL_IDS:
                        settle()
            if rows:
                yield made()
        settle()
        if rows:
            yield made()

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return by_batch(source, run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids).withColumnRenamed("id", id_col)


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return stage(spark, documents(spark, sf_dir), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that are left."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_pack_windows": op8_pack_windows}
