"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into chunks. A chunk keeps, for each term, one bitmap of its documents for every bit of the
term's impact in them. A query's scores come from bitwise full adders over these bitmaps: impacts are multiplied by
the terms' weights by shifting and adding, products are added up by carry-save steps, 64 documents to a word. The
best documents of a chunk are found by descending from the sum's most significant bitmap; the chunks' best are ranked
together. Integers throughout, so the result is exact.

Texts are read once and never shuffled: only each chunk's k best of each query are.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import Scratch, by_batch, documents, small_batches

#: A chunk ends with so many documents, or so many postings: the bound of what a task holds.
CHUNK_DOCS, CHUNK_POSTINGS = 1 << 14, 1 << 17
#: Queries are sent to the tasks in blocks of at most about so many, and of so many characters.
BLOCK_ITEMS, BLOCK_CHARS = 1024, 1 << 22
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_ONE = np.uint64(1)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order: runs of ASCII letters and digits and of all characters beyond ASCII, only
    A-Z lower-cased."""
    return _TERM.findall((text or b"").lower())


def postings(docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk of documents: their ids and numbers of terms, and for each term, in the order of terms, its
    documents' places in the chunk and its occurrences there. With terms only these are kept (all are counted)."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(source: Iterator[dict]) -> Iterator[dict]:
        wanted = sent.value
        ids, sizes, found, n = [], [], {}, 0

        def chunk():
            names = sorted(found)
            flat = [np.array(found[t], np.int64) for t in names]
            at = np.concatenate([x[:, 0] for x in flat]) if flat else np.zeros(0, np.int64)
            tf = np.concatenate([x[:, 1] for x in flat]) if flat else np.zeros(0, np.int64)
            row = {"ids": ids, "sizes": np.array(sizes, "<u4").tobytes(), "terms": names, "df": [len(x) for x in flat], "at": at.astype("<u2").tobytes(), "tf": tf.astype("<u4").tobytes()}
            return {k: [v] for k, v in (row | {"docs": sum(x > 0 for x in sizes), "total": sum(sizes)}).items()}

        for batch in source:
            for i, text in zip(batch["id"], batch["text"]):
                words = terms_of(text)
                for term, tf in Counter(words if wanted is None else filter(wanted.__contains__, words)).items():
                    found.setdefault(term, []).append((len(ids), tf))
                    n += 1
                ids.append(i)
                sizes.append(len(words))
                if len(ids) == CHUNK_DOCS or n >= CHUNK_POSTINGS:
                    yield chunk()
                    ids, sizes, found, n = [], [], {}, 0
        if ids:
            yield chunk()

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    return by_batch(source, run, f"ids array<{kind}>, sizes binary, terms array<binary>, df array<bigint>, at binary, tf binary, docs bigint, total bigint")


def sliced(values: np.ndarray, at: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of the bits of values, by term: how many words of 64 documents each term has, which, and a matrix with
    one row for each bit. Words without a document of the term are left out."""
    term = np.repeat(np.arange(len(df)), df)
    key = term * (CHUNK_DOCS // 64) + (at >> 6)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    held, bits = _ONE << (at & 63).astype(np.uint64), int(values.max(initial=0)).bit_length()
    out = np.zeros((bits, len(first)), np.uint64)
    for b in range(bits if len(first) else 0):
        out[b] = np.bitwise_or.reduceat(np.where(values >> b & 1, held, np.uint64(0)), first)
    return np.bincount(term[first], minlength=len(df)), (at >> 6)[first], out


def index(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The bit-sliced index of postings: a term's impact in a document of n terms is
    10^9 tf div (1000 tf + 20 m), m = 50 + (50 n n_docs) div n_terms."""
    kind = rows.schema["ids"].dataType.simpleString()

    def run(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            for ids, sizes, terms, df, at, tf in zip(*(batch[k] for k in ("ids", "sizes", "terms", "df", "at", "tf"))):
                at, tf = np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(tf, "<u4").astype(np.int64)
                m = 50 + 50 * np.frombuffer(sizes, "<u4").astype(np.int64)[at] * n_docs // max(1, n_terms)
                words, places, bits = sliced(1_000_000_000 * tf // (1000 * tf + 20 * m), at, np.array(df, np.int64))
                row = {"ids": ids, "terms": terms, "words": words.astype("<u4").tobytes(), "places": places.astype("<u2").tobytes(), "n_bits": len(bits), "slices": zlib.compress(bits.astype("<u8").tobytes(), 1)}
                yield {k: [v] for k, v in row.items()}

    return by_batch(rows, run, f"ids {kind}, terms array<binary>, words binary, places binary, n_bits int, slices binary")


def weights(rows: DataFrame, n_docs: int) -> DataFrame:
    """Of each term of postings the number of documents and its weight, floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    out = rows.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    return out.withColumn("w", F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))))


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two bit-sliced numbers (bits, words), least significant first, by ripple carry."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out, carry = np.empty((len(a) + 1, a.shape[1]), np.uint64), np.zeros(a.shape[1], np.uint64)
    for k in range(len(a)):
        half = a[k] ^ b[k] if k < len(b) else a[k]
        out[k] = half ^ carry
        carry = (a[k] & b[k] if k < len(b) else np.uint64(0)) | half & carry
    out[-1] = carry
    return out if carry.any() else out[:-1]


def times(bits: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bit-sliced numbers times whole numbers w, one for each word: shifted copies are added where w has the bit."""
    out = np.zeros((1, bits.shape[1]), np.uint64)
    for j in range(int(w.max(initial=0)).bit_length()):
        has = np.where(w >> j & 1, ~np.uint64(0), np.uint64(0))
        low = out[:j]
        while len(low) < j:
            low = np.vstack([low, np.zeros_like(out[:1])])
        out = np.vstack([low, added(out[j:] if len(out) > j else np.zeros_like(out[:1]), bits & has)])
    return out


def total(numbers: np.ndarray) -> np.ndarray:
    """The sum of bit-sliced numbers (numbers, bits, words): three become two by carry-save steps until two are left."""
    room = len(numbers).bit_length()
    now = np.concatenate([numbers, np.zeros((len(numbers), room, numbers.shape[2]), np.uint64)], 1)
    while len(now) > 2:
        n = len(now) // 3
        a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
        half = a ^ b
        carry = a & b | half & c
        carry[:, 1:], carry[:, 0] = carry[:, :-1].copy(), 0
        now = np.concatenate([half ^ c, carry, now[3 * n :]])
    return now[0] if len(now) == 1 else added(now[0], now[1])


def _members(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little"))


def best(sums: np.ndarray, ids: list, k: int) -> list[tuple]:
    """(id, sum) of the k largest sums above zero, of equal ones the smallest ids: from the most significant bitmap
    down, those sure to be in (held) and those still equal (open)."""
    count = lambda x: int(np.bitwise_count(x).sum())
    open_ = np.bitwise_or.reduce(sums, axis=0) if len(sums) else np.zeros(sums.shape[1], np.uint64)
    held, n = np.zeros_like(open_), 0
    if count(open_) <= k:
        held, open_ = open_, np.zeros_like(open_)
    else:
        for row in sums[::-1]:
            ones = open_ & row
            m = count(ones)
            if n + m >= k:
                open_ = ones
            else:
                held, n, open_ = held | ones, n + m, open_ & ~row
    places = _members(held)
    rest = sorted(_members(open_).tolist(), key=lambda p: (ids[p] is None, ids[p] or 0))[: max(0, k - len(places))]
    out = []
    for p in [*places.tolist(), *rest]:
        column = sums[:, p >> 6] >> np.uint64(p & 63) & _ONE
        out.append((ids[p], sum(int(x) << b for b, x in enumerate(column))))
    return out


def search(indexed: DataFrame, items: list[tuple[int, dict[bytes, int]]], k: int) -> DataFrame:
    """For each item (a number and its terms' weights) and chunk of the index the k best: item, id, score."""
    kind = indexed.schema["ids"].dataType.elementType.simpleString()
    sent = indexed.sparkSession.sparkContext.broadcast(items)

    def chunk(ids, terms, words, places, n_bits, slices) -> Iterator[tuple]:
        items = sent.value
        weight = {t: w for _, terms_ in items for t, w in terms_.items()}
        words, places = np.frombuffer(words, "<u4").astype(np.int64), np.frombuffer(places, "<u2").astype(np.int64)
        w = np.array([weight.get(t, 0) for t in terms], np.int64)
        kept = np.repeat(w > 0, words)
        bits = np.frombuffer(zlib.decompress(slices), "<u8").reshape(n_bits, len(places))[:, kept]
        names, words, places = [t for t, x in zip(terms, w) if x > 0], words[w > 0], places[kept]
        bits = times(bits, np.repeat(w[w > 0], words))
        ends = np.cumsum(words)
        at = {t: slice(b - a, b) for t, a, b in zip(names, words.tolist(), ends.tolist())}
        for item, wanted in items:
            found = [at[t] for t in wanted if t in at]
            # many terms at a time, so that a long query needs no more memory
            sums = np.zeros((1, -(-len(ids) // 64)), np.uint64)
            for some in (found[j : j + 128] for j in range(0, len(found), 128)):
                dense = np.zeros((len(some), len(bits), sums.shape[1]), np.uint64)
                for row, where in zip(dense, some):
                    row[:, places[where]] = bits[:, where]
                sums = added(sums, total(dense))
            if found:
                yield from ((item, *pair) for pair in best(sums, ids, k))

    def run(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            for row in zip(*(batch[c] for c in ("ids", "terms", "words", "places", "n_bits", "slices"))):
                out = list(chunk(*row))
                yield {"item": [x[0] for x in out], "id": [x[1] for x in out], "score": [x[2] for x in out]}

    return by_batch(indexed, run, f"item int, id {kind}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of items the k rows of docs with the highest scores above 0, equal scores by ascending id (null
    ids last): item_id, rank, doc_id, score.

    Null and empty texts have no terms: such documents count neither in N nor anywhere, such items find nothing.
    Every row is a document of its own, so copies and repeated ids are ranked side by side. Repeated items each get
    their list. Empty tables give no rows; other columns don't matter. Items go to the tasks in blocks of a bounded
    size; every block is held against the whole index.
    """
    spark = docs.sparkSession
    asked = items.select(items[item_col].alias("item_id"), items[item_text].cast("binary").alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-(size["chars"] or 0) // BLOCK_CHARS), 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    with Scratch() as stage, contextlib.ExitStack() as small:
        one = asked.collect() if blocks == 1 else None  # at most a block
        wanted = None if one is None else {t for row in one for t in terms_of(row["text"] and bytes(row["text"]))}
        rows = stage(postings(docs, wanted, id_col, text_col))
        got = rows.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
        n_docs, n_terms = got["docs"] or 0, got["total"] or 0
        small.enter_context(small_batches(spark, 1))  # a row is a chunk
        indexed = stage(index(rows, n_docs, n_terms))
        weighed = stage(weights(rows, n_docs))
        stage.drop(rows)
        for b in range(blocks):
            held = one if one is not None else asked.where(F.col("block") == b).collect()
            terms = [sorted(set(terms_of(row["text"] and bytes(row["text"])))) for row in held]
            names = spark.createDataFrame([(bytearray(t),) for t in sorted({t for x in terms for t in x})], "term binary")
            w = {bytes(r["term"]): r["w"] for r in weighed.join(F.broadcast(names), "term", "left_semi").collect()}  # terms of a block
            found = search(indexed, [(j, {t: w[t] for t in x if w.get(t)}) for j, x in enumerate(terms)], k)
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
            top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            key = spark.createDataFrame([(j, row["item_id"]) for j, row in enumerate(held)], f"item int, item_id {items.schema[item_col].dataType.simpleString()}")
            parts.append(stage.keep(top.join(F.broadcast(key), "item").select("item_id", "rank", F.col("id").alias(id_col), "score")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("item_id", item_col)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM t WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM t),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE text IS NOT NULL)),
c AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 50
"""
QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": ORACLE_SQL}
