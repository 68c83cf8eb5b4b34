"""Cross-entropy difference: a target model and a background model with one vocabulary, and for each
document the mean over its tokens of the target's loss less the background's (low: like the target).

Tokens are lower-cased words; the vocabulary is every word of the corpus. The target is a set of documents,
the background are all others. Both models are bigrams smoothed by their unigrams, and they are matched:
counts of the larger one are scaled to the size of the smaller, so both trust what they have seen alike. A
document is scored by what the other documents say: its own counts are taken out of the model it belongs to,
so that a document that occurs twice is known from its copy and one that doesn't isn't known from itself.

Counts are exact and cover all documents. Documents are read in chunks; a chunk sends its distinct words and
pairs (64-bit hashes, sorted, packed) to buckets of the hash space; a bucket adds them up and sends each
chunk the totals of what it asked for, in the same order. Nothing but the sizes of the models reaches the
driver, hot words are one entry a chunk, and a bucket's memory is bounded by their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import Scratch, by_batch, documents

#: Weight of the unigram estimate in the bigram's, and of the uniform one in the unigram's, in tokens.
KAPPA, ALPHA = 20.0, 0.5
#: Tokens of a chunk (a longer document is a chunk of its own), and entries of a bucket.
CHUNK, BUCKET = 500_000, 4_000_000
#: Ids of the target are broadcast up to so many (8 bytes each).
BROADCAST_IDS = 1_000_000
_START = np.uint64(0x5851F42D4C957F2D)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words; only A-Z are lower-cased, only 0x20 and 0x09-0x0D separate."""
    import xxhash

    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pairs(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, _START at the start of a document, and a hash of each pair."""
    before = np.r_[_START, flat[:-1]][: len(flat)]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = _START
    both = before * _P + (flat ^ (flat >> np.uint64(29))) * _Q
    both = (both ^ (both >> np.uint64(32))) * _P
    return before, both ^ (both >> np.uint64(29))


def _pack(values: np.ndarray, width: str = "<u8") -> bytes:
    """Numbers as byte planes, compressed; sorted keys are sent as differences."""
    raw = values.astype(width)
    return zlib.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), 1)


def _unpack(raw: bytes, width: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8)
    size = np.dtype(width).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(width).copy()


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted keys begins and ends: buckets are equal ranges of the hash space."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(keys, edges), len(keys)]


_ASKED = "chunk bigint, grams int, bucket int, keys binary, b binary, t binary"
_OWN = "chunk bigint, words binary, codes binary, sizes binary, target binary, tokens_b bigint, tokens_t bigint"


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _chunks(buckets: int, asking: bool):
    """A chunk's row with its documents and tokens; or, asking, a row for each bucket with the counts of its words
    or of its pairs. Both come from the same chunks, as the documents are read in the same order."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names = _names(_ASKED) if asking else ["ids", *_names(_OWN)]
        ids, marks, found, waiting = [], [], [], 0

        def chunk():
            nonlocal number
            sizes, marked = np.array([len(x) for x in found], np.int64), np.array(marks, np.uint8)
            flat = np.concatenate(found)
            of = np.repeat(marked, sizes).astype(bool)
            words, codes = np.unique(flat, return_inverse=True)
            if asking:
                rows = []
                for grams, keys, at in ((1, words, codes), (2, *np.unique(_pairs(flat, sizes)[1], return_inverse=True))):
                    t = np.bincount(at, weights=of, minlength=len(keys))
                    b = np.bincount(at, minlength=len(keys)) - t
                    cuts = _cuts(keys, buckets)
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        own = slice(cuts[k], cuts[k + 1])
                        rows.append({"chunk": number, "grams": grams, "bucket": k, "keys": _pack(np.diff(keys[own], prepend=np.uint64(0))), "b": _pack(b[own], "<u4"), "t": _pack(t[own], "<u4")})
            else:
                rows = [{"chunk": number, "ids": list(ids), "words": _pack(np.diff(words, prepend=np.uint64(0))), "codes": _pack(codes, "<u4"), "sizes": _pack(sizes, "<u4"), "target": marked.tobytes(), "tokens_b": int((~of).sum()), "tokens_t": int(of.sum())}]
            number += 1
            ids.clear(), marks.clear(), found.clear()
            return {name: [row.get(name) for row in rows] for name in names}

        for batch in source:
            for key, text, mark in zip(batch["id"], batch["text"], batch["target"]):
                own = tokens(text)
                if found and waiting + len(own) > CHUNK or len(found) >= 1 << 16:
                    yield chunk()
                    waiting = 0
                ids.append(key), marks.append(mark), found.append(own)
                waiting += len(own)
        if found:
            yield chunk()

    return run


def _added(source: Iterator[dict]) -> Iterator[dict]:
    """The rows of a task's buckets with counts over all chunks in place of the chunk's own, and a row with the
    number of distinct words."""
    rows, parts = [], []
    for batch in source:
        for chunk, grams, bucket, keys, b, t in zip(*(batch[c] for c in ("chunk", "grams", "bucket", "keys", "b", "t"))):
            rows.append((chunk, grams, bucket))
            parts.append((np.cumsum(_unpack(keys), dtype=np.uint64), _unpack(b, "<u4"), _unpack(t, "<u4")))
    new = 0
    for kind in (1, 2):
        mine = [k for k, row in enumerate(rows) if row[1] == kind]
        if not mine:
            continue
        keys, at = np.unique(np.concatenate([parts[k][0] for k in mine]), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([parts[k][c] for k in mine])) for c in (1, 2)]
        new += len(keys) if kind == 1 else 0
        start = 0
        for k in mine:
            end = start + len(parts[k][0])
            b, t = (_pack(s[at[start:end]]) for s in sums)
            yield {"chunk": [rows[k][0]], "grams": [kind], "bucket": [rows[k][2]], "b": [b], "t": [t], "vocabulary": [None]}
            start = end
    yield {"chunk": [None], "grams": [None], "bucket": [None], "b": [None], "t": [None], "vocabulary": [new]}


def _losses(row: dict, totals: list[dict], buckets: int, sizes: dict, vocabulary: int) -> dict:
    """Of each document of a chunk its tokens and its mean losses under the target and the background."""
    words = np.cumsum(_unpack(row["words"]), dtype=np.uint64)
    codes, lengths = _unpack(row["codes"], "<u4").astype(np.int64), _unpack(row["sizes"], "<u4").astype(np.int64)
    marked = np.frombuffer(row["target"], np.uint8).astype(bool)
    flat = words[codes]
    before, every = _pairs(flat, lengths)
    pairs, which = np.unique(every, return_inverse=True)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    of = marked[doc]

    def own(at: np.ndarray, n: int) -> np.ndarray:
        """How often its document has what stands at each place."""
        _, place, times = np.unique(doc * n + at, return_inverse=True, return_counts=True)
        return times[place]

    mine = {1: own(codes, len(words)), 2: own(which, len(pairs))}
    counts = {}
    for grams, keys in ((1, words), (2, pairs)):
        cuts = _cuts(keys, buckets)
        for m in "bt":
            counts[grams, m] = np.zeros(len(keys))
        for part in totals:
            if part["grams"] == grams:
                for m in "bt":
                    counts[grams, m][cuts[part["bucket"]] : cuts[part["bucket"] + 1]] = _unpack(part[m])
    first = before == _START
    lead = np.r_[0, codes[:-1]][: len(codes)]  # the code of the word before
    out = {"id": row["ids"], "n_tokens": lengths.tolist()}
    least = min(sizes["tokens"].values())
    for m, name in (("t", "target"), ("b", "background")):
        inside = of if m == "t" else ~of
        n = sizes["tokens"][m] - inside * lengths[doc]
        scale = least / sizes["tokens"][m] if sizes["tokens"][m] else 0.0
        one = ((counts[1, m][codes] - inside * mine[1]) * scale + ALPHA) / (n * scale + ALPHA * (vocabulary + 1))
        two = counts[2, m][which] - inside * mine[2]
        # the document's count of the word before, by the place of that word
        context = np.where(first, sizes["texts"][m] - inside, counts[1, m][lead] - inside * np.r_[0, mine[1][:-1]][: len(codes)])
        loss = -np.log((two * scale + KAPPA * one) / (context * scale + KAPPA)) if len(flat) else np.zeros(0)
        out[f"{name}_loss"] = (np.bincount(doc, loss, len(lengths)) / np.maximum(lengths, 1)).tolist()
    return out


def _scored(buckets: int, sizes: dict, vocabulary: int):
    """Rows come sorted by chunk, a chunk's own row and the totals it asked for."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        now, row, totals = None, None, []
        for batch in source:
            for values in zip(*batch.values()):
                new = dict(zip(batch, values))
                if new["chunk"] != now and row is not None:
                    yield _losses(row, totals, buckets, sizes, vocabulary)
                if new["chunk"] != now:
                    now, row, totals = new["chunk"], None, []
                if new["bucket"] is None:
                    row = new
                else:
                    totals.append(new)
        if row is not None:
            yield _losses(row, totals, buckets, sizes, vocabulary)

    return run


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its id, n_tokens, target_loss and background_loss (nats per token) and score, their
    difference. The rows whose id is in target (a column id_col) are the target, the others the background.

    Null and empty texts have no tokens and zeros. Ids of target that repeat or are null or unknown change
    nothing. Rows of docs that repeat are documents of their own, each known to the others; a null id is of
    the background. Without a target, or without a background, both models are uniform and all scores 0. Other
    columns of any name don't matter, texts may be of any length, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch() as stage:
        wanted = stage(target.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("target", F.lit(1)))
        small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        kind = source.schema["id"].dataType.simpleString()
        size = source.agg(F.sum(F.length("text"))).first()[0] or 0
        source = source.join(F.broadcast(wanted) if small else wanted, "id", "left").select("id", "text", F.coalesce("target", F.lit(0)).alias("target"))
        source = source if small else stage(source)  # rows from a shuffle needn't come in the same order again
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(parts, size // 3 // BUCKET)
        # chunks are made twice, so that only their tokens are kept, and what they ask is only shuffled
        rows = stage(by_batch(source, _chunks(buckets, False), f"ids array<{kind}>, {_OWN}"))
        n = rows.agg(F.sum("tokens_b"), F.sum("tokens_t")).first()
        texts = source.agg(F.sum("target"), F.count("*")).first()
        sizes = {"tokens": {"b": n[0] or 0, "t": n[1] or 0}, "texts": {"b": (texts[1] or 0) - (texts[0] or 0), "t": texts[0] or 0}}
        asked = by_batch(source, _chunks(buckets, True), _ASKED)
        totals = stage(by_batch(asked.repartition(buckets, "bucket"), _added, "chunk bigint, grams int, bucket int, b binary, t binary, vocabulary bigint"))
        stage.drop(wanted)
        del asked
        stage.release(spark)
        vocabulary = totals.agg(F.sum("vocabulary")).first()[0] or 0
        answers = totals.where("chunk IS NOT NULL").select("chunk", "grams", "bucket", "b", "t")
        own = rows.select("ids", "chunk", "words", "codes", "sizes", "target")
        both = own.unionByName(answers, allowMissingColumns=True).repartition(max(parts, buckets), "chunk").sortWithinPartitions("chunk")
        out = stage.keep(by_batch(both, _scored(buckets, sizes, vocabulary), f"id {kind}, n_tokens bigint, target_loss double, background_loss double"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference; the target is what labels.quality marks with 1."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return score(documents(spark, sf_dir), good)


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
