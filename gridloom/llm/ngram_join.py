"""N-gram Jaccard join with several global token orders.

A document is its set of five-word shingles; two are linked when 100 * |A and B| >= 75 * |A or B|.

1. One pass over the texts gives each document its set's hash (documents with equal sets are one class from
   here on) and adds its shingles to a count sketch of fixed size, summed over all tasks. The sketch only
   orders shingles, rare ones first; any order gives the same result, a good one gives few candidates.
2. A second pass emits each class's prefix under the first order: of n shingles the first n // 4 + 1, for
   linked sets share one there. Prefixes travel in packed blocks by shingle hash; a task sorts its share
   and finds the classes that meet on a shingle at places from which they can still reach the threshold.
3. Classes that meet are paired with the smallest one of their shingle. Pairs that do not share a prefix
   shingle under each of two more orders too are gone before texts are fetched, and what is left is verified on
   whole sets. Then classes that met but are not yet connected are paired with each other and tried likewise. So
   connected components are exact, yet a group of any size needs about as many pairs as it has members.
4. Components come from alternating stars over the verified links (gridloom.llm._common.components).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import Scratch, by_batch, collected_blocks, components, documents, packed, small_batches, summed_blocks

#: Counters in each of the sketch's two rows, and in a block of them; sums are the same for any number of tasks.
ROW, BLOCK = 1 << 21, 1 << 16
#: Prefix entries for a task that sorts them.
SHARE = 500_000
#: Classes whose texts are read again are broadcast up to so many (16 bytes each).
BROADCAST_ROWS = 400_000
#: Rounds in which classes that meet are tried with one hub of their shingle, before they are tried with each other.
HUB_ROUNDS = 2
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_STEP = np.uint64(0x100000001B3 * 2 + 1)


def _mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_MIX[k])
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer words than width give one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D separate
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _STEP + _mixed(h[k : len(h) - size + 1 + k])
    return np.unique(_mixed(out))


def set_hash(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes(), len(found)) - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class Orders:
    """The global orders of shingles: by estimated count and a hash, by estimated count and another hash,
    and by a third hash alone."""

    def __init__(self, sketch: np.ndarray):
        self.low, self.high = sketch.reshape(2, ROW)

    def keys(self, found: np.ndarray, order: int) -> np.ndarray:
        mixed = _mixed(found, order)
        if order == 2:
            return mixed
        at = np.uint64(ROW - 1)
        count = np.minimum(self.low[found & at], self.high[(found >> np.uint64(32)) & at])
        return np.minimum(count, (1 << 20) - 1).astype(np.uint64) << np.uint64(44) | mixed >> np.uint64(20)

    def prefix(self, found: np.ndarray, order: int) -> np.ndarray:
        """The first len // 4 + 1 shingles of a sorted set; equal keys keep the order of the shingles."""
        return found[np.argsort(self.keys(found, order), kind="stable")[: len(found) // 4 + 1]]


def _profile(source: Iterator[dict]) -> Iterator[dict]:
    """Rows of documents (doc_id, hash, n, node) and, after them, blocks of this task's sketch."""
    sketch = np.zeros(2 * ROW, np.int64)
    pending, waiting = [], 0

    def add():
        flat = np.concatenate(pending)
        at = np.uint64(ROW - 1)
        sketch[:ROW] += np.bincount((flat & at).astype(np.int64), minlength=ROW)
        sketch[ROW:] += np.bincount(((flat >> np.uint64(32)) & at).astype(np.int64), minlength=ROW)
        pending.clear()

    for batch in source:
        ids, sizes, nodes = batch["doc_id"], [], []
        for text in batch["text"]:
            found = shingles(text)
            sizes.append(len(found))
            nodes.append(set_hash(found) if len(found) else None)
            pending.append(found)
            waiting += len(found)
            if waiting > ROW:
                add()
                waiting = 0
        yield {"doc_id": ids, "hash": batch["hash"], "n": sizes, "node": nodes, "block": [None] * len(ids), "counts": [None] * len(ids)}
    if pending:
        add()
    blocks = [k for k in range(2 * ROW // BLOCK) if sketch[k * BLOCK : (k + 1) * BLOCK].any()]
    none = [None] * len(blocks)
    yield {"doc_id": none, "hash": none, "n": none, "node": none, "block": blocks, "counts": [packed(sketch[k * BLOCK : (k + 1) * BLOCK]) for k in blocks]}


_BLOB = "bucket int, token binary, top binary, reach binary, doc binary, node binary, n binary"
#: A partner's size relative to one's own lies between 0.75 and 4 / 3; a byte holds how much of that a place allows.
_LEAST, _SPAN = 0.75, 4 / 3 - 0.75


def _prefixes(sketch, buckets: int):
    """Prefix entries in packed blocks, one for each bucket of shingle hashes and some thousand documents."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        orders = Orders(sketch.value)
        seen: set[int] = set()
        sets: list[tuple[int, int, np.ndarray]] = []
        waiting = 0

        def blobs():
            token = np.concatenate([p for _, _, p in sets])
            doc = np.repeat(np.arange(len(sets), dtype="<u2"), [len(p) for _, _, p in sets])
            n = np.array([n for _, n, _ in sets], "<u4")
            node = np.array([k for k, _, _ in sets], "<i8")
            place = np.concatenate([np.arange(len(p)) for _, _, p in sets])
            ratio = (4 * n[doc].astype(float) - 7 * place) / (3 * n[doc])
            reach = np.clip(np.ceil((ratio - _LEAST) / _SPAN * 255), 0, 255).astype(np.uint8)
            bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            token, doc, reach = token[by], doc[by], reach[by]
            at = np.searchsorted(bucket[by], np.arange(buckets + 1))
            out = {name: [] for name in ("bucket", "token", "top", "reach", "doc", "node", "n")}
            for k in np.flatnonzero(np.diff(at)).tolist():
                own, where = np.unique(doc[at[k] : at[k + 1]], return_inverse=True)
                t = token[at[k] : at[k + 1]]
                values = (k, (t & np.uint64(0xFFFFFFFF)).astype("<u4"), (t >> np.uint64(56)).astype(np.uint8), reach[at[k] : at[k + 1]], where.astype("<u2"), node[own], n[own])
                for name, value in zip(out, values):
                    out[name].append(value if name == "bucket" else value.tobytes())
            sets.clear()
            return out

        for batch in source:
            for text in batch["text"]:
                found = shingles(text)
                if not len(found):
                    continue
                node = set_hash(found)
                if node in seen:
                    continue
                seen.add(node)
                sets.append((node, len(found), orders.prefix(found, 0)))
                waiting += len(sets[-1][2])
                if len(sets) == 1 << 14 or waiting > 4_000_000:
                    yield blobs()
                    waiting = 0
            if len(seen) > 1_000_000:
                seen.clear()
        if sets:
            yield blobs()

    return run


def _meetings(source: Iterator[dict]) -> Iterator[dict]:
    """Of a bucket's entries: pairs of each class with the smallest on its shingle, and groups of three or more.

    A row is a group of classes that share a shingle, the smallest first; equal groups of a task are one
    row. reach is the largest size of a partner with which a class can still be linked from there.
    """
    parts: list[list[np.ndarray]] = [[] for _ in range(4)]
    for batch in source:
        for bucket, token, top, reach, doc, node, n in zip(*(batch[c] for c in ("bucket", "token", "top", "reach", "doc", "node", "n"))):
            where = np.frombuffer(doc, "<u2")
            size = np.frombuffer(n, "<u4")[where].astype(np.int64)
            key = np.frombuffer(token, "<u4").astype(np.uint64) | np.frombuffer(top, np.uint8).astype(np.uint64) << np.uint64(32) | np.uint64(bucket % (1 << 24)) << np.uint64(40)
            limit = np.floor(size * (_LEAST + np.frombuffer(reach, np.uint8) / 255 * _SPAN) + 1e-6).astype(np.int64)
            for part, value in zip(parts, (key, np.frombuffer(node, "<i8")[where], size, limit)):
                part.append(value)
    if not parts[0]:
        return
    key, node, size, limit = (np.concatenate(p) for p in parts)
    by = np.lexsort((node, size, key))
    key, node, size, limit = key[by], node[by], size[by], limit[by]
    again = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
    keep = np.r_[True, ~again]
    key, node, size, limit = key[keep], node[keep], size[keep], limit[keep]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(key)]
    groups: dict[bytes, list] = {}
    for s, e in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist()):
        if e - s == 2 and (size[s + 1] > limit[s] or size[s] > limit[s + 1]):
            continue
        name = node[s:e].tobytes()
        old = groups.get(name)
        groups[name] = [size[s:e], limit[s:e] if old is None else np.maximum(old[1], limit[s:e])]
    names = list(groups)
    for k in range(0, len(names), 2000):
        own = names[k : k + 2000]
        yield {"nodes": [np.frombuffer(x, "<i8").tolist() for x in own], "sizes": [groups[x][0].tolist() for x in own], "reach": [groups[x][1].tolist() for x in own]}


_GROUP = "nodes array<bigint>, sizes array<bigint>, reach array<bigint>"
_PAIR = "a bigint, b bigint"


def _with_smallest(source: Iterator[dict]) -> Iterator[dict]:
    """Each class of a group with the group's smallest, if sizes and places allow a link; a pair once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in source:
        new = []
        for nodes, sizes, reach in zip(batch["nodes"], batch["sizes"], batch["reach"]):
            hub, least, most = nodes[0], sizes[0], reach[0]
            for node, size, limit in zip(nodes[1:], sizes[1:], reach[1:]):
                pair = (min(hub, node), max(hub, node))
                if size <= most and least <= limit and pair not in seen:
                    seen.add(pair)
                    new.append(pair)
        if len(seen) > 1_000_000:
            seen.clear()
        yield {"a": [a for a, _ in new], "b": [b for _, b in new]}


def _prefixed(sketch):
    """A class's text, and the prefixes of its set under the other two orders as sorted 32-bit halves."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        orders = Orders(sketch.value)
        for batch in source:
            out = {"node": [], "text": [], "second": [], "third": []}
            for node, text in zip(batch["node"], batch["text"]):
                found = shingles(text)
                if set_hash(found) == node:
                    second, third = (np.unique(orders.prefix(found, k).astype("<u4")).tobytes() for k in (1, 2))
                    for name, value in zip(out, (node, text, second, third)):
                        out[name].append(value)
            yield out

    return run


def _sharing(source: Iterator[dict]) -> Iterator[dict]:
    """The pairs whose prefixes have a shingle in common under the second and under the third order too."""
    for batch in source:
        out = {"a": [], "b": []}
        for a, b, *prefixes in zip(*(batch[c] for c in ("a", "b", "a2", "b2", "a3", "b3"))):
            x2, y2, x3, y3 = (np.frombuffer(p, "<u4") for p in prefixes)
            if all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in ((x2, y2), (x3, y3))):
                out["a"].append(a)
                out["b"].append(b)
        yield out


def _reaching(percent: int):
    """The pairs whose sets reach the threshold."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        kept: dict[str, np.ndarray] = {}

        def found(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[text] = shingles(text)
            return kept[text]

        for batch in source:
            same = [linked(found(x), found(y), percent) for x, y in zip(batch["x"], batch["y"])]
            yield {c: [v for v, keep in zip(batch[c], same) if keep] for c in ("a", "b")}

    return run


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, sketch, percent: int, stage: Scratch) -> DataFrame:
    """Verified pairs, staged: the filters of the other orders first, on prefixes alone, then texts of the rest.
    Only texts of classes that are in a pair are read again."""
    need = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("hash", "node"))
    wanted = F.broadcast(need) if need.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else need
    texts = docs.join(wanted, "hash").select("node", "text")  # one of a class's texts, whatever its id
    with small_batches(pairs.sparkSession, 256):  # a text may be long
        own = stage(by_batch(texts, _prefixed(sketch), "node bigint, text string, second binary, third binary").dropDuplicates(["node"]))

        def beside(rows: DataFrame, **columns: str) -> DataFrame:
            for side in "ab":
                rows = rows.join(own.select(F.col("node").alias(side), *[F.col(c).alias(n.format(side)) for n, c in columns.items()]), side)
            return rows

        both = stage(by_batch(beside(pairs, **{"{}2": "second", "{}3": "third"}), _sharing, _PAIR))
        whole = beside(both, **{"{}text": "text"}).withColumnsRenamed({"atext": "x", "btext": "y"})
        out = stage(by_batch(whole, _reaching(percent), _PAIR))
    stage.drop(need, own, both)
    stage.release(pairs.sparkSession)
    return out


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """For each row its id, n_shingles and component_id: the smallest id reachable by links, itself included.

    Null and empty texts have no shingles and no links. Rows with equal texts are linked (an id that repeats
    is listed as often as it comes). A null id is reported with its n_shingles; it joins no component's
    minimum, and its component_id is that of its class, null if no other row of it has an id. Other columns
    are ignored. An empty table gives no rows. percent is at least 75: the prefixes are made for it.
    """
    if percent < 75:
        raise ValueError("prefixes are long enough for 75 % or more")
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    with Scratch() as stage:
        rows, of = _components(docs, percent, stage)
        out = rows.join(of, "node", "left")
        empty = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return stage.keep(out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), empty.alias("component_id")))


def _components(docs: DataFrame, percent: int, stage: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, node) of all documents, and (node, component_id) of all classes; both staged."""
    spark = docs.sparkSession
    docs = docs.withColumn("hash", F.xxhash64("text"))
    profile = stage(by_batch(docs, _profile, "doc_id bigint, hash bigint, n bigint, node bigint, block int, counts binary"))
    rows = profile.where("block IS NULL").select("doc_id", "n", "node")
    named = profile.where("block IS NULL AND node IS NOT NULL")
    classes = stage(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"), F.first("n").alias("n")))
    sketch = spark.sparkContext.broadcast(collected_blocks(summed_blocks(profile.where("block IS NOT NULL")), 2 * ROW))
    total = classes.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // SHARE))
    blobs = by_batch(docs.select("text"), _prefixes(sketch, buckets), _BLOB)
    groups = stage(by_batch(blobs.repartition(buckets, "bucket"), _meetings, _GROUP))
    stage.release(spark)
    pairs = stage(by_batch(groups, _with_smallest, _PAIR).distinct())
    edges = _verify(pairs, classes, docs, sketch, percent, stage)
    named = components(edges)
    # groups of classes that are not yet connected: first with the hubs of their shingles, then, where
    # different components still meet, with each other
    large = stage(groups.where("size(nodes) > 2").withColumn("g", F.monotonically_increasing_id()))
    stage.drop(groups)
    members = large.select("g", F.size("nodes").alias("k"), F.explode(F.arrays_zip("nodes", "sizes", "reach")).alias("m")).select("g", "k", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("n"), F.col("m.reach").alias("reach"))
    # an original meets its copies on more shingles than they meet each other: the likeliest hub
    central = members.groupBy("node").agg(F.sum("k").alias("central"))
    members = stage(members.join(central, "node").select("g", "node", "n", "reach", "central"))
    stage.drop(large)
    hub_of = [F.struct("central", "node", "n", "reach", "component"), *[F.struct(F.xxhash64(F.lit(k), "node"), "node", "n", "reach", "component") for k in range(HUB_ROUNDS - 1)]]
    for hub in [*hub_of, None]:
        of = members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = of.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(hub if hub is not None else F.struct("node")).alias("hub")).where("low <> high").select("g", "hub")
        of = stage(of.join(split, "g"))
        if hub is not None:
            meet = of.where((F.col("component") != F.col("hub.component")) & (F.col("n") <= F.col("hub.reach")) & (F.col("hub.n") <= F.col("reach")))
            meet = meet.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        else:
            # by group and by size: partners' sizes differ by a third at most, so a class looks into few of them
            shape = "cast(floor(ln({}) / ln(4 / 3D)) AS int)"
            left = of.drop("hub").withColumn("shape", F.expr(shape.format("n"))).alias("l")
            right = of.drop("hub").withColumn("shape", F.explode(F.expr(f"sequence({shape.format('n')} - 1, {shape.format('n')} + 2)"))).alias("r")
            fits = (F.col("l.n") <= F.col("r.reach")) & (F.col("r.n") <= F.col("l.reach")) & (F.col("l.component") < F.col("r.component"))
            meet = left.join(right, (F.col("l.g") == F.col("r.g")) & (F.col("l.shape") == F.col("r.shape")) & fits)
            meet = meet.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
        more = stage(meet.distinct().join(pairs, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            edges = edges.unionByName(_verify(more, classes, docs, sketch, percent, stage))
            pairs = pairs.unionByName(more)
            stage.drop(named)
            named = components(edges)
        members = of.select("g", "node", "n", "reach", "central")
    stage.tables.append(named)
    of = classes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows, stage(of.join(least, "component").select("node", "component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and link components of every document."""
    return similar_documents(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays. Rows without an id stay; of
    rows that repeat an id and a text one stays."""
    kept = similar_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES = {"op1_ngram_join": ORACLE_SQL}
