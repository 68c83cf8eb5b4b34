"""Phrase collocations by hierarchical pair naming.

Words that are frequent in their language get ids. From then on a phrase of k words is a pair of adjacent ids of
phrases of k - 1 words, one place apart: pairs are counted over all documents, the frequent ones are named by a join,
and their names take the place of the pairs in the texts for the next round. A name's two halves are parent pointers:
following the first gives the frequencies of a phrase's beginnings, the second those of its ends, and phrases that a
longer one contains are the parents of that one. Names, counts and pointers are tables; only ids in a chunk of text
are held by a task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import Scratch, by_batch, documents, small_batches

#: Words in a chunk of one language's text, and the most that a task holds of all languages.
CHUNK, HELD = 1 << 20, 1 << 22
#: Tables of names of at most so many rows are sent to the tasks; larger ones meet what the chunks ask in a join.
BROADCAST_ROWS = 1 << 20
#: Rows that a task hands on at a time.
_ROWS = 1 << 16
_PARTS = re.compile(rb"[.,;:!?\x0a-\x0d]|[^\x20\x09.,;:!?\x0a-\x0d]+")
_ENDS = frozenset(bytes([x]) for x in b".,;:!?\x0a\x0b\x0c\x0d")
#: Chunks of text: for each place a number of the chunk's list of words, -1 for a mark that ends a piece.
_TEXT = "chunk bigint, lang string, refs binary, words binary, n bigint"
#: Chunks of phrases: places where a phrase with a name begins, and the names.
_NAMED = "chunk bigint, lang string, places binary, ids binary"


def parts_of(text: bytes | None) -> list[bytes]:
    """Words and the marks that end pieces, in order, A-Z lower-cased."""
    return _PARTS.findall((text or b"").lower())


def _pack(numbers: np.ndarray, kind: str) -> bytes:
    return zlib.compress(numbers.astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _rows(**columns) -> Iterator[dict]:
    """Columns as rows, some at a time."""
    n = len(next(iter(columns.values())))
    for k in range(0, n, _ROWS):
        yield {c: v[k : k + _ROWS] for c, v in columns.items()}


def chunked(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The texts as chunks of words by language, n words each."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        first = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[dict[bytes, int], array]] = {}
        total, made = 0, 0

        def chunk(lang: str) -> dict:
            known, refs = held.pop(lang)
            refs = np.frombuffer(refs, np.int32)
            return {"chunk": [first + made], "lang": [lang], "refs": [_pack(refs, "<i4")], "words": [zlib.compress(b" ".join(known), 1)], "n": [int((refs >= 0).sum())]}

        for batch in source:
            for lang, text in zip(batch["lang"], batch["text"]):
                known, refs = held.setdefault(lang, ({}, array("i")))
                before = len(refs)
                refs.extend(-1 if w in _ENDS else known.setdefault(w, len(known)) for w in parts_of(text))
                refs.append(-1)
                total += len(refs) - before
                if len(refs) >= CHUNK or total >= HELD:
                    most = max(held, key=lambda x: len(held[x][1]))
                    total -= len(held[most][1])
                    yield chunk(most)
                    made += 1
        for lang in list(held):
            yield chunk(lang)
            made += 1

    source = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("binary").alias("text"))
    return by_batch(source, run, _TEXT)


def _known(words: bytes) -> list[bytes]:
    data = zlib.decompress(words)
    return data.split(b" ") if data else []


def word_counts(chunks: DataFrame) -> DataFrame:
    """Each chunk's words: chunk, ref (the word's number in the chunk), lang, word, n."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            for chunk, lang, refs, words in zip(*(batch[k] for k in ("chunk", "lang", "refs", "words"))):
                refs, known = _unpack(refs, "<i4"), _known(words)
                if known:
                    n = np.bincount(refs[refs >= 0], minlength=len(known))
                    size = len(known)
                    yield from _rows(chunk=[chunk] * size, ref=np.arange(size, dtype=np.int32), lang=[lang] * size, word=[w.decode(errors="replace") for w in known], n=n)

    return by_batch(chunks, run, "chunk bigint, ref int, lang string, word string, n bigint")


def _pairs(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent phrases: where they are (indices of places), the number of each one's pair, and of each distinct pair
    both names and its count."""
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    names, number = np.unique(ids, return_inverse=True)
    keys, pair, n = np.unique(number[at] * np.int64(max(1, len(names))) + number[at + 1], return_inverse=True, return_counts=True)
    return at, pair, names[keys // max(1, len(names))], names[keys % max(1, len(names))], n


def pair_counts(named: DataFrame) -> DataFrame:
    """Each chunk's pairs of adjacent phrases, by their names: chunk, a, b, n."""

    def run(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            for chunk, places, ids in zip(batch["chunk"], batch["places"], batch["ids"]):
                _, _, a, b, n = _pairs(_unpack(places, "<u4"), _unpack(ids, "<i8"))
                if len(a):
                    yield from _rows(chunk=np.full(len(a), chunk), a=a, b=b, n=n)

    return by_batch(named, run, "chunk bigint, a bigint, b bigint, n bigint")


def names(asked: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Phrases that occur least times or more in all chunks, with ids."""
    return asked.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id())


def _look_up(sorted_a: np.ndarray, sorted_b: np.ndarray, id_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of pairs (a, b) in a table in the order of (a, b); -1 for those that it does not have."""
    out = np.full(len(a), -1, np.int64)
    if not len(id_) or not len(a):
        return out
    heads, starts = np.unique(sorted_a, return_index=True)
    seconds = np.unique(np.r_[sorted_b, b])
    wide = np.int64(len(seconds))
    code = lambda x, y: np.searchsorted(heads, x) * wide + np.searchsorted(seconds, y)
    table, wanted = code(sorted_a, sorted_b), code(a, b)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    same = (table[at] == wanted) & (heads[np.minimum(np.searchsorted(heads, a), len(heads) - 1)] == a)
    out[same] = id_[at[same]]
    return out


def _given(asked: DataFrame, known: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """For each chunk the names that it asks for, packed: numbers (carried..., id)."""
    found = asked.join(known.select(*keys, "id"), keys).select("chunk", *carried, "id")

    def pack(source: Iterator[dict]) -> Iterator[dict]:
        chunk, held = None, array("q")
        for batch in source:
            for c, *row in zip(batch["chunk"], *(batch[k] for k in carried), batch["id"]):
                if c != chunk and held:
                    yield {"chunk": [chunk], "given": [zlib.compress(held.tobytes(), 1)]}
                    held = array("q")
                chunk = c
                held.extend(row)
        if held:
            yield {"chunk": [chunk], "given": [zlib.compress(held.tobytes(), 1)]}

    return by_batch(found.repartition("chunk").sortWithinPartitions("chunk", *carried), pack, "chunk bigint, given binary")


def _told(rows: DataFrame, asked: DataFrame, known: DataFrame, keys: list[str], carried: list[str]):
    """rows with the names they need: beside each chunk those it asks for, or, if there are few enough of them in all,
    all of them as a broadcast value."""
    if known.count() > BROADCAST_ROWS:
        return rows.join(_given(asked, known, keys, carried), "chunk"), None
    table = known.select(*keys, "id").orderBy(*keys).toArrow()  # at most BROADCAST_ROWS
    if keys == ["a", "b"]:
        value = tuple(table.column(c).to_numpy() for c in (*keys, "id"))
    else:
        value = {}
        for lang, word, i in zip(*(table.column(c).to_pylist() for c in (*keys, "id"))):
            value.setdefault(lang, {})[word] = i
    return rows.withColumn("given", F.lit(None).cast("binary")), rows.sparkSession.sparkContext.broadcast(value)


def named_words(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks of text as chunks of named words; words without a name leave their places empty."""
    rows, sent = _told(chunks, word_counts(chunks), known, ["lang", "word"], ["ref"])

    def run(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            for chunk, lang, refs, words, given in zip(*(batch[k] for k in ("chunk", "lang", "refs", "words", "given"))):
                refs, known = _unpack(refs, "<i4"), _known(words)
                name = np.full(len(known) + 1, -1, np.int64)  # the last for marks
                if sent is None:
                    ref, ids = _unpack(given, "<i8").reshape(-1, 2).T
                    name[ref] = ids
                else:
                    of = sent.value.get(lang, {})
                    name[: len(known)] = [of.get(w.decode(errors="replace"), -1) for w in known]
                ids = name[refs]
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    yield {"chunk": [chunk], "lang": [lang], "places": [_pack(at, "<u4")], "ids": [_pack(ids[at], "<i8")]}

    return by_batch(rows.select("chunk", "lang", "refs", "words", "given"), run, _NAMED)


def named_pairs(named: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks of named phrases as chunks of named phrases one word longer."""
    rows, sent = _told(named, pair_counts(named), known, ["a", "b"], ["a", "b"])

    def run(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            for chunk, lang, places, ids, given in zip(*(batch[k] for k in ("chunk", "lang", "places", "ids", "given"))):
                table = sent.value if sent is not None else tuple(_unpack(given, "<i8").reshape(-1, 3).T)
                places = _unpack(places, "<u4")
                where, pair, a, b, _ = _pairs(places, _unpack(ids, "<i8"))
                name = _look_up(*table, a, b)[pair]
                where, name = where[name >= 0], name[name >= 0]
                if len(where):
                    yield {"chunk": [chunk], "lang": [lang], "places": [_pack(places[where], "<u4")], "ids": [_pack(name, "<i8")]}

    return by_batch(rows.select("chunk", "lang", "places", "ids", "given"), run, _NAMED)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exactly: of longs, by way of decimals of 38 places."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(a) * wide(n)).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    rest = above % (wide(left) * wide(right)).cast("decimal(38,0)")
    return ((above - rest) / (wide(left) * wide(right)).cast("decimal(38,0)")).cast("bigint")


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, share: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first phrases of 2 to longest words: lang, rank, phrase, a, l, r, n, score, cut.

    A phrase needs least occurrences in its language; its score is that of its lowest-scoring cut, the earliest of
    equal ones (cut: words before it). One that lies within a longer candidate which occurs at least share hundredths
    as often goes. Null texts are empty, a null language is und; rows without words, repeated rows (each counts),
    empty tables and other columns are no special cases. A text is read whole and never cut.
    """
    with Scratch() as stage:
        with small_batches(docs.sparkSession, 1000):
            text = stage(chunked(docs, lang_col, text_col))
        n_of = stage(text.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"))
        levels, now = [stage(names(word_counts(text), ["lang", "word"], least))], text
        while len(levels) < longest and levels[-1].head(1):
            if len(levels) == 1:
                now = named_words(text, levels[0])  # not written: its chunks are as large as the text's
            else:
                before, now = now, stage(named_pairs(now, levels[-1]))
                stage.drop(text if len(levels) == 2 else before)
            levels.append(stage(names(pair_counts(now), ["a", "b"], least)))
        return stage.keep(_ranked(levels, n_of, first, share))


def _ranked(levels: list[DataFrame], n_of: DataFrame, first: int, share: int) -> DataFrame:
    """From the names of each size the ranking: parents give the frequencies of all beginnings and ends."""
    #: starts and ends: frequencies of the phrase's first 1, 2, ... words, and of its last 1, 2, ...
    now = levels[0].select("id", "lang", F.array("word").alias("words"), F.array("f").alias("starts"), F.array("f").alias("ends"), "f")
    found = []
    for k, known in enumerate(levels[1:], 1):
        a = now.select(F.col("id").alias("a"), "lang", F.col("words").alias("aw"), "starts")
        b = now.select(F.col("id").alias("b"), F.element_at("words", -1).alias("bw"), "ends")
        joined = known.join(a, "a").join(b, "b")
        now = joined.select("id", "lang", F.concat("aw", F.array("bw")).alias("words"), F.concat("starts", F.array("f")).alias("starts"), F.concat("ends", F.array("f")).alias("ends"), "f")
        mine = now
        if k + 1 < len(levels):
            longer = levels[k + 1]
            top = longer.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
            mine = now.join(top, "id", "left").where(f"g IS NULL OR 100 * g < {share} * f").drop("g")
        found.append(mine.select("lang", "words", "starts", "ends", "f"))
    if not found:
        found = [now.limit(0).select("lang", "words", "starts", "ends", "f")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.join(F.broadcast(n_of), "lang")  # one row a language
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda c: F.struct(score(F.col("f"), F.col("n"), F.element_at("starts", c), F.element_at("ends", F.size("words") - c)).alias("score"), c.alias("cut")))
    every = every.withColumn("least", F.array_min(cuts)).withColumns({"phrase": F.array_join("words", " "), "score": F.col("least.score"), "cut": F.col("least.cut")})
    every = every.withColumns({"a": F.col("f"), "l": F.element_at("starts", F.col("cut")), "r": F.expr("element_at(ends, size(words) - cut)")})
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of documents."""
    return phrases(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM
            (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM q GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM q, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, f.phrase, f.f AS a, n.n, j, string_split(f.phrase, ' ') AS w FROM f JOIN n USING (lang), range(1, 5) t(j) WHERE f.k > 1 AND j < f.k),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.n, j, x.f AS l, y.f AS r, (1000 * c.a * c.n) // (x.f * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(c.w[1 : j], ' ')
             JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
kept AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM f h WHERE h.lang = m.lang AND h.k > m.k AND h.f >= m.a AND contains(' ' || h.phrase || ' ', ' ' || m.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, CAST(j AS INTEGER) AS cut
FROM o WHERE rank <= 2000
"""
QUERIES = {"op11_phrase_mining": op11_phrase_mining}
ORACLES = {"op11_phrase_mining": ORACLE_SQL}
