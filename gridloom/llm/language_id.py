"""Language identification: script ranges narrow the candidates of a word, and Viterbi over the words' scores with a
penalty for each switch labels spans of mixed-language text.

A word's score in a language is a sum of smoothed log probabilities of its character n-grams, edges included, and of
the word itself; features are hashed. The model is learnt from a bounded sample of labelled documents of each language
(a documented parameter) and has a fixed size for each. Every document is labelled, over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import by_batch, documents, packed, summed_blocks

#: Hashed features of a language: 256 KB of its model.
SPACE = 1 << 16
#: At most so many documents of a language are learnt from, those first by a hash of their id.
SAMPLE = 2000
#: Words of a batch of texts that are labelled side by side, and words whose scores a task remembers.
SIDE_BY_SIDE, REMEMBERED = 1 << 20, 1 << 17
_WORD = re.compile(r"[^\W\d_]+")

# fixed values: first code points of the ranges of scripts, by the Unicode standard
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_FROM = np.array([at for at, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall((text or "").lower())


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as a number."""
    first = np.fromiter((ord(word[0]) for word in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_FROM, first, "right") - 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes as coordinates."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64) & (SPACE - 1)


def features(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The features of words: n-grams of 1 to 4 letters with the word's edges, and the word. The words' letters, each
    word between edges, lie in one array; for each length of n-gram there is an array of coordinates, one for each
    letter or edge at which an n-gram of its word begins (SPACE, which weighs nothing, for the others). The last array
    has the words' own. Besides, where each word begins, and how many features it has."""
    letters = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), "<u4").astype(np.uint64) if words else np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if words else np.zeros(0, np.int64)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(letters))  # letters from here to the word's end
    base, out = np.uint64(0x9E3779B97F4A7C15), []
    rolling = np.zeros(len(letters), np.uint64)
    for n in range(1, 5):
        rolling[: len(letters) - n + 1] = rolling[: len(letters) - n + 1] * base + letters[n - 1 :] + np.uint64(n)
        out.append(np.where(left >= n, _mixed(rolling), SPACE))
    power = np.cumprod(np.r_[np.uint64(1), np.full(max(0, int(sizes.max(initial=1)) - 1), base)])
    whole = np.add.reduceat(letters * power[left - 1], starts) if words else letters
    out.append(_mixed(whole ^ np.uint64(0xD6E8FEB86659FD93)))
    return out, starts, sum(np.maximum(sizes - n + 1, 0) for n in range(1, 5)) + 1


@dataclass(frozen=True)
class Model:
    """langs, the log probability of each feature by language, and by script the languages that use it."""

    langs: list[str]
    weight: np.ndarray
    uses: np.ndarray
    smoothing: float = 0.5
    #: A word tells at most so much against a language, in natural logarithms; and a switch costs so much.
    most: float = 6.0
    switch: float = 8.0

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray, letters: np.ndarray, **settings) -> Model:
        """From counts of features and of words by script, a row for each language."""
        seen = counts + cls.smoothing
        uses = letters > 0.01 * letters.sum(1, keepdims=True)
        return cls(langs, np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32), uses, **settings)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word with its score by language, 0 at best; languages that don't use its script get the
        most a word can tell against one. A word in a script that none uses tells nothing."""
        at, starts, sizes = features(words)
        weight = np.vstack([self.weight.T, np.zeros((1, len(self.langs)), np.float32)])
        out = weight[at[-1]] + sum(np.add.reduceat(weight[x], starts, axis=0) for x in at[:-1])
        out = out / np.sqrt(sizes)[:, None]
        out = np.where(self.uses[:, scripts_of(words)].T, out, -np.inf)
        top = out.max(1, keepdims=True)
        out = np.where(np.isfinite(top), np.maximum(out - np.where(np.isfinite(top), top, 0), -self.most), 0)
        return out.astype(np.float32)


def viterbi(score: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word of many texts, which lie one after the other: label scores less switch for each
    change of label. Texts advance side by side, the longest first, so one step is one array operation."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    label = np.zeros(len(score), np.int32)
    stays = np.zeros(score.shape, bool)
    before = np.zeros(len(score), np.int32)  # where a change comes from
    now = score[starts[: active[0]]] if longest else None
    ends = np.zeros(len(sizes), np.int32)
    for t in range(1, longest + 1):
        n = active[t] if t < longest else 0
        ends[n : len(now)] = now[n:].argmax(1)
        if not n:
            break
        now = now[:n]
        at = starts[:n] + t
        came = now.argmax(1)
        change = now[np.arange(n), came] - switch
        stay = now >= change[:, None]
        stays[at], before[at] = stay, came
        now = np.where(stay, now, change[:, None]) + score[at]
    held = np.zeros(0, np.int32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        held = np.r_[held, ends[len(held) : n]].astype(np.int32)
        at = starts[:n] + t
        label[at] = held
        if t:
            held = np.where(stays[at, held], held, before[at])
    return label


def held_out(id_col: str = "doc_id"):
    """Rows whose language is never learnt from: crc32 of the id as text is 2 modulo 4; a null id is none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, **settings) -> Model:
    """The model of doc_id, text and lang; rows without an id, text or language, and held-out rows, teach nothing.

    At most sample documents of a language are read, so a language's model depends on a bounded number of rows, and
    the driver gets SPACE counters for each language. Without any labelled row the model knows no language.
    """
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    order = F.xxhash64("doc_id")
    sized = usable.groupBy("lang").agg(F.count("*").alias("rows"))  # a row a language
    # about twice the sample is let through by hash, whatever the language's size, before its rows meet in one task
    few = usable.select("doc_id", "lang").join(F.broadcast(sized), "lang").where(F.pmod(order, F.lit(1 << 30)) / (1 << 30) < F.lit(2.0 * sample) / F.col("rows"))
    first = Window.partitionBy("lang").orderBy(order, "doc_id")
    ids = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("doc_id", "lang").distinct()
    langs = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    if not langs:
        return Model.of([], np.zeros((0, SPACE)), np.zeros((0, len(_NAMES))), **settings)
    number = {name: k for k, name in enumerate(langs)}
    chosen = usable.join(F.broadcast(ids), ["doc_id", "lang"])  # sample ids of each language at most

    def count(source: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in source:
            for lang, text in zip(batch["lang"], batch["text"]):
                words = words_of(text)
                if words:
                    n = Counter(words)
                    words, n = list(n), np.fromiter(n.values(), np.int64, len(n))
                    at, _, _ = features(words)
                    mine = total.setdefault(number[lang], np.zeros(SPACE + len(_NAMES), np.int64))
                    each = np.repeat(n, np.fromiter(map(len, words), np.int64, len(words)) + 2)
                    for x in at[:-1]:
                        mine[:SPACE] += np.bincount(x, each, SPACE + 1)[:SPACE].astype(np.int64)
                    mine[:SPACE] += np.bincount(at[-1], n, SPACE).astype(np.int64)
                    mine[SPACE:] += np.bincount(scripts_of(words), n, len(_NAMES)).astype(np.int64)
        yield {"block": list(total), "counts": [packed(x, "<u8") for x in total.values()]}

    import zlib

    counts = np.zeros((len(langs), SPACE + len(_NAMES)))
    for row in summed_blocks(by_batch(chosen.select("lang", "text"), count, "block int, counts binary"), "<u8").toLocalIterator():
        counts[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u8")
    return Model.of(langs, counts[:, :SPACE], counts[:, SPACE:], **settings)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, lang_pred, score and spans: (lang, first, last) of words in the order of the text.

    lang_pred is the language with the most letters (the first by name of equals), score the share of the letters
    that are labelled with it. A null text, one without a letter, or a model without languages gives und, 0.0 and no
    spans. Rows are labelled each by itself, so repeated rows, null ids and other columns don't matter. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(source: Iterator[dict]) -> Iterator[dict]:
        model = sent.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.langs)), np.float32)

        def labelled(ids: list, texts: list[list[str]]) -> dict:
            nonlocal known, table
            if len(known) > REMEMBERED:
                known, table = {}, table[:0]
            new = list({w: None for words in texts for w in words if w not in known})
            if new and model.langs:
                known.update({w: len(known) + k for k, w in enumerate(new)})
                table = np.vstack([table, *[model.scores(new[k : k + 4096]) for k in range(0, len(new), 4096)]])
            sizes = np.array([len(w) for w in texts], np.int64)
            starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
            out: dict[str, list] = {"id": ids, "lang_pred": [], "score": [], "spans": []}
            if model.langs:
                flat = np.fromiter((known[w] for words in texts for w in words), np.int64, int(sizes.sum()))
                length = np.fromiter((len(w) for words in texts for w in words), np.int64, len(flat))
                labels = viterbi(table[flat], starts, sizes, model.switch)
            for a, n in zip(starts.tolist(), sizes.tolist()):
                if not n or not model.langs:
                    out["lang_pred"].append("und")
                    out["score"].append(0.0)
                    out["spans"].append([])
                    continue
                mine = labels[a : a + n]
                letters = np.bincount(mine, length[a : a + n], len(model.langs))
                best = int(letters.argmax())
                out["lang_pred"].append(model.langs[best])
                out["score"].append(float(letters[best] / letters.sum()))
                first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                last = np.r_[first[1:], n] - 1
                out["spans"].append([{"lang": model.langs[mine[x]], "first": x, "last": y} for x, y in zip(first.tolist(), last.tolist())])
            return out

        for batch in source:
            ids, texts, n = [], [], 0
            for i, text in zip(batch["id"], batch["text"]):
                ids.append(i)
                texts.append(words_of(text))
                n += len(texts[-1])
                if n >= SIDE_BY_SIDE:
                    yield labelled(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield labelled(ids, texts)

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return by_batch(source, run, f"id {kind}, lang_pred string, score double, spans array<struct<lang: string, first: int, last: int>>").withColumnRenamed("id", id_col)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = documents(spark, sf_dir)
    out = label(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op12_language_id": op12_language_id}
