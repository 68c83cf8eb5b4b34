"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate; L1 leaves few weights other than zero, so the model is a small
table that is broadcast to the scoring tasks. The model learns from a bounded sample of labelled
documents (a documented parameter); every document is scored, over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import by_batch, documents

#: Coordinates of the hashed feature space: the bound of the broadcast model.
SPACE = 1 << 20
#: At most so many labelled documents of each class are learnt from, those first by a hash of their id.
SAMPLE = 4000
_WORD = re.compile(rb"[a-z\x80-\xff]+(?:'[a-z]+)?")
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def features(text: str | None) -> np.ndarray:
    """Coordinates of a text's words, word pairs and pairs with one word between, with repetitions."""
    import xxhash

    words = _WORD.findall((text or "").encode().lower())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.concatenate([h * _P, h[:-1] * _Q + h[1:] * _R, h[:-2] * _R + h[2:] * _P])
    return ((out ^ (out >> np.uint64(31))) * _Q >> np.uint64(44)).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner. The prediction of a text is sigmoid(bias + sum of its distinct features' weights)."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 10

    def learn(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
        """Weights and bias after passes over the rows (distinct coordinates each) in shuffled order."""
        z, n = np.zeros(SPACE), np.zeros(SPACE)
        bias, bias_n = 0.0, 0.0
        order = np.random.default_rng(seed)
        for _ in range(self.epochs):
            for k in order.permutation(len(rows)):
                at = rows[k]
                zs, root = z[at], np.sqrt(n[at])
                w = np.where(np.abs(zs) <= self.l1, 0.0, (np.sign(zs) * self.l1 - zs) / ((self.beta + root) / self.alpha + self.l2))
                g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - labels[k]
                after = np.sqrt(n[at] + g * g)
                z[at] += g - (after - root) / self.alpha * w
                n[at] += g * g
                bias_n += g * g
                bias -= 0.1 * g / (1 + bias_n**0.5)
        w = np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return w, bias


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learnt from: crc32 of the id as text is 1 modulo 3; a null id is none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learner: Ftrl | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights other than zero, and the bias.

    docs has doc_id and text, labels has doc_id and toxic. At most sample documents of each class are used,
    none of them held out; null labels and ids count as unlabelled. Without labels all weights are zero.
    """
    learner = learner or Ftrl()
    usable = labels.where(~held_out()).where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample ids at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def coordinates(source: Iterator[dict]) -> Iterator[dict]:
        for batch in source:
            yield {**{k: batch[k] for k in ("doc_id", "label")}, "at": [np.unique(features(t)).astype("<u4").tobytes() for t in batch["text"]]}

    def learn(source: Iterator[dict]) -> Iterator[dict]:
        found = sorted((i, label, at) for batch in source for i, label, at in zip(batch["doc_id"], batch["label"], batch["at"]))
        w, bias = learner.learn([np.frombuffer(at, "<u4").astype(np.int64) for _, _, at in found], np.array([x for _, x, _ in found], float))
        at = np.flatnonzero(w)
        yield {"at": [-1, *at.tolist()], "weight": [bias, *w[at].tolist()]}

    rows = by_batch(rows, coordinates, "doc_id bigint, label int, at binary")
    model = by_batch(rows.repartition(1), learn, "at bigint, weight double").collect()
    bias = next((r["weight"] for r in model if r["at"] < 0), 0.0)
    kept = [r for r in model if r["at"] >= 0]
    return np.array([r["at"] for r in kept], np.int64), np.array([r["weight"] for r in kept], np.float64), bias


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts have no features: their score is the bias's. Rows are scored each by itself, so
    repeated rows, ties, null ids and other columns don't matter. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[dict]) -> Iterator[dict]:
        at, values, bias = sent.value
        weight = np.zeros(SPACE)
        weight[at] = values
        for batch in source:
            scores = []
            for text in batch["text"]:
                found = features(text)
                hit = np.unique(found[weight[found] != 0])
                scores.append(float(1 / (1 + np.exp(-np.clip(bias + weight[hit].sum(), -35, 35)))))
            yield {"id": batch["id"], "score": scores, "predicted": [int(x >= threshold) for x in scores]}

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return by_batch(source, run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
