"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, the stems of its words (their first bytes, which compounds and inflections share), pairs of
neighbouring words, and pairs with one or two words between, each hashed to one of 2^bits coordinates and counted once. Words are
A to Z lower-cased and lose the punctuation at their ends.

FTRL-proximal keeps two sums per coordinate, z and n; its weight is zero while |z| stays within the L1 bound, and its rate falls
with the root of n, the squared gradients of that coordinate alone. So most coordinates never get a weight and the rest fit in a
broadcast: at most 2^bits of them, whatever the corpus.

Training takes up to ``train_rows`` labelled rows, chosen by a hash of their id: a documented bound. They are spread over tasks
of ``shard_rows`` rows by hash; each task goes over its rows ``epochs`` times; the weights of the tasks are averaged coordinate
by coordinate. Scoring covers every text whole.

Defined results: a null or empty text has the score of the intercept. Rows without an id belong to the training folds but have no
label. Of several labels for one id the highest counts; labels other than 0 and 1, and null ones, are left aside. With no
labelled rows every score is the prior 0.5. Repeated rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fold, mix, settle, words_of

KEPT_WORDS = 200_000
EDGES = b".,;:!?\"'()[]{}<>*_-"


@dataclass(frozen=True)
class ToxicSpec:
    folds: int = 4
    held_fold: int = 2
    bits: int = 20
    stem_bytes: int = 6
    gaps: tuple[int, ...] = (0, 1, 2)  # words skipped between the two of a pair
    train_rows: int = 1 << 16
    shard_rows: int = 1 << 14
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    threshold: float = 0.3


class Features:
    """Hashed coordinates of texts."""

    def __init__(self, spec: ToxicSpec):
        self.spec = spec
        self.known: dict[bytes, tuple[int, int]] = {}  # hashes of a word and of its stem

    def of(self, text: str | None) -> np.ndarray:
        """Coordinates, repeats included."""
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        words = words_of(text)
        distinct = set(words)
        for w in distinct:
            if w not in known:
                core = w.strip(EDGES)
                known[w] = xxhash.xxh3_64_intdigest(core), xxhash.xxh3_64_intdigest(core[: self.spec.stem_bytes], seed=1)
        h = np.fromiter((known[w][0] for w in words), np.uint64, len(words))
        parts = [h, np.fromiter((known[w][1] for w in distinct), np.uint64, len(distinct))]
        for gap in self.spec.gaps:
            if len(h) > gap + 1:
                parts.append(mix(h[: -gap - 1]) * np.uint64(3) + h[gap + 1 :] + np.uint64(gap))
        return (mix(np.concatenate(parts)) >> np.uint64(64 - self.spec.bits)).astype(np.int32)


def sigmoid(x: np.ndarray | float):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal over 2^bits coordinates and an intercept, which has no L1 term."""

    def __init__(self, spec: ToxicSpec):
        self.spec = spec
        self.z = np.zeros((1 << spec.bits) + 1)
        self.n = np.zeros((1 << spec.bits) + 1)

    def weights(self, at) -> np.ndarray:
        s, z, n = self.spec, self.z[at], self.n[at]
        bound = np.where(np.asarray(at) == 1 << s.bits, 0.0, s.l1)
        active = np.sign(z) * np.maximum(np.abs(z) - bound, 0.0)
        return -active / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = sigmoid(w.sum()) - label
        square, n = gradient * gradient, self.n[at]
        self.z[at] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.spec.alpha * w
        self.n[at] = n + square


def training_rows(docs: DataFrame, labels: DataFrame, spec: ToxicSpec) -> DataFrame:
    """(shard, doc_id, text, toxic) of the labelled rows outside the held-out fold, ``train_rows`` of them at most."""
    marked = (
        labels.filter("doc_id is not null and toxic in (0, 1)").filter(fold("doc_id", spec.folds) != spec.held_fold)
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    total = marked.count()
    shards = max(1, -(-min(total, spec.train_rows) // spec.shard_rows))
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(spec.train_rows)
    # At most train_rows pairs of numbers, about 1 MB: small enough to send everywhere, so that no text is shuffled for the join.
    chosen = F.broadcast(settle(chosen, "label-sample"))
    shard = F.pmod(F.xxhash64(F.col("label_id"), F.lit(1)), F.lit(shards)).alias("shard")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(chosen, F.col("doc_id") == F.col("label_id")).select(shard, "doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, spec: ToxicSpec) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with a weight, their weights, and the intercept."""

    def fit(key, group):
        features, model = Features(spec), Ftrl(spec)
        order = np.lexsort([np.array([xxhash.xxh3_64_intdigest(str(i)) for i in group.column("doc_id").to_pylist()], np.uint64)])
        intercept = np.array([1 << spec.bits])
        rows = [
            (np.concatenate([np.unique(features.of(group.column("text")[i].as_py())), intercept]), group.column("toxic")[i].as_py())
            for i in order.tolist()
        ]
        for _ in range(spec.epochs):
            for at, label in rows:
                model.learn(at, label)
        used = np.flatnonzero(np.abs(model.z) > spec.l1 * (np.arange(len(model.z)) < 1 << spec.bits))
        return pa.table({"at": pa.array(used, pa.int64()), "weight": pa.array(model.weights(used), pa.float64())})

    fitted = training_rows(docs, labels, spec).groupBy("shard").applyInArrow(fit, "at long, weight double")
    # The intercept has a row from every shard, so its count is the number of shards.
    summed = fitted.groupBy("at").agg(F.sum("weight").alias("weight"), F.count("*").alias("shards")).toPandas()
    shards = int(summed.shards.max()) if len(summed) else 1
    at, weight = summed["at"].to_numpy(np.int64), summed["weight"].to_numpy(np.float64) / shards
    real = at < 1 << spec.bits
    return at[real], weight[real], float(weight[~real].sum())


def score(docs: DataFrame, labels: DataFrame, spec: ToxicSpec = ToxicSpec()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, spec))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, intercept = shared.value
        dense = np.zeros(1 << spec.bits)
        dense[at] = weight
        features = Features(spec)
        for batch in batches:
            sums = []
            for text in batch.column("text"):
                own = features.of(text.as_py())
                own = np.unique(own[dense[own] != 0])
                sums.append(dense[own].sum())
            scores = sigmoid(np.array(sums, np.float64) + intercept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(measure, f"doc_id {kind}, score double").select(
        "doc_id", (fold("doc_id", spec.folds) == spec.held_fold).alias("held_out"), "score",
        F.when(F.col("score") >= spec.threshold, 1).otherwise(0).alias("predicted"),
    )
