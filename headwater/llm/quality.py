"""Quality classification by naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``WIDTH`` places: byte trigrams of
the text as written, and n-grams of one to ``SHAPES`` words' shapes.  A shape is
a word's sequence of capital, small, digit and other characters, runs counted
once; a word equal to the one before it has the shape ``=``.  An indicator is
scaled by the log ratio of its smoothed counts in the two classes, a document's
features are brought to length 1, and a linear hinge-loss model is fitted by
dual coordinate descent.  Margins become scores by a logistic curve fitted on
folds that the margins' models did not see.

The model is fitted on at most ``SAMPLE`` labelled documents, those whose ids
have the smallest hashes; its size is fixed, so it is broadcast.  Scores cover
whole texts and use nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 16
#: Most labelled documents that a model is fitted on.
SAMPLE = 4000
#: Words in the longest n-gram of shapes, and words remembered with their shape.
SHAPES, CACHE = 3, 200_000
COST, FOLDS = 1.0, 4
#: Passes over the rows at most, and the step of a row below which it counts as solved.
EPOCHS, STEP = 100, 0.002


class Shapes(dict):
    """Words to hashes of their shapes."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        shape = "".join(k for k, _ in groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        self[word] = out = crc32(shape.encode("utf-8", "replace"))
        return out


SHAPE = Shapes()
SAME = crc32(b"same word")


def indicators(text: str | None) -> np.ndarray:
    """Places of a text's features, ascending, each once."""
    seen = np.zeros(WIDTH, bool)
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) > 2:
        code = raw[:-2] * np.uint32(40503) + raw[1:-1] * np.uint32(2654435) + raw[2:] * np.uint32(7919)
        seen[((code ^ (code >> np.uint32(11))) & np.uint32(WIDTH - 1))] = True
    words = text.split()
    if words:
        same = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
        code = np.fromiter(map(SHAPE.__getitem__, words), np.uint64, len(words))
        code[1:][same] = SAME
        mixed = np.zeros(len(words), np.uint64)
        for n in range(min(SHAPES, len(words))):
            mixed = (mixed[: len(words) - n] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15) + code[n:]
            seen[(mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum()) / self.length(places) + self.bias

    def length(self, places: np.ndarray) -> float:
        return float(np.sqrt(len(places))) or 1.0

    def score(self, places: np.ndarray) -> float:
        z = self.slope * self.margin(places) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, WIDTH))
    for places, label in zip(rows, labels):
        counts[int(label), places] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; weights over indicators (ratio included) and bias."""
    rng = np.random.default_rng(0)
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (labels == 0).sum()), max(1, (labels > 0).sum())]) / len(labels)
    cost = COST / (2 * share[(labels > 0).astype(int)])
    x = [ratios[p] / (np.sqrt(len(p)) or 1.0) for p in rows]
    norm = np.array([float(v @ v) + 1.0 for v in x])
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        far = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ x[i]) + bias) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if a != alpha[i]:
                far = max(far, abs(a - alpha[i]) * norm[i])
                d = (a - alpha[i]) * y[i]
                w[rows[i]] += d * x[i]
                bias += d
                alpha[i] = a
        if far < STEP:
            break
    return w * ratios, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margin to score, by Newton steps on smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels == 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels > 0, 0.5 / n1, 0.5 / n0) * len(labels)
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = np.clip(beta - np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-3 * (beta - [1.0, 0.0])), -50, 50)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """With one class only, every score lies on that class's side; with no rows on that of label 1."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(WIDTH), 1.0 if not len(labels) or labels[0] > 0 else -1.0, 1.0, 0.0)

    def train(keep: np.ndarray) -> Model:
        some = [rows[i] for i in keep]
        ratios = log_count_ratios(some, labels[keep])
        return Model(*descend(some, labels[keep], ratios), 1.0, 0.0)

    every, unseen = np.arange(len(rows)), np.zeros(len(rows))
    fold = np.empty(len(rows), int)
    for label in (0, 1):  # both classes in every fold, as far as they go
        own = np.flatnonzero(labels == label)
        fold[own] = np.arange(len(own)) % FOLDS
    for f in range(FOLDS):
        if min((labels[fold != f] == 0).sum(), (labels[fold != f] > 0).sum()):
            model = train(every[fold != f])
            for i in every[fold == f]:
                unseen[i] = model.margin(rows[i])
    model = train(every)
    model.slope, model.shift = logistic(unseen, labels)
    return model


def may_learn(doc_id: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of ``labels`` (doc_id, ``label`` 0/1) from the texts of ``docs``.

    Labels that are null or other than 0 and 1 are left out; of a document's several labels the mean decides, half counting as 1.
    Of several rows with one doc_id one counts, so the driver gets ``sample`` sets of at most ``WIDTH`` features.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("told")).where("doc_id IS NOT NULL AND told IN (0, 1)").where(may_learn(F.col("doc_id")))
    told = told.groupBy("doc_id").agg((F.avg("told") >= 0.5).cast("int").alias("told")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [indicators(t.as_py()).astype("<u2").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.binary())], names=["doc_id", "told", "places"])

    found = texts.join(F.broadcast(told), "doc_id").select("doc_id", "text", "told").mapInArrow(each, "doc_id long, told int, places binary")
    got = found.groupBy("doc_id", "told").agg(F.min("places").alias("places")).toArrow()
    found = sorted(zip(got["doc_id"].to_pylist(), got["told"].to_pylist(), got["places"].to_pylist()))
    return fit_rows([np.frombuffer(p, "<u2").astype(np.int64) for _, _, p in found], np.array([t for _, t, _ in found], int))


def score(model: Model, spark) -> Column:
    """The score of column ``text``, from 0 to 1; a null text is an empty one."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = held.value
        return pa.array([m.score(indicators(t.as_py())) for t in texts], pa.float64())

    return scored.asNondeterministic()(F.col("text").cast("string"))  # so that the optimiser runs it once


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs``, with a ``doc_id`` and ``text`` among them, and the new ``score`` and ``predicted``.

    A row is judged by its text alone: null and empty texts get the score of a
    text without features, repeated rows equal scores, no rows none.  A column
    of ``docs`` with a new column's name is replaced.
    """
    model = fit(docs, labels)
    return docs.withColumn("score", score(model, docs.sparkSession)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
