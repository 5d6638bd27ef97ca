"""Toxicity scores by character n-grams scaled with naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed.  From labelled
texts each feature gets the log ratio of its smoothed rates in toxic and other texts; the features
whose rates differ most surely are kept, their presence is multiplied by the ratio, and a logistic
regression is fitted on top.  Scoring is one pass over all texts with a small table of weights.

Only training reads a bounded sample: ``per_class`` labelled rows of either label at most, the
first by a hash of their ids.  Rows held out (crc32 of the id modulo 5 is 0) never train.

Defined cases: a null or empty text has no features and gets the score of the intercept; a missing
label is no label, and of several labels of an id the largest counts; with no labelled rows, or one
label only, every score is the share of toxic rows; repeated rows are scored each; an empty table
gives no rows; other columns come back inside ``row`` and are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import as_rows, batch_of, documents, whole_text

SIZES = (3, 4, 5)
BITS = 20
PER_CLASS = 3000
FEATURES = 8192
LEAST_TEXTS = 4
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, size: int, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of one size, in chunks of bounded memory."""
    padded = f" {text.lower()} "
    for at in range(0, max(1, len(padded) - size + 1), CHUNK):
        points = np.frombuffer(padded[at:at + CHUNK + size - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) < size:
            return
        n = len(points) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = (h + points[k:k + n]) * _ODD
            h ^= h >> np.uint64(29)
        yield ((h * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """The distinct features of a text, ascending."""
    seen = np.zeros(1 << BITS, bool)
    for size in SIZES:
        for h in gram_hashes(text, size):
            seen[h] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """``weights`` has ratio times coefficient of each kept feature, ``slots`` the kept features."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.slots] = self.weights
        return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text",
                  doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The bounded sample: ``doc_id``, ``y`` and ``text``, one row per id."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        "doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(3))
    picked = [marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # 2 * per_class rows at most, so it may be broadcast
    known = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole_text(f"`{text}`").alias("text"))
    return known.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 200):
            part = batch.slice(k, 200)
            yield batch_of({
                "doc_id": part.column(0), "y": part.column(1),
                "ids": pa.array([features(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **columns: str) -> Model:
    """Fit on the bounded sample.  The features are found by tasks, the regression by the driver."""
    rows = training_rows(docs, labels, per_class, **columns).mapInArrow(
        _with_features, "doc_id long, y int, ids binary").orderBy("doc_id")
    label = columns.get("label", "toxic")
    marked = labels.where(F.col(label).isNotNull()).where(~held_out(columns.get("doc_id", "doc_id"))).agg(
        F.sum(F.col(label).cast("int").cast("double")), F.count("*")).first()
    share = (marked[0] or 0.0) / marked[1] if marked[1] else 0.0
    held = [(r["y"], np.frombuffer(r["ids"], np.int32)) for r in rows.toLocalIterator()]
    y = np.array([r[0] for r in held], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), _logit(min(max(share, 0.001), 0.999)))
    positive = _counts(held, 1)
    negative = _counts(held, 0)
    n1, n0 = y.sum(), len(y) - y.sum()
    rate1, rate0 = (positive + 1) / (n1 + 2), (negative + 1) / (n0 + 2)
    ratio = np.log(rate1 / rate0)
    sure = np.abs(ratio) / np.sqrt((1 - rate1) / (positive + 1) + (1 - rate0) / (negative + 1))
    sure[positive + negative < LEAST_TEXTS] = 0
    slots = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    slots = slots[sure[slots] > 2]
    at = np.full(1 << BITS, -1, np.int64)
    at[slots] = np.arange(len(slots))
    columns_of = [k[k >= 0] for k in (at[ids] for _, ids in held)]
    weights, intercept = _regression(columns_of, y, ratio[slots])
    # the sample has other shares of the labels than the corpus
    intercept += _logit(min(max(share, 0.001), 0.999)) - _logit(n1 / len(y))
    return Model(slots, weights * ratio[slots], intercept)


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _counts(held: list, label: int) -> np.ndarray:
    out = np.zeros(1 << BITS)
    for y, ids in held:
        if y == label:
            out[ids] += 1
    return out


def _regression(columns_of: list, y: np.ndarray, ratio: np.ndarray, penalty: float = 0.02, steps: int = 300):
    """Logistic regression on presence times ratio: full gradients with momentum, fixed steps."""
    row = np.repeat(np.arange(len(columns_of)), [len(c) for c in columns_of])
    column = np.concatenate(columns_of) if len(columns_of) else np.zeros(0, np.int64)
    value = ratio[column]
    lipschitz = 0.25 * np.bincount(row, value * value, minlength=len(y)).mean() + penalty + 0.25
    rate = 4.0 / lipschitz
    w, b = np.zeros(len(ratio)), _logit(y.mean())
    vw, vb = np.zeros(len(ratio)), 0.0
    for _ in range(steps):
        z = np.bincount(row, value * (w + 0.9 * vw)[column], minlength=len(y)) + b + 0.9 * vb
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.bincount(column, value * off[row], minlength=len(w)) / len(y) + penalty * (w + 0.9 * vw) / len(y) ** 0.5
        vw, vb = 0.9 * vw - rate * gradient, 0.9 * vb - rate * off.mean()
        w, b = w + vw, b + vb
    return w, b


def _scored(model: Model):
    state: dict = {}

    def score(text: str) -> float:
        table = state.setdefault("table", model.table())
        hits = []
        for size in SIZES:
            for h in gram_hashes(text, size):
                hits.append(h[table[h] != 0])
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        z = model.intercept + float(table[found].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                yield batch_of({
                    "row": part.column(0),
                    "score": pa.array([score(t or "") for t in part.column(1).to_pylist()], pa.float64())})

    return work


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Each row (its columns ``keep``, or all) with its ``score``."""
    rows = as_rows(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs)
    kind = rows.schema["row"].dataType.simpleString()
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(_scored(model), f"row {kind}, score double")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their score."""
    docs = documents(spark, folder)
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored(docs, model, keep=("doc_id",)).select(
        F.col("row.doc_id").alias("doc_id"), "score").withColumn("held_out", held_out()).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict = {}
