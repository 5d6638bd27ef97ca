import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import toxicity as tx
from tests_llm_data import ODD_TEXTS

FOLDER = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    rows = tx.op9_toxicity(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    table = rows.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(table["score"].values, table["toxic"].values) > 0.97
    assert (table["predicted"] == table["toxic"]).mean() > 0.95
    assert (table["predicted"][table["toxic"] == 0]).mean() < 0.01


def test_held_out_rows_never_train(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = [r["doc_id"] for r in tx.training_rows(docs, labels).collect()]
    assert sorted(ids) == [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    assert tx.training_rows(docs, labels, per_class=3).count() == 6


def test_learns_a_word(spark, docs):
    clean = [(k, f"nice day number {k} in town") for k in range(200)]
    rude = [(k, f"nice day number {k} you dreadful lout") for k in range(200, 300)]
    labels = spark.createDataFrame([(k, int(k >= 200)) for k in range(300)], "doc_id long, toxic int")
    table = docs(clean + rude).withColumn("score", F.lit("clash"))
    scores = {r["row"]["doc_id"]: r["score"] for r in tx.scored(table, tx.fit(table, labels)).collect()}
    assert min(scores[k] for k, _ in rude) > 0.5 > max(scores[k] for k, _ in clean)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 1), (2, None)]])
def test_without_two_labels_and_odd_texts(spark, docs, labels):
    table = docs(ODD_TEXTS)
    model = tx.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = tx.scored(table, model).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert tx.scored(docs([]), model).count() == 0


def test_repeated_rows_are_one_training_row(spark, docs):
    table = docs([(2, "a"), (2, "a"), (2, "b"), (3, "c")])
    labels = spark.createDataFrame([(2, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted((r["doc_id"], r["y"], r["text"]) for r in tx.training_rows(table, labels).collect()) in (
        [(2, 1, "a"), (3, 0, "c")], [(3, 0, "c")], [(2, 1, "a")], [])


def plain_hash(gram):
    """One n-gram's slot, in whole numbers."""
    odd, mask, h = 0x9E3779B97F4A7C15, (1 << 64) - 1, len(gram)
    for c in gram:
        h = (h + ord(c)) * odd & mask
        h ^= h >> 29
    return (h * odd & mask) >> (64 - tx.BITS)


def test_scores_against_a_plain_scorer_and_recall(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    table = tx.scored(docs.join(labels, "doc_id").where(tx.held_out()), model).select("row.doc_id", "row.text", "row.toxic", "score").toPandas()
    for text, score in zip(table["text"][:120], table["score"][:120]):
        padded = f" {(text or '').lower()} "
        grams = {plain_hash(padded[k:k + n]) for n in tx.SIZES for k in range(len(padded) - n + 1)}
        z = model.intercept + sum(weight.get(g, 0.0) for g in grams)
        assert abs(score - 1 / (1 + np.exp(-min(max(z, -40), 40)))) < 1e-4
    toxic = table["toxic"] == 1
    assert (table["score"][toxic] >= 0.5).mean() > 0.7  # what is missed are texts without shared words
    assert (table["score"][~toxic] >= 0.5).mean() < 0.01
