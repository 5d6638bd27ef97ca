"""Postings are counted inside the document's row, and shuffled once, in bounded ranges."""

from collections import Counter

from pyspark.sql import functions as F

from notespark.operators import block_max, bm25


def test_counts_need_no_shuffle(spark):
    docs = spark.createDataFrame(
        [(1, "b a B c a b"), (2, ""), (3, None), (4, "x"), (4, "x y")], "doc_id long, text string")
    postings = bm25.build_postings(docs)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    got = Counter((r.doc_id, r.length, r.term, r.tf) for r in postings.collect())
    assert got == Counter([(1, 6, "a", 2), (1, 6, "b", 3), (1, 6, "c", 1), (4, 1, "x", 1), (4, 2, "x", 1), (4, 2, "y", 1)])
    lengths = {r.doc_id: r.length for r in bm25.count_terms(docs).where("doc_id < 4").collect()}
    assert lengths == {1: 6, 2: 0, 3: None}


def test_files_follow_the_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "POSTINGS_PER_FILE", 40)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.col("id"), F.lit("all")).alias("text"))
    for write, path in [(bm25.write_index, f"{tmp_path}/a"), (block_max.write_index, f"{tmp_path}/b")]:
        write(docs, path)
        stored = spark.read.parquet(f"{path}/postings")
        assert stored.count() == 600 and stored.rdd.getNumPartitions() >= 1
        assert len(stored.inputFiles()) > 8  # more than the session's shuffle partitions: the number follows the postings
        assert stored.where("term = 'all'").select(F.input_file_name()).distinct().count() > 1
    totals = spark.read.parquet(f"{tmp_path}/a/totals").first()
    assert (totals["documents"], totals["mean_length"], totals["terms"], totals["postings"]) == (300, 3.0, 301, 600)
