"""Keyword search splits texts once and reads vectors only where they are asked for; deleted names are found once."""

import glob

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notespark.operators import bm25
from notespark.plans import reports_search
from notespark.sources import store


def _counting(spark):
    """A text column that counts how often it is computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def tell(text):
        seen.add(1)
        return text

    return F.udf(tell, StringType()).asNondeterministic(), seen


def test_search_splits_texts_once_and_the_best_again(spark, monkeypatch):
    texts = [f"word{i % 40} common" if i % 3 else f"rare word{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = bm25.score_scan(docs, "rare word7").orderBy(F.desc("score"), "doc_id").limit(5).collect()
    profile, rows = bm25._profile, []
    monkeypatch.setattr(bm25, "_profile", lambda docs, *rest: rows.append(docs.count()) or profile(docs, *rest))
    assert bm25.search(docs, "rare word7", 5).collect() == want
    assert sorted(rows) == [5, 300]


def test_search_with_repeated_and_null_keys(spark):
    rows = [(1, "cat"), (1, "cat cat"), (None, "cat cat cat"), (2, "dog"), (3, "cat dog"), (4, "dog cow"), (5, "dog"), (6, "cow"),
            (7, "cow"), (8, "hen"), (9, "hen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 2, 3, 9):
        want = bm25.score_scan(docs, "cat").orderBy(F.desc("score"), "doc_id").limit(n).collect()
        assert bm25.search(docs, "cat", n).collect() == want
        kept = [r for r in bm25.score_scan(docs, "cat").orderBy(F.desc("score"), "doc_id").collect() if "dog" not in r.text][:n]
        assert bm25.search(docs, "cat", n, where=~F.contains("text", F.lit("dog"))).collect() == kept


def test_keyword_search_reads_no_vectors(spark, tmp_path):
    for path in glob.glob("/root/testdata/sf0.001/documents.parquet"):
        spark.read.parquet(path).write.parquet(f"{tmp_path}/documents.parquet")
    assert reports_search.keyword_only_search(spark, str(tmp_path)).count() == 10


def test_deleted_names_are_computed_once(spark, tmp_path):
    tell, seen = _counting(spark)
    chunks = spark.createDataFrame([(f"n{i}.md", f"c{i}") for i in range(20)], "source string, text string")
    notes = chunks.select(F.col("source").alias("path"), F.md5("text").alias("checksum"))
    path = str(tmp_path / "index")
    store.index_notes(chunks, notes, path)
    store.delete_notes(chunks.where("source < 'n15'").select(tell("source").alias("source")), path)
    assert seen.value == chunks.where("source < 'n15'").count()
    assert store.read(spark, path).count() == 20 - seen.value
