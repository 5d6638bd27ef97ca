import zlib
from collections import Counter

from pyspark.sql import functions as F

from notespark.llm import shuffle_shards as ss
from tests_llm_data import ODD_TEXTS


def slots_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    return by


def test_rows_law_and_slots(docs):
    table = docs([(k % 50, f"text {k % 7}") for k in range(503)]).withColumn("shard", F.lit("clash"))
    rows = ss.shards(table, bucket_bytes=2000).collect()
    by = slots_of(rows)
    assert len(rows) == 503
    assert sorted(by) == list(range(40))
    assert {len(s) for s in by.values()} == {12, 13}
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(r["row"]["doc_id"] for r in rows) == Counter(k % 50 for k in range(503))
    assert rows[0]["row"]["shard"] == "clash"
    # mixed: neighbours in the input do not stay together
    assert len({r["shard"] for r in rows if r["row"]["doc_id"] == 3}) > 3


def test_same_input_same_shards(docs):
    table = docs([f"t{k}" for k in range(200)])
    a, b = ({(r["row"]["doc_id"], r["shard"], r["slot"]) for r in ss.shards(table, bucket_bytes=3000).collect()}
            for _ in range(2))
    assert a == b
    assert a != {(r["row"]["doc_id"], r["shard"], r["slot"]) for r in ss.shards(table, seed=5, bucket_bytes=3000).collect()}


def test_odd_texts_few_rows_and_none(docs):
    rows = ss.shards(docs(ODD_TEXTS)).collect()
    assert sorted(r["shard"] for r in rows) == list(range(len(ODD_TEXTS)))
    assert {r["slot"] for r in rows} == {0}
    assert ss.shards(docs([])).count() == 0


def test_written_shards(spark, docs, tmp_path):
    ss.write_shards(ss.shards(docs([f"t{k}" for k in range(90)])), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 90
    assert back.select("shard").distinct().count() == 40


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    want = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = ss.op4_shuffle_shards(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(want[r["doc_id"]]) + 16, zlib.crc32(want[r["doc_id"]]))
    assert all(sorted(s) == list(range(len(s))) for s in slots_of(rows).values())
