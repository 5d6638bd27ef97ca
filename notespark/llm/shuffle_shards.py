"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets by a seeded hash; the number of buckets
follows the bytes, so that each fits in memory.  Pass two reads a bucket, puts it into a defined
order, shuffles it by Fisher-Yates and writes it.  The buckets one after the other are a random
order of all records; it is cut into shards whose row counts differ by one at most (law ``rows``).

The hash takes the record's number in the input beside its id, so rows with equal ids or equal
texts scatter like any others and no bucket is hot.  The same files read with the same split
settings give the same shards.

Defined cases: a null text has no bytes and stays null; repeated rows are shuffled like others; an
empty table gives no rows; with fewer rows than shards some shards stay empty; all input columns
come back inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notespark.llm.common import as_rows, documents, staged

SHARDS = 40
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16


def record_bytes(text: str) -> F.Column:
    return (F.coalesce(F.octet_length(F.col(f"row.`{text}`")), F.lit(0)) + ROW_BYTES).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of ``range(n)``."""
    order = np.arange(n)
    swaps = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else order
    for k in range(n - 1, 0, -1):
        j = swaps[n - 1 - k]
        order[k], order[j] = order[j], order[k]
    return order


def _shuffled(seed: int):
    """Shuffle the one bucket of a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        bucket = pa.Table.from_batches(held).combine_chunks().sort_by([("draw", "ascending"), ("number", "ascending")])
        number = bucket["bucket"][0].as_py()
        bucket = bucket.take(pa.array(fisher_yates(len(bucket), seed * 1_000_003 + number)))
        bucket = bucket.append_column("place", pa.array(np.arange(len(bucket)), pa.int64()))
        yield from bucket.select(["row", "bucket", "place"]).to_batches(max_chunksize=2000)

    return work


def shards(docs: DataFrame, count: int = SHARDS, seed: int = 11, text: str = "text", doc_id: str = "doc_id",
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each row with its ``shard`` and its ``slot`` there (gapless from 0).

    Returns ``row`` (the input row), ``bucket``, ``shard`` (int) and ``slot`` (long).
    """
    rows = as_rows(docs)
    kind = rows.schema["row"].dataType.simpleString()
    total = rows.agg(F.sum(record_bytes(text))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    drawn = rows.withColumn("number", F.monotonically_increasing_id()).withColumn(
        "draw", F.xxhash64(F.lit(seed), F.col(f"row.`{doc_id}`"), "number"))
    scattered = drawn.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int")).repartitionById(
        buckets, F.col("bucket"))
    # the written buckets: (bucket, place) is the shuffled order
    written = staged(
        scattered.mapInArrow(_shuffled(seed), f"row {kind}, bucket int, place long"), "shuffle-buckets")
    sizes = written.groupBy("bucket").agg(F.count("*").alias("_rows"))
    # one row per bucket; staged, so that the join is planned by the size of its file
    before = staged(sizes.select(
        "bucket", F.sum("_rows").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.sum("_rows").over(W.partitionBy()).alias("_all")), "shuffle-offsets")
    place = F.col("place") + F.coalesce("_before", F.lit(0))
    # the first `extra` shards have one row more than the others
    least, extra = F.floor(F.col("_all") / count), F.col("_all") % count
    long_rows = extra * (least + 1)
    shard = F.when(F.col("_at") < long_rows, F.floor(F.col("_at") / (least + 1))).otherwise(
        extra + F.floor((F.col("_at") - long_rows) / F.greatest(least, F.lit(1))))
    start = F.col("shard") * least + F.least(F.col("shard").cast("long"), extra)
    return (
        written.join(before, "bucket").withColumn("_at", place).withColumn("shard", shard.cast("int"))
        .select("row", "bucket", "shard", (F.col("_at") - start).cast("long").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet, a folder each, in the order of the slots within each file."""
    sharded.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)


def op4_shuffle_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of equal row counts."""
    docs = documents(spark, folder).select("doc_id", "text")
    return shards(docs).select(
        F.col("row.doc_id").alias("doc_id"), record_bytes("text").alias("size"),
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_shuffle_shards": op4_shuffle_shards}
ORACLE: dict = {}
