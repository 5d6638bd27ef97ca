"""The documents, cleaned, mixed and packed: five stages, each written and read again.

    quality rules      rejected documents go
    exact dedup        of equal texts the row with the largest id stays
    near dedup         of texts linked by a five-word Jaccard similarity of 0.8 or more the row with the smallest id stays
    mixing             sources cut down to target weights, no document twice
    packing            windows of 2048 ids

A stage takes what its predecessor kept, and all but the last return the columns of ``documents``.
Nulls, empty tables and repeated rows are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm import exact_dedup, mixing, near_sets, pack_windows, quality_rules
from notespark.llm.common import documents, scratch

#: Nine tenths of the tokens, once each; where that is more than a leaf has, its siblings get the rest.
MIX = mixing.Mix(weights=mixing.MIX.weights, share=0.9, epochs=1)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 5; rules learned from the labels of the folder."""
    judged = quality_rules.judged(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return judged.where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 8."""
    return exact_dedup.unique(docs).select("row.*")


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Near copies by their five-word shingles, compared in full: the row with the smallest id of each component."""
    return near_sets.representatives(docs).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 10."""
    return mixing.mixed(docs, MIX, mixing.document_levels()).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 3: a row per piece of a document in a window."""
    import public_tokenizers

    return pack_windows.digests(pack_windows.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]
#: The learned rules and the tokenizer are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, folder)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, folder).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
