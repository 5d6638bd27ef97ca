"""Reciprocal rank fusion of a vector and a keyword result list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notespark import vocab


def with_rank(results: DataFrame, order: Sequence, rank: str = "rank") -> DataFrame:
    """Number a result list that a limit has already cut to the size of one page."""
    return results.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def fuse(
    vector: DataFrame,
    keyword: DataFrame,
    n: int = 10,
    key: str = "text",
    attributes: Sequence[str] = (),
    vector_weight: float = 1.0,
    keyword_weight: float = 1.0,
    k: int = vocab.RRF_K,
) -> DataFrame:
    """Merge two ranked lists by ``key``: score is the sum of weight / (k + rank).

    One union and one aggregation stand for the outer join.  A text that occurs twice in a
    list counts twice; attributes come from its first occurrence, vector side first.
    """

    def side(df: DataFrame, number: int, weight: float) -> DataFrame:
        return df.select(
            key, *attributes, F.col("rank"), F.lit(number).alias("_side"),
            (F.lit(float(weight)) / (F.lit(float(k)) + F.col("rank"))).alias("_part"),
        )

    both = side(vector, 0, vector_weight).unionByName(side(keyword, 1, keyword_weight))
    first = F.struct("_side", "rank")
    merged = both.groupBy(key).agg(
        F.sum("_part").alias("rrf_score"),
        F.min(F.when(F.col("_side") == 0, F.col("rank"))).alias("vector_rank"),
        F.max(F.when(F.col("_side") == 1, F.col("rank"))).alias("bm25_rank"),
        *[F.min_by(a, first).alias(a) for a in attributes],
    )
    return merged.orderBy(
        F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank")
    ).limit(n)


def search_method(vector_rank: str = "vector_rank", bm25_rank: str = "bm25_rank"):
    """Which lists a hit came from, with its ranks."""
    label = F.concat_ws(
        "+",
        F.when(F.col(vector_rank).isNotNull(), F.concat(F.lit("vec#"), F.col(vector_rank).cast("string"))),
        F.when(F.col(bm25_rank).isNotNull(), F.concat(F.lit("bm25#"), F.col(bm25_rank).cast("string"))),
    )
    return F.when(label != "", label).otherwise(F.lit("hybrid"))
