"""Connected components of a table of links, in rounds of joins.

Alternating large-star and small-star steps: each step gives every node the smallest neighbour of
its group, and the links end as stars around the smallest node of each component after a number of
rounds that grows with the logarithm of the longest chain.  A node with very many links is
aggregated before it is shuffled and its join is split like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import staged, unstage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over links ``(u, v)`` with ``u > v``."""
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        # neighbours above the node go to the smallest
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v")
    # neighbours below the node, and the node itself, go to the smallest
    own = joined.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v")


def stars(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of orderable values as ``(node, root)``, the root the smallest of its component.

    Roots themselves are not listed.
    """
    pairs = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        after = staged(_star(_star(pairs, True).distinct(), False).distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        unstage(pairs)
        pairs = after
        if tuple(mark) == before or not mark[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)
