"""Joining points with the intervals that contain them, by equality only.

Days are numbers.  An interval is cut into blocks of power-of-two length, as in a segment tree: at most
two per length.  A point lies in one block of each length.  Interval and point share exactly one block
if the interval contains the point, so the pairs come from an equi-join on (key, block), without a
range join, and each pair once.  Lengths go up to the span of the points asked for.

A block of one key may still be asked for by many points.  Where there are more than ``per_task`` the
points are dealt to parts, and the block's intervals go to each of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark.session import cut_lineage


def _cover(low: Column, high: Column, levels: int) -> Column:
    """The blocks ``(level, block)`` that make up ``low`` to ``high``, both included, from 0."""

    def step(state: Column, level: Column) -> Column:
        odd_low = (state["low"] < state["high"]) & (state["low"] % 2 == 1)
        odd_high = (state["low"] < state["high"]) & (state["high"] % 2 == 1)
        taken = F.array_compact(F.array(
            F.when(odd_low, F.struct(level.alias("level"), state["low"].alias("block"))),
            F.when(odd_high, F.struct(level.alias("level"), (state["high"] - 1).alias("block")))))
        up = F.when(odd_low, state["low"] + 1).otherwise(state["low"])
        down = F.when(odd_high, state["high"] - 1).otherwise(state["high"])
        return F.struct(
            F.floor(up / 2).alias("low"), F.floor(down / 2).alias("high"),
            # both ends of one block: the interval is that block
            F.concat(state["blocks"], F.array_distinct(taken)).alias("blocks"))

    start = F.struct(
        low.cast("long").alias("low"), (high + 1).cast("long").alias("high"),
        F.array().cast("array<struct<level:int,block:bigint>>").alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["blocks"])


def contained(points: DataFrame, intervals: DataFrame, key: str, point: str, low: str, high: str,
              per_task: int = 1 << 20) -> DataFrame:
    """Pairs of a point and an interval of its key that contains it; columns of both, the key once.

    ``point``, ``low`` and ``high`` are dates; a null bound is open, and a row with a null key or point meets none.
    """
    asked = points.where(F.col(point).isNotNull() & F.col(key).isNotNull())
    number = lambda c: F.unix_date(F.col(c)).cast("long")
    span = asked.agg(F.min(number(point)).alias("first"), F.max(number(point)).alias("last")).first()  # one row
    first, last = span["first"] or 0, span["last"] or 0
    levels = max((last - first).bit_length(), 1)
    from_day = F.greatest(F.coalesce(number(low), F.lit(first)), F.lit(first)) - first
    to_day = F.least(F.coalesce(number(high), F.lit(last)), F.lit(last)) - first
    place = [key, "_level", "_block"]
    cut = intervals.where(F.col(key).isNotNull()).withColumn("_from", from_day).withColumn("_to", to_day).where("_from <= _to").select(
        "*", F.inline(_cover(F.col("_from"), F.col("_to"), levels)).alias("_level", "_block")).drop("_from", "_to")
    where = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(
        k.alias("level"), F.floor((number(point) - first) / F.pow(F.lit(2.0), k)).alias("block")))
    met = asked.select("*", F.inline(where).alias("_level", "_block"))
    many = cut_lineage(met.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > per_task).select(
        *place, F.ceil(F.col("n") / per_task).alias("_parts")))
    dealt = met.join(many, place, "left").withColumn("_part", F.when(
        F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*points.columns), "_parts")).otherwise(F.lit(0).cast("long"))).drop("_parts")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)
    copied = cut.join(many, place, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(copied, [*place, "_part"]).drop("_level", "_block", "_part")
