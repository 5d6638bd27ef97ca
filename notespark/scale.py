"""Ordered computations that survive a hot key.

A window ``partitionBy(key).orderBy(x)`` sends all rows of a key to one task.  When a
single key may hold a third of the table this does not scale, and a window without key
never does.  The functions here cut the order into ranges first: rows are processed per
(key, range), each range is summarised in one row, the few summary rows (at most one per
key and range) carry state from range to range, and are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notespark.session import cut_lineage


def ranged(df: DataFrame, order: str) -> DataFrame:
    """The rows cut by ``order`` into ranges of about equal size, numbered in ``_range``.

    Written to the shared folder once, so every later use sees the same ranges; several ordered
    computations over one table should share one call.  There are as many ranges as the session
    has shuffle partitions, less those AQE finds too small.
    """
    if "_range" in df.columns:
        return df
    return cut_lineage(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))


def _without_range(out: DataFrame, df: DataFrame) -> DataFrame:
    """Ranges stay for the next computation where the caller made them."""
    return out if "_range" in df.columns else out.drop("_range")


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, "_range"]
    match = F.lit(True)
    for name in on:
        match = match & df[name].eqNullSafe(carry[name])
    out = df.join(carry, match, "left")
    for name in on:
        out = out.drop(carry[name])
    return out


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
) -> DataFrame:
    """Add columns: for each ``out: value`` the sum of ``value`` over the key's rows before
    this one.  ``order`` must be unique within a key."""
    on = [*keys, "_range"]
    outs = list(values)
    rows = ranged(df, order)
    for out in outs:
        rows = rows.withColumn(f"_v_{out}", values[out])
    before = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    for out in outs:
        rows = rows.withColumn(f"_l_{out}", F.coalesce(F.sum(f"_v_{out}").over(before), F.lit(0)))
    totals = rows.groupBy(*on).agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in outs])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*on, *[F.sum(f"_t_{out}").over(earlier).alias(f"_c_{out}") for out in outs])
    joined = _join_carry(rows, carry, keys)
    for out in outs:
        joined = joined.withColumn(out, F.col(f"_l_{out}") + F.coalesce(f"_c_{out}", F.lit(0)))
    return _without_range(joined.drop(*[f"_{k}_{out}" for k in "vlc" for out in outs]), df)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
) -> DataFrame:
    """:func:`running_sums` of one value."""
    return running_sums(df, keys, order, {out: value})


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out``: ``value`` of the key's row just before this one, null on the first."""
    on = [*keys, "_range"]
    rows = ranged(df, order)
    rows = rows.withColumn("_local", F.lag(F.struct(value)).over(W.partitionBy(*on).orderBy(order)))
    last = rows.groupBy(*on).agg(F.max_by(F.struct(value), F.col(order)).alias("_last"))
    carry = last.select(
        *on, F.lag("_last").over(W.partitionBy(*keys).orderBy("_range")).alias("_carry")
    )
    joined = _join_carry(rows, carry, keys).withColumn(out, F.coalesce("_local", "_carry")[value])
    return _without_range(joined.drop("_local", "_carry"), df)


def next_different(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    taken: str,
    out: str,
) -> DataFrame:
    """Add ``out``: ``taken`` of the key's first later row whose ``value`` differs.

    Null when no later row differs.
    """
    on = [*keys, "_range"]
    rows = ranged(df, order)
    back = W.partitionBy(*on).orderBy(F.col(order).desc())
    so_far = back.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_next", F.lag(F.struct(value, taken)).over(back))
    rows = rows.withColumn(
        "_change",
        F.when(~F.col("_next")[value].eqNullSafe(F.col(value)) & F.col("_next").isNotNull(),
               F.struct(F.col("_next")[taken].alias("t"))),
    )
    rows = rows.withColumn("_local", F.last("_change", ignorenulls=True).over(so_far)).drop(
        "_next", "_change"
    )
    # One row per range: its first value, what follows that value inside the range, its last value.
    ends = rows.groupBy(*on).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col(taken).alias("t"), "_local"),
                 F.col(order)).alias("_first"),
        F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_last"),
    )
    forward = W.partitionBy(*keys).orderBy("_range")
    ends = ends.withColumn("_then", F.lead("_first").over(forward)).withColumn(
        "_direct",
        F.when(
            F.col("_then").isNotNull(),
            F.when(
                ~F.col("_then")["v"].eqNullSafe(F.col("_last")["v"]),
                F.struct(F.col("_then")["t"].alias("t")),
            ).otherwise(F.col("_then")["_local"]),
        ),
    )
    backward = (
        W.partitionBy(*keys).orderBy(F.col("_range").desc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    carry = ends.select(*on, F.last("_direct", ignorenulls=True).over(backward).alias("_carry"))
    joined = _join_carry(rows, carry, keys).withColumn(out, F.coalesce("_local", "_carry")["t"])
    return _without_range(joined.drop("_local", "_carry"), df)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key, with their rank.

    Filtering ``row_number() <= n`` right on the window lets Spark keep ``n`` rows per key
    in each task before the shuffle, so a hot key never travels whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
