"""File events: which count, how they group into quiet periods, and applying them.

The quiet-time timer is one for the whole vault: a period ends when no event came for the
debounce time.  A session window keyed by a constant would send every event through one task.
Here periods are found range by range of event time, in batch and in every micro-batch alike.
The stream keeps its open period as one row per changed path, so its state grows with the paths
and not with the events, and closes it when the clock says that it has been quiet long enough.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.scale import previous_value, ranged, running_sum
from notespark.session import cut_lineage
from notespark.sources import store


def relevant(path: Column | str) -> Column:
    """Events on notes: Markdown, no hidden or template directory, no generated file."""
    path = tx.col(path)
    parts = F.split(path, "/")
    return (
        path.endswith(".md") & ~F.exists(parts, lambda p: p.startswith("."))
        & ~F.array_contains(parts, vocab.TEMPLATE_DIR)
        & ~F.element_at(parts, -1).isin(vocab.GENERATED_FILES)
    )


def with_period(events: DataFrame, quiet: float = vocab.DEBOUNCE_SECONDS) -> DataFrame:
    """Add ``period``, the number of the quiet period an event belongs to, from 1.

    Events are ``(seq, ts, ...)``.  An event at least the quiet time after the one before it
    starts a new period; events of one instant stay in order of ``seq``.
    """
    # time and sequence as one sortable key
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumn("_us", micros).withColumn(
        "_at", F.concat(F.lpad((micros + F.lit(10**18)).cast("string"), 20, "0"), F.lit(" "),
                        F.lpad(F.col("seq").cast("string"), 20, "0"))
    )
    rows = previous_value(ranged(rows, "_at"), [], "_at", "_us", "_prev")
    starts = F.when(
        F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= F.lit(int(quiet * 1_000_000))), 1
    ).otherwise(0)
    rows = running_sum(rows.withColumn("_new", starts), [], "_at", F.col("_new"), "_before")
    return rows.withColumn("period", F.col("_before") + F.col("_new")).drop(
        "_us", "_at", "_prev", "_new", "_before", "_range"
    )


def periods(events: DataFrame, quiet: float = vocab.DEBOUNCE_SECONDS) -> DataFrame:
    """Start, end and number of events of every quiet period."""
    return with_period(events, quiet).groupBy("period").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")
    )


def pending(with_periods: DataFrame) -> DataFrame:
    """What is left to do per period and path: the last event decides.

    ``created`` tells whether a creation was among the events, which the last event hides.
    """
    return _folded(with_periods.withColumn("created", F.col("event_type") == "created")).drop("seq")


def _folded(rows: DataFrame) -> DataFrame:
    """One row per period and path, of events or of rows folded before."""
    order = F.struct("ts", "seq")
    return rows.groupBy("period", "path").agg(
        F.max_by("event_type", order).alias("event_type"), F.max("created").alias("created"),
        F.max("ts").alias("ts"), F.max_by("seq", order).alias("seq"),
    )


def period_counts(todo: DataFrame) -> DataFrame:
    """Created, modified and deleted notes of each period."""
    return todo.groupBy("period").agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in ("created", "modified", "deleted")]
    )


STATE = "period long, path string, event_type string, created boolean, ts timestamp, seq long"


class Watcher:
    """Micro-batches of file events to batches of note changes.

    ``apply(todo, batch_id)`` gets one row per path of the closed periods, and is not called where none
    closed; it must be idempotent, as an upsert by path is, because a batch whose commit was lost is run again.
    The open period is kept in ``state/batch=<id>``, a row per path; a rerun reads the state of the
    batch before it and so finds the same events.  Older states are removed.  With ``log`` every
    applied change is also written there, a folder per batch.

    ``clock`` tells the seconds since 1970 by which a period has been quiet long enough.
    """

    def __init__(self, spark: SparkSession, state: str, apply: Callable[[DataFrame, int], None],
                 quiet: float = vocab.DEBOUNCE_SECONDS, log: str | None = None,
                 clock: Callable[[], float] = time.time):
        self.spark, self.state, self.apply, self.quiet = spark, state, apply, quiet
        self.log, self.clock = log, clock

    def _path(self, batch_id: int) -> str:
        return f"{self.state}/batch={batch_id}"

    def _open(self, batch_id: int) -> DataFrame:
        if batch_id < 0 or not store.exists(self.spark, self._path(batch_id)):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self._path(batch_id))

    def run(self, batch: DataFrame, batch_id: int) -> None:
        now = int(self.clock() * 1_000_000)
        wait = int(self.quiet * 1_000_000)
        fresh = with_period(batch.select(
            "seq", F.col("ts").cast("timestamp").alias("ts"), "path", "event_type").where(relevant("path")), self.quiet)
        fresh = cut_lineage(fresh.withColumn("created", F.col("event_type") == "created"))
        held = self._open(batch_id - 1)
        begin = fresh.agg(F.min(F.unix_micros("ts"))).first()[0]
        last = held.agg(F.max(F.unix_micros("ts"))).first()[0]
        # the open period goes on where the first new event comes soon enough, else it is over
        joins = begin is not None and last is not None and begin - last < wait
        both = held.withColumn("period", F.lit(1 if joins else 0).cast("long")).unionByName(
            fresh.select("period", "path", "event_type", "created", "ts", "seq"))
        todo = cut_lineage(_folded(both))
        end = todo.agg(F.max("period"), F.max_by(F.unix_micros("ts"), F.struct("period", "ts"))).first()
        still_open = end[0] is not None and now - end[1] < wait
        closed = todo.where(F.col("period") < end[0]) if still_open else todo
        if not closed.isEmpty():
            self.apply(closed.drop("seq"), batch_id)
            if self.log:
                closed.drop("seq").write.mode("overwrite").parquet(f"{self.log}/batch={batch_id}")
        left = todo.where(F.col("period") == end[0]) if still_open else todo.where(F.lit(False))
        left.write.mode("overwrite").parquet(self._path(batch_id))
        store.delete(self.spark, self._path(batch_id - 2))  # a rerun needs the state just before it

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        """Start the stream; ``events`` is a streaming table of ``FILE_EVENT`` rows.

        A heartbeat goes along with the events, so that a period is closed also when no event comes.
        """
        columns = ["seq", "ts", "path", "event_type"]
        beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        kinds = {f.name: f.dataType for f in events.schema.fields}
        beat = beat.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
        writer = events.select(*columns).unionByName(beat).writeStream.foreachBatch(lambda df, i: self.run(df, i))
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def apply_to_index(read_files: Callable[[DataFrame], DataFrame], to_chunks: Callable[[DataFrame], DataFrame],
                   path: str) -> Callable[[DataFrame, int], None]:
    """An ``apply`` for :class:`Watcher` that keeps a chunk table up to date.

    ``read_files`` gives the files of the changed paths, ``to_chunks`` their chunks.  A batch that was
    committed before is not written again.
    """

    def apply(todo: DataFrame, batch_id: int) -> None:
        last = todo.groupBy("path").agg(F.max_by("event_type", "period").alias("event_type"))
        last = cut_lineage(last)
        changed = last.where("event_type <> 'deleted'").select("path")
        chunks = to_chunks(read_files(changed))
        store.upsert(chunks, path, "source", deleted=last.select(F.col("path").alias("source")),
                     writer=("watcher", batch_id))

    return apply
