"""Packing token ids into windows by bounded-space best fit.

Each task keeps a fixed number of open windows.  A document longer than a window fills whole
windows first; what remains goes into the open window that it fills most tightly.  When none has
room and all windows are open, the fullest is emitted.  A task's last open windows are leftovers:
those of each ``MERGE`` tasks are merged, one after the other, and cut where a window is full.

Memory per task is the open windows and one batch.  The leftovers are at most ``open_windows`` per
task, so no group gathers more than ``MERGE * open_windows`` windows, whatever the size of the input.

Defined cases: a null text is the empty text, a piece of the end id alone; repeated rows are packed
like others; an empty table gives no pieces; other columns come back inside ``row`` on request.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notespark.llm import tokens
from notespark.llm.common import batch_of, documents, staged, task_number, whole_text
from notespark.llm.token_files import with_end

WINDOW = 2048
OPEN_WINDOWS = 64
MERGE = 16
FLUSH_BYTES = 8 << 20
#: Rows of a slice of texts up to this size are copied once for all, larger ones one by one.
SHARED_BYTES = 64 << 10
#: A window's number: the task above these bits, its count in the task below.
TASK_BITS = 36
#: Numbers of merged windows start above those of all tasks.
MERGED_IDS = 1 << 26


class OpenWindows:
    """A fixed number of open windows, best fit; ``done`` holds those that were emitted."""

    def __init__(self, window: int, bound: int) -> None:
        self.window, self.bound = window, bound
        self.room: list[tuple[int, int]] = []  # (room left, number), ascending
        self.held: dict[int, list] = {}
        self.done: list[list] = []
        self.next = 0

    def place(self, size: int, item) -> None:
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            if len(self.room) == self.bound:
                _, fullest = self.room.pop(0)
                self.done.append(self.held.pop(fullest))
            room, number = self.window, self.next
            self.next += 1
            self.held[number] = []
        self.held[number].append((size, item))
        if room == size:
            self.done.append(self.held.pop(number))
        else:
            bisect.insort(self.room, (room - size, number))

    def leftovers(self) -> list[list]:
        return [self.held[number] for _, number in self.room]


PIECES = "row {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, open boolean"


def _pack(vocabulary: str, separated: bool, end_id: int, window: int, bound: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, separated)
        base, number = task_number() << TASK_BITS, 0
        windows = OpenWindows(window, bound)
        out: list = []
        size = 0

        def emit(pieces, still_open):
            nonlocal number, size
            offset = 0
            for length, (row, start, total, ids) in pieces:
                out.append((row, start, length, total, ids, base + number, offset, still_open))
                offset += length
                size += 4 * length + 64
            number += 1

        def flushed():
            nonlocal size
            columns = list(zip(*out, strict=True))
            rows_out = pa.concat_arrays(list(columns[0]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            batch = batch_of(
                {"row": rows_out}
                | {n: pa.array(c, k) for n, c, k in zip(
                    ("start", "length", "doc_tokens", "ids", "sequence_id", "offset", "open"), columns[1:], kinds, strict=True)})
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for i, j in tokens.slices(batch.column(1)):
                part = batch.slice(i, j - i)
                rows, shared = _rows(part.column(0))
                ids, counts = encoder.encode(part.column(1))
                ids = with_end(ids, counts, end_id).astype("<u4")
                ends = np.cumsum(counts + 1)
                for k in range(len(part)):
                    total = int(counts[k]) + 1
                    first = int(ends[k]) - total
                    row = rows.slice(k, 1)
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        raw = ids[first + start:first + start + length].tobytes()
                        piece = (row, start, total, raw)
                        if length == window:
                            emit([(length, piece)], False)
                        else:
                            windows.place(length, (row if shared else _own(row), start, total, raw))
                        for done in windows.done:
                            emit(done, False)
                        windows.done.clear()
                        if size >= FLUSH_BYTES:
                            yield flushed()
        for left in windows.leftovers():
            emit(left, True)
        if out:
            yield flushed()

    return work


def _rows(rows: pa.Array) -> tuple[pa.Array, bool]:
    """The rows of a slice, and whether an open window may hold on to all of them: a copy of few bytes."""
    if rows.nbytes > SHARED_BYTES:
        return rows, False
    return rows.take(pa.array(np.arange(len(rows)))), True


def _own(row: pa.Array) -> pa.Array:
    """A copy of one row that does not keep its whole batch in memory."""
    return row.take(pa.array([0]))


def pack(docs: DataFrame, vocabulary: str, separated: bool = False, end_id: int = 1, window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The documents' ids in pieces: which window (``sequence_id``) and where in it (``offset``).

    Returns ``row`` (the columns ``keep`` of the document), ``start`` (ids of the document before
    the piece), ``length``, ``doc_tokens``, ``ids`` (packed 32-bit), ``sequence_id``, ``offset``.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), whole_text(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    pieces = staged(
        rows.mapInArrow(_pack(vocabulary, separated, end_id, window, open_windows), PIECES.format(kind=kind)),
        "pack-pieces")
    names = ["row", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    return pieces.where("NOT open").select(*names).unionByName(_merged(pieces.where("open"), window).select(*names))


def _merged(left: DataFrame, window: int) -> DataFrame:
    """The leftovers of each ``MERGE`` tasks one after the other, cut into full windows.

    At most ``MERGE * open_windows`` windows meet in a group, and one window of a group is padded.
    """
    stream = F.shiftright("sequence_id", TASK_BITS) / F.lit(MERGE)
    sizes = left.groupBy("sequence_id").agg(F.sum("length").alias("size")).withColumn("stream", F.floor(stream))
    before = F.sum("size").over(
        W.partitionBy("stream").orderBy("sequence_id").rowsBetween(W.unboundedPreceding, -1))
    placed = sizes.select(
        F.col("sequence_id").alias("was"), "stream", F.coalesce(before, F.lit(0)).alias("at"))
    at = F.col("at") + F.col("offset")
    pieces = left.join(placed, F.col("sequence_id") == F.col("was")).withColumn("at", at).withColumn(
        "head", F.least(F.col("length"), F.lit(window) - F.col("at") % window))
    parts = F.filter(
        F.array(F.struct(F.lit(0).cast("long").alias("skip"), F.col("head").alias("size")),
                F.struct(F.col("head").alias("skip"), (F.col("length") - F.col("head")).alias("size"))),
        lambda part: part["size"] > 0)
    cut = pieces.select("row", "start", "doc_tokens", "ids", "stream", "at", F.explode(parts).alias("part"))
    place = F.col("at") + F.col("part.skip")
    return cut.select(
        "row", (F.col("start") + F.col("part.skip")).alias("start"), F.col("part.size").alias("length"), "doc_tokens",
        F.col("ids").substr((4 * F.col("part.skip") + 1).cast("int"), (4 * F.col("part.size")).cast("int")).alias("ids"),
        (F.shiftleft(F.lit(MERGED_IDS).cast("long") + F.col("stream"), TASK_BITS) + F.floor(place / window)).alias("sequence_id"),
        (place % window).alias("offset"))


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select(
        F.col("row.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def op3_pack_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    import public_tokenizers

    return digests(pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op3_pack_windows": op3_pack_windows}
ORACLE: dict = {}
