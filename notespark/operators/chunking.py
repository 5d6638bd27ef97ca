"""Splitting notes into search chunks.

Where a chunk ends depends on where the one before ended, so cutting a long section is a
walk through its text.  That walk alone runs in Python, over Arrow batches and in bounded memory;
sections, prefixes and numbering are column expressions, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from notespark import vocab
from notespark.functions import text as tx


#: Characters whose pieces a worker holds before it gives them back.
FLUSH_CHARS = 2 << 20
PIECES = pa.list_(pa.list_(pa.string()))


def _flushed(batches: Iterator[pa.Array], cut) -> Iterator[pa.Array]:
    """The pieces of each note's sections, given back every few megabytes.

    A batch comes as Arrow; one note of it at a time is made of Python strings.
    """
    for batch in batches:
        out, held = [], 0
        for note in batch:
            sections = note.as_py()
            out.append([cut(s) for s in sections])
            held += sum(map(len, sections))
            if held >= FLUSH_CHARS:
                yield pa.array(out, PIECES)
                out, held = [], 0
        if out:
            yield pa.array(out, PIECES)


def _cutter(size: int, overlap: int):
    def cut(text: str) -> list[str]:
        if len(text) <= size:
            return [text]
        pieces, start, total = [], 0, len(text)
        while True:
            end = start + size
            if end < total:
                stop = max(text.rfind(". ", start, end), text.rfind("\n", start, end)) + 1
                if stop - 1 - start > size // 2:
                    end = stop
            piece = text[start:end].strip()
            if piece:
                pieces.append(piece)
            if end >= total:
                return pieces
            start = end - overlap

    @arrow_udf(ArrayType(ArrayType(StringType())))
    def cut_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _flushed(batches, cut)

    return cut_all


def sections(content):
    """Array of (section, text): a new section at every line that starts with ``#``."""
    parts = F.transform(F.split(content, "\n(?=#)"), tx.strip)
    named = F.transform(
        parts,
        lambda s: F.struct(
            F.when(
                s.startswith("#"),
                tx.strip(F.regexp_replace(F.split_part(s, F.lit("\n"), F.lit(1)), r"^#+", "")),
            ).otherwise(F.lit("")).alias("section"),
            s.alias("text"),
        ),
    )
    return F.filter(named, lambda s: s["text"] != "")


def chunk_notes(
    notes: DataFrame, size: int = vocab.CHUNK_SIZE, overlap: int = vocab.CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: all note columns, ``section``, ``chunk_index`` and ``text``.

    Each section starts with the note's context line; a section longer than ``size`` is cut
    after the last sentence or line end in its second half, else at ``size``, and pieces
    overlap.  A tail that lies inside the piece before it is not repeated.
    """
    if overlap > size // 2:
        raise ValueError("overlap must be at most half the chunk size")
    prefix = F.concat(
        F.lit("[Project: "), "project", F.lit("] ["), "note_type", F.lit("] "), "title",
        F.lit("\n\n"),
    )
    parts = tx.once(notes, _s=sections(F.col("content")), _p=prefix)
    texts = F.transform("_s", lambda s: F.concat(F.col("_p"), s["text"]))
    cut = parts.withColumn("_c", _cutter(size, overlap)(texts))
    flat = F.flatten(
        F.zip_with(
            "_s", "_c",
            lambda s, pieces: F.transform(
                pieces, lambda piece: F.struct(s["section"].alias("section"), piece.alias("text"))
            ),
        )
    )
    return cut.select(
        *notes.columns, F.posexplode(flat).alias("chunk_index", "_x")
    ).select(
        *notes.columns, F.col("_x.section").alias("section"), "chunk_index",
        F.col("_x.text").alias("text"),
    )


def chunk_table(notes: DataFrame, **sizes: int) -> DataFrame:
    """Chunks as the index stores them."""
    return chunk_notes(notes, **sizes).select(
        F.concat_ws("::chunk_", "path", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("path").alias("source"), "project", F.col("note_type").alias("type"), "tags",
        "updated", "section", "chunk_index", "text",
    )
