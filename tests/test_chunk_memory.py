"""Cutting holds the pieces of a few megabytes of text at a time, whatever the batch."""

import pyarrow as pa

from notespark.operators import chunking


def test_pieces_leave_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(chunking, "FLUSH_CHARS", 1000)
    notes = [["x" * 300, "y"]] * 50 + [[]] + [["z" * 5000]]
    parts = list(chunking._flushed(iter([pa.array(notes), pa.array(notes[:0], pa.list_(pa.string()))]), lambda s: [s, s]))
    assert sum(map(len, parts), 0) == len(notes)
    assert max(map(len, parts)) == 4
    assert [note for part in parts for note in part.to_pylist()] == [[[s, s] for s in note] for note in notes]


def test_chunks_over_many_parts(spark):
    text = "word. " * 40_000
    notes = spark.range(30).selectExpr(
        "concat('p/', id, '.md') path", "'p' project", "'note' note_type", "concat('t', id) title",
        "array('a') tags", "cast(null as string) updated", "repeat('word. ', 40000 + cast(id as int)) content").coalesce(1)
    got = chunking.chunk_notes(notes).groupBy("path").count().collect()
    one = chunking.chunk_notes(notes.where("path = 'p/7.md'")).count()
    assert len(got) == 30 and {r["path"]: r["count"] for r in got}["p/7.md"] == one > len(text) // 500
