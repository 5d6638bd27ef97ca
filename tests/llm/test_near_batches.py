"""Blocks of sets reach Python few at a time, and are not copied there."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notespark.llm import common, near_sets


def test_large_rows_come_in_small_batches_and_the_setting_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("sets"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["rows"])

    with common.small_batches(spark):
        got = common.staged(rows.mapInArrow(sizes, "rows long"), "batches").collect()
    assert spark.conf.get(name) == before
    assert sum(r.rows for r in got) == 40 and max(r.rows for r in got) <= 10


def test_near_dedup_sends_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", set()
    held = near_sets.staged
    monkeypatch.setattr(near_sets, "staged", lambda df, what: seen.add(df.sparkSession.conf.get(name)) or held(df, what))
    docs = spark.createDataFrame([(k, f"a b c d e f g {k // 2}") for k in range(6)], "doc_id long, text string")
    assert sorted(r.row.doc_id for r in near_sets.representatives(docs).collect()) == [0, 2, 4]
    assert seen == {str(common.BATCH_BYTES)}


def _batch(rows):
    names = ["key", "salt", "number", "root", "shingles"]
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)


def test_blocks_across_batches_and_met_without_copies():
    sets = [np.arange(k, k + 30, dtype="<u8").tobytes() for k in (0, 1, 500, 2)]
    rows = [(7, 0, 1, 1, sets[0]), (7, 0, 2, 2, sets[1]), (7, 1, 3, 3, sets[2]), (7, 1, 4, 4, sets[3]), (9, 0, 5, 5, b"")]
    got = list(near_sets._blocks(iter([_batch(rows[:1]), _batch(rows[1:3]), _batch([]), _batch(rows[3:])])))
    assert [(b.column(0)[0].as_py(), b.column(1)[0].as_py(), b.column(2)[0].as_py()) for b in got] == [
        (7, 0, [1, 2]), (7, 1, [3, 4]), (9, 0, [5])]
    assert got[1].column(4)[0].as_py() == sets[2:]
    names = ["numbers", "roots", "sets"]
    alone, other = ([b.column(c) for c in (2, 3, 4)] for b in got[:2])
    none = [pa.nulls(1, c.type) for c in alone]

    def links(ours, theirs):
        row = pa.RecordBatch.from_arrays([*ours, *theirs], [*names, *(f"{n}_b" for n in names)])
        out = near_sets._met(0.8)(iter([row]))
        return {frozenset((a, b)) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}

    assert links(alone, none) == {frozenset((1, 2))} and links(other, none) == set()
    assert links(alone, other) in ({frozenset((1, 4))}, {frozenset((2, 4))}, {frozenset((1, 4)), frozenset((2, 4))})
