import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import vector_codes as vc

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Python of the contract: {(id, vector): (code, error)}, label sums, digest of the codebooks."""
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, label, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, sums = [], {}
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, code, error, sums[label], digest) for i, code, error, label in out)


def result(table):
    coded, books = vc.encode(table)
    rows = vc.with_label_error(coded).select("row.vec_id", "code", "error", "label_error").collect()
    return [(*r, vc.books_sha256(books)) for r in rows]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def vectors(n, seed=1, dims=16, ids=None):
    rnd = random.Random(seed)
    return [(k if ids is None else ids[k], rnd.choice([None, 1, 2]), [round(rnd.gauss(0, 0.1), 3) for _ in range(dims)]) for k in range(n)]


def single(rows):
    """Components as single precision, as Spark stores them."""
    return [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(tuple(r) for r in vc.op13_vector_codes(spark, folder).collect()) == brute(rows)


def test_ties_copies_and_bad_rows(spark):
    rows = vectors(60)
    rows += [(100 + k, 1, [0.0] * 16) for k in range(30)]  # a hot vector
    rows += [(200, 1, None), (201, 2, [None] * 16), (202, 2, [math.nan] * 16), (203, None, [math.inf] + [0.0] * 15),
             (204, 1, [-math.inf] + [0.0] * 15)]
    rows += [(300, 3, [-1e-9] * 16), (301, 3, [1.0, -1.0] * 8), (302, 3, [-0.5] * 16), (303, 3, [-0.5] * 16)]
    got = sorted(result(table(spark, rows).repartition(5)))
    assert got == brute(single(rows))
    assert len(got) == 60 + 30 + 4


def test_fewer_vectors_than_entries(spark):
    rows = vectors(5)
    assert sorted(result(table(spark, rows))) == brute(single(rows))


def test_repeated_ids_null_ids_and_clashing_names(spark):
    rows = vectors(40, ids=[None, 7, 7] + list(range(10, 47)))
    extra = table(spark, rows).withColumn("code", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("ints", F.lit(2))
    coded, _ = vc.encode(extra.unionByName(extra.where("vec_id = 7")))
    out = vc.with_label_error(coded)
    assert out.count() == 42
    assert out.select("row.code").distinct().collect()[0][0] == "clash"
    assert {r["n"] for r in out.groupBy("row.embedding").agg(F.count_distinct("code").alias("n")).collect()} == {1}


def test_other_lengths_keep_their_row(spark):
    rows = vectors(20) + [(50, 1, [0.5] * 3), (51, 1, [])]
    got = {r[0]: r for r in result(table(spark, rows))}
    assert got[50][1:3] == (None, None) and got[51][1:3] == (None, None)
    want = {r[0]: r[1:3] for r in brute(single(rows[:20]))}
    assert all(got[i][1:3] == w for i, w in want.items())


def test_length_that_the_parts_do_not_divide(spark):
    coded, books = vc.encode(table(spark, vectors(30, dims=11)))
    assert [b.shape[1] for b in books] == [1, 1, 2, 1, 1, 2, 1, 2]
    assert coded.where("length(code) = 16").count() == 30


def test_huge_components_count_as_the_bound(spark):
    coded, _ = vc.encode(table(spark, [(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16), *vectors(20, ids=range(10, 30))]), rounds=1)
    assert coded.where("error < 0").count() == 0
    assert coded.count() == 22


def test_an_empty_table(spark):
    coded, books = vc.encode(table(spark, [(1, 1, None)]))
    assert vc.with_label_error(coded).count() == 0
    assert vc.books_sha256(books) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("across", [1, 2, 8])
def test_the_grid_never_drops_a_nearest_entry(across):
    rnd = np.random.default_rng(across)
    entries = rnd.integers(-500, 500, (16, 8))
    entries[5] = entries[9]
    x = np.concatenate((rnd.integers(-700, 700, (3000, 8)), entries, np.full((1, 8), 1 << 27), np.full((1, 8), -(1 << 27))))
    grid = vc.Grid(entries, across)
    want = ((x[:, None] - entries) ** 2).sum(2)
    for _ in range(2):  # the second time from the memo
        entry, distance = grid.nearest(x)
        assert (entry == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert grid.left.sum(1).min() >= 1


def test_the_memo_is_bounded_and_prunes(monkeypatch):
    monkeypatch.setattr(vc, "MEMO_CELLS", 50)
    rnd = np.random.default_rng(3)
    entries = rnd.integers(-500, 500, (16, 4))
    grid = vc.Grid(entries, 8)
    x = rnd.integers(-500, 500, (4000, 4))
    want = ((x[:, None] - entries) ** 2).sum(2).argmin(1)
    for k in range(0, 4000, 500):
        assert (grid.nearest(x[k:k + 500])[0] == want[k:k + 500]).all()
    assert len(grid.keys) == 50
    assert grid.candidates(x).sum() < x.shape[0] * 16 / 2


def test_cells_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(vc, "_FACTORS", np.zeros(64, np.uint64))
    rnd = np.random.default_rng(4)
    entries, x = rnd.integers(-500, 500, (16, 8)), rnd.integers(-500, 500, (500, 8))
    grid = vc.Grid(entries)
    assert (grid.nearest(x)[0] == ((x[:, None] - entries) ** 2).sum(2).argmin(1)).all()
