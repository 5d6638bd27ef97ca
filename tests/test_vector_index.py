import numpy as np
import pytest

from notespark.operators import vector_index as vi
from notespark.operators import vectors

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "i")
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    odd = spark.createDataFrame([(-1, None, 1), (-2, [0.0] * 64, 1), (-3, [None] * 64, 1), (-4, [], 1)],
                                "vec_id long, embedding array<float>, label int")
    vi.build(table.unionByName(odd), path)
    return path, table


def test_every_row_is_in_one_list(spark, index):
    path, table = index
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == table.count() + 4
    assert {r.vec_id for r in rows.where("_list = -1").collect()} == {-1, -2, -3, -4}
    assert rows.where("_list >= 0").select("_list").distinct().count() > 5


def test_recall_exactness_and_lists_read(spark, index):
    path, table = index
    data = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, matrix = np.array(list(data)), np.stack([v / np.linalg.norm(v) for v in data.values()])
    asked = [int(i) for i in ids if i % 20 == 0]
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in asked], "query_id long, vector array<double>")

    def full(i):
        sims = np.round(matrix @ (data[i] / np.linalg.norm(data[i])), 6)
        return ids[np.lexsort((ids, -sims))][:10].tolist()

    def pages(**options):
        out = {}
        for r in vi.search_many(spark, path, queries, **options).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out

    near = pages(nprobe=14)
    recall = np.mean([len(set(near[i]) & set(full(i))) / 10 for i in asked])
    assert recall >= 0.95
    assert pages(nprobe=2, exact=True) == {i: full(i) for i in asked}


def test_one_query_reads_its_lists_only(spark, index):
    path, table = index
    query = vectors.vector_of(table, "vec_id", 0)
    whole = [tuple(r) for r in vectors.nearest(table, query, 10).collect()]
    assert [tuple(r) for r in vi.search(spark, path, query, nprobe=None).select(*table.columns, "score").collect()] == whole
    assert [tuple(r) for r in vi.search(spark, path, query, nprobe=1, exact=True).select(*table.columns, "score").collect()] == whole
    plan = vi.search(spark, path, query, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_list" in plan
    assert vi.search(spark, path, query, nprobe=1).count() <= 10


def test_an_empty_table_and_one_row(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vi.build(none, str(tmp_path / "e"))
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    vi.build(one, str(tmp_path / "o"))
    assert [r.vec_id for r in vi.search(spark, str(tmp_path / "o"), [1.0, 1.0]).collect()] == [1]
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert vi.search_many(spark, str(tmp_path / "e"), queries).count() == 0
