import numpy as np

from notespark.operators import vector_index


def test_no_row_is_made_per_query_and_vector(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 40)
    monkeypatch.setattr(vector_index, "CHUNK", 16)
    monkeypatch.setattr(vector_index, "PIECE", 7)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    data[100:220] = data[7]  # a list of copies larger than a part
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    vector_index.build(rows, str(tmp_path), lists=9)
    asked = spark.createDataFrame([(k, data[k].tolist()) for k in range(0, 300, 5)], "query_id long, vector array<double>")
    pages = vector_index.search_many(spark, str(tmp_path), asked, 10, nprobe=2, exact=True)
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    expected = set()
    for q in range(0, 300, 5):
        scores = np.round(units @ units[q], 6)
        expected |= {(q, rank, int(k)) for rank, k in enumerate(sorted(range(300), key=lambda i: (-scores[i], i))[:10], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in pages.collect()} == expected
    first, count = vector_index._parts(spark, str(tmp_path), vector_index._lists(spark, str(tmp_path))[0])
    assert count.max() > 1 and len(set(first)) > 1
    assert "Join" not in pages._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[0]
