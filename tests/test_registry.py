import pytest

import __spark_entry__ as entry
from notespark.plans import registry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["bm25_topk", "chunk_documents", "facts_valid_to", "orphans", "pack_budget", "pending_changes"]


def test_every_query_has_sql():
    names, sqls = set(registry.queries()), set(registry.oracle_sql())
    assert sqls == names
    assert names <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_their_sql(spark, name):
    import glob
    import os

    import duckdb

    from check import rows_of

    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
