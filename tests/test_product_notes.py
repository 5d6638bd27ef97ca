"""Product notes are read by all cores, and their front matter by the quick reader."""

import pytest

from notespark.plans import corpus
from notespark.sources import vault


@pytest.mark.parametrize("block", [
    "title: Customer#000000001\nstatus: active\nstack: [Spark, UNITED STATES]\ndescription: a building project\n",
    "title: a b#c d#\nstack: [C#, F#x]\n", "title: a b-#c\n", "list:\n  - C#\n  - a#b c\n"])
def test_number_sign_inside_a_word(block):
    assert vault._simple_yaml(block) is not None
    assert vault._simple_yaml(block) == vault._yaml(block)


@pytest.mark.parametrize("block", ["title: a #b\n", "title: #b\n", "stack: [C, #d]\n", "list:\n  - a #b\n"])
def test_comments_are_left_to_yaml(block):
    assert vault._simple_yaml(block) is None


def test_one_small_file_is_parsed_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr(
        "id c_custkey", "concat('Customer#', id) c_name", "'BUILDING' c_mktsegment", "0 c_nationkey").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "FRANCE")], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    files = corpus.product_files(spark, str(tmp_path))
    assert files.count() == 40
    assert files.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
