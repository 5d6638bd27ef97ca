import random

from pyspark.sql import functions as F

from notespark import scale


def rows(n=1500):
    rng = random.Random(3)
    return [
        (rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.choice("xxxxxy"), f"d{i}")
        for i in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, seq long, v string, t string").repartition(3)


def test_next_different_matches_brute_force(spark):
    data = rows()
    got = {r.seq: r.o for r in scale.next_different(frame(spark, data), ["k"], "seq", "v", "t", "o").collect()}
    want = {
        s: next((t2 for k2, s2, v2, t2 in data[s + 1:] if k2 == k and v2 != v), None)
        for k, s, v, _ in data
    }
    assert got == want


def test_next_different_with_long_runs_across_ranges(spark):
    data = [("a", i, "x" if i < 900 else "y", f"d{i}") for i in range(1000)]
    got = {r.seq: r.o for r in scale.next_different(frame(spark, data), ["k"], "seq", "v", "t", "o").collect()}
    assert got == {i: "d900" if i < 900 else None for i in range(1000)}


def test_running_sum_and_previous_value(spark):
    data = rows(800)
    sums = {r.seq: r.o for r in scale.running_sum(frame(spark, data), ["k"], "seq", F.col("seq"), "o").collect()}
    assert sums == {s: sum(s2 for k2, s2, _, _ in data[:s] if k2 == k) for k, s, _, _ in data}
    before = {r.seq: r.o for r in scale.previous_value(frame(spark, data), [], "seq", "t", "o").collect()}
    assert before == {s: data[s - 1][3] if s else None for _, s, _, _ in data}


def test_ranges_balance_a_single_hot_key(spark):
    df = spark.range(10000).select(F.lit("hot").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut = scale.ranged(df, "id")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 5000
    ends = cut.groupBy("_range").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_range").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_computations_share_ranges(spark):
    cut = scale.ranged(frame(spark, rows(300)), "seq")
    both = scale.previous_value(scale.running_sum(cut, [], "seq", F.lit(1), "n"), [], "seq", "t", "o")
    assert "_range" in both.columns
    assert {r.seq: (r.n, r.o) for r in both.collect()} == {i: (i, f"d{i - 1}" if i else None) for i in range(300)}


def test_ranges_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, seq long, v string, t string")
    assert scale.next_different(empty, ["k"], "seq", "v", "t", "o").count() == 0


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = scale.top_per_key(df, ["k"], [F.desc("id")], 3)
    assert sorted((r.k, r.id, r["rank"]) for r in top.collect()) == [
        (0, 994, 3), (0, 996, 2), (0, 998, 1), (1, 995, 3), (1, 997, 2), (1, 999, 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
