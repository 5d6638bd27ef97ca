import datetime
import random

import pytest

from notespark.operators import facts
from notespark.operators.intervals import contained

DAY = datetime.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


@pytest.mark.parametrize("per_task", [1 << 20, 5])
def test_against_nested_loops(spark, per_task):
    rnd = random.Random(4)
    bound = lambda: rnd.choice([None, *range(-40, 140)])
    intervals = [(k, rnd.choice(["a", "a", "b", "c", None]), day(bound()), day(bound())) for k in range(120)]
    points = [(k, rnd.choice(["a", "a", "b", "d", None]), day(rnd.choice([None, *range(0, 101)]))) for k in range(200)]
    got = contained(
        spark.createDataFrame(points, "p long, key string, at date"),
        spark.createDataFrame(intervals, "i long, key string, low date, high date"), "key", "at", "low", "high", per_task)
    want = sorted((p, i) for p, k, at in points for i, key, low, high in intervals
                  if k is not None and at is not None and k == key and (low is None or low <= at) and (high is None or high >= at))
    assert sorted((r.p, r.i) for r in got.collect()) == want


def test_one_day_and_nothing(spark):
    intervals = spark.createDataFrame([(1, "a", day(3), day(3)), (2, "a", day(4), day(3))], "i long, key string, low date, high date")
    points = spark.createDataFrame([(1, "a", day(3)), (2, "a", day(3))], "p long, key string, at date")
    assert sorted((r.p, r.i) for r in contained(points, intervals, "key", "at", "low", "high").collect()) == [(1, 1), (2, 1)]
    assert contained(points.where("p > 5"), intervals, "key", "at", "low", "high").count() == 0


def test_probes_are_what_single_questions_give(spark):
    said = spark.createDataFrame([
        (1, "app", "uses", "react", "2024-01-01", "2024-02-01"), (2, "app", "uses", "vue", "2024-02-01", ""),
        (3, "react", "made_by", "meta", "", ""), (4, "app", "uses", "app", "soon", "2024-01-05")],
        "seq long, subject string, predicate string, object string, valid_from string, valid_to string")
    asked = [("App", "2024-01-15"), ("app", "2024-02-01"), ("react", "2024-01-01"), ("app", "2024-01-02"), ("none", "2024-01-01")]
    got = facts.probed(said, spark.createDataFrame(asked, "entity string, day string"))
    found = sorted((r.entity, r.day, r.seq) for r in got.collect())
    assert found == sorted([
        ("app", "2024-01-15", 1), ("app", "2024-02-01", 1), ("app", "2024-02-01", 2), ("react", "2024-01-01", 1),
        ("react", "2024-01-01", 3), ("app", "2024-01-02", 1), ("app", "2024-01-02", 4)])


def test_the_plan_joins_by_equality(spark):
    asked = spark.createDataFrame([("app", "2024-01-15")], "entity string, day string")
    said = spark.createDataFrame([(1, "app", "uses", "react", "2024-01-01", "")],
                                 "seq long, subject string, predicate string, object string, valid_from string, valid_to string")
    plan = facts.probed(said, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
