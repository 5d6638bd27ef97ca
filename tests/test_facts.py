import random

import pytest
from pyspark.sql import functions as F

from notespark.operators import extraction, facts
from notespark.sources import feeds, store

SAID = "seq long, subject string, predicate string, object string, valid_from string, confidence double"


def said(spark, rows):
    return spark.createDataFrame(rows, SAID)


def test_bulk_closure(spark):
    rows = [(i + 1, "s", "p", o, d, 1.0) for i, (o, d) in enumerate(
        [("x", "2024-01-01"), ("x", "2024-02-01"), ("y", "2024-03-01"), ("x", "2024-04-01")])]
    held = facts.with_valid_to(said(spark, rows))
    assert [r.valid_to for r in held.orderBy("seq").collect()] == ["2024-03-01", "2024-03-01", "2024-04-01", ""]
    # both ends count, so on the day of the change old and new hold
    on = held.where(facts.holds_on("2024-03-01"))
    assert sorted(r.seq for r in on.collect()) == [1, 2, 3]


def test_new_fact_closes_the_old(spark):
    rows = [(1, "app", "uses_db", "sqlite", "2026-01-01", 1.0), (2, "app", "uses_db", "postgres", "2026-06-01", 1.0)]
    held = facts.with_valid_to(said(spark, rows))
    assert [r.object for r in held.where(facts.is_active("2026-06-02")).collect()] == ["postgres"]
    assert [r.object for r in facts.timeline(held, "APP").collect()] == ["sqlite", "postgres"]
    change = facts.changes(said(spark, rows)).first()
    assert (change.old_object, change.new_object, change.severity) == ("sqlite", "postgres", "critical")


def test_invalidate(spark):
    held = said(spark, [(1, "clipnote", "uses_auth", "clerk", "2025-01-01", 1.0)]).withColumn("valid_to", F.lit(""))
    ended = spark.createDataFrame([("Clipnote", "uses_auth", "Clerk", "2026-01-01")],
                                  "subject string, predicate string, object string, ended string")
    row = facts.invalidate(held, ended).first()
    assert row.valid_to == "2026-01-01"
    assert facts.invalidate(held, ended).where(facts.is_active("2026-01-02")).count() == 0



@pytest.mark.parametrize("end, want", [("", True), ("soon", True), ("2024-01-01", True), ("2023-12-31", False)])
def test_is_active(spark, end, want):
    df = spark.createDataFrame([(end,)], "valid_to string")
    assert df.select(facts.is_active("2024-01-01").alias("a")).first().a is want


@pytest.mark.parametrize("old, new, predicate, want", [
    (1.0, 1.0, "likes", "critical"), (0.8, 1.0, "uses_db", "warning"), (0.8, 1.0, "likes", "info")])
def test_severity(spark, old, new, predicate, want):
    df = spark.createDataFrame([(old, new, predicate)], "o double, n double, predicate string")
    assert df.select(facts.severity("o", "n", "predicate").alias("s")).first().s == want


def test_contradictions_count_every_pair(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aab"), rng.choice(["uses", "likes"]), rng.choice("xyz"), "2024-01-01",
             rng.choice([0.5, 0.95])) for i in range(300)]
    held = said(spark, rows).withColumn("valid_to", F.lit(""))
    got = {r.seq: (r.conflicts, r.critical, r.warning, r.info)
           for r in facts.contradictions(held, "2024-01-01").collect()}
    want = {}
    for s, sub, pred, obj, _, conf in rows:
        old = [c for s2, sub2, p2, o2, _, c in rows if s2 < s and (sub2, p2) == (sub, pred) and o2 != obj]
        if old:
            critical = sum(c >= 0.9 and conf >= 0.9 for c in old)
            rest = len(old) - critical
            want[s] = (len(old), critical, rest if pred == "uses" else 0, 0 if pred == "uses" else rest)
    assert got == want


def test_check_search_and_stats(spark):
    held = facts.with_valid_to(said(spark, [
        (1, "app", "uses", "redis", "2024-01-01", 0.8), (2, "web", "runs", "go", "2024-01-01", 1.0)]))
    hit = facts.check(held, "App", "uses", "Kafka", "2024-02-01").first()
    assert hit.severity == "warning" and hit.message == "Conflict: app uses was 'redis' (since 2024-01-01), now 'kafka'"
    assert facts.check(held, "app", "uses", "redis", "2024-02-01").count() == 0
    assert [r.seq for r in facts.search_facts(held, "GO").collect()] == [2]
    assert facts.fact_stats(held, "2024-02-01").first().asDict() == {
        "total_facts": 2, "active_facts": 2, "expired_facts": 0, "unique_subjects": 2, "unique_predicates": 2}


def test_corrupt_store_is_empty(spark, tmp_path):
    (tmp_path / "facts.json").write_text("{not json", encoding="utf-8")
    assert feeds.read_facts(spark, str(tmp_path / "facts.json")).count() == 0
    (tmp_path / "good.json").write_text('[\n {"subject": "a", "confidence": 0.9, "extra": 1}\n]', encoding="utf-8")
    row = feeds.read_facts(spark, str(tmp_path / "good.json")).first()
    assert (row.subject, row.confidence, row.object) == ("a", 0.9, None)


def test_appended_statements_survive(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        store.append(said(spark, [(i, "s", "p", f"o{i}", f"2024-0{i + 1}-01", 0.9)]), path)
    held = facts.with_valid_to(spark.read.parquet(path))
    assert [(r.object, r.valid_to) for r in held.orderBy("seq").collect()] == [("o0", "2024-02-01"), ("o1", "")]


def extracted(spark, text):
    df = spark.createDataFrame([("app", text)], "project string, content string")
    return [(r.predicate, r.object, r.confidence) for r in extraction.candidates(df).orderBy("position").collect()]


@pytest.mark.parametrize("text, want", [
    ("We use Flutter and Redis here", [("uses_framework", "flutter", 0.8)]),
    ("Мы используем Turso для данных", [("uses_db", "turso", 0.8)]),
    ("We migrated from Redis to Turso now", [("migration_from", "redis", 0.9), ("uses", "turso now", 0.9)]),
    ("Deployed to Vercel. Deployed to Vercel!", [("deploys_to", "vercel", 0.8)]),
    ("auth via Clerk for users", [("uses_auth", "clerk", 0.8)]),
    ("Database: PostgreSQL", [("uses_db", "postgresql", 0.8)]),
    ("using x", []),
])
def test_extraction(spark, text, want):
    assert extracted(spark, text) == want


def test_known_tech(value):
    assert value(extraction.is_known_tech(F.lit("Next-JS"))) is True
    assert value(extraction.is_known_tech(F.lit("fly io"))) is True
    assert value(extraction.is_known_tech(F.lit("cobol"))) is False
    assert value(extraction.tech_name(F.lit("Turso для"))) == "turso"
    assert value(extraction.tech_name(F.lit("and more"))) == "and more"


def test_migration_ends_the_specialised_fact(spark):
    df = spark.createDataFrame([("app", "We switched from Redis to Turso", "2024-05-01")],
                               "project string, content string, created string")
    row = extraction.migrations(extraction.known_candidates(df), "created").first()
    assert (row.subject, row.predicate, row.object, row.ended) == ("app", "uses_db", "redis", "2024-05-01")


def test_entities(spark):
    df = spark.createDataFrame([("Going to use redis in Lantern, see [[Page One|x]]",)], "content string")
    assert extraction.entities(df, projects=["lantern"]).first().entities == ["Page One", "go", "lantern", "redis"]


def test_a_log_is_applied_in_order(spark, monkeypatch):
    """Against a walk entry by entry; one key has a third of the log and is cut into ranges."""
    rnd = random.Random(11)
    log = []
    for seq in range(300):
        subject = "hot" if seq % 3 == 0 else f"s{rnd.randrange(6)}"
        log.append((seq, rnd.choice(["add", "add", "end"]), subject, rnd.choice(["p", "q"]), rnd.choice("abc"), f"day{seq:03d}"))
    held = []
    for seq, kind, *key, obj, day in log:
        for fact in held:
            if fact["key"] == key and fact["to"] == "" and (fact["object"] == obj) == (kind == "end"):
                fact["to"] = day
        if kind == "add":
            held.append({"seq": seq, "key": key, "object": obj, "to": ""})
    df = spark.createDataFrame(log, "seq long, kind string, subject string, predicate string, object string, day string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: r.valid_to for r in facts.applied(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {f["seq"]: f["to"] for f in held}


def test_an_empty_log(spark):
    assert facts.applied(spark.createDataFrame(
        [], "seq long, kind string, subject string, predicate string, object string, day string")).count() == 0
