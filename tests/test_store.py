import pytest
from pyspark.sql import functions as F

from notespark.operators import chunking, dashboard
from notespark.sources import store, vault
from notespark.streaming import watcher

EVENTS = "seq long, ts timestamp, path string, event_type string"


def notes(spark, texts):
    files = spark.createDataFrame(list(texts.items()), "path string, raw_content string")
    return vault.scan(files)


def index(spark, path):
    return {r.source: r.text.split("\n\n", 1)[1] for r in store.read(spark, path).collect()}


def test_index_is_brought_up_to_date(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = notes(spark, {f"p/{i}.md": f"text {i}" for i in range(20)})
    assert store.index_notes(chunking.chunk_table(first), first, path) == {"added": 20, "updated": 0, "skipped": 0}
    second = notes(spark, {"p/1.md": "text 1", "p/2.md": "new 2", "p/x.md": "text x"})
    assert store.index_notes(chunking.chunk_table(second), second, path) == {"added": 1, "updated": 1, "skipped": 1}
    got = index(spark, path)
    assert len(got) == 21 and got["p/2.md"] == "new 2" and got["p/1.md"] == "text 1" and got["p/x.md"] == "text x"
    # running it again changes nothing
    assert store.index_notes(chunking.chunk_table(second), second, path)["skipped"] == 3
    assert index(spark, path) == got
    gone = spark.createDataFrame([("p/2.md",), ("p/absent.md",)], "source string")
    store.delete_notes(gone, path)
    assert sorted(set(got) - set(index(spark, path))) == ["p/2.md"]
    store.clear_notes(spark, path)
    assert index(spark, path) == {}
    assert store.index_notes(chunking.chunk_table(second), second, path)["added"] == 3


def test_a_note_without_chunks_is_known(spark, tmp_path):
    path = str(tmp_path / "chunks")
    empty = notes(spark, {"p/a.md": ""})
    none = chunking.chunk_table(empty).where(F.lit(False))
    assert store.index_notes(none, empty, path) == {"added": 1, "updated": 0, "skipped": 0}
    assert store.index_notes(none, empty, path) == {"added": 0, "updated": 0, "skipped": 1}


def test_new_files_take_the_next_free_name(spark):
    asked = spark.createDataFrame(
        [(i, "p", t, "note", ["a"], "body") for i, t in enumerate(["My Plan", "My Plan", "Other", "My Plan"])],
        "id long, project string, title string, note_type string, tags array<string>, content string")
    have = spark.createDataFrame([("p/my-plan.md",), ("q/other.md",)], "path string")
    made = store.new_note_files(asked, have, "2024-01-01").orderBy("id").collect()
    assert [r.path for r in made] == ["p/my-plan-1.md", "p/my-plan-2.md", "p/other.md", "p/my-plan-3.md"]
    note = vault.parse_notes(spark.createDataFrame([(made[0].path, made[0].raw_content)], "path string, raw_content string")).first()
    assert (note.title, note.project, note.tags, note.updated, note.content) == (
        "My Plan", "p", ["a"], "2024-01-01", "# My Plan\n\nbody")


def test_updates(spark):
    files = spark.createDataFrame([("p/a.md", "---\ntype: x\nupdated: 2020-01-01\n---\n\nold\n"), ("p/b.md", "plain"),
                                   ("p/c.md", "kept")], "path string, raw_content string")
    edits = spark.createDataFrame([("p/a.md", None, "more"), ("p/b.md", "new", "more"), ("p/c.md", "", None),
                                   ("../x.md", "no", None)],
                                  "path string, replace_content string, append_content string")
    done = {r.path: r.raw_content for r in store.updated_files(files, edits, "2024-01-01").collect()}
    assert done == {"p/a.md": "---\ntype: x\nupdated: 2024-01-01\n---\n\nold\n\nmore",
                    "p/b.md": "---\nupdated: 2024-01-01\n---\n\nnew"}


def test_templates_for_new_projects_only(spark):
    want = spark.createDataFrame([("old",), ("new-app",)], "project string")
    have = spark.createDataFrame([("old/x.md",)], "path string")
    made = store.project_templates(want, have, "2024-01-01").collect()
    assert sorted(r.path for r in made) == [f"new-app/{k}.md" for k in ("api", "architecture", "guidelines", "prd")]


def test_files_changed(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, checksum string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, checksum string")
    assert {(r.path, r.state) for r in store.files_changed(before, after).collect()} == {
        ("b", "changed"), ("c", "deleted"), ("d", "added")}


def test_cards(spark):
    files = spark.createDataFrame([
        ("shop/prd.md", "---\ntitle: Shop\nstatus: active\nstack: [Next.js, Prisma]\ngithub: o/shop\n---\n"
                        "# Plan\n\n## What's Next\n1. First\n- Second\nplain\n* third\n4) Third\n5. Fourth\n# End\n- no"),
        ("web/prd.md", "---\nproject: web-2\nservices: [Stripe]\n---\nno list"), ("_global/prd.md", "---\na: b\n---"),
        ("bare/prd.md", "no front matter")], "path string, raw_content string")
    commits = spark.createDataFrame([("shop", "m1", "2024-01-01", "a"), ("shop", "m2", "2024-02-01", "b")],
                                    "project string, message string, date string, hash string")
    cards = dashboard.project_cards(files, commits)
    got = {r.id: r for r in cards.collect()}
    assert sorted(got) == ["shop", "web-2"]
    assert got["shop"].whats_next == ["First", "Second", "Third"] and got["shop"].last_commit.message == "m2"
    assert got["shop"].github_url == "https://github.com/o/shop" and got["web-2"].status == "unknown"
    assert [r.id for r in dashboard.in_order(cards).collect()] == ["shop", "web-2"]
    assert [r.id for r in dashboard.filtered(cards, search="STRIPE").collect()] == ["web-2"]
    assert [r.stack for r in dashboard.stack_names(cards).collect()] == ["Next.js", "Prisma"]
    assert dashboard.counters(cards).first().asDict() == {"total": 2, "active": 1, "paused": 0, "done": 0, "idea": 0}


@pytest.mark.parametrize("path, want", [
    ("a/x.md", True), ("a/x.txt", False), (".git/x.md", False), ("_templates/x.md", False), ("index.md", False),
    ("a/log.md", False)])
def test_relevant_events(value, path, want):
    assert value(watcher.relevant(F.lit(path))) is want


def events(spark, rows):
    data = [(i, float(second), p, t) for i, (second, p, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, s double, path string, event_type string")
    return df.select("seq", (F.lit(1_700_000_000) + F.col("s")).cast("timestamp").alias("ts"), "path", "event_type")


ROWS = [(0.0, "a.md", "created"), (1.5, "a.md", "modified"), (1.6, "b.md", "created"), (3.6, "a.md", "deleted"),
        (4.0, "x.txt", "created"), (9.0, "b.md", "modified")]


def test_periods_are_of_the_whole_vault(spark):
    marked = watcher.with_period(events(spark, ROWS).where(watcher.relevant("path")))
    assert [r.period for r in marked.orderBy("seq").collect()] == [1, 1, 1, 2, 3]
    todo = {(r.period, r.path): (r.event_type, r.created) for r in watcher.pending(marked).collect()}
    assert todo == {(1, "a.md"): ("modified", True), (1, "b.md"): ("created", True),
                    (2, "a.md"): ("deleted", False), (3, "b.md"): ("modified", False)}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(i * 0.7 if i % 5 else i * 0.7 + 3, f"n{i % 4}.md", "modified") for i in range(60)]
    all_events = events(spark, rows)
    for part in range(3):
        all_events.where(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(source)
    done = []

    def apply(todo, batch_id):
        done.extend((r.ts, r.path) for r in todo.select("ts", "path").collect())

    clock = [0.0]
    watch = watcher.Watcher(spark, state, apply, clock=lambda: clock[0])
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = watch.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    clock[0] = 2e9
    watch.run(spark.createDataFrame([], EVENTS), 1 + max(int(p.name.partition("=")[2]) for p in (tmp_path / "state").iterdir()))
    want = [(r.ts, r.path) for r in watcher.pending(watcher.with_period(all_events)).collect()]
    assert sorted(done) == sorted(want)


def test_watcher_keeps_the_index(spark, tmp_path):
    path = str(tmp_path / "chunks")
    vault_files = {"a.md": "alpha", "b.md": "beta"}
    first = notes(spark, {"p/" + k: v for k, v in vault_files.items()})
    store.index_notes(chunking.chunk_table(first), first, path)
    disk = spark.createDataFrame([("p/b.md", "beta two"), ("p/c.md", "gamma")], "path string, raw_content string")

    def to_chunks(files):
        found = vault.scan(files)
        return chunking.chunk_table(found).join(found.select(F.col("path").alias("source"), "checksum"), "source")

    apply = watcher.apply_to_index(lambda changed: disk.join(changed, "path", "left_semi"), to_chunks, path)
    batch = events(spark, [(0, "p/a.md", "deleted"), (1, "p/b.md", "modified"), (2, "p/c.md", "created")])
    watch = watcher.Watcher(spark, str(tmp_path / "state"), apply)
    watch.run(batch, 0)
    want = {"p/b.md": "beta two", "p/c.md": "gamma"}
    assert index(spark, path) == want
    watch.run(batch, 0)  # a batch run again leaves the same table
    assert index(spark, path) == want


def test_a_quiet_vault_closes_its_last_period(spark, tmp_path):
    done, clock = [], [1_700_000_000.5]

    def apply(todo, batch_id):
        done.append((batch_id, sorted((r.path, r.event_type, r.created) for r in todo.collect())))

    log = str(tmp_path / "log")
    watch = watcher.Watcher(spark, str(tmp_path / "state"), apply, log=log, clock=lambda: clock[0])
    none = spark.createDataFrame([], EVENTS)
    watch.run(events(spark, [(0, "a.md", "created"), (0.2, "b.md", "modified")]), 0)
    clock[0] += 1
    watch.run(events(spark, [(1.5, "a.md", "modified")]), 1)
    clock[0] += 1
    watch.run(none, 2)
    clock[0] += 2
    watch.run(none, 3)
    watch.run(none, 4)
    last = [("a.md", "modified", True), ("b.md", "modified", False)]
    assert done == [(3, last)]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch=3", "batch=4"]
    assert spark.read.parquet(log).count() == 2


def test_a_late_period_follows_the_open_one(spark, tmp_path):
    done = []
    watch = watcher.Watcher(
        spark, str(tmp_path / "state"), lambda todo, _: done.append(sorted((r.period, r.path) for r in todo.collect())),
        clock=lambda: 1_700_000_011.0)
    watch.run(events(spark, [(10, "a.md", "created")]), 0)
    watch.run(events(spark, [(20, "b.md", "created"), (30, "c.md", "created")]), 1)
    assert done == [[(0, "a.md"), (1, "b.md")]]
