import pytest
from pyspark.sql import functions as F

from notespark.operators import sessions, snapshots
from notespark.sources import vault


def scan(spark, files):
    return vault.scan(spark.createDataFrame(list(files.items()), "path string, raw_content string"))


SESSION = """---
project: app
type: note
tags: [session]
---

# Session {day}

## What Was Done
- nothing to report here

### What Failed / Issues
- Firebase init crashed, workaround: clear the cache
- short
* Build failed at /src/main.dart on 2026-04-{day} for commit abcdef0123

## Next
- not an issue at all
"""


@pytest.fixture
def notes(spark):
    return scan(spark, {
        "app/session-1.md": SESSION.format(day="01"), "app/session-2.md": SESSION.format(day="02"),
        "web/log.md": "# Log\n\n### Issues\n- API timeout error, switched to polling\n",
        "web/deep/log.md": "# Log\n\n### Issues\n- not read, lies too deep in here\n",
    })


def test_issues(notes):
    found = sessions.issues(sessions.failure_notes(notes)).collect()
    assert sorted((r.path, r.category, r.workaround) for r in found) == [
        ("app/session-1.md", "build", ""), ("app/session-1.md", "crash", "clear the cache"),
        ("app/session-2.md", "build", ""), ("app/session-2.md", "crash", "clear the cache"),
        ("web/log.md", "api", "polling")]
    assert sessions.session_notes(notes).count() == 2


def test_reports(notes):
    found = sessions.issues(sessions.failure_notes(notes))
    again = sessions.repeating(found).collect()
    assert [(r["count"], r.projects, r.category, r.workaround) for r in again] == [
        (2, 1, "build", ""), (2, 1, "crash", "clear the cache")]
    assert again[0].pattern == "Build failed at <path> on <date> for commit <hash>"
    share = {r.category: (r["count"], r.pct) for r in sessions.category_share(found).collect()}
    assert share == {"build": (2, 40), "crash": (2, 40), "api": (1, 20)}
    assert [r.workaround for r in sessions.workarounds(found).collect()] == ["clear the cache", "polling"]
    advice = sessions.recommendations(found, 2)
    assert len(advice) == 3
    top = sessions.repeating(found, 1).first()
    projects = sorted({r.project for r in found.where(F.col("pattern") == top["pattern"]).collect()})
    assert advice[0].endswith(f"appeared {top['count']} times across {', '.join(projects)}")
    assert sessions.recommendations(found.where(F.lit(False)), 2)[0].startswith("No issues found")


@pytest.mark.parametrize("text, want", [
    ("Firebase init crashed", "crash"), ("API timeout error", "api"), ("Build failed", "build"),
    ("Browser tool broken", "tool"), ("Something random happened", "other")])
def test_categories(value, text, want):
    assert value(sessions.category(F.lit(text))) == want


DECISION = "---\nproject: app\ntype: decision\ncreated: {day}\n---\n\n# {title}\n\n## Decision\nTake it.\n"
OUTCOME = "\n## Outcome (later)\n**Status**: {status}\n**Lessons learned**: {lesson}\nmore\n\n## Other\nStatus: failed\n"


def test_outcomes(spark):
    files = {
        "app/a.md": DECISION.format(day="2024-05-30", title="A") + OUTCOME.format(status="Success", lesson="ship early"),
        "app/b.md": DECISION.format(day="2024-05-20", title="B") + "\n## Outcome\nStatus: failed\nno gain\n",
        "app/c.md": DECISION.format(day="2024-05-29", title="C"),
        "app/d.md": DECISION.format(day="2024-05-28", title="D") + "\n### Outcome\nno state\n",
    }
    notes = scan(spark, files)
    found = sessions.outcomes(notes)
    got = {r.title: (r.status, r.lessons) for r in found.collect()}
    assert got == {"A": ("success", "ship early"), "B": ("failed", ""), "C": (None, None), "D": ("unknown", "")}
    assert sessions.outcome_counts(found).first().asDict() == {
        "total_decisions": 4, "with_outcomes": 3, "without_outcomes": 1, "success_count": 1,
        "partial_count": 0, "failed_count": 1}
    rules = [(r.kind, r.rule) for r in sessions.auto_rules(found).orderBy("kind", "path").collect()]
    assert rules[0] == ("DO", "**app**: ship early")
    # without a lesson the outcome text speaks
    assert rules[1][0] == "DON'T" and rules[1][1].startswith("**app**: Status: failed")
    recent = [r.decision for r in sessions.recent_decisions(notes, "2024-06-10").collect()]
    assert recent == ["Take it.", "Take it.", "Take it."]
    titles = [r.title for r in sessions.decisions_per_project(notes, "2024-06-10", top=2).collect()]
    assert titles == ["A", "C"]


def test_wakeup(spark):
    files = {"app/arch.md": "---\ntype: architecture\n---\n# Arch\n\n## Tech stack: Flutter, Dart\n",
             "app/x.md": "x", "inbox/idea-link.md": "x", "inbox/memo.md": "x"}
    notes = scan(spark, files)
    summary = {r.project: (r.notes, r.stack) for r in sessions.projects_summary(notes).collect()}
    assert summary == {"app": (2, "Flutter, Dart"), "inbox": (2, "")}
    assert sessions.inbox_summary(notes).first().asDict() == {
        "items": 2, "ideas": 1, "links": 1, "decisions": 0, "other": 1}
    assert sessions.inbox_summary(notes, parity=True).first().other == 0


def test_blockers(spark):
    rows = [("a/docs/CURRENT_STATUS.md", "## Known Issues\n- login broken\n"),
            ("b/docs/CURRENT_STATUS.md", "## Blockers\nNone\n"),
            ("c/docs/CURRENT_STATUS.md", "## Blockers\nwaiting\n## Next\n")]
    df = spark.createDataFrame(rows, "path string, raw_content string")
    assert [(r.project, r.blocker) for r in sessions.blockers(df).collect()] == [
        ("a", "- login broken"), ("c", "waiting")]


SNAP = ("timestamp string, project string, summary string, git_branch string, recent_commits array<string>, "
        "uncommitted_changes array<string>, active_decisions array<string>, blockers array<string>, next_steps array<string>")


def snaps(spark, rows):
    return spark.createDataFrame([(t, p, s, "main", ["c1", "c2", "c3", "c4"], ["f"], [], None, ["n"]) for t, p, s in rows], SNAP)


def test_snapshots(spark):
    df = snaps(spark, [(f"2024-01-01 10:0{i}", "app", f"s{i}") for i in range(8)] + [("2024-01-01 09:00", "app-web", "w")])
    last = {r.project: r.summary for r in snapshots.latest(df).collect()}
    assert last == {"app": "s7", "app-web": "w"}
    kept = snapshots.keep_newest(df, 5)
    # a project whose name begins like another is not pruned with it
    assert kept.count() == 6 and kept.where("project = 'app'").agg(F.min("timestamp")).first()[0].endswith("10:03")
    assert [r.summary for r in snapshots.newest(df, "app", 2).collect()] == ["s7", "s6"]
    assert snapshots.newest(df, "absent").count() == 0


def test_wakeup_cache(spark):
    cache = snapshots.wakeup_cache(snaps(spark, [("2024-01-01 10:00", "app", "old"), ("2024-01-01 10:00", "web", "w")]))
    fresh = snapshots.wakeup_cache(snaps(spark, [("2024-01-02 10:00", "app", "new")]), cache)
    got = {r.project: r for r in fresh.collect()}
    assert got["app"].summary == "new" and got["web"].summary == "w"
    assert got["app"].recent_commits == ["c1", "c2", "c3"] and got["app"].blockers == [] and got["app"].uncommitted == 1
