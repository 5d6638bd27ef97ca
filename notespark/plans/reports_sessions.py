"""Registered queries: sessions, decisions, snapshots, catalog and dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from notespark.operators import dashboard, sessions, snapshots
from notespark.plans import catalog, corpus
from notespark.session import cut_lineage
from notespark.sources import store, vault

AS_OF = "2001-07-30"


def _issues(spark, folder):
    notes = vault.scan(corpus.session_files(spark, folder))
    return cut_lineage(sessions.issues(sessions.failure_notes(notes)))


def session_issues(spark, folder):
    return _issues(spark, folder).select(
        "project", "session", "path", "issue_text", "workaround", "category", "pattern")


def repeating_issues(spark, folder):
    return sessions.repeating(_issues(spark, folder))


def repeating_projects(spark, folder):
    found = _issues(spark, folder)
    return sessions.repeating_projects(found, sessions.repeating(found))


def category_share(spark, folder):
    return sessions.category_share(_issues(spark, folder))


def workarounds(spark, folder):
    return sessions.workarounds(_issues(spark, folder))


def _outcomes(spark, folder):
    return sessions.outcomes(vault.scan(corpus.order_files(spark, folder)))


def decision_outcomes(spark, folder):
    return _outcomes(spark, folder).select("path", "title", "has_outcome", "status", "lessons")


def outcome_counts(spark, folder):
    return sessions.outcome_counts(_outcomes(spark, folder))


def auto_rules(spark, folder):
    return sessions.auto_rules(_outcomes(spark, folder))


def recent_decisions(spark, folder):
    return sessions.recent_decisions(vault.scan(corpus.order_files(spark, folder)), AS_OF)


def decisions_per_project(spark, folder):
    notes = vault.scan(corpus.order_files(spark, folder))
    return sessions.decisions_per_project(notes, AS_OF).select(
        "project", "title", "created", F.col("rank").cast("bigint").alias("rank"))


def projects_summary(spark, folder):
    return sessions.projects_summary(vault.scan(corpus.document_files(spark, folder)))


def inbox_summary(spark, folder):
    return sessions.inbox_summary(corpus.capture_files(spark, folder))


def latest_session(spark, folder):
    return snapshots.latest(corpus.snapshots(spark, folder)).select("project", "timestamp", "git_branch")


def newest_sessions(spark, folder):
    return snapshots.newest(corpus.snapshots(spark, folder), "user-7").select("project", "timestamp")


def prune_keep_n(spark, folder):
    return snapshots.keep_newest(corpus.snapshots(spark, folder)).select("project", "timestamp")


def wakeup_cache(spark, folder):
    return snapshots.wakeup_cache(corpus.snapshots(spark, folder)).select(
        "project", "last_session", "branch", F.col("uncommitted").cast("bigint").alias("uncommitted"),
        F.array_join("recent_commits", ",").alias("recent_commits"),
        F.array_join("next_steps", ",").alias("next_steps"))


def enhanced_wakeup(spark, folder):
    snaps = corpus.snapshots(spark, folder)
    projects = snaps.groupBy("project").agg(F.count(F.lit(1)).alias("notes"))
    return snapshots.enhanced_wakeup(projects, snaps, corpus.event_facts(spark, folder)).select(
        "project", "notes", "last_session", F.array_join("active_stack", "; ").alias("active_stack"))


def type_catalog(spark, folder):
    return catalog.catalog_lines(vault.scan(corpus.document_files(spark, folder)))


def catalog_headers(spark, folder):
    return catalog.catalog_headers(vault.scan(corpus.document_files(spark, folder)))


def _cards(spark, folder):
    return dashboard.project_cards(corpus.product_files(spark, folder))


def project_cards(spark, folder):
    return _cards(spark, folder).select(
        "id", "title", "status", "category", "description", F.array_join("stack", ",").alias("stack"),
        F.array_join("whats_next", "|").alias("whats_next"))


def dashboard_counters(spark, folder):
    return dashboard.counters(_cards(spark, folder))


def dashboard_stacks(spark, folder):
    return dashboard.stack_names(_cards(spark, folder))


def dashboard_filter(spark, folder):
    cards = dashboard.filtered(_cards(spark, folder), "active", "Spark", "Customer#00000000")
    return dashboard.in_order(cards).select("id", "status")


def checksum_changes(spark, folder):
    """Notes that differ between the corpus and a copy in which labelled toxic ones were edited
    and those of low quality removed."""
    notes = vault.parse_notes(corpus.document_files(spark, folder)).select("path", "checksum")
    labels = corpus.table(spark, folder, "labels")
    docs = corpus.table(spark, folder, "documents").select(
        "doc_id", F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    marks = docs.join(labels, "doc_id").select("path", "quality", "toxic")
    after = notes.join(marks, "path", "left").where(F.coalesce("quality", F.lit(1)) == 1).select(
        "path", F.when(F.col("toxic") == 1, F.md5("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    return store.files_changed(notes, after)


def new_note_names(spark, folder):
    """Names for one new note per part, titled by its name, beside one note that exists."""
    parts = corpus.table(spark, folder, "part")
    none = F.array().cast("array<string>")
    asked = parts.select(
        F.col("p_partkey").alias("id"), F.lit("shop").alias("project"), F.initcap("p_name").alias("title"),
        F.lit("note").alias("note_type"), none.alias("tags"), F.lit("text").alias("content"))
    have = spark.createDataFrame([("shop/red-plate.md",), ("shop/red-plate-2.md",)], "path string")
    return store.new_note_files(asked, have, "2024-01-01").select("id", "path")


QUERIES = {
    f.__name__: f
    for f in [
        session_issues, repeating_issues, repeating_projects, category_share, workarounds,
        decision_outcomes, outcome_counts, auto_rules, recent_decisions, decisions_per_project,
        projects_summary, inbox_summary, latest_session, newest_sessions, prune_keep_n, wakeup_cache,
        enhanced_wakeup, type_catalog, catalog_headers, project_cards, dashboard_counters,
        dashboard_stacks, dashboard_filter, checksum_changes, new_note_names,
    ]
}

_I = f"WITH {corpus.SESSION_ISSUES}"
_O = f"WITH {corpus.ORDER_NOTES}"
_OUT = f"""{_O}, found AS (
  SELECT *, CASE WHEN has_outcome THEN '**Status**: ' || status || chr(10) || '**Lessons learned**: '
    || lessons END AS outcome FROM order_notes)"""
_TOP = f"""top AS (SELECT pattern, count(*) AS n FROM issues GROUP BY 1 HAVING count(*) >= 2
  ORDER BY n DESC, pattern LIMIT 10)"""
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_DECISION = """substr('Customer ' || o_custkey || ' uses ' || tech || ' and more. They migrated from '
  || old_tech || ' to ' || tech || '.', 1, 80)"""

ORACLE = {
    "session_issues": f"""{_I} SELECT project, session, path, issue_text, workaround, category, pattern
        FROM issues""",
    "repeating_issues": f"""{_I} SELECT pattern, count(*) AS count, count(DISTINCT project) AS projects,
        any_value(category) AS category, coalesce(any_value(nullif(workaround, '')), '') AS workaround
        FROM issues GROUP BY pattern HAVING count(*) >= 2 ORDER BY count(*) DESC, pattern LIMIT 10""",
    "repeating_projects": f"""{_I}, {_TOP} SELECT pattern, project, workaround, count(*) AS n
        FROM issues WHERE pattern IN (SELECT pattern FROM top) GROUP BY ALL""",
    "category_share": f"""{_I} SELECT category, count(*) AS count,
        CAST(round_even(count(*) / (SELECT count(*) FROM issues)::DOUBLE * 100, 0) AS BIGINT) AS pct
        FROM issues GROUP BY category ORDER BY count(*) DESC, category LIMIT 8""",
    "workarounds": f"""{_I}, f AS (
        SELECT *, row_number() OVER (PARTITION BY workaround ORDER BY path, line) AS k
        FROM issues WHERE workaround <> '')
        SELECT substr(issue_text, 1, 100) AS issue, workaround, project, category
        FROM f WHERE k = 1 ORDER BY path, line LIMIT 10""",
    "decision_outcomes": f"""{_O} SELECT path, title, has_outcome,
        CASE WHEN has_outcome THEN status END AS status, CASE WHEN has_outcome THEN lessons END AS lessons
        FROM order_notes""",
    "outcome_counts": f"""{_O} SELECT count(*) AS total_decisions,
        count(*) FILTER (has_outcome) AS with_outcomes,
        count(*) FILTER (NOT has_outcome) AS without_outcomes,
        count(*) FILTER (has_outcome AND status = 'success') AS success_count,
        count(*) FILTER (has_outcome AND status = 'partial') AS partial_count,
        count(*) FILTER (has_outcome AND status = 'failed') AS failed_count FROM order_notes""",
    "auto_rules": f"""{_O} SELECT CASE WHEN status = 'failed' THEN 'DON''T' ELSE 'DO' END AS kind, path,
        '**' || project || '**: ' || lessons AS rule FROM order_notes
        WHERE has_outcome AND status IN ('success', 'partial', 'failed')""",
    "recent_decisions": f"""{_O} SELECT created, project, path, {_DECISION} AS decision
        FROM order_notes WHERE created >= '2001-07-16'
        ORDER BY created DESC, project DESC, decision DESC, path LIMIT 5""",
    "decisions_per_project": f"""{_O} SELECT project, title, created, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY created DESC, path) AS rank
        FROM order_notes WHERE created >= '2001-07-16') WHERE rank <= 5""",
    "projects_summary": "SELECT source AS project, count(*) AS notes, '' AS stack FROM documents GROUP BY 1",
    "inbox_summary": f"""WITH {corpus.CAPTURES} SELECT count(*) AS items,
        count(*) FILTER (contains(path, 'idea')) AS ideas, count(*) FILTER (contains(path, 'link')) AS links,
        count(*) FILTER (contains(path, 'decision')) AS decisions,
        count(*) FILTER (contains(path, 'memo')) AS other FROM captures""",
    "latest_session": f"""WITH {corpus.SNAPSHOTS} SELECT project, max({_TS}) AS timestamp,
        arg_max(event_type, ts) AS git_branch FROM snapshots GROUP BY project""",
    "newest_sessions": f"""WITH {corpus.SNAPSHOTS} SELECT project, {_TS} AS timestamp FROM snapshots
        WHERE project = 'user-7' ORDER BY ts DESC LIMIT 10""",
    "prune_keep_n": f"""WITH {corpus.SNAPSHOTS} SELECT project, timestamp FROM (
        SELECT project, {_TS} AS timestamp,
          row_number() OVER (PARTITION BY project ORDER BY ts DESC) AS k FROM snapshots) WHERE k <= 50""",
    "wakeup_cache": f"""WITH {corpus.SNAPSHOTS} SELECT project, max({_TS}) AS last_session,
        arg_max(event_type, ts) AS branch, 1::BIGINT AS uncommitted, 'c1,c2,c3' AS recent_commits,
        arg_max(event_type, ts) AS next_steps FROM snapshots GROUP BY project""",
    "enhanced_wakeup": f"""WITH {corpus.SNAPSHOTS}, {corpus.EVENT_FACTS}, firsts AS (
        SELECT subject, string_agg(predicate || ': ' || object, '; ' ORDER BY seq) AS active_stack
        FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq) AS k FROM stated)
        WHERE k <= 6 GROUP BY subject)
        SELECT project, count(*) AS notes, max({_TS}) AS last_session, any_value(active_stack) AS active_stack
        FROM snapshots JOIN firsts ON subject = project GROUP BY project""",
    "type_catalog": f"""WITH {corpus.DOCUMENT_NOTES}, l AS (
        SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> ''
          AND NOT regexp_matches(x, '^(#|---|>|- \\*\\*|\\| )'))[1] AS first FROM notes)
        SELECT project, CASE note_type WHEN 'architecture' THEN 1 WHEN 'decision' THEN 4
            WHEN 'research' THEN 8 ELSE 9 END AS rank, path,
          '- [' || title || '](' || path || ') `' || note_type || '` — ' || CASE
            WHEN first IS NULL THEN '(no summary)' WHEN length(first) <= 80 THEN first
            ELSE regexp_replace(substr(first, 1, 80), ' [^ ]*$', '') || '…' END AS line
        FROM l""",
    "catalog_headers": f"""WITH {corpus.DOCUMENT_NOTES}
        SELECT project, '## 📁 ' || project || ' (' || count(*) || ' notes: '
          || array_to_string(list_sort(list(DISTINCT note_type)), ', ') || ')' AS line
        FROM notes GROUP BY project""",
    "project_cards": f"""WITH {corpus.PRODUCTS} SELECT id, title, status, 'other' AS category, description,
        'Spark,' || n_name AS stack, 'Call ' || title || '|then wait' AS whats_next FROM cards""",
    "dashboard_counters": f"""WITH {corpus.PRODUCTS} SELECT count(*) AS total,
        count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'paused') AS paused,
        count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'idea') AS idea FROM cards""",
    "dashboard_stacks": f"""WITH {corpus.PRODUCTS} SELECT DISTINCT n_name AS stack FROM cards
        UNION SELECT 'Spark'""",
    "dashboard_filter": f"""WITH {corpus.PRODUCTS} SELECT id, status FROM cards
        WHERE status = 'active' AND contains(lower(title), 'customer#00000000')""",
    "checksum_changes": """SELECT source || '/doc-' || doc_id || '.md' AS path,
        CASE WHEN quality <> 1 THEN 'deleted' ELSE 'changed' END AS state
        FROM documents JOIN labels USING (doc_id) WHERE quality <> 1 OR toxic = 1""",
    "new_note_names": """WITH p AS (
          SELECT p_partkey AS id, 'shop/' || replace(p_name, ' ', '-') AS base,
            row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)
        SELECT id, base || CASE WHEN base = 'shop/red-plate' THEN '-' || (k + 3)
          WHEN k = 0 THEN '' ELSE '-' || k END || '.md' AS path FROM p""",
}
