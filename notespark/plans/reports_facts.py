"""Registered queries: temporal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from notespark.operators import facts
from notespark.plans import corpus
from notespark.session import cut_lineage

AS_OF = "2024-01-15"


def _facts(spark, folder):
    return cut_lineage(facts.with_valid_to(corpus.event_facts(spark, folder)))


def facts_valid_to(spark, folder):
    return facts.with_valid_to(corpus.event_facts(spark, folder)).select(
        "seq", "subject", "predicate", "object", "valid_from", "valid_to"
    )


def facts_as_of(spark, folder):
    """All facts that hold on a day."""
    return _facts(spark, folder).where(facts.holds_on(AS_OF)).select(
        "seq", "subject", "predicate", "object"
    )


def facts_about(spark, folder):
    return facts.about(_facts(spark, folder), "User-7", AS_OF).select("seq", "predicate", "object")


def facts_timeline(spark, folder):
    return facts.timeline(_facts(spark, folder), "user-7").select(
        "seq", "predicate", "object", "valid_from", "valid_to"
    )


def facts_search(spark, folder):
    return facts.search_facts(corpus.event_facts(spark, folder), "SER-12").select("seq", "subject")


def fact_changes(spark, folder):
    return facts.changes(corpus.event_facts(spark, folder))


def contradictions(spark, folder):
    """Facts as stated, before any is closed, so that all of them are active."""
    stated = corpus.event_facts(spark, folder).withColumn("valid_to", F.lit(""))
    return facts.contradictions(stated, AS_OF)


def contradicting_subjects(spark, folder):
    return facts.contradicting_subjects(_facts(spark, folder), AS_OF)


def check_new_fact(spark, folder):
    held = _facts(spark, folder)
    return facts.check(held, "user-7", "uses", "Level-9", "2024-01-10", 0.95).select(
        "seq", "object", "severity", "message"
    )


def fact_stats(spark, folder):
    return facts.fact_stats(_facts(spark, folder), AS_OF)


def facts_invalidated(spark, folder):
    """Facts still open after every object a user's error reports name has been ended."""
    held = _facts(spark, folder)
    ended = held.where(F.col("predicate") == "reports").select(
        "subject", F.lit("uses").alias("predicate"), "object", F.lit("2024-02-01").alias("ended")
    )
    return facts.invalidate(held, ended).where(F.col("valid_to") == "2024-02-01").select(
        "seq", "subject", "object"
    )


def active_fact_lines(spark, folder):
    return facts.active_lines(_facts(spark, folder), AS_OF)


def facts_before(spark, folder):
    return facts.facts_before(corpus.event_facts(spark, folder)).select("seq", "subject", "earlier")


def facts_probed(spark, folder):
    """What held about each event's user on the day of the event."""
    asked = corpus.table(spark, folder, "events").select(
        F.col("event_id").alias("probe"), F.concat(F.lit("User-"), F.col("user_id")).alias("entity"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"))
    # what is asked for of a fact, before its ranges are kept
    stated = corpus.event_facts(spark, folder).select("seq", "subject", "predicate", "object", "valid_from")
    return facts.probed(cut_lineage(facts.with_valid_to(stated)), asked).select("probe", "entity", "day", "seq", "predicate", "object")


QUERIES = {
    f.__name__: f
    for f in [
        facts_valid_to, facts_as_of, facts_about, facts_timeline, facts_search, fact_changes,
        contradictions, contradicting_subjects, check_new_fact, fact_stats, facts_invalidated,
        active_fact_lines, facts_before, facts_probed,
    ]
}

_F = f"WITH {corpus.EVENT_FACTS}"
_HOLDS = f"valid_from <= '{AS_OF}' AND (closed IS NULL OR closed >= '{AS_OF}')"
_ACTIVE = f"(closed IS NULL OR closed >= '{AS_OF}')"
_SEVERITY = """CASE WHEN {o} >= 0.9 AND {n} >= 0.9 THEN 'critical' WHEN predicate IN
  ('uses', 'uses_auth', 'uses_db', 'uses_framework', 'deploys_to') THEN 'warning' ELSE 'info' END"""

ORACLE = {
    "facts_valid_to": f"""{_F} SELECT seq, subject, predicate, object, valid_from,
        coalesce(closed, '') AS valid_to FROM facts""",
    "facts_as_of": f"{_F} SELECT seq, subject, predicate, object FROM facts WHERE {_HOLDS}",
    "facts_about": f"""{_F} SELECT seq, predicate, object FROM facts
        WHERE subject = 'user-7' AND {_HOLDS}""",
    "facts_timeline": f"""{_F} SELECT seq, predicate, object, valid_from,
        coalesce(closed, '') AS valid_to FROM facts WHERE subject = 'user-7'
        ORDER BY valid_from, seq""",
    "facts_search": f"""{_F} SELECT seq, subject FROM stated WHERE contains(subject, 'ser-12')
        OR contains(predicate, 'ser-12') OR contains(object, 'ser-12')""",
    "fact_changes": f"""{_F}, l AS (
        SELECT *, lag(object) OVER w AS old_object, lag(valid_from) OVER w AS old_since,
          lag(confidence) OVER w AS oc
        FROM stated WINDOW w AS (PARTITION BY subject, predicate ORDER BY seq))
        SELECT subject, predicate, seq, old_object, object AS new_object, old_since, valid_from,
          {_SEVERITY.format(o='oc', n='confidence')} AS severity
        FROM l WHERE old_object IS NOT NULL AND old_object <> object""",
    "contradictions": f"""{_F}, pairs AS (
        SELECT n.subject, n.predicate, n.object, n.seq,
          {_SEVERITY.format(o='o.confidence', n='n.confidence').replace('predicate IN', 'n.predicate IN')}
            AS severity
        FROM stated o JOIN stated n ON o.subject = n.subject AND o.predicate = n.predicate
          AND o.object <> n.object AND o.seq < n.seq)
        SELECT subject, predicate, object, seq, count(*) AS conflicts,
          count(*) FILTER (severity = 'critical') AS critical,
          count(*) FILTER (severity = 'warning') AS warning,
          count(*) FILTER (severity = 'info') AS info
        FROM pairs GROUP BY ALL""",
    "contradicting_subjects": f"""{_F} SELECT subject, predicate,
        count(DISTINCT object) AS objects, count(*) AS facts FROM facts WHERE {_ACTIVE}
        GROUP BY 1, 2 HAVING count(DISTINCT object) > 1""",
    "check_new_fact": f"""{_F} SELECT seq, object,
        {_SEVERITY.format(o='confidence', n='0.95')} AS severity,
        'Conflict: user-7 uses was ''' || object || ''' (since ' || valid_from || '), now ''level-9'''
          AS message
        FROM facts WHERE subject = 'user-7' AND predicate = 'uses' AND object <> 'level-9'
          AND (closed IS NULL OR closed >= '2024-01-10')""",
    "fact_stats": f"""{_F} SELECT count(*) AS total_facts,
        count(*) FILTER ({_ACTIVE}) AS active_facts, count(*) FILTER (NOT {_ACTIVE}) AS expired_facts,
        count(DISTINCT subject) AS unique_subjects, count(DISTINCT predicate) AS unique_predicates
        FROM facts""",
    "facts_invalidated": f"""{_F} SELECT seq, subject, object FROM facts f
        WHERE predicate = 'uses' AND closed IS NULL AND EXISTS (SELECT 1 FROM facts r
          WHERE r.predicate = 'reports' AND r.subject = f.subject AND r.object = f.object)""",
    "active_fact_lines": f"""{_F} SELECT subject, seq,
        '- ' || predicate || ': **' || object || '** (since ' || valid_from || ')' AS line
        FROM facts WHERE {_ACTIVE}""",
    "facts_probed": f"""{_F} SELECT e.event_id AS probe, f.subject AS entity, strftime(e.ts, '%Y-%m-%d') AS day,
          f.seq, f.predicate, f.object
        FROM events e JOIN facts f ON f.subject = 'user-' || e.user_id
          AND f.valid_from <= strftime(e.ts, '%Y-%m-%d') AND coalesce(f.closed, '9999') >= strftime(e.ts, '%Y-%m-%d')""",
    "facts_before": f"""{_F} SELECT seq, subject,
        row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS earlier FROM stated""",
}
