"""Temporal facts: statements that hold from a day to a day.

Facts are an append-only table of statements; when a fact stopped holding is derived from
later statements, never written into earlier rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.operators.intervals import contained
from notespark.session import cut_lineage
from notespark.scale import next_different, previous_value, ranged, running_sum, running_sums


def stated(subject: Column, predicate: Column, obj: Column) -> list[Column]:
    """The three parts of a fact as they are compared: in lower case."""
    return [
        F.lower(subject).alias("subject"), F.lower(predicate).alias("predicate"),
        F.lower(obj).alias("object"),
    ]


def with_valid_to(statements: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``valid_to``: the start of the first later statement on the same subject and
    predicate with another object, empty while none has come.

    ``order`` is the order of arrival.  A subject that holds much of the table is processed in
    ranges of arrival.
    """
    closed = next_different(
        statements, ["subject", "predicate"], order, "object", "valid_from", "_to"
    )
    return closed.withColumn("valid_to", F.coalesce("_to", F.lit(""))).drop("_to")


def applied(log: DataFrame, order: str = "seq") -> DataFrame:
    """The facts of a log of additions and endings, as they stand after its last entry.

    ``log`` has ``kind`` (``add`` or ``end``), ``subject``, ``predicate``, ``object`` and ``day``, in order of
    arrival.  An addition closes what is open on its subject and predicate with another object, an ending
    what is open with its object; each fact keeps the day of the first entry after it that closes it, and
    an ending says nothing about additions that come later.  Subjects with much of the log are worked
    through by ranges of arrival.
    """
    key = ["subject", "predicate"]
    ranges = ranged(log.withColumn("_mark", F.struct(F.col(order).alias("at"), F.col("day").alias("to"))), order)
    ended = next_different(ranges, [*key, "object"], order, "kind", "_mark", "_ended").where(F.col("kind") == "add")
    closed = next_different(ended, key, order, "object", "_mark", "_replaced")
    first = F.least("_ended", "_replaced")  # by arrival; a null does not count
    return closed.withColumn("valid_from", F.col("day")).withColumn("valid_to", F.coalesce(first["to"], F.lit(""))).drop(
        "_mark", "_ended", "_replaced", "_range", "kind", "day")


def invalidate(facts: DataFrame, ended: DataFrame) -> DataFrame:
    """Close open facts named by ``(subject, predicate, object, ended)``, earliest end first."""
    ends = ended.groupBy(
        F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"),
        F.lower("object").alias("object"),
    ).agg(F.min("ended").alias("_end"))
    ends = cut_lineage(ends)
    joined = facts.join(ends, ["subject", "predicate", "object"], "left")
    to = F.when((F.col("valid_to") == "") & F.col("_end").isNotNull(), F.col("_end")).otherwise(
        F.col("valid_to")
    )
    return joined.withColumn("valid_to", to).select(*facts.columns)


def is_active(as_of: str, valid_to: str = "valid_to") -> Column:
    """Not ended before ``as_of``; an end that is no date does not end.  The start is not
    looked at: see :func:`holds_on`."""
    day = F.col(valid_to).try_cast("date")
    return F.coalesce(day >= F.lit(as_of).cast("date"), F.lit(True))


def holds_on(as_of: str | Column) -> Column:
    """Valid on a day.  Both ends are included: on the day of a change old and new both hold."""
    day = F.lit(as_of) if isinstance(as_of, str) else as_of
    started = (F.coalesce("valid_from", F.lit("")) == "") | (F.col("valid_from") <= day)
    not_over = (F.coalesce("valid_to", F.lit("")) == "") | (F.col("valid_to") >= day)
    return started & not_over


def _about(entity: str) -> Column:
    name = entity.lower()
    return (F.col("subject") == name) | (F.col("object") == name)


def about(facts: DataFrame, entity: str, as_of: str) -> DataFrame:
    return facts.where(_about(entity) & holds_on(as_of))


def probed(facts: DataFrame, probes: DataFrame, per_task: int = 1 << 20) -> DataFrame:
    """Facts about many entities, each on its own day: ``probes`` has ``entity`` and ``day``.

    A row per probe and fact with the entity as subject or object, as :func:`about` gives for one probe.
    Starts and ends that are no dates do not limit.
    """
    names = F.array_distinct(F.array("subject", "object"))
    held = facts.withColumn("entity", F.explode(names)).withColumn(
        "_start", F.col("valid_from").try_cast("date")).withColumn("_end", F.col("valid_to").try_cast("date"))
    asked = probes.withColumn("entity", F.lower("entity")).withColumn("_day", F.col("day").try_cast("date"))
    return contained(asked, held, "entity", "_day", "_start", "_end", per_task).drop("_day", "_start", "_end")


def timeline(facts: DataFrame, entity: str, order: str = "seq") -> DataFrame:
    """Everything ever stated about an entity, by start; facts without a start come first."""
    start = F.coalesce(F.when(F.col("valid_from") != "", F.col("valid_from")), F.lit("0000"))
    return facts.where(_about(entity)).orderBy(start, order)


def search_facts(facts: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return facts.where(
        F.contains("subject", q) | F.contains("predicate", q) | F.contains("object", q)
    )


def severity(old_confidence, new_confidence, predicate) -> Column:
    high = vocab.CRITICAL_CONFIDENCE
    return (
        F.when((F.col(old_confidence) >= high) & (F.col(new_confidence) >= high), F.lit("critical"))
        .when(F.col(predicate).isin(vocab.STACK_PREDICATES), F.lit("warning"))
        .otherwise(F.lit("info"))
    )


def changes(statements: DataFrame, order: str = "seq") -> DataFrame:
    """The contradictions met while facts arrive: each statement against the last one with
    another object that it replaces.

    A run of statements with one object is one fact restated; each new run contradicts the run
    before it, so there is one row per change and no pair of all old with all new.
    """
    key = ["subject", "predicate"]
    held = statements.withColumn("_old", F.struct("object", "valid_from", "confidence"))
    before = previous_value(held, key, order, "_old", "_prev")
    changed = before.where(F.col("_prev").isNotNull() & (F.col("_prev.object") != F.col("object")))
    out = changed.select(
        *key, order, F.col("_prev.object").alias("old_object"), F.col("object").alias("new_object"),
        F.col("_prev.valid_from").alias("old_since"), "valid_from",
        F.col("_prev.confidence").alias("_oc"), F.col("confidence").alias("_nc"),
    )
    return out.withColumn("severity", severity("_oc", "_nc", "predicate")).drop("_oc", "_nc")


def check(facts: DataFrame, subject: str, predicate: str, obj: str, as_of: str,
          confidence: float = 1.0) -> DataFrame:
    """Active facts a new fact contradicts, with the severity of each."""
    held = facts.where(
        (F.col("subject") == subject.lower()) & (F.col("predicate") == predicate.lower())
        & (F.col("object") != obj.lower()) & is_active(as_of)
    ).withColumn("_nc", F.lit(float(confidence)))
    message = F.concat(
        F.lit("Conflict: "), "subject", F.lit(" "), "predicate", F.lit(" was '"), "object",
        F.lit("' (since "), "valid_from", F.lit(f"), now '{obj.lower()}'"),
    )
    return held.withColumn("message", message).withColumn(
        "severity", severity("confidence", "_nc", "predicate")
    ).drop("_nc")


def contradictions(facts: DataFrame, as_of: str, order: str = "seq") -> DataFrame:
    """Every active fact with the number of earlier active facts it contradicts, by severity.

    A fact contradicts the earlier facts on its subject and predicate that have another object:
    all of them less those with its own object.  Counting that way covers every pair without
    writing the pairs out.
    """
    key = ["subject", "predicate"]
    high = (F.col("confidence") >= vocab.CRITICAL_CONFIDENCE).cast("int")
    active = facts.where(is_active(as_of)).select(*key, "object", order, "confidence")
    counted = running_sums(ranged(active, order), key, order, {"_all": F.lit(1), "_high": high})
    counted = running_sums(
        counted, [*key, "object"], order, {"_same": F.lit(1), "_same_high": high}
    )
    critical = F.when(high == 1, F.col("_high") - F.col("_same_high")).otherwise(F.lit(0))
    rest = F.col("conflicts") - F.col("critical")
    stack = F.col("predicate").isin(vocab.STACK_PREDICATES)
    return (
        counted.withColumn("conflicts", F.col("_all") - F.col("_same"))
        .withColumn("critical", critical)
        .withColumn("warning", F.when(stack, rest).otherwise(F.lit(0)))
        .withColumn("info", F.when(stack, F.lit(0)).otherwise(rest))
        .where("conflicts > 0")
        .select(*key, "object", order, "conflicts", "critical", "warning", "info")
    )


def contradicting_subjects(facts: DataFrame, as_of: str) -> DataFrame:
    """Per subject and predicate how many objects are active at once, if more than one."""
    key = ["subject", "predicate"]
    folded = facts.where(is_active(as_of)).groupBy(*key, "object").agg(F.count(F.lit(1)).alias("n"))
    return folded.groupBy(*key).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("n").alias("facts")
    ).where("objects > 1")


def fact_stats(facts: DataFrame, as_of: str) -> DataFrame:
    """Totals as one row.  Distinct values are counted in two steps."""
    return facts.agg(
        F.count(F.lit(1)).alias("total_facts"),
        F.count_if(is_active(as_of)).alias("active_facts"),
        F.count_if(~is_active(as_of)).alias("expired_facts"),
        F.count_distinct("subject").alias("unique_subjects"),
        F.count_distinct("predicate").alias("unique_predicates"),
    )


def active_lines(facts: DataFrame, as_of: str, order: str = "seq") -> DataFrame:
    """Active facts as report lines, to be listed by subject and order of arrival."""
    return facts.where(is_active(as_of)).select(
        "subject", order,
        F.concat(
            F.lit("- "), "predicate", F.lit(": **"), "object", F.lit("** (since "), "valid_from",
            F.lit(")"),
        ).alias("line"),
    )


def facts_before(statements: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``earlier``: how many facts on the same subject were stated before."""
    return running_sum(statements, ["subject"], order, F.lit(1), "earlier")
