"""Health checks of a vault.  Each check is a small query; a report is their union.

Every check returns ``severity, category, file, message, suggestion``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.operators import links
from notespark.session import cut_lineage


def _issues(df: DataFrame, severity: str, category: str, file, message: Column,
            suggestion: Column | str) -> DataFrame:
    hint = F.lit(suggestion) if isinstance(suggestion, str) else suggestion
    return df.select(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"),
        (F.lit(file) if file == "(vault-wide)" else F.col(file)).alias("file"),
        message.alias("message"), hint.alias("suggestion"),
    )


def _empty_headings(content: Column) -> Column:
    """Headings with nothing but blank lines, or another heading, in the four lines below."""

    def of(lines: Column) -> Column:
        def checked(line: Column, at: Column) -> Column:
            below = F.transform(F.slice(lines, at + 2, 4), lambda s: F.trim(s))
            first = F.get(F.filter(below, lambda s: s != ""), F.lit(0))
            empty = line.startswith("#") & (first.isNull() | first.startswith("#"))
            return F.when(empty, F.trim(F.regexp_replace(line, "^#+", "")))

        return F.filter(F.transform(lines, checked), lambda h: h.isNotNull() & (h != ""))

    return tx.let(tx.lines(content), of)


def extracted(notes: DataFrame, pattern: str = vocab.CONCEPT_MENTION) -> DataFrame:
    """What the checks need of each note, found in one pass over its text, without the text."""
    return notes.select(
        "path", "stem", "project", "note_type", "title", "created", "updated", tx.links("raw_content").alias("links"),
        tx.find_all("content", pattern).alias("concepts"),
        F.regexp_count("content", F.lit(vocab.TODO_MARKER)).alias("todos"),
        _empty_headings(F.col("content")).alias("empty"), F.map_keys("meta").alias("keys"),
    )


def _known(notes: DataFrame, name: str, value: Column) -> Column:
    """A column that was extracted before, else its value from the text."""
    return F.col(name) if name in notes.columns else value


def orphans(notes: DataFrame, parity: bool = False) -> DataFrame:
    """Notes nothing links to.  Links of a note to itself do not count; with ``parity`` they do."""
    rows = links.link_rows(notes)
    if not parity:
        rows = rows.where("key <> source")
    linked = rows.select(F.col("key").alias("node")).distinct()
    # of notes sharing a stem, links reach the one with the last path
    reached = links.nodes(notes).join(linked, "node", "left_semi").select("path")
    checked = notes.where(
        ~F.lower("stem").isin(vocab.ORPHAN_SKIP_STEMS) & ~F.col("path").startswith(vocab.GLOBAL_PREFIX)
    )
    return _issues(
        checked.join(reached, "path", "left_anti"), "info", "orphan", "path",
        F.lit("No inbound WikiLinks — this page is isolated"),
        F.concat(F.lit("Add [["), "stem", F.lit("]] link from related notes")),
    )


def stale(notes: DataFrame, as_of: str, days: int = vocab.STALE_DAYS) -> DataFrame:
    """Notes last changed more than ``days`` before ``as_of``."""
    today = F.lit(as_of).cast("date")
    changed = F.coalesce(F.col("updated").try_cast("date"), F.col("created").try_cast("date"))
    aged = notes.withColumn("_d", changed).where(F.col("_d") < F.date_sub(today, days))
    return _issues(
        aged, "warning", "stale", "path",
        F.concat(
            F.lit("Not updated for "), F.datediff(today, "_d").cast("string"),
            F.lit(" days (since "), F.col("_d").cast("string"), F.lit(")"),
        ),
        "Review and update, or mark as archived",
    )


def broken_links(notes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Links to notes that do not exist, one issue per link written.

    ``existing`` names the notes that may be linked to; pass the whole vault when ``notes`` is
    one project of it.
    """
    stems = (notes if existing is None else existing).select(F.lower("stem").alias("key"))
    missing = links.link_rows(notes).join(stems, "key", "left_anti")
    return _issues(
        missing, "warning", "broken_link", "path",
        F.concat(F.lit("Broken WikiLink: [["), "target", F.lit("]] — target not found")),
        "Create the page or fix the link",
    )


def concept_counts(notes: DataFrame, pattern: str = vocab.CONCEPT_MENTION) -> DataFrame:
    return (
        notes.select(F.explode(_known(notes, "concepts", tx.find_all("content", pattern))).alias("m"))
        .groupBy(F.lower("m").alias("concept")).agg(F.count(F.lit(1)).alias("mentions"))
    )


def missing_concepts(
    notes: DataFrame, pattern: str = vocab.CONCEPT_MENTION, top: int = vocab.CONCEPT_TOP,
    least: int = vocab.CONCEPT_MIN_MENTIONS,
) -> DataFrame:
    """Often mentioned concepts that no note is named after or titled with.

    The few top concepts are found first and reach the notes as one list, so titles are tested for them
    inside each row instead of being joined with them.
    """
    wanted = cut_lineage(concept_counts(notes, pattern).where(F.col("mentions") >= least).orderBy(
        F.desc("mentions"), "concept").limit(top))
    names = wanted.agg(F.collect_list("concept")).scalar()  # ``top`` names
    own = F.regexp_replace(F.lower("stem"), "^concept-", "")
    low = notes.select(F.lower("stem").alias("stem"), F.lower("title").alias("title"), own.alias("own"), names.alias("names"))
    named = F.filter("names", lambda c: (c == F.col("own")) | (c == F.col("stem")) | F.contains(F.col("title"), c))
    have = low.select(F.explode(named).alias("concept")).distinct()
    return _issues(
        wanted.join(have, "concept", "left_anti"), "info", "missing_concept", "(vault-wide)",
        F.concat(
            F.lit('"'), "concept", F.lit('" mentioned '), F.col("mentions").cast("string"),
            F.lit(" times but has no concept page"),
        ),
        F.concat(F.lit("Create a concept page: concept-"), "concept", F.lit(".md")),
    )


def todo_markers(notes: DataFrame) -> DataFrame:
    counted = tx.once(notes, _n=_known(notes, "todos", F.regexp_count("content", F.lit(vocab.TODO_MARKER))))
    return _issues(
        counted.where("_n > 0"), "warning", "empty_section", "path",
        F.concat(F.lit("Contains "), F.col("_n").cast("string"), F.lit(" TODO/FIXME markers")),
        "Complete or remove TODO items",
    )


def empty_sections(notes: DataFrame) -> DataFrame:
    """Headings with nothing but blank lines, or another heading, in the four lines below."""
    found = notes.select("path", F.explode(_known(notes, "empty", _empty_headings(F.col("content")))).alias("heading"))
    return _issues(
        found, "info", "empty_section", "path",
        F.concat(F.lit('Empty section: "'), "heading", F.lit('"')),
        "Add content or remove the heading",
    )


def front_matter(notes: DataFrame) -> DataFrame:
    """Notes without front matter, or without its required or recommended fields."""
    keys = _known(notes, "keys", F.map_keys("meta"))
    none = notes.where(F.size(keys) == 0)
    some = notes.where(F.size(keys) > 0)

    def lacking(fields: list[str]) -> DataFrame:
        missing = F.array_except(F.array(*[F.lit(f) for f in fields]), keys)
        return some.withColumn("_m", F.array_sort(missing)).where(F.size("_m") > 0)

    def named(label: str) -> Column:
        return F.concat(F.lit(f"Missing {label} fields: "), F.array_join("_m", ", "))

    return (
        _issues(none, "warning", "frontmatter", "path", F.lit("Missing frontmatter entirely"),
                "Add YAML frontmatter with project, type, tags")
        .unionByName(_issues(lacking(vocab.REQUIRED_FIELDS), "warning", "frontmatter", "path",
                             named("required"), "Add missing frontmatter fields"))
        .unionByName(_issues(lacking(vocab.RECOMMENDED_FIELDS), "info", "frontmatter", "path",
                             named("recommended"), ""))
    )


def lint(notes: DataFrame, as_of: str, project: str | None = None,
         stale_days: int = vocab.STALE_DAYS) -> DataFrame:
    """The issues of all checks; :func:`in_order` lists them.

    The texts are read once; the checks work on what was extracted, kept in the shared folder.
    """
    whole = notes = cut_lineage(extracted(notes))
    if project:
        notes = notes.where(F.col("project") == project)
    checks = [
        orphans(notes), stale(notes, as_of, stale_days), broken_links(notes, whole),
        missing_concepts(notes), todo_markers(notes), empty_sections(notes), front_matter(notes),
    ]
    return reduce(DataFrame.unionByName, checks)


def in_order(issues: DataFrame) -> DataFrame:
    """Most severe first."""
    rank = F.when(F.lit(False), F.lit(0))
    for name, value in vocab.SEVERITY_RANK.items():
        rank = rank.when(F.col("severity") == name, F.lit(value))
    return issues.orderBy(rank, "category", "file", "message")


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("issues"))
