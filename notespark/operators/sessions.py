"""What session notes say about failures, and decision notes about outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notespark import vocab
from notespark.functions import text as tx
from notespark.scale import top_per_key


def session_notes(notes: DataFrame) -> DataFrame:
    tagged = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in vocab.SESSION_TAGS]))
    return notes.where((F.col("note_type") == "note") & tagged)


def failure_notes(notes: DataFrame) -> DataFrame:
    """Session notes, and any note right in a project directory with a failure section.

    A note that is both is read once.
    """
    tagged = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in vocab.SESSION_TAGS]))
    parts = F.split("path", "/")
    direct = (F.size(parts) == 2) & ~parts[0].rlike(r"^[._]")
    return notes.where(
        ((F.col("note_type") == "note") & tagged)
        | (direct & F.col("raw_content").rlike(vocab.FAILURE_HEADER))
    )


def category(text: Column) -> Column:
    return tx.first_rule(F.lower(text), vocab.ISSUE_CATEGORIES, vocab.OTHER_CATEGORY)


def issue_key(text: Column) -> Column:
    """Issue text without hashes, paths and dates, to find repeats by."""
    out = F.regexp_replace(text, r"[a-f0-9]{7,}", "<hash>")
    out = F.regexp_replace(out, r"(?U)/[\w\-./]+\.\w+", "<path>")
    out = F.regexp_replace(out, r"\d{4}-\d{2}-\d{2}", "<date>")
    out = tx.strip(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.substring(out, 1, vocab.ISSUE_KEY_LENGTH)


def issues(notes: DataFrame, text: str = "content") -> DataFrame:
    """One row per issue: the bullets below a failure header, up to the next heading."""
    after = tx.let(F.split(tx.col(text), vocab.FAILURE_HEADER), lambda x: tx.rest(x))
    bodies = F.transform(after, lambda s: F.split_part(s, F.lit("\n##"), F.lit(1)))
    # what follows the header's own words on its line is not an issue
    lines = F.flatten(F.transform(bodies, lambda b: tx.let(F.split(b, "\n"), lambda x: tx.rest(x))))
    clean = F.transform(
        F.filter(F.transform(lines, tx.strip), lambda s: (s != "") & ~s.startswith("#")),
        lambda s: tx.strip(F.regexp_replace(s, r"^[-*•]\s*", "")),
    )
    kept = F.filter(clean, lambda s: F.length(s) >= vocab.MIN_ISSUE)
    rows = notes.select(
        "project", F.col("title").alias("session"), "path", F.posexplode(kept).alias("line", "issue_text")
    )
    return rows.select(
        "*", tx.strip(F.regexp_extract("issue_text", vocab.WORKAROUND, 1)).alias("workaround"),
        category(F.col("issue_text")).alias("category"),
        issue_key(F.col("issue_text")).alias("pattern"),
    )




def repeating(found: DataFrame, top: int = 10) -> DataFrame:
    """Issues met twice or more: count, number of projects, category and fix of the first.

    Counting and taking the first combine in each task; no list of instances is built.
    """
    first = F.struct("path", "line")
    per_project = found.groupBy("pattern", "project").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(first.alias("at"), "category")).alias("f"),
        F.min(F.when(F.col("workaround") != "", F.struct(first.alias("at"), "workaround"))).alias("w"),
    )
    return (
        per_project.groupBy("pattern")
        .agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("projects"),
            F.min("f")["category"].alias("category"),
            F.coalesce(F.min("w")["workaround"], F.lit("")).alias("workaround"),
        )
        .where(F.col("count") >= 2)
        .orderBy(F.desc("count"), "pattern").limit(top)
    )


def repeating_projects(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """The projects and workarounds of repeating issues, as rows."""
    kept = found.join(patterns.select("pattern"), "pattern", "left_semi")
    return kept.groupBy("pattern", "project", "workaround").agg(F.count(F.lit(1)).alias("n"))


def category_share(found: DataFrame, top: int = 8) -> DataFrame:
    """Issues per category with their share in percent, halves rounded to even."""
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    # one row per category of the fixed list: few enough for one window
    total = F.sum("count").over(W.partitionBy(F.lit(1)))
    return (
        counts.withColumn("pct", F.bround(F.col("count") / total * 100).cast("bigint"))
        .orderBy(F.desc("count"), "category").limit(top)
    )


def workarounds(found: DataFrame, top: int = 10) -> DataFrame:
    """Each distinct workaround with the first issue it solved."""
    first = F.struct("path", "line")
    return (
        found.where("workaround <> ''").groupBy("workaround")
        .agg(F.min(F.struct(first.alias("at"), "issue_text", "project", "category")).alias("f"))
        .orderBy("f.at").limit(top)
        .select(F.substring("f.issue_text", 1, 100).alias("issue"), "workaround",
                "f.project", "f.category")
    )


def recommendations(found: DataFrame, sessions: int) -> list[str]:
    """Advice by threshold, from the report's few top rows."""
    out = []
    again = repeating(found, 1).first()
    if again:
        named = found.where(F.col("pattern") == again["pattern"]).select("project").distinct().orderBy("project")
        projects = ", ".join(row["project"] for row in named.toLocalIterator())
        out.append(vocab.ADVICE_REPEATING.format(projects=projects, **{k: again[k] for k in ("pattern", "count")}))
    area = category_share(found, 1).first()
    if area and area["pct"] > vocab.ADVICE_SHARE:
        out.append(vocab.ADVICE_AREA.format(**area.asDict()))
    fixes = workarounds(found).count()
    if fixes:
        out.append(vocab.ADVICE_WORKAROUNDS.format(count=fixes))
    if sessions and area is None:
        out.append(vocab.ADVICE_NONE)
    return out


# ---------------------------------------------------------------------------- decisions


def outcomes(notes: DataFrame) -> DataFrame:
    """Decision notes with the status, text and lessons of their outcome section."""
    decisions = notes.where(F.col("note_type") == "decision")
    section = tx.find_all("content", vocab.OUTCOME, 1)
    found = tx.once(
        decisions.select("project", "title", "path", "content"), outcome=F.get(section, F.lit(0))
    )
    rows = found.select(
        "project", "title", "path", F.col("outcome").isNotNull().alias("has_outcome"),
        tx.strip("outcome").alias("outcome"),
    )
    status = F.lower(F.regexp_extract("outcome", vocab.OUTCOME_STATUS, 1))
    return rows.select(
        "*",
        F.when(F.col("has_outcome"), F.when(status != "", status).otherwise(F.lit("unknown"))).alias("status"),
        tx.strip(F.regexp_extract("outcome", vocab.OUTCOME_LESSONS, 1)).alias("lessons"),
    )


def outcome_counts(found: DataFrame) -> DataFrame:
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(f"{status}_count")

    return found.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.count_if(F.col("has_outcome")).alias("with_outcomes"),
        F.count_if(~F.col("has_outcome")).alias("without_outcomes"),
        of("success"), of("partial"), of("failed"),
    )


def patterns(found: DataFrame) -> DataFrame:
    """Outcomes to repeat (success, partly) and to avoid (failure)."""
    kind = (
        F.when(F.col("status").isin("success", "partial"), F.lit("DO"))
        .when(F.col("status") == "failed", F.lit("DON'T"))
    )
    return found.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "kind", "project", "title", "path", "outcome", "lessons"
    )


def auto_rules(found: DataFrame) -> DataFrame:
    """Rules as lines ``**project**: lesson``, to be listed by ``kind`` and ``path``.

    A decision without a lesson gives the start of its outcome text.
    """
    lesson = F.when(F.col("lessons") != "", F.col("lessons")).otherwise(F.substring("outcome", 1, 150))
    return patterns(found).select(
        "kind", "path", F.concat(F.lit("**"), "project", F.lit("**: "), lesson).alias("rule")
    )


# ------------------------------------------------------------------------------ wake-up


def projects_summary(notes: DataFrame) -> DataFrame:
    """Notes per project directory, and the stack line of its first architecture note."""
    marked = F.filter(
        F.transform(tx.lines("content"), tx.strip),
        lambda s: tx.contains_any(F.lower(s), vocab.STACK_LINE_MARKERS) & F.contains(s, F.lit(":")),
    )
    line = F.regexp_replace(F.get(marked, F.lit(0)), r"^#+", "")
    stack = F.substring(tx.strip(F.regexp_replace(line, r"(?s)^[^:]*:", "")), 1, 50)
    rows = notes.where(F.contains("path", F.lit("/"))).select(
        F.split("path", "/")[0].alias("project"), "path",
        F.when(F.col("note_type") == "architecture", F.struct("path", stack.alias("stack"))).alias("_a"),
    )
    return (
        rows.where(~F.col("project").rlike(r"^[._]")).groupBy("project")
        .agg(F.count(F.lit(1)).alias("notes"), F.min("_a")["stack"].alias("stack"))
        .withColumn("stack", F.coalesce("stack", F.lit("")))
    )


def inbox_summary(files: DataFrame, parity: bool = False) -> DataFrame:
    """Inbox files by kind, read from their names.

    A name that matches two kinds counts for both but is not taken from the rest twice;
    with ``parity`` it is.
    """
    stem = F.lower(tx.stem("path"))
    kinds = {"ideas": "idea", "links": "link", "decisions": "decision"}
    inbox = files.where(F.col("path").rlike(r"^inbox/[^/]*\.md$"))
    named = tx.contains_any(stem, list(kinds.values()))
    counted = inbox.agg(
        F.count(F.lit(1)).alias("items"),
        *[F.count_if(F.contains(stem, F.lit(word))).alias(k) for k, word in kinds.items()],
        F.count_if(~named).alias("other"),
    )
    if parity:
        return counted.withColumn("other", F.expr("items - ideas - links - decisions"))
    return counted


def decision_date(tags: str = "tags", raw: str = "raw_content") -> Column:
    """A tag that looks like a date, else the text of the first ``created:`` line."""
    tag = F.get(
        F.filter(tags, lambda t: (F.length(t) == 10) & t.startswith("20")), F.lit(0)
    )
    line = tx.strip(F.regexp_extract(raw, r"(?m)^created:(.*)$", 1))
    return F.coalesce(tag, line)


def recent_decisions(notes: DataFrame, as_of: str, days: int = vocab.RECENT_DAYS,
                     top: int = 5) -> DataFrame:
    """Newest decisions of the last days, with the text of their decision section."""
    cutoff = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    text = tx.section_text("content", "Decision")
    return (
        notes.where(F.col("note_type") == "decision")
        .select(
            decision_date().alias("created"), "project", "path",
            F.substring(F.when(text != "", text).otherwise(F.col("title")), 1, 80).alias("decision"),
        )
        .where((F.col("created") != "") & (F.col("created") >= cutoff))
        .orderBy(F.desc("created"), F.desc("project"), F.desc("decision"), "path").limit(top)
    )


def blockers(status_files: DataFrame, top: int = 3) -> DataFrame:
    """What status files name as known issues, else as blockers."""
    known = tx.section_text("raw_content", "Known Issues")
    text = F.when(known != "", known).otherwise(tx.section_text("raw_content", "Blockers"))
    project = F.regexp_extract("path", r"^([^/]+)/docs/CURRENT_STATUS\.md$", 1)
    return (
        status_files.select(project.alias("project"), F.substring(text, 1, 80).alias("blocker"), "path")
        .where((F.col("project") != "") & ~F.trim("blocker").isin(vocab.EMPTY_BLOCKERS))
        .orderBy("path").limit(top).select("project", "blocker")
    )


def decisions_per_project(notes: DataFrame, as_of: str, days: int = vocab.RECENT_DAYS,
                          top: int = 5) -> DataFrame:
    """Newest decision titles of each project."""
    cutoff = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    recent = notes.where(F.col("note_type") == "decision").select(
        "project", F.substring("title", 1, 80).alias("title"), "created", "path"
    ).where(F.col("created") >= cutoff)
    return top_per_key(recent, ["project"], [F.desc("created"), F.col("path")], top)
