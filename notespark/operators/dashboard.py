"""Project cards of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.scale import top_per_key
from notespark.sources import vault

QUESTIONS = ["what's next", "what to do"]
STATUSES = ["active", "paused", "done", "idea"]


def whats_next(content: Column | str, top: int = 3) -> Column:
    """First list items after a line that asks what is next, up to the next heading."""
    all_lines = tx.lines(content)
    asks = F.transform(all_lines, lambda s: tx.contains_any(F.lower(s), QUESTIONS))
    at = F.array_position(asks, F.lit(True)).cast("int")
    rest = F.when(at > 0, tx.rest(all_lines, at)).otherwise(F.slice(all_lines, 1, 0))
    rest = F.transform(rest, tx.strip)
    stop = F.array_position(F.transform(rest, lambda s: s.startswith("#")), F.lit(True)).cast("int")
    section = F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest)
    items = F.filter(section, lambda s: s.rlike(r"^[0-9-]"))
    clean = F.transform(items, lambda s: F.trim(F.regexp_replace(s, r"^[0-9.\-) ]+", "")))
    return F.slice(F.filter(clean, lambda s: s != ""), 1, top)


def _list(name: str) -> Column:
    """A front-matter list, kept as JSON by the parser."""
    return F.coalesce(
        F.from_json(F.try_element_at("meta", F.lit(name)), "array<string>"),
        F.array().cast("array<string>"),
    )


def project_cards(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """A card per project with a product note: its front matter with defaults, what is next,
    and its last commit from ``(project, message, date, hash)``."""
    notes = vault.with_front_matter(files.where(F.col("path").rlike(r"^[^_./][^/]*/prd\.md$")))
    folder = F.split("path", "/")[0]

    def field(name: str, default) -> Column:
        return F.coalesce(F.try_element_at("meta", F.lit(name)), default)

    github = field("github", F.lit(""))
    cards = notes.where(F.size("meta") > 0).select(
        field("project", folder).alias("id"),
        field("title", field("project", folder)).alias("title"),
        field("description", F.lit("")).alias("description"),
        field("status", F.lit("unknown")).alias("status"),
        field("category", F.lit("other")).alias("category"),
        _list("stack").alias("stack"), _list("services").alias("services"),
        F.col("meta_tags").alias("tags"), field("path", F.lit("")).alias("path"),
        github.alias("github"),
        F.when(github != "", F.concat(F.lit("https://github.com/"), github)).otherwise(F.lit("")).alias("github_url"),
        whats_next("raw_content").alias("whats_next"),
    )
    if commits is None:
        return cards
    last = commits.groupBy(F.col("project").alias("id")).agg(
        F.max_by(F.struct("message", "date", "hash"), F.col("date")).alias("last_commit")
    )
    return cards.join(last, "id", "left")


def in_order(cards: DataFrame) -> DataFrame:
    return cards.orderBy(status_rank("status"), "id")


def status_rank(status: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in vocab.STATUS_RANK.items():
        out = out.when(tx.col(status) == name, F.lit(rank))
    return out.otherwise(F.lit(vocab.STATUS_RANK["unknown"]))


def counters(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    )


def stack_names(cards: DataFrame) -> DataFrame:
    return cards.select(F.explode("stack").alias("stack")).distinct().orderBy("stack")


def filtered(cards: DataFrame, status: str = "all", stack: str | None = None,
             search: str = "") -> DataFrame:
    """Cards by status, stack and a text found in name, description, title or a list."""
    if status != "all":
        cards = cards.where(F.col("status") == status)
    if stack:
        cards = cards.where(F.array_contains("stack", stack))
    text = search.lower().strip()
    if text:
        q = F.lit(text)
        hit = F.lit(False)
        for name in ("id", "description", "title"):
            hit = hit | F.contains(F.lower(F.coalesce(name, F.lit(""))), q)
        for name in ("stack", "services"):
            hit = hit | F.exists(name, lambda s: F.contains(F.lower(s), q))
        cards = cards.where(hit)
    return cards


def as_json(cards: DataFrame) -> DataFrame:
    return cards.select("id", F.to_json(F.struct(*cards.columns)).alias("json"))


def newest_cards(cards: DataFrame, n: int = 5) -> DataFrame:
    """First cards of each state, in dashboard order."""
    return top_per_key(cards, ["status"], [F.col("id")], n)
