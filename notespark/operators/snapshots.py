"""Session snapshots: the last state of work per project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.scale import top_per_key


def latest(snapshots: DataFrame, order: str = "timestamp") -> DataFrame:
    """The newest snapshot of each project; combined in each task before the shuffle."""
    rest = [c for c in snapshots.columns if c != "project"]
    return (
        snapshots.groupBy("project").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_s"))
        .select("project", "_s.*")
    )


def newest(snapshots: DataFrame, project: str | None = None, n: int = 10,
           order: str = "timestamp") -> DataFrame:
    """Newest snapshots first, of one project or of all."""
    rows = snapshots if project is None else snapshots.where(F.col("project") == project)
    return rows.orderBy(F.desc(order), F.desc("project")).limit(n)


def keep_newest(snapshots: DataFrame, n: int = vocab.KEEP_SNAPSHOTS,
                order: str = "timestamp") -> DataFrame:
    """What pruning leaves: the newest ``n`` snapshots of each project."""
    return top_per_key(snapshots, ["project"], [F.desc(order)], n).drop("rank")


def wakeup_cache(snapshots: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One entry per project with what a session needs to start; replaces older entries."""

    def head(name: str):
        return F.slice(F.coalesce(name, F.array().cast("array<string>")), 1, 3).alias(name)

    fresh = latest(snapshots).select(
        "project", F.col("timestamp").alias("last_session"), "summary",
        F.col("git_branch").alias("branch"),
        F.size(F.coalesce("uncommitted_changes", F.array().cast("array<string>"))).alias("uncommitted"),
        head("recent_commits"), head("active_decisions"), head("blockers"), head("next_steps"),
    )
    if cache is None:
        return fresh
    return cache.join(fresh.select("project"), "project", "left_anti").unionByName(fresh)


def enhanced_wakeup(projects: DataFrame, snapshots: DataFrame, active_facts: DataFrame,
                    facts_per_project: int = 6) -> DataFrame:
    """Per project its note count and stack, its last snapshot and its first active facts."""
    first = top_per_key(
        active_facts.select(F.col("subject").alias("project"), "seq", "predicate", "object"),
        ["project"], [F.col("seq")], facts_per_project,
    )
    listed = first.groupBy("project").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "predicate", "object"))
        ).alias("_f")
    ).select(
        "project",
        F.transform("_f", lambda f: F.concat(f["predicate"], F.lit(": "), f["object"])).alias("active_stack"),
    )
    last = latest(snapshots).select(
        "project", F.col("timestamp").alias("last_session"), "summary"
    )
    return projects.join(last, "project", "left").join(listed, "project", "left")
