"""Relevance of found tools and repositories, and what changed between two scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.scale import top_per_key
from notespark.session import cut_lineage
from notespark.sources import versions


def tool_relevance(name, description, keywords: dict[str, list[str]] = vocab.TOOL_KEYWORDS) -> Column:
    text = F.lower(F.concat_ws(" ", tx.col(name), tx.col(description)))
    return tx.first_rule(text, list(keywords.items()), "low")


def score_tools(tools: DataFrame) -> DataFrame:
    return tools.withColumn("relevance", tool_relevance("name", "description"))


def new_tools(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """High and medium tools whose name was in no part of the previous scan."""
    wanted = current.where(F.col("relevance").isin("high", "medium"))
    if previous is None:
        return wanted
    return wanted.join(previous.select("name"), "name", "left_anti")


def removed_tools(current: DataFrame, previous: DataFrame) -> DataFrame:
    """High and medium tools of the previous scan whose name is in no part of this one."""
    wanted = previous.where(F.col("relevance").isin("high", "medium"))
    return wanted.join(current.select("name"), "name", "left_anti")


def diff_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sizes of both scans and of what is new and gone, one row."""
    parts = [
        current.select(F.lit("total_current").alias("what")),
        previous.select(F.lit("total_previous").alias("what")),
        new_tools(current, previous).select(
            F.concat(F.lit("new_"), "relevance").alias("what")),
        removed_tools(current, previous).select(F.lit("removed").alias("what")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    names = ["total_current", "total_previous", "new_high", "new_medium", "removed"]
    return rows.agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


def run_scan(found: DataFrame, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Score a scan of tools, compare it with the stored one and store it in its place.

    Returns what is new and what is gone among important tools, and the version of the stored scan.  Only
    rows that differ are written, so the same scan again makes no version and finds nothing new.
    """
    spark = found.sparkSession
    current = cut_lineage(score_tools(found))
    last = max(versions.versions(spark, path), default=0) if versions.exists(spark, path) else 0
    previous = versions.read(spark, path, last) if last else None
    if previous is None:
        return new_tools(current, None), current.where(F.lit(False)), versions.upsert(current, path, "name")
    known = [current[c].eqNullSafe(previous[c]) for c in current.columns]
    differs = current.join(previous, known, "left_anti")
    version = versions.upsert(differs, path, "name", deleted=previous.join(current, "name", "left_anti").select("name"))
    return new_tools(current, previous), removed_tools(current, previous), version


def alert_lines(new: DataFrame, top: int = 5) -> DataFrame:
    """The first new important tools, as escaped text for a message."""
    high = new.where(F.col("relevance") == "high").orderBy("name").limit(top)
    return high.select(
        "name", F.concat(
            tx.escape_html("name"), F.lit(" — "), tx.escape_html(F.substring("description", 1, 80))
        ).alias("line"),
    )


def _matches(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def repo_score(description, topics, language) -> Column:
    """Relevance of a repository from 0 to 1, in hundredths, and why: a struct.

    Points per topic for up to three of its keywords found anywhere in description and topics,
    for a language in use and for the protocol in use; added in hundredths, so exact.
    """
    p = vocab.REPO_POINTS
    found = tx.let(
        _repo_text(description, topics),
        lambda text: F.struct(
            *[_matches(text, words).alias(topic) for topic, words in vocab.REPO_TOPICS.items()],
            tx.contains_any(text, vocab.REPO_MCP_MARKS).alias("_mark"),
        ),
    )
    return tx.let(found, lambda f: _points(f, tx.col(language), p))


def _repo_text(description, topics) -> Column:
    return F.concat_ws(" ", F.coalesce(F.lower(tx.col(description)), F.lit("")),
                       F.concat_ws(" ", tx.col(topics)))


def _points(matched: Column, language: Column, p: dict) -> Column:
    hundredths = F.lit(0)
    reasons = []
    for topic in vocab.REPO_TOPICS:
        found = matched[topic]
        hundredths = hundredths + F.least(F.size(found), F.lit(p["keyword_cap"])) * round(100 * p["keyword"])
        reasons.append(
            F.when(F.size(found) > 0,
                   F.concat(F.lit(topic + ": "), F.array_join(F.slice(found, 1, p["keyword_cap"]), ", ")))
        )
    known = F.lower(language).isin(vocab.REPO_LANGUAGES)
    mcp = matched["_mark"]
    hundredths = hundredths + F.when(known, round(100 * p["language"])).otherwise(0)
    hundredths = hundredths + F.when(mcp, round(100 * p["mcp"])).otherwise(0)
    reasons.append(F.when(known, F.concat(F.lit("language: "), language)))
    reasons.append(F.when(mcp, F.lit("MCP related")))
    reason = F.concat_ws("; ", *reasons)
    return F.struct(
        (F.least(hundredths, F.lit(round(100 * p["max"]))) / 100.0).alias("score"),
        F.when(reason != "", reason).otherwise(F.lit("no relevant signals")).alias("reason"),
    )


def score_repos(repos: DataFrame) -> DataFrame:
    scored = tx.once(repos, _r=repo_score("description", "topics", "language"))
    return scored.withColumn("relevance_score", F.col("_r.score")).withColumn(
        "relevance_reason", F.col("_r.reason")
    ).drop("_r")


def trending(repos: DataFrame, since: str, min_stars: int = 50, topic: str = "all",
             n: int = 20) -> DataFrame:
    """Most starred recent repositories, then ordered by relevance and stars.

    A topic keeps repositories with one of its keywords.
    """
    rows = repos.where((F.col("created_at") > since) & (F.col("stars") >= min_stars))
    if topic != "all" and topic in vocab.REPO_TOPICS:
        text = F.lower(F.concat_ws(" ", "full_name", "description", F.concat_ws(" ", "topics")))
        rows = rows.where(tx.contains_any(text, vocab.REPO_TOPICS[topic]))
    page = rows.orderBy(F.desc("stars"), "full_name").limit(n)
    return score_repos(page).orderBy(F.desc("relevance_score"), F.desc("stars"), "full_name")


def band(score: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, least in vocab.REPO_BANDS:
        out = out.when(tx.col(score) >= least, F.lit(name))
    return out.otherwise(F.lit("other"))


def digest(scored: DataFrame, topic: str = "topic", n: int = vocab.DIGEST_TOP) -> DataFrame:
    """Per topic the best repositories that are relevant enough for the daily report."""
    relevant = scored.where(F.col("relevance_score") >= vocab.DIGEST_MIN_SCORE)
    return top_per_key(
        relevant, [topic], [F.desc("relevance_score"), F.desc("stars"), F.col("full_name")], n
    )


def latest_per_developer(repos: DataFrame) -> DataFrame:
    """Each watched developer's most recently updated repository."""
    rest = [c for c in repos.columns if c != "username"]
    return repos.groupBy("username").agg(
        F.max_by(F.struct(*rest), F.struct("updated", "full_name")).alias("_r")
    ).select("username", "_r.*")


def applicable_projects(description, topics, rules=vocab.APPLICABLE_PROJECTS) -> Column:
    """Projects a repository may help, by a table of (project, keywords)."""

    def hits(text: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(tx.contains_any(text, words), F.lit(p))
                    for p, words in rules
                ]
            )
        )

    return tx.let(_repo_text(description, topics), hits)


def watch(watched: DataFrame, added: DataFrame) -> DataFrame:
    """Add developers not yet on the list, whatever the case of their names."""
    have = watched.select(F.lower("username").alias("_u"))
    fresh = added.withColumn("_u", F.lower("username")).join(have, "_u", "left_anti")
    first = fresh.groupBy("_u").agg(F.min_by(F.struct(*added.columns), "username").alias("_r"))
    return watched.unionByName(first.select("_r.*"))


def unwatch(watched: DataFrame, username: str) -> DataFrame:
    return watched.where(F.lower("username") != username.lower())
