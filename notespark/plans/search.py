"""Hybrid search: vector and keyword legs, fusion and refinement, as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.operators import bm25, fusion, rerank, vectors


@dataclass(frozen=True)
class SearchSettings:
    hybrid: bool = True
    reranking: bool = True
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    multiplier: int = vocab.RETRIEVAL_MULTIPLIER
    mmr: bool = True
    mmr_lambda: float = vocab.MMR_LAMBDA
    dedup_threshold: float = vocab.DEDUP_THRESHOLD
    decay: bool = True
    decay_lambda: float = vocab.DECAY_LAMBDA
    # clean: type and tag filters apply to both legs before the cut.  parity: the type filters
    # the vector leg only and tags are tested after fusion.
    parity: bool = False


ATTRIBUTES = ["source", "project", "type", "tags", "section", "updated"]


def _filters(project, note_type, tags) -> tuple[Column, Column, Column]:
    yes = F.lit(True)
    return (
        F.col("project") == project if project else yes,
        F.col("type") == note_type if note_type else yes,
        F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else yes,
    )


def search(
    chunks: DataFrame,
    query: str,
    query_vector: Sequence[float] | None,
    as_of: str,
    n: int = 10,
    project: str | None = None,
    note_type: str | None = None,
    tags: list[str] | None = None,
    settings: SearchSettings = SearchSettings(),
    scorer: Column | None = None,
) -> DataFrame:
    """Search chunks ``(chunk_id, source, project, type, tags, section, updated, text,
    embedding)``; returns at most ``n`` rows with score, method and rank.

    Both legs scan the chunks once and keep a page of candidates; everything after the
    fusion works on that page.
    """
    s = settings
    by_project, by_type, by_tags = _filters(project, note_type, tags)
    fetch = n * s.multiplier if s.reranking else n
    early = by_tags if not s.parity else F.lit(True)
    order = [F.desc("score"), "chunk_id"]
    fields = ["chunk_id", *ATTRIBUTES, "text"]

    legs = []
    if query_vector is not None:
        near = vectors.nearest(
            chunks, query_vector, fetch, key="chunk_id",
            where=by_project & by_type & early & F.col("embedding").isNotNull(),
        )
        legs.append(fusion.with_rank(near.select(*fields, "score"), order))
    if query_vector is None or s.hybrid:
        kept = by_project & early if s.parity else by_project & by_type & early
        words = bm25.search(chunks.drop("embedding"), query, fetch, key="chunk_id", where=kept)
        legs.append(fusion.with_rank(words.select(*fields, "score"), order))

    if len(legs) == 2:
        hits = fusion.fuse(
            legs[0], legs[1], fetch, attributes=ATTRIBUTES,
            vector_weight=s.vector_weight, keyword_weight=s.bm25_weight,
        ).withColumn("search_method", fusion.search_method()).withColumnRenamed("rrf_score", "score")
        hits = fusion.with_rank(
            hits, [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank")],
            "position",
        )
    else:
        label = "vector" if query_vector is not None else "bm25"
        hits = legs[0].withColumnRenamed("rank", "position").withColumn("search_method", F.lit(label))
    hits = hits.withColumn("query_id", F.lit(1)).where(by_tags)

    if s.reranking:
        chosen = rerank.lexical_score(query) if scorer is None else scorer
        hits = rerank.rerank(hits, chosen).withColumn("score", F.col("rerank_score"))
        hits = fusion.with_rank(
            hits.withColumnRenamed("position", "_before"), [F.desc("score"), "_before"], "position"
        ).withColumn("search_method", F.concat("search_method", F.lit("+rerank")))
    if len(legs) == 2:
        hits = rerank.deduplicate(hits, s.dedup_threshold).drop("pick")
        if s.mmr:
            picked = rerank.diversify(hits, n, s.mmr_lambda)
            hits = picked.drop("pick").withColumn(
                "search_method", F.concat("search_method", F.lit("+mmr"))
            )
        if s.decay:
            hits = hits.withColumn(
                "score", rerank.decayed("score", "updated", as_of, s.decay_lambda)
            ).withColumn("search_method", F.concat("search_method", F.lit("+decay")))
    page = hits.orderBy(F.desc("score"), "position").limit(n)
    ranked = fusion.with_rank(page, [F.desc("score"), "position"])
    return ranked.select(
        "rank", "text", "source", "project", "type", "tags", "section",
        F.round("score", 4).alias("score"), "search_method",
    )


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunk, note, project and type counts of an index.

    Distinct values are counted in two steps, so no value set is held in one task.
    """
    per_source = chunks.groupBy("source", "project", "type").agg(F.count(F.lit(1)).alias("n"))
    return per_source.agg(
        F.sum("n").alias("total_chunks"),
        F.count_distinct("source").alias("total_notes"),
        F.count_distinct(F.when(F.col("project") != "", F.col("project"))).alias("projects"),
        F.count_distinct(F.when(F.col("type") != "", F.col("type"))).alias("types"),
    )
