"""Refining a result page: rerank, near-duplicates, diversity, decay.

These work on the candidates of a query, a list whose length the search has limited.
Greedy choices depend on the choices before them; they run per query in one Arrow batch,
many queries in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from notespark import vocab
from notespark.functions import text as tx


def lexical_score(query: str, text: str = "text") -> Column:
    """Default reranker: share of the query's distinct tokens found in the text."""
    words = sorted(set(tx.query_tokens(query)))
    if not words:
        return F.lit(0.0)
    return F.size(
        F.array_intersect(tx.tokens(text), F.array(*[F.lit(w) for w in words]))
    ) / F.lit(float(len(words)))


def rerank(candidates: DataFrame, score: Column, top: int | None = None,
           tie: str = "position") -> DataFrame:
    """Order candidates by a scorer, kept in ``rerank_score``.

    The scorer is a column: built-in functions, or a pandas UDF around a cross-encoder.
    """
    out = candidates.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), tie)
    return out if top is None else out.limit(top)


def _per_query(candidates: DataFrame, query: str, position: str, score: str | None,
               choose: Callable) -> DataFrame:
    """Keep the candidates ``choose`` picks, in the order picked as ``pick``."""
    tokens = candidates.withColumn("_tok", F.array_distinct(tx.tokens("text")))
    schema = StructType([*candidates.schema.fields, StructField("pick", LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(position)
        sets = [frozenset(t) for t in group["_tok"]]
        picked = choose(sets, list(group[score]) if score else None)
        kept = group.iloc[picked].drop(columns="_tok")
        return kept.assign(pick=range(1, len(picked) + 1))

    return tokens.groupBy(query).applyInPandas(run, schema)


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def deduplicate(candidates: DataFrame, threshold: float = vocab.DEDUP_THRESHOLD,
                query: str = "query_id", position: str = "position") -> DataFrame:
    """Drop a candidate that is as similar as ``threshold`` to one kept before it."""
    similar = _jaccard

    def choose(sets, _scores):
        kept: list[int] = []
        for i, tokens in enumerate(sets):
            if all(similar(tokens, sets[j]) < threshold for j in kept):
                kept.append(i)
        return kept

    return _per_query(candidates, query, position, None, choose)


def diversify(candidates: DataFrame, top: int = 5, lam: float = vocab.MMR_LAMBDA,
              score: str = "score", query: str = "query_id",
              position: str = "position") -> DataFrame:
    """Maximal marginal relevance: pick ``top`` candidates, each the best trade of relevance
    against its greatest similarity to those picked before.  ``pick`` gives the order."""
    similar = _jaccard

    def choose(sets, scores):
        count = len(sets)
        if count <= top:
            return list(range(count))
        low, high = min(scores), max(scores)
        width = (high - low) or 1.0
        gain = [(s - low) / width for s in scores]
        nearest = [0.0] * count
        left = list(range(count))
        best = max(left, key=lambda i: gain[i])
        picked = []
        while True:
            picked.append(best)
            left.remove(best)
            if len(picked) == top:
                return picked
            for i in left:
                nearest[i] = max(nearest[i], similar(sets[i], sets[best]))
            best = max(left, key=lambda i: lam * gain[i] - (1.0 - lam) * nearest[i])

    return _per_query(candidates, query, position, score, choose)


def decayed(score: Column | str, updated: Column | str, as_of: Column | str,
            lam: float = vocab.DECAY_LAMBDA) -> Column:
    """Score times exp(-lam * days since the update).

    Future or unreadable dates do not decay, nor do negative scores, which decay would raise.
    """
    score, day = tx.col(score), tx.col(updated)
    today = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    days = F.greatest(F.lit(0), F.datediff(today, day.try_cast("date")))
    factor = F.coalesce(F.exp(F.lit(-lam) * days), F.lit(1.0))
    return F.when(score > 0, score * factor).otherwise(score)
