"""Keyword search with Okapi BM25.

Two ways to the same scores: one pass over the texts, and a stored inverted index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark import vocab
from notespark.functions import text as tx
from notespark.session import kept
from notespark.sources import versions

#: Postings that one task sorts and writes, about.
POSTINGS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class BM25:
    k1: float = vocab.BM25_K1
    b: float = vocab.BM25_B
    epsilon: float = vocab.BM25_EPSILON


def _idf(n: Column | float, df: Column | float):
    if isinstance(df, Column):
        return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)
    return math.log(n - df + 0.5) - math.log(df + 0.5)


def _profile(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Add each document's length ``_len`` and its count ``_tf<i>`` of every term, reading and
    splitting the text once."""

    def counts(tokens: Column) -> Column:
        def of(term: str) -> Column:
            return F.size(F.filter(tokens, lambda token: token == term))

        return F.struct(
            F.size(tokens).alias("_len"), *[of(t).alias(f"_tf{i}") for i, t in enumerate(terms)]
        )

    return docs.select("*", F.inline(F.transform(F.array(tx.tokens(text)), counts)))


def _weight(tf: Column, length: Column, average: Column | float, p: BM25) -> Column:
    norm = F.lit(p.k1) * (F.lit(1 - p.b) + F.lit(p.b) * length / average)
    return tf * F.lit(p.k1 + 1) / (tf + norm)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of documents each term occurs in; counted in each task before the shuffle."""
    return (
        docs.select(F.explode(F.array_distinct(tx.tokens(text))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )


def _term_weights(docs: DataFrame, counts: Counter, n: int, df: dict, text: str, p: BM25) -> dict:
    """idf of each query term.  A term in more than half the documents has a negative idf and
    takes a share of the mean idf over all terms instead; only then is that mean computed."""
    idf = {t: _idf(n, df[t]) for t in counts if df[t]}
    if any(value < 0 for value in idf.values()):
        mean = (
            document_frequencies(docs, text)
            .agg(F.avg(_idf(float(n), F.col("df"))).alias("m")).first()["m"]
        )
        idf = {t: p.epsilon * mean if value < 0 else value for t, value in idf.items()}
    return idf


def score_scan(docs: DataFrame, query: str, text: str = "text", p: BM25 = BM25()) -> DataFrame:
    """Add ``score`` to the documents a query matches, by reading the texts.

    A first aggregation finds the few numbers the formula needs (count, mean length, document
    frequency of each query term); with them as constants, scoring is one narrow pass.
    """
    counts = Counter(tx.query_tokens(query))
    terms = sorted(counts)
    score = _score(docs, _profile(docs.select(text), text, terms), counts, text, p)
    scored = _profile(docs, text, terms).withColumn("score", score).where("score > 0")
    return scored.drop("_len", *_counted(terms))


def _counted(terms: list[str]) -> list[str]:
    return [f"_tf{i}" for i in range(len(terms))]


def _score(docs: DataFrame, profiled: DataFrame, counts: Counter, text: str, p: BM25) -> Column:
    """The score by the columns of :func:`_profile`, with the numbers of all documents as constants."""
    terms = sorted(counts)
    stats = profiled.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_len").alias("len"),
        *[F.count_if(F.col(tf) > 0).alias(tf) for tf in _counted(terms)],
    ).first()
    df = dict(zip(terms, (stats[tf] for tf in _counted(terms)), strict=True))
    idf = _term_weights(docs, counts, stats["n"], df, text, p)
    score = F.lit(0.0)
    for tf, term in zip(_counted(terms), terms, strict=True):
        if term in idf:
            score = score + F.lit(counts[term] * idf[term]) * _weight(F.col(tf), F.col("_len"), stats["len"], p)
    return score


def search(
    docs: DataFrame,
    query: str,
    n: int = 10,
    key: str = "doc_id",
    text: str = "text",
    where: Column | None = None,
    p: BM25 = BM25(),
) -> DataFrame:
    """Best ``n`` documents for a query.

    Scores are over all documents; ``where`` restricts which of them may be returned.  Texts are split once:
    a document's counts are kept beside its key, and the rows of the ``n`` best keys are fetched and scored.
    """
    counts = Counter(tx.query_tokens(query))
    terms = sorted(counts)
    may = F.lit(True) if where is None else where
    profiled = kept(_profile(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), may.alias("_may")), "_text", terms).drop(
        "_text"), "bm25-counts")
    score = _score(docs, profiled, counts, text, p)
    best = profiled.withColumn("score", score).where("_may AND score > 0").orderBy(F.desc("score"), "_key").limit(n)
    found = docs.where(may).join(F.broadcast(best.select("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    # keys may repeat, so the rows themselves are scored and cut again
    scored = _profile(found, text, terms).withColumn("score", score).where("score > 0")
    return scored.drop("_len", *_counted(terms)).orderBy(F.desc("score"), key).limit(n)


# ------------------------------------------------------------------------ stored index


def count_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """Each document's ``length`` and its distinct terms, ``counts`` of ``(term, tf)``; a row per document, with the columns ``also``.

    Counting is inside the row: equal tokens lie side by side once sorted.  Nothing is shuffled.
    """
    words = tx.once(docs.select(key, text, *also), _t=F.sort_array(tx.tokens(text)))
    size = F.size("_t")

    def at(i: Column) -> Column:
        return F.get(F.col("_t"), i)

    firsts = F.when(size > 0, F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))).otherwise(
        F.array().cast("array<int>"))
    marked = tx.once(words, _i=firsts)
    ends = F.slice(F.concat(F.slice("_i", F.lit(2), F.size("_i") + 1), F.array(size)), F.lit(1), F.size("_i"))
    counts = F.zip_with(
        "_i", ends,
        lambda first, end: F.struct(at(first).alias("term"), (end - first).cast("long").alias("tf")))
    return marked.select(key, size.alias("length"), counts.alias("counts"), *also)


def postings_of(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per term and document, of the rows of :func:`count_terms`."""
    return counted.select(key, "length", F.inline("counts"))


def build_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index: one row per term and document, with the term's count and the length.

    Counting is per document, inside the row, so no term is ever gathered in one place.
    """
    return postings_of(count_terms(docs, key, text), key)


def stage_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """:func:`count_terms` written to ``path``, and its totals; texts are split once.

    ``documents``, ``mean_length`` and ``files``: so many range partitions that the postings of one are sorted in memory.
    """
    spark = docs.sparkSession
    count_terms(docs, key, text, also).write.mode("overwrite").option("compression", "zstd").parquet(path)
    counted = spark.read.parquet(path)
    totals = counted.agg(
        F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length"),
        F.sum(F.size("counts")).alias("postings")).first().asDict()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counted, totals | {"files": max(least, (totals["postings"] or 0) // POSTINGS_PER_FILE + 1)}


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write postings ordered by term, term statistics, document lengths and a row of totals.

    Range partitions on (term, key) keep a frequent term in several files, and sorting lets
    Parquet skip all row groups without a query's terms.  Postings are shuffled once.
    """
    spark = docs.sparkSession
    counted, held = stage_counts(docs, f"{path}/counted", key, text)
    postings_of(counted, key).repartitionByRange(held["files"], "term", key).sortWithinPartitions("term", key).write.mode(
        "overwrite"
    ).parquet(f"{path}/postings")
    counted.select(key, "length").write.mode("overwrite").parquet(f"{path}/lengths")
    versions.delete(spark, f"{path}/counted")
    n = held["documents"]
    terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms.withColumn("idf", _idf(float(n), F.col("df"))).repartitionByRange("term").write.mode(
        "overwrite"
    ).parquet(f"{path}/terms")
    totals = spark.read.parquet(f"{path}/lengths").agg(
        F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length"))
    mean = spark.read.parquet(f"{path}/terms").agg(
        F.avg("idf").alias("mean_idf"), F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    totals.crossJoin(mean).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")  # a row each


def search_postings(
    postings: DataFrame,
    terms: DataFrame,
    documents: int,
    mean_length: float,
    query: str,
    n: int = 10,
    key: str = "doc_id",
    p: BM25 = BM25(),
    mean_idf: float | None = None,
) -> DataFrame:
    """Best ``n`` document keys for a query from postings; reads only the query's terms.

    ``mean_idf`` is asked for by terms in more than half the documents; without it all terms are read.
    """
    counts = Counter(tx.query_tokens(query))
    found = terms.where(F.col("term").isin(list(counts))).select("term", "df").collect()
    idf = {row["term"]: _idf(documents, row["df"]) for row in found}
    if any(value < 0 for value in idf.values()):
        mean = mean_idf
        if mean is None:
            mean = terms.agg(F.avg(_idf(float(documents), F.col("df")))).first()[0]
        idf = {t: p.epsilon * mean if value < 0 else value for t, value in idf.items()}
    factor = F.when(F.lit(False), F.lit(0.0))
    for term, value in sorted(idf.items()):
        factor = factor.when(F.col("term") == term, F.lit(counts[term] * value))
    part = factor * _weight(F.col("tf"), F.col("length"), F.lit(mean_length), p)
    return (
        postings.where(F.col("term").isin(sorted(idf)))
        .groupBy(key).agg(F.sum(part).alias("score")).where("score > 0")
        .orderBy(F.desc("score"), key).limit(n)
    )


def search_index(spark, path: str, query: str, n: int = 10, key: str = "doc_id") -> DataFrame:
    """:func:`search_postings` on an index written by :func:`write_index`."""
    totals = spark.read.parquet(f"{path}/totals").first()
    return search_postings(
        spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"),
        totals["documents"], totals["mean_length"], query, n, key, mean_idf=totals["mean_idf"],
    )
