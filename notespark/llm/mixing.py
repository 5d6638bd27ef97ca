"""Mixing sources to target weights by hierarchical budgets.

Sources form a tree: domain, language, source.  A budget of tokens goes down the tree by weights.  A
node that has less than its share gives up the rest to its siblings, by their weights, and only what
a whole branch cannot use goes to the siblings of its parent.  Each leaf then reads its documents
epoch by epoch, each epoch in an order of its own drawn by a seed: whole epochs as far as its budget
goes, and of the next the longest prefix that still fits.

The tree is a table with a row per leaf.  A leaf's prefix is found by its cut: token sums per leaf
and range of the order tell in which range the budget ends, and only the documents of that range are
put in order.  So a leaf with a third of all documents is no task of its own, and documents are
filtered by their leaf's cut without a shuffle.

Defined cases: a null text has no tokens; a null name is a name of its own, with weight 1 unless it
is given one; a weight of 0 gives nothing; documents without tokens come along as far as the prefix
goes; rows with one id are taken or left together; fractions of a token are not handed out; an empty
table gives no rows; other columns come back inside ``row``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notespark.llm.common import documents, staged, whole_text

LEVELS = ("domain", "language", "source")
RANGE_DIGITS = 3
NO_NAME = "\x00"


@dataclass(frozen=True)
class Mix:
    """``weights``: of each level, by name, whole numbers; others weigh ``other``.

    ``share`` of all tokens is the budget; no document is read more than ``epochs`` times.
    """

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    share: float = 0.5
    epochs: int = 2
    seed: int = 11
    other: int = 1


def weight(mix: Mix, level: str) -> Column:
    out = F.lit(mix.other)
    for name, value in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(value)).otherwise(out)
    return out.cast("long")


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order, as 32 hex digits."""
    shown = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), shown).cast("binary"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves ``(domain, language, source, supply)`` with the ``quota`` of each in tokens."""
    nodes = leaves.withColumn("capacity", F.col("supply") * mix.epochs)
    total = nodes.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * mix.share).alias("quota"))
    given = total.select(F.floor("quota").cast("long").alias("quota"))
    for depth, level in enumerate(LEVELS):
        above, path = list(LEVELS[:depth]), list(LEVELS[:depth + 1])
        level_nodes = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        # at the root this is one row
        joined = level_nodes.join(given, above) if above else level_nodes.join(given, F.lit(True))
        given = _filled(joined.withColumn("weight", weight(mix, level)), above, level).select(*path, "quota")
    return leaves.join(given, list(LEVELS))


def _filled(nodes: DataFrame, above: Sequence[str], level: str) -> DataFrame:
    """Share ``quota`` of the parent among siblings by ``weight``, none above its ``capacity``.

    Siblings in the order of capacity per weight: the first that can take its share tells the rate
    of all after it, and that rate is the largest of those computed at each sibling.
    """
    nodes = nodes.where("weight > 0")
    order = W.partitionBy(*above).orderBy(F.col("capacity") / F.col("weight"), level)
    taken = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rated = nodes.withColumn("rate", (F.col("quota") - taken) / open_weight)
    rate = F.max("rate").over(W.partitionBy(*above))
    return rated.withColumn("rate", rate).withColumn(
        "quota", F.least(F.col("capacity"), F.greatest(F.floor(F.col("rate") * F.col("weight")), F.lit(0))).cast("long"))


def cuts(narrow: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf its quota, ``whole`` epochs, and ``last``: the last key of the next epoch's prefix.

    ``narrow`` has a row per document: levels, ``doc_id``, ``tokens``.
    """
    names = list(LEVELS)
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("supply"))
    supply = F.greatest(F.col("supply"), F.lit(1))
    quotas = staged(budgets(leaves, mix).select(
        *names, "supply", "quota", F.floor(F.col("quota") / supply).alias("whole"),
        (F.col("quota") % supply).alias("rest")), "mix-quotas")
    keyed = narrow.join(quotas.where(F.col("whole") < mix.epochs), names).withColumn(
        "key", order_key(mix, F.col("whole"), F.col("doc_id"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    of_range = keyed.groupBy(*names, "range", "rest").agg(F.sum("tokens").alias("n"))
    along = W.partitionBy(*names).orderBy("range")
    sums = of_range.withColumn("before", F.sum("n").over(along) - F.col("n"))
    # the first range that does not fit; all before it are taken whole
    over = sums.where(F.col("before") + F.col("n") > F.col("rest")).groupBy(*names).agg(
        F.min_by(F.struct("range", "before"), "range").alias("cut")).select(*names, "cut.range", "cut.before")
    inside = keyed.join(over, [*names, "range"]).groupBy(*names, "range", "before", "rest", "key").agg(F.sum("tokens").alias("n"))
    place = F.sum("n").over(W.partitionBy(*names).orderBy("key"))
    last = inside.withColumn("until", F.col("before") + place).where(F.col("until") <= F.col("rest")).groupBy(*names).agg(
        F.max("key").alias("last"))
    # without a cut the whole epoch fits; with one and no key inside, all of the ranges before
    everything = F.lit("g")
    found = quotas.join(over, names, "left").join(last, names, "left")
    return staged(found.select(
        *names, "quota", "whole", F.when(F.col("whole") >= mix.epochs, F.lit("")).otherwise(
            F.coalesce("last", "range", everything)).alias("last")), "mix-cuts")


def mixed(docs: DataFrame, mix: Mix, levels: Mapping[str, Column], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents to read: ``row``, its levels, ``epoch`` and the ``quota`` of its leaf.

    A document comes once for each epoch in which it is read.
    """
    names = list(LEVELS)
    plain = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
        *[F.coalesce(levels[n].cast("string"), F.lit(NO_NAME)).alias(n) for n in names])
    narrow = staged(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), *[F.coalesce(levels[n].cast("string"), F.lit(NO_NAME)).alias(n) for n in names],
        tokens(whole_text(f"`{text}`")).alias("tokens")), "mix-tokens")
    # a row per leaf, staged: the join is planned by the size of its file
    placed = plain.join(cuts(narrow, mix), names)
    more = order_key(mix, F.col("whole"), F.col("doc_id")) <= F.col("last")
    epochs = F.concat(
        F.when(F.col("whole") > 0, F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.when(more & (F.col("last") != ""), F.array(F.col("whole").cast("int"))).otherwise(F.array().cast("array<int>")))
    return placed.select("row", *[F.nullif(F.col(n), F.lit(NO_NAME)).alias(n) for n in names], "quota", F.explode(epochs).alias("epoch"))


DOMAINS = 4
MIX = Mix(weights={
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "language": {"en": 5, "de": 2, "fr": 2, "es": 1},
})


def document_levels() -> dict[str, Column]:
    """Domains by the number of the source; the tables name no domains."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return {
        "domain": F.concat(F.lit("domain"), F.pmod(number, F.lit(DOMAINS)).cast("string")),
        "language": F.col("lang"), "source": F.col("source")}


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the tokens of all documents, mixed to the target weights."""
    return mixed(documents(spark, folder), MIX, document_levels()).select(
        F.col("row.doc_id").alias("doc_id"), "domain", "language", "source", "quota", "epoch")


def _sql_level(source: str, out: str, depth: int) -> str:
    above, level = list(LEVELS[:depth]), LEVELS[depth]
    path = ", ".join(LEVELS[:depth + 1])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in MIX.weights.get(level, {}).items())
    weight_sql = f"CASE {level} {cases} ELSE {MIX.other} END" if cases else str(MIX.other)
    using = f"JOIN {source} USING ({', '.join(above)})" if above else f"CROSS JOIN {source}"
    order = f"{part} ORDER BY capacity / weight, {level}"
    return f"""
    {out}_n AS (SELECT {path}, sum(capacity)::BIGINT AS capacity, {weight_sql} AS weight FROM leaves GROUP BY {path}),
    {out}_r AS (SELECT *, (quota - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {out}_n {using}),
    {out} AS (SELECT {path}, least(capacity, greatest(floor(max(rate) OVER ({part}) * weight), 0))::BIGINT AS quota FROM {out}_r)"""


ORACLE = {"op10_mixing": f"""
    WITH d AS (SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT), 0) % {DOMAINS})
                      AS domain, lang AS language, source,
                      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
               FROM documents),
    leaves AS (SELECT domain, language, source, sum(tokens)::BIGINT AS supply, sum(tokens)::BIGINT * {MIX.epochs} AS capacity
               FROM d GROUP BY ALL),
    root AS (SELECT floor(sum(supply) * {MIX.share}::DOUBLE)::BIGINT AS quota FROM leaves),
    {_sql_level('root', 'one', 0)}, {_sql_level('one', 'two', 1)}, {_sql_level('two', 'three', 2)},
    q AS (SELECT domain, language, source, quota, quota // greatest(supply, 1) AS whole, quota % greatest(supply, 1) AS rest
          FROM three JOIN leaves USING (domain, language, source)),
    k AS (SELECT *, md5('{MIX.seed}:' || whole || ':' || doc_id) AS key FROM d JOIN q USING (domain, language, source)),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key) AS until FROM k)
    SELECT doc_id, domain, language, source, quota, e::INTEGER AS epoch
    FROM (SELECT *, unnest(range(0, whole)) AS e FROM s
          UNION ALL SELECT *, whole AS e FROM s WHERE until <= rest AND whole < {MIX.epochs})"""}
QUERIES = {"op10_mixing": op10_mixing}
