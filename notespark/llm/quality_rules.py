"""Quality rules: a learned decision list over statistics of the text, in Spark expressions only.

Statistics of each text are computed by built-in functions, once, and staged.  From the labelled
texts a list of rules is learned by sequential covering: a rule grows by the threshold condition
that gains most on two thirds of the labelled rows still uncovered, is pruned on the other third,
and is kept if it is precise there; the rows it covers leave, and the next rule is grown.  Each
step is one aggregation whose result, a count per statistic and threshold, has a fixed size.  What
comes out is an ordered conditional expression.

Defined cases: a null text has no words and fails the base rule; missing labels and labels of
unknown documents teach nothing, and of several labels of an id the lowest counts; with no labels
the list is empty and the base rule alone decides; repeated rows are judged each; an empty table
gives no rows; other columns come back inside ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.functions.text import let, once
from notespark.llm.common import documents, staged, whole_text

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

CUTS = 48
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.9
LEAST_COVERED = 5


def _paired(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` after it."""
    return let(hashes, lambda a: let(
        F.greatest(F.size(a) - step, F.lit(0)),
        lambda n: F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))))


def repeated_words(words: Column) -> Column:
    """How many words lie in an 8-word window that the text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _paired(_paired(_paired(hashes, 1), 2), 4)

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(ordered, lambda s: F.zip_with(
            s, F.slice(s, F.lit(2), F.size(s)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        lengths = let(places, lambda p: F.zip_with(
            p, F.slice(p, F.lit(2), F.size(p)),
            lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)

    return let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")


def measured(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, or all) and the statistics of its text."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), whole_text(f"`{text}`").alias("_text"))
    words = F.filter(F.split("_text", SPACE, -1), lambda w: w != "")
    rows = once(rows, _words=words)
    return once(
        rows.select(
            "row", F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _duplicate_lines(F.col("_text")).alias("_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
            F.size(F.array_distinct("_words")).cast("long").alias("n_distinct")),
        n_lines=F.col("_lines.n_lines"), n_dup_lines=F.col("_lines.n_dup_lines"),
    ).select("row", *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """What conditions may be about: ratios, so that long and short texts compare."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "symbols_per_word": F.col("n_symbols") / words,
        "word_length": F.col("word_chars") / words,
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "distinct_words": F.col("n_distinct") / F.sqrt(words),
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def test(self, value: Column) -> Column:
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.cut:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.test(values[condition.statistic])
    return out


def decision(rules: Sequence[Rule], values: dict[str, Column] | None = None) -> Column:
    """The number of the first rule that covers the row, from 1; null if none does."""
    values = values or statistics()
    out = None
    for number, rule in enumerate(rules, 1):
        case = covers(rule, values)
        out = F.when(case, F.lit(number)) if out is None else out.when(case, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def learn(measures: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
          most_rules: int = MOST_RULES, least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Rules for bad texts (label 0), most useful first.

    ``measures`` has the statistics' counts with ``row`` holding the id.
    """
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        "_id IS NOT NULL AND _label IS NOT NULL").groupBy("_id").agg(F.min("_label").alias("_label"))
    values = statistics()
    names = list(values)
    table = measures.where(~base_failed()).join(marked, F.col(f"row.`{doc_id}`") == F.col("_id")).select(
        "_id", (F.col("_label") == 0).cast("long").alias("_bad"), *[v.alias(n) for n, v in values.items()])
    table = staged(table, "quality-labelled")
    cuts = _cuts(table, names)
    bins = {n: _bin(F.col(n), cuts[n]) for n in names}
    # a cut's number is what a step counts; the cuts are the same for all rules
    table = staged(table.select(
        "_bad", (F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(3)) == 0).alias("_prune"), *[bins[n].alias(n) for n in names]),
        "quality-binned")
    found: list[Rule] = []
    as_bins: list[list[tuple[str, bool, int]]] = []
    while len(found) < most_rules:
        left = table
        for rule in as_bins:
            left = left.where(~_all(rule))
        rule = _grown(left.where("NOT _prune"), names, cuts)
        rule = _pruned(left.where("_prune"), rule, least_precision) if rule else []
        if not rule:
            break
        as_bins.append(rule)
        found.append(tuple(Condition(n, above, cuts[n][k]) for n, above, k in rule))
    return found


def _cuts(table: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """Candidate thresholds of each statistic: approximate quantiles of both labels' rows."""
    shares = [k / CUTS for k in range(CUTS + 1)]
    row = table.agg(
        *[F.percentile_approx(F.when(F.col("_bad") == bad, F.col(n)), shares, 10_000).alias(f"{n}_{bad}")
          for n in names for bad in (0, 1)]).first()
    return {n: sorted({c for bad in (0, 1) for c in row[f"{n}_{bad}"] or []}) for n in names}


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are not above the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value))


def _meets(condition: tuple[str, bool, int]) -> Column:
    name, above, k = condition
    return F.col(name) > k if above else F.col(name) <= k


def _all(rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & _meets(condition)
    return out


def _grown(left: DataFrame, names: Sequence[str], cuts: dict) -> list:
    """Add the condition of greatest gain until no good row is covered or none gains."""
    rule: list = []
    while len(rule) < MOST_CONDITIONS:
        cells = left.where(_all(rule)).select(
            "_bad", F.explode(F.array(*[
                F.struct(F.lit(k).alias("statistic"), F.col(n).cast("int").alias("bin")) for k, n in enumerate(names)])).alias("cell")
        ).groupBy("cell.statistic", "cell.bin").agg(F.sum("_bad").alias("bad"), F.count("*").alias("rows")).collect()
        of: dict[int, dict[int, tuple[int, int]]] = {}
        for c in cells:  # names times cuts of them at most
            of.setdefault(c["statistic"], {})[c["bin"]] = (c["bad"], c["rows"] - c["bad"])
        if not of:
            break
        bad, good = (sum(v[k] for v in of[min(of)].values()) for k in (0, 1))
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for number, counts in sorted(of.items()):
            b_below = g_below = 0
            for k in range(len(cuts[names[number]])):
                b_below += counts.get(k, (0, 0))[0]
                g_below += counts.get(k, (0, 0))[1]
                for above, b, g in ((True, bad - b_below, good - g_below), (False, b_below, g_below)):
                    if b < LEAST_COVERED:
                        continue
                    gained = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                    if gained > gain:
                        best, gain = (names[number], above, k), gained
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(left: DataFrame, rule: list, least_precision: float) -> list:
    """The head of the rule that does best on rows it was not grown on; empty if not precise."""
    heads = [rule[:k] for k in range(1, len(rule) + 1)]
    row = left.agg(*[
        F.sum(F.when(_all(head), v)).alias(f"{name}{k}")
        for k, head in enumerate(heads) for name, v in (("bad", F.col("_bad")), ("rows", F.lit(1)))]).first()
    best, worth = [], -1.0
    for k, head in enumerate(heads):
        bad, rows = row[f"bad{k}"] or 0, row[f"rows{k}"] or 0
        if bad and bad / rows >= least_precision and (2 * bad - rows) / rows > worth:
            best, worth = head, (2 * bad - rows) / rows
    return best


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
           keep: Sequence[str] | None = None) -> DataFrame:
    """Each row with its statistics and verdict.

    Returns ``row``, the statistics' counts, ``base_failed``, ``rule`` (the first that covers the
    row, null if none) and ``kept``.
    """
    measures = staged(measured(docs, text, keep), "quality-measures")
    return with_verdict(measures, learn(measures, labels, doc_id))


def with_verdict(measures: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    out = measures.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their counts and verdict."""
    out = judged(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), keep=("doc_id",))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE: dict = {}
