import hashlib
import math

import pytest
from pyspark.sql import functions as F

from notespark.llm import mixing as mx
from tests_llm_data import ODD_TEXTS


def levels():
    return {"domain": F.substring("source", 1, 1), "language": F.col("lang"), "source": F.col("source")}


def fill(quota, nodes):
    """``name: (capacity, weight)`` to budgets: hand out, take back what cannot be used, again."""
    nodes = {n: v for n, v in nodes.items() if v[1] > 0}
    given, open_ = {}, dict(nodes)
    while open_:
        rate = quota / sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c <= rate * w]
        if not full:
            return given | {n: math.floor(rate * w) for n, (_, w) in open_.items()}
        for n in full:
            given[n] = open_.pop(n)[0]
            quota -= given[n]
    return given


def brute(rows, mix):
    """rows ``(doc_id, domain, language, source, tokens)`` to ``{(doc_id, epoch): quota}``."""
    supply = {}
    for r in rows:
        supply[r[1:4]] = supply.get(r[1:4], 0) + r[4]
    quotas = {(): math.floor(sum(supply.values()) * mix.share)}
    for depth, level in enumerate(mx.LEVELS):
        nxt = {}
        for parent, quota in quotas.items():
            nodes = {}
            for leaf, n in supply.items():
                if leaf[:depth] == parent:
                    path = leaf[:depth + 1]
                    c = nodes.get(path, (0, 0))[0] + n * mix.epochs
                    nodes[path] = (c, mix.weights.get(level, {}).get(path[-1], mix.other))
            nxt |= fill(quota, nodes)
        quotas = nxt
    out = {}
    for leaf, quota in quotas.items():
        docs = [r for r in rows if r[1:4] == leaf]
        whole, rest = divmod(quota, max(supply[leaf], 1))
        for e in range(whole):
            out |= {(r[0], e): quota for r in docs}
        if whole < mix.epochs:
            keyed = sorted((hashlib.md5(f"{mix.seed}:{whole}:{r[0]}".encode()).hexdigest(), r) for r in docs)
            until = 0
            for _, r in keyed:
                until += r[4]
                if until > rest:
                    break
                out[r[0], whole] = quota
    return out


def table_of(spark, rows):
    return spark.createDataFrame(
        [(d, "w " * n, lang, source, 1) for d, _, lang, source, n in rows], "doc_id long, text string, lang string, source string, epoch int")


@pytest.mark.parametrize("mix", [
    mx.Mix(), mx.Mix(share=1.0, epochs=1), mx.Mix(share=3.0), mx.Mix({"domain": {"a": 7, "b": 1}, "language": {"en": 3}}, 0.9, 3, 5),
    mx.Mix({"domain": {"a": 0}, "source": {"b2": 9}}, 0.6), mx.Mix(share=0.0),
])
def test_against_brute_force(spark, mix):
    sources = ["a1", "a2", "b1", "b2", "c1"]
    rows = [(k, s[0], lang, s, (k * 37) % 23) for k in range(240)
            for s in [sources[min(k % 9, 4)]] for lang in ["en" if k % 3 else "de"]]
    got = {(r["row"]["doc_id"], r["epoch"]): r["quota"] for r in mx.mixed(table_of(spark, rows), mix, levels()).collect()}
    assert got == brute(rows, mix)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "a1", 10), ("a", "en", "a2", 1000), ("b", "en", "b1", 1000)], "domain string, language string, source string, supply long")
    mix = mx.Mix(share=400 / 2010, epochs=1)
    quotas = {r["source"]: r["quota"] for r in mx.budgets(leaves, mix).collect()}
    assert quotas == {"a1": 10, "a2": 190, "b1": 200}


def test_odd_rows_and_an_empty_table(docs):
    table = docs([*ODD_TEXTS, (None, "no id"), (3, "one text"), (3, "one text")]).withColumn("quota", F.lit("clash"))
    table = table.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    rows = mx.mixed(table, mx.Mix(share=5.0, epochs=2), levels()).collect()
    assert len(rows) == 2 * (len(ODD_TEXTS) + 3)
    assert {r["epoch"] for r in rows} == {0, 1}
    assert mx.mixed(docs([]), mx.Mix(), levels()).count() == 0


def test_repeated_ids_are_taken_together(spark):
    rows = [(k % 5, "a", "en", "a1", 3) for k in range(100)]
    got = mx.mixed(table_of(spark, rows), mx.Mix(share=0.5, epochs=1), levels()).groupBy("row.doc_id").count().collect()
    assert {r["count"] for r in got} == {20}
    assert len(got) == 2
