import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from notespark.functions.text import once
from notespark.llm import sketches as sk
from tests_llm_data import ODD_TEXTS

COLUMNS = ("n_chars", "edited_sha256", "near_edited", "near_next")


def paragraphs(text):
    found = (p.strip(" \t\r\x0b\x0c") for p in re.findall(r"(?:[^.!?\n]*[.!?]+){1,3}|[^.!?\n]+", text))
    return {p for p in found if p}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    """Texts in order of ids, compared as plain sets."""
    out = []
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        version = text[:len(text) - half] + after[:half]
        out.append((len(text), hashlib.sha256(version.encode()).hexdigest(), alike(text, version), alike(text, after)))
    return out


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])


def rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.orderBy("row.doc_id").collect()]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    got = sk.op12_sketches(spark, folder).orderBy("doc_id").collect()
    close([tuple(r[c] for c in COLUMNS) for r in got], brute(texts))
    prints = {}
    for r, text in zip(got, texts):
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 40 * sk.CELLS
    assert sum(r["near_edited"] for r in got) > 50 * sum(r["near_next"] for r in got)


def test_odd_texts_and_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(sk, "BUCKET", 4)
    close(rows(sk.compared(docs(ODD_TEXTS).repartition(3))), brute([t or "" for t in ODD_TEXTS]))


def test_one_document_is_its_own_next(docs):
    close(rows(sk.compared(docs(["One. Two. Three. Four.\nFive"]))), brute(["One. Two. Three. Four.\nFive"]))


def test_an_empty_table(docs):
    assert sk.compared(docs([])).count() == 0


def test_null_and_repeated_ids_repeated_rows_and_clashing_names(spark, docs):
    table = docs([(None, "a. b."), (None, "c. d."), (5, "e. f."), (5, "e. f."), (5, "g"), (2, "first.")])
    table = table.withColumn("next", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("digests", F.lit("x"))
    out = sk.compared(table).collect()
    assert len(out) == 6
    assert all(r["row"]["next"] == "clash" for r in out)
    assert len({(r["edited_sha256"]) for r in out if r["row"]["text"] == "e. f."}) == 1
    order = [r["text"] for r in table.dropDuplicates(["doc_id", "text"]).orderBy(
        F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()]
    want = dict(zip(order, brute(order)))
    for r in out:
        close([tuple(r[c] for c in COLUMNS)], [want[r["row"]["text"]]])


def test_differing_digests_come_back(spark, docs):
    """Small and large differences, and what is recovered is the symmetric difference."""
    rnd = random.Random(2)
    lines = lambda n: [f"line {rnd.randrange(10**9)}" for _ in range(n)]
    cases = []
    for size, gone, new in [(5, 0, 0), (40, 1, 2), (40, 5, 5), (40, 40, 0), (3000, 3, 1), (3000, 700, 600), (0, 0, 30)]:
        first = lines(size)
        second = rnd.sample(first, size - gone) + lines(new)
        cases.append(("\n".join(first), "\n".join(second)))
    table = spark.createDataFrame(cases, "x string, y string")
    keyed = once(table, a=sk.digests(F.col("x")), b=sk.digests(F.col("y")))
    drawn = once(keyed, ca=sk.sketch(F.col("a")), cb=sk.sketch(F.col("b")))
    out = once(drawn, found=sk.difference(F.col("a"), F.col("ca"), F.col("b"), F.col("cb")),
               base=sk.peel(sk.subtract(F.col("ca"), F.col("cb")), sk.CELLS))
    small = 0
    for r in out.collect():
        signed = sorted((e["k"], e["n"]) for e in r["found"])
        assert signed == sorted([(k, 1) for k in set(r["a"]) - set(r["b"])] + [(k, -1) for k in set(r["b"]) - set(r["a"])])
        if r["base"] is not None:
            small += 1
            assert sorted((e["k"], e["n"]) for e in r["base"]) == signed
    assert 3 <= small < len(cases)


def test_larger_sketches_and_the_exact_way_after_failures(spark, monkeypatch):
    monkeypatch.setattr(sk, "SIZES", (3, 6))
    keys = list(range(60))
    table = spark.createDataFrame([(keys[:40], keys[10:])], "a array<long>, b array<long>")
    found = table.select(sk._larger(F.col("a"), F.col("b")).alias("f")).first()["f"]
    assert sorted((e["k"], e["n"]) for e in found) == [(k, 1) for k in range(10)] + [(k, -1) for k in range(40, 60)]


def test_no_python_in_the_plan(spark):
    plan = sk.op12_sketches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
