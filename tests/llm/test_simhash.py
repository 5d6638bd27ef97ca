import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notespark.llm import simhash as sh
from notespark.llm.components import stars
from tests_llm_data import ODD_TEXTS


def plain_print(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[k:k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, budget=4):
    """Smallest index reachable, by comparing all pairs."""
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1:]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near(rng, count, flips):
    base = rng.integers(0, 1 << 64, count, dtype=np.uint64)
    out = [base]
    for _ in range(3):
        copy = base.copy()
        for _ in range(rng.integers(1, flips + 1)):
            copy ^= np.uint64(1) << rng.integers(0, 64, count).astype(np.uint64)
        out.append(copy)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("text", [*ODD_TEXTS[:12], *ODD_TEXTS[13:], "a b c d", "a b c d e", "A b\tC\nd  e"])
def test_fingerprint(text):
    assert sh.fingerprint(text or "") == plain_print(text)


@pytest.mark.parametrize("leaf", [3, 40, 100_000])
def test_links_against_all_pairs(spark, leaf):
    rng = np.random.default_rng(5)
    ball = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    prints = np.unique(np.concatenate((near(rng, 150, 6), ball, np.arange(20, dtype=np.uint64), [np.uint64(2**64 - 1)])))
    table = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "print long")
    roots = {r["node"]: r["root"] for r in stars(sh.links(table, leaf=leaf)).collect()}
    signed = prints.view(np.int64).tolist()
    want = classes(prints)
    groups = {}
    for value, c in zip(signed, want, strict=True):
        groups.setdefault(c, []).append(value)
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200)], "a long, b long")
    assert {(r["node"], r["root"]) for r in stars(links).collect()} == {(k, 0) for k in range(1, 61)} | {(200, 100)}


def test_odd_rows_and_an_empty_table(docs):
    table = docs([*ODD_TEXTS, (None, "one text"), (3, "one text")]).withColumn("component_id", F.lit("clash"))
    rows = sh.near_duplicates(table).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    names = {(r["row"]["doc_id"], r["row"]["text"]): r["component_id"] for r in rows}
    assert names[None, "one text"] == names[1, "one text"] == names[2, "One TEXT"] == 1
    assert names[4, ""] == names[5, None] == names[6, "   "] == 4
    assert sh.near_duplicates(docs([])).count() == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(r["text"]) for r in source]
    ids = [r["doc_id"] for r in source]
    want = {(i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, classes(prints), strict=True)}
    assert {tuple(r) for r in sh.op1_simhash(spark, folder).collect()} == want


def test_one_row_of_each_component_stays(docs):
    table = docs([(5, "one text"), (2, "One TEXT"), (2, "one text"), (None, "one text"), (7, "another matter"), (None, ""), (None, "  ")])
    rows = sh.representatives(table).collect()
    assert sorted((r["row"]["doc_id"] or 0) for r in rows) == [0, 2, 7]
    assert sh.representatives(docs([])).count() == 0
