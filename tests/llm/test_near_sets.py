import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from notespark.llm import near_sets as ns
from tests_llm_data import ODD_TEXTS


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + n]) for k in range(max(len(words) - n + 1, 1))} if words else set()


def brute(texts):
    """The smallest id of each component of texts with a similarity of 0.8 or more."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k, (d, _) in enumerate(texts):
        least[top(k)] = min(least.get(top(k), d), d)
    return sorted(least.values())


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def near_copies():
    """Pairs and chains above and below the threshold, and a family where not all are similar."""
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for changed in (1, 2, 3, 4, 5, 8):
        for _ in range(6):
            base = words(200)
            copy = list(base)
            for k in range(changed):
                copy[20 + 30 * k if changed < 6 else 10 + 22 * k] = "changed"
            texts += [" ".join(base), " ".join(copy)]
    base = words(150)
    for k in range(40):
        own = list(base)
        for at in rnd.sample(range(150), 2):
            own[at] = f"own{k}"
        texts.append(" ".join(own))
    numbers = rnd.sample(range(10**6), len(texts))
    return list(zip(numbers, texts, strict=True))


def test_the_stage_finds_all_pairs_above_the_threshold(spark, docs):
    texts = near_copies()
    want = brute(texts)
    assert len(want) < len(texts) - 60
    assert ids(cp.near(spark, docs(texts).repartition(5), "")) == want


def unlike(n, seed=3):
    """Texts with a large common part, so that many share a key, and hardly any two alike."""
    rnd = random.Random(seed)
    common = [f"c{k}" for k in range(120)]
    return [" ".join(common + [f"u{rnd.randrange(10**7)}" for _ in range(45)]) for _ in range(n)]


def test_texts_that_share_keys_and_are_not_alike(spark, docs, monkeypatch):
    """No row per pair, in one block and in several."""
    monkeypatch.setattr(ns, "BLOCK_BYTES", 40_000)
    texts = unlike(150)
    texts += [t + " end" for t in texts[:10]] + texts[:3]
    pairs = list(enumerate(texts, 1))
    want = brute(pairs)
    assert len(want) == 150
    assert ids(cp.near(spark, docs(pairs).repartition(4), "")) == want


def test_the_forest_of_a_block_is_exact():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 40, (6, 100))
    sets = []
    for k in range(80):
        own = base[k % 6].copy()
        changed = rnd.integers(3, 9)
        own[rnd.integers(0, 100, changed)] = rnd.integers(0, 1 << 40, changed)
        sets.append(np.unique(own).astype(np.uint64))

    def classes(links):
        root = list(range(80))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]

    alike = [(a, b) for b in range(80) for a in range(b) if ns.similar(sets[a], sets[b])]
    found = ns.forest(sets, list(range(80)), 0)
    assert 6 <= len(set(classes(alike))) < 80
    assert classes(found) == classes(alike) and len(found) == 80 - len(set(classes(alike)))
    across = ns.forest(sets, list(range(80)), 40)
    assert all((a < 40) != (b < 40) for a, b in across)
    assert classes(across) == classes([(a, b) for a, b in alike if (a < 40) != (b < 40)])


def test_clashing_names_and_repeated_rows(spark, docs):
    table = docs([(3, "one two three"), (1, "one two three"), (1, "one two three")]).withColumn("key", F.lit("clash"))
    table = table.withColumn("number", F.lit(9)).withColumn("row", F.lit(1))
    kept = ns.representatives(table).select("row.*").collect()
    assert [(r["doc_id"], r["key"], r["number"]) for r in kept] == [(1, "clash", 9)]


def test_given_documents_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert ids(cp.near(spark, table, "")) == brute(texts)


def test_odd_rows_and_an_empty_table(spark, docs):
    texts = list(enumerate(ODD_TEXTS))
    assert ids(cp.near(spark, docs(texts), "")) == brute(texts)
    assert cp.near(spark, docs([]), "").count() == 0
    kept = ns.representatives(docs([(None, "one two"), (4, "One  two"), (None, None), (None, "")])).collect()
    assert sorted((r["row"]["doc_id"] or 0) for r in kept) == [0, 4]
