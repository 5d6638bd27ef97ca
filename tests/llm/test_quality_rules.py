import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notespark.llm import quality_rules as qr
from tests_llm_data import ODD_TEXTS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(k, k + 8))
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(docs):
    texts = [*ODD_TEXTS, "a b c d e f g h " * 3, "x a b c d e f g h y a b c d e f g h z", "1 2 3 4 5 6 7 8", "1 " * 9, "#a| b\n#a| b\n\n c",
             " lead\x1cand trail ", "a\r\na\n", "é ü ß"]
    table = docs(texts).withColumn("n_words", F.lit("clash"))
    rows = qr.measured(table).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == brute(r["row"]["text"])


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = qr.op5_quality_rules(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    judged = [r for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(r["kept"] == (labels[r["doc_id"]] == 1) for r in judged) / len(judged) > 0.98
    assert all(r["kept"] for r in judged if labels[r["doc_id"]] == 1)


def test_no_python_in_the_plan(spark, docs):
    measures = qr.measured(docs(["a"]))
    plan = qr.with_verdict(measures, [(qr.Condition("words", True, 3.0),)])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_learns_a_conjunction(spark, docs):
    # bad: long words and many symbols together; either alone is good
    def text(k):
        word = "longishword" if k & 1 else "it"
        return " ".join(f"{word}{'$' if k & 2 and j % 2 else ''}{j}" for j in range(30 + k % 17))

    table = docs([(k, text(k)) for k in range(400)])
    labels = spark.createDataFrame([(k, int(k & 3 != 3)) for k in range(400)], "doc_id long, quality int")
    measures = qr.staged(qr.measured(table), "test")
    rules = qr.learn(measures, labels)
    assert rules and all(len(r) <= 3 for r in rules)
    got = {r["row"]["doc_id"]: r["kept"] for r in qr.with_verdict(measures, rules).collect()}
    assert got == {k: k & 3 != 3 for k in range(400)}


@pytest.mark.parametrize("labels", [[], [(None, 0), (3, None), (999, 0)], [(1, 0), (1, 1)]])
def test_little_to_learn_from(spark, docs, labels):
    table = docs([*ODD_TEXTS, "one " * 5 + " ".join(map(str, range(40)))])
    rows = qr.judged(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert qr.judged(docs([]), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_order_decides(spark):
    rules = [(qr.Condition("words", True, 10.0),), (qr.Condition("words", True, 5.0), qr.Condition("words", False, 8.0))]
    rows = spark.range(12).select("id", qr.decision(rules, {"words": F.col("id").cast("double")}).alias("rule")).collect()
    assert [r["rule"] for r in rows] == [None] * 5 + [2] * 3 + [None] * 2 + [1] * 2


def test_verdicts_on_labels_that_were_not_learned(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    judged = qr.judged(docs, labels.where(~third)).select("row.doc_id", "base_failed", "kept").join(labels.where(third), "doc_id")
    rows = judged.groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in rows}
    good, bad = (sum(c for k, c in n.items() if k[0] == q) for q in (1, 0))
    assert sum(c for k, c in n.items() if k[0] == 0 and not k[2]) / bad > 0.95
    assert n.get((1, False, False), 0) / good < 0.01  # dropped by a rule and not by the base
