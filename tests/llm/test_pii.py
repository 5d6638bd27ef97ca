import hashlib
import re

import pytest
from pyspark.sql import functions as F

from notespark.llm import pii
from tests_llm_data import ODD_TEXTS

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def holds(kind, s):
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    d = digits(s)
    if kind == "card":
        double = [x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in BASE.items()}


DISGUISED = [
    ("mail j.doe at example.com now", "email", "j.doe at example.com"),
    ("write jane at example dot com please", "email", "jane at example dot com"),
    ("jane [at] example (dot) org", "email", "jane [at] example (dot) org"),
    ("jane(at)example.com", "email", "jane(at)example.com"),
    ("say jane @ example.com", "email", "jane @ example.com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("jane​.doe＠example．com", "email", "jane​.doe＠example．com"),
    ("call plus four nine three zero one two three four five six seven!", "phone",
     "plus four nine three zero one two three four five six seven"),
    ("card 4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("host 192 dot 168 dot 1 dot 10 ok", "ip", "192 dot 168 dot 1 dot 10"),
    ("192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
]


@pytest.mark.parametrize(("text", "kind", "found"), DISGUISED)
def test_disguises_are_undone_in_source_offsets(text, kind, found):
    base, both = pii.all_spans(text)
    assert base[kind] == []
    assert [text[s:e] for s, e in both[kind]] == [found]
    assert sum(map(len, both.values())) == 1


@pytest.mark.parametrize("text", [
    "look at example.com", "one two three go", "at dot at", "zero point five", "Привет, как дела", "a (at) b", "the dot",
    "un deux trois quatre", "100 200 300 400",
])
def test_clean_texts_stay_clean(text):
    assert not any(pii.all_spans(text)[1].values())


@pytest.mark.parametrize("text", [
    "1.2.3.4.5.6.7.8.9", "1.2.3..4.5.6.7", "999.1.1.1 10.0.0.1", "a@b@c.d.e@f.g a@b.c@d.e", "+1 (23) 456-78-90 +12", "a+b@c-d.e.",
    "4111111111111111 4111-1111-1111-1112", "0" * 5000 + ".1.1.1", "x@y", "@a.b", "+ 1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
])
def test_base_spans_are_those_of_the_patterns(text):
    if len(text) < 4000:
        assert pii.plain_spans(text) == brute(text)
    else:
        assert pii.plain_spans(text)["ip"] == [(0, len(text))]


def test_base_spans_stay_beside_added_ones():
    text = "a@b.com or c at d dot com, 10.0.0.1"
    base, both = pii.all_spans(text)
    assert set(base["email"]) < set(both["email"])
    assert both["ip"] == base["ip"]
    assert pii.masked(text) == "[email] or [email], [ip]"


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "@" * 100_000, "+1 " * 100_000, "one " * 100_000, "é" * 300_000,
                 "a dot " * 30_000, "(" * 100_000, " at " * 60_000):
        pii.all_spans(text)


def test_rows_odd_texts_and_an_empty_table(docs):
    table = docs(ODD_TEXTS + ["a@b.com"]).withColumn("spans", F.lit("clash"))
    rows = pii.spans(table).collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    assert {r["row"]["doc_id"]: r["spans"] for r in rows}[len(ODD_TEXTS) + 1] == "email:0:7"
    assert all(r["row"]["spans"] == "clash" for r in rows)
    assert pii.spans(docs([])).count() == 0


def test_query_against_the_patterns(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = pii.op6_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        said = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in want[k])
        assert [r[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
