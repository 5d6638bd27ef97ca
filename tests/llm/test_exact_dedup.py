import hashlib
import random

import pytest
from pyspark.sql import functions as F

from notespark.llm import exact_dedup as ed
from tests_llm_data import ODD_TEXTS


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(d)
    return {(d, max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)]),
             hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows}


def got(frame):
    rows = frame.collect()
    return rows, {(r["row"]["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows}


@pytest.mark.parametrize("bucket_bytes", [1500, 20_000, ed.BUCKET_BYTES])
def test_against_brute_force_at_any_bucket_size(docs, bucket_bytes, monkeypatch):
    monkeypatch.setattr(ed, "FLUSH_ROWS", 60)
    rnd = random.Random(1)
    texts = [rnd.choice(["hot text of many copies " * 6, "Other", "other", f"own {k}", "x" * rnd.randrange(900)]) for k in range(700)]
    table = docs(texts).repartition(9)
    rows, found = got(ed.deduplicate(table, bucket_bytes=bucket_bytes))
    assert len(rows) == 700
    assert found == brute([(k + 1, t) for k, t in enumerate(texts)])
    kept = [r["row"]["doc_id"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted({k for _, k, _, _ in found})
    stay = ed.unique(table, bucket_bytes=bucket_bytes).collect()
    assert sorted(r["row"]["doc_id"] for r in stay) == sorted(kept)
    assert {(r["row"]["doc_id"], r["row"]["text"]) for r in stay} == {(k, texts[k - 1]) for k in kept}


def test_odd_texts_ties_and_an_empty_table(docs):
    pairs = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(99, "tie"), (99, "tie"), (None, "tie"), (None, "alone")]
    rows, found = got(ed.deduplicate(docs(pairs).withColumn("keep_id", F.lit("clash"))))
    assert len(rows) == len(pairs)
    assert found == brute(pairs)
    ties = [r for r in rows if r["row"]["text"] == "tie"]
    assert sorted(r["kept"] for r in ties) == [False, False, True]
    assert [r["kept"] for r in rows if r["row"]["text"] == "alone"] == [True]
    assert ed.deduplicate(docs([])).count() == ed.unique(docs([])).count() == 0
    assert ed.unique(docs(pairs)).count() == len({r["text_sha256"] for r in rows})


def test_equal_hashes_are_not_equal_contents():
    table = ed.ContentTable(4)
    numbers = [table.put(7, c) for c in (b"a", b"b", b"a", b"c", b"b")]
    assert numbers == [0, 1, 0, 2, 1]
    many = [table.put(k % 5, str(k).encode()) for k in range(500)]
    assert many == [table.put(k % 5, str(k).encode()) for k in range(500)]
