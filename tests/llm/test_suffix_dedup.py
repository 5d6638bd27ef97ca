import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import suffix_dedup as sd
from tests_llm_data import ODD_TEXTS

LENGTH = 100


def brute(texts):
    """``doc_id``: (bytes, removed, runs, digest of the rest), by the rule word for word."""
    first = {}
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        key = (d is not None, d or 0)
        for k in range(len(t) - LENGTH + 1):
            first.setdefault(t[k:k + LENGTH], (key, k))
    out = {}
    for d, t in texts:
        key, gone = (d is not None, d or 0), bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if first[t[k:k + LENGTH]] < (key, k):
                gone[k:k + LENGTH] = b"\x01" * LENGTH
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[d] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(frame):
    return {
        r["row"]["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        for r in frame.collect()}


def cases(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(35)
    texts = []
    for k in range(60):
        t = text(rnd.randrange(0, 120))
        if k % 3 == 0:
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + passage[rnd.randrange(20):len(passage) - rnd.randrange(20)] + t[at:]
        if k % 4 == 0:
            t += other + t[:150] + other
        texts.append((rnd.randrange(10**6), t))
    base = text(200)
    texts += [(10**6 + k, base[:k * 7] + "#" + base[k * 7:]) for k in range(20)]
    texts += [(2 * 10**6, base), (5, base), (2 * 10**6 + 1, "x" * 700), (2 * 10**6 + 2, "xy" * 300 + "x" * 400)]
    return list(dict(texts).items())


@pytest.mark.parametrize(("seed", "large"), [(1, 20_000), (2, 20_000), (3, 3)])
def test_against_brute_force(docs, seed, large):
    texts = cases(seed)
    want = brute([(d, t.encode()) for d, t in texts])
    assert got(sd.without_repeats(docs(texts).repartition(7), large_bucket=large)) == want


def test_the_cover_is_the_same_wherever_a_window_stands():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 101, 5000).astype(np.uint8)
    place, _, first, last = sd.cover(data)
    assert first[0] == 0 and last[-1] == len(data) - LENGTH
    assert (first[1:] == last[:-1] + 1).all()
    assert ((place >= first) & (place <= first + LENGTH - sd.GRAM)).all()
    moved = np.concatenate((rnd.integers(97, 101, 333).astype(np.uint8), data[1000:1400]))
    p, _, f, t = sd.cover(moved)
    covers = {w: q - w for q, a, b in zip(p, f, t, strict=True) for w in range(a, b + 1)}
    here = {w: q - w for q, a, b in zip(place, first, last, strict=True) for w in range(a, b + 1)}
    for k in range(300):
        assert covers[333 + k] == here[1000 + k]


def test_a_long_text_is_covered_across_pieces(monkeypatch):
    data = np.random.default_rng(3).integers(97, 99, 3000).astype(np.uint8)
    whole = sd.cover(data)
    monkeypatch.setattr(sd, "PIECE", 250)
    for a, b in zip(whole, sd.cover(data), strict=True):
        assert (a == b).all()


def test_odd_rows_and_an_empty_table(docs):
    line = "the same line again and again, longer than one hundred bytes, so that it is found wherever it stands in a text"
    texts = [*enumerate(ODD_TEXTS), (None, line), (100, line + line), (101, line)]
    table = docs(texts).withColumn("kept", F.lit("clash"))
    want = brute([(d, (t or "").encode()) for d, t in texts])
    assert got(sd.without_repeats(table)) == want
    assert sd.without_repeats(docs([])).count() == 0


def test_repeated_rows_are_one_document(docs):
    rnd = random.Random(4)
    line = "".join(rnd.choice("abcdefgh") for _ in range(150))
    rows = sd.without_repeats(docs([(1, line), (1, line), (2, line)])).collect()
    assert sorted((r["row"]["doc_id"], len(r["kept"])) for r in rows) == [(1, len(line)), (1, len(line)), (2, 0)]


@pytest.mark.parametrize("large", [20_000, 1])
@pytest.mark.parametrize("shared", [None, 7])
def test_texts_that_share_an_id_are_cut_one_by_one(docs, shared, large):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line, other, plain = text(200), text(150), text(800)
    repeating = text(300) + line + text(100)
    same = [text(40) + other + text(60) for _ in range(2)]  # the same bytes at the same offset
    rows = [(1, line), (shared, plain), (shared, repeating), (shared, same[0]), (shared, same[1]), (shared, plain)]
    order = -1 if shared is None else shared
    found = sd.without_repeats(docs(rows).repartition(3), large_bucket=large).collect()
    left = sorted((r["row"]["text"], bytes(r["kept"]).decode()) for r in found if r["row"]["doc_id"] == shared)
    assert len(found) == len(rows)
    assert [k for t, k in left if t == plain] == [plain, plain]
    first = order < 1  # a null id comes before 1, so the line of document 1 goes
    assert [k for t, k in left if t == repeating] == [repeating if first else repeating.replace(line, "")]
    assert [bytes(r["kept"]).decode() for r in found if r["row"]["doc_id"] == 1] == ["" if first else line]
    assert sorted(k == t for t, k in left if t in same) == [False, True]
    assert [k for t, k in left if t in same and k != t] == [t.replace(other, "") for t, k in left if t in same and k != t]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = sd.op7_suffix_dedup(spark, folder).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute(texts)
