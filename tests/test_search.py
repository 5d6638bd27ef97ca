import math
import random
import re

import pytest
from pyspark.sql import functions as F

from notespark.operators import bm25, chunking, fusion, rerank, vectors
from notespark.plans import search
from notespark.plans.search import SearchSettings


def note(spark, content, project="p", kind="note", title="t"):
    return spark.createDataFrame(
        [("p/n.md", project, kind, title, ["a"], None, content)],
        "path string, project string, note_type string, title string, tags array<string>, updated string, content string",
    )


def pieces(spark, content, **sizes):
    return [(r.section, r.text) for r in chunking.chunk_notes(note(spark, content), **sizes)
            .orderBy("chunk_index").collect()]


PREFIX = "[Project: p] [note] t\n\n"


def test_sections(spark):
    got = pieces(spark, "intro\n# One\ntext\n#tag line\n\n## Two ##\n")
    assert got == [("", PREFIX + "intro"), ("One", PREFIX + "# One\ntext"),
                   ("tag line", PREFIX + "#tag line"), ("Two ##", PREFIX + "## Two ##")]
    assert pieces(spark, "") == []


def test_window_without_break_characters(spark):
    body = "x" * (940 - len(PREFIX))
    got = [t for _, t in pieces(spark, body)]
    whole = PREFIX + body
    assert got == [whole[:500], whole[450:940]]


def test_cut_after_sentence_in_second_half(spark):
    body = "a" * 350 + ". " + "b" * 400
    got = [t for _, t in pieces(spark, body)]
    assert got[0].endswith("a.") and got[1].startswith("a" * 49 + ".")


def test_chunks_cover_the_text(spark):
    rng = random.Random(5)
    body = " ".join(rng.choice(["word", "other.", "line\n", "end. "]) for _ in range(900))
    whole = PREFIX + body.strip()
    covered, at = 0, 0
    for _, text in pieces(spark, body):
        at = whole.index(text[:60], max(0, at))
        assert at <= covered + 2 and len(text) <= 500
        covered = max(covered, at + len(text))
    assert covered >= len(whole) - 1


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        chunking.chunk_notes(note(spark, "x"), size=100, overlap=60)


DOCS = ["the cat sat on the mat", "the dog sat", "a bird flew over the cat", "the the the", "fish only"]


def brute_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = [re.findall(r"[a-z0-9_\-.]+", d) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for w in query.split():
            tf = t.count(w)
            s += idf.get(w, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        out.append(s)
    return out


@pytest.mark.parametrize("query", ["cat", "the cat", "sat sat dog", "unknown bird", "the"])
def test_bm25_matches_the_formula(spark, tmp_path, query):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    want = {i: s for i, s in enumerate(brute_bm25(DOCS, query)) if s > 0}
    got = {r.doc_id: r.score for r in bm25.score_scan(docs, query).collect()}
    assert got == pytest.approx(want)
    bm25.write_index(docs, str(tmp_path))
    stored = {r.doc_id: r.score for r in bm25.search_index(spark, str(tmp_path), query).collect()}
    assert stored == pytest.approx(want)


def test_bm25_filter_keeps_corpus_statistics(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    got = bm25.search(docs, "cat", where=F.col("doc_id") == 2).collect()
    assert [r.doc_id for r in got] == [2]
    assert got[0].score == pytest.approx(brute_bm25(DOCS, "cat")[2])
    assert bm25.search(docs, "!!").count() == 0


def test_nearest(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "vec_id long, embedding array<float>")
    got = vectors.nearest(rows, [2.0, 0.0], 2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (3, 0.7071)]


def ranked(spark, texts):
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)], "text string, rank int")


def test_fusion(spark):
    got = fusion.fuse(ranked(spark, ["a", "b", "a"]), ranked(spark, ["a", "c"])).collect()
    assert [(r.text, r.vector_rank, r.bm25_rank) for r in got] == [("a", 1, 1), ("b", 2, None), ("c", None, 2)]
    assert got[0].rrf_score == pytest.approx(2 / 61 + 1 / 63)
    assert got[1].rrf_score == pytest.approx(1 / 62)


def candidates(spark, texts, scores=None):
    scores = scores or [float(len(texts) - i) for i in range(len(texts))]
    return spark.createDataFrame(
        [(1, i + 1, t, s) for i, (t, s) in enumerate(zip(texts, scores))],
        "query_id int, position int, text string, score double")


def test_deduplicate(spark):
    got = rerank.deduplicate(candidates(spark, ["a b", "b a", "c"])).collect()
    assert [(r.position, r.pick) for r in sorted(got, key=lambda r: r.pick)] == [(1, 1), (3, 2)]
    again = rerank.deduplicate(candidates(spark, ["a b", "c"]))
    assert again.count() == 2


def test_diversify_matches_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=5)) for _ in range(12)]
    scores = [rng.random() for _ in texts]
    sets = [set(t.split()) for t in texts]
    low, high = min(scores), max(scores)
    gain = [(s - low) / (high - low) for s in scores]
    picked = [max(range(12), key=lambda i: gain[i])]
    while len(picked) < 5:
        rest = [i for i in range(12) if i not in picked]
        picked.append(max(rest, key=lambda i: 0.7 * gain[i] - 0.3 * max(
            len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in picked)))
    got = rerank.diversify(candidates(spark, texts, scores), 5).collect()
    assert [r.position - 1 for r in sorted(got, key=lambda r: r.pick)] == picked
    few = rerank.diversify(candidates(spark, ["a", "b"]), 5)
    assert few.count() == 2


@pytest.mark.parametrize("updated, want", [
    ("2024-06-01", 1.0), ("2024-03-03", 0.6376), ("2025-01-01", 1.0), ("soon", 1.0), (None, 1.0)])
def test_decay(value, updated, want):
    got = value(rerank.decayed(F.lit(1.0), F.lit(updated), "2024-06-01"))
    assert got == pytest.approx(want, abs=1e-4)


def test_decay_leaves_negative_scores(value):
    assert value(rerank.decayed(F.lit(-2.0), F.lit("2020-01-01"), "2024-06-01")) == -2.0


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["login flow with tokens", "tokens with login flow", "database backup plan",
             "token refresh for login", "holiday list"]
    rows = [
        (f"n{i}::chunk_0", f"n{i}.md", "app" if i != 3 else "web", "note" if i % 2 == 0 else "decision",
         ["x"] if i < 3 else ["y"], "", "2024-01-01", t, [float(i), 1.0])
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(
        rows, "chunk_id string, source string, project string, type string, tags array<string>, "
              "section string, updated string, text string, embedding array<double>")


def test_hybrid_search(chunks):
    got = search.search(chunks, "login tokens", [0.0, 1.0], "2024-01-01", n=2).collect()
    assert len(got) == 2 and got[0].source == "n0.md" and [r["rank"] for r in got] == [1, 2]
    assert got[0].search_method.startswith("vec#1+bm25#")
    # the copy of the first hit with its words in another order is gone
    assert "n1.md" not in [r.source for r in got]


def test_search_filters(chunks):
    got = search.search(chunks, "login", [0.0, 1.0], "2024-01-01", n=5, project="web").collect()
    assert {r.source for r in got} == {"n3.md"}
    typed = search.search(chunks, "login", [0.0, 1.0], "2024-01-01", n=5, note_type="decision").collect()
    assert {r.type for r in typed} == {"decision"}
    tagged = search.search(chunks, "login", [0.0, 1.0], "2024-01-01", n=5, tags=["y"]).collect()
    assert {r.source for r in tagged} == {"n3.md", "n4.md"}


def test_search_parity_filters_types_on_the_vector_side_only(chunks):
    got = search.search(chunks, "login backup", [0.0, 1.0], "2024-01-01", n=5, note_type="decision",
                        settings=SearchSettings(parity=True)).collect()
    assert {r.type for r in got} == {"decision", "note"}


def test_pure_vector_search(chunks):
    plain = SearchSettings(hybrid=False, reranking=False)
    got = search.search(chunks, "login", [0.0, 1.0], "2024-01-01", n=3, settings=plain).collect()
    assert [r.source for r in got] == ["n0.md", "n1.md", "n2.md"] and got[0].search_method == "vector"


def test_index_stats(chunks):
    assert search.index_stats(chunks).first().asDict() == {
        "total_chunks": 5, "total_notes": 5, "projects": 2, "types": 2}
