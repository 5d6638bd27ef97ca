import itertools
import random

import pytest
from pyspark.sql import functions as F

from notespark.operators import links, lint

NOTE = ("path string, stem string, title string, content string, raw_content string, project string, "
        "note_type string, tags array<string>, created string, updated string, meta map<string,string>")


def note(path, text="", title=None, created=None, updated=None, meta=None, project=None):
    stem = path.split("/")[-1].removesuffix(".md")
    return (path, stem, title or stem, text, text, project or path.split("/")[0], "note", [], created, updated,
            meta if meta is not None else {"project": "x", "type": "y", "tags": "", "created": "", "updated": ""})


def vault(spark, *notes):
    return spark.createDataFrame(list(notes), NOTE)


@pytest.fixture
def small(spark):
    return vault(
        spark,
        note("p/a.md", "[[b]] [[b|again]] [[x/C.md#part]] [[a]]"),
        note("p/b.md", "[[c]]"), note("q/c.md", ""), note("q/d.md", "[[e]] [[nowhere]]"), note("q/e.md", ""),
        note("q/lone.md", "[[lone]]"),
    )


def graph(notes):
    return links.nodes(notes), links.edges(notes)


def test_edges(small):
    _, edges = graph(small)
    assert sorted((r.source, r.target, r.n) for r in edges.collect()) == [
        ("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "e", 1)]


def test_stats_and_hubs(small):
    nodes, edges = graph(small)
    degrees = links.degrees(nodes, edges)
    row = links.graph_stats(degrees, edges, links.components(nodes, edges)).first()
    assert row.asDict() == {"nodes": 6, "edges": 5, "density": 0.1667, "avg_degree": 1.33, "components": 3}
    assert [(r.node, r.degree) for r in links.hubs(degrees, 2).collect()] == [("a", 2), ("b", 2)]
    summary, best = links.clusters(degrees, 1)
    assert {r.project: (r.node_count, r.total_connections) for r in summary.collect()} == {"p": (2, 4), "q": (4, 4)}
    assert {(r.project, r.node) for r in best.collect()} == {("p", "a"), ("q", "c")}


def test_last_path_names_a_shared_stem(spark):
    nodes = links.nodes(vault(spark, note("a/x.md"), note("b/X.md")))
    assert [(r.node, r.path) for r in nodes.collect()] == [("x", "b/X.md")]


def test_neighbors_and_path(small):
    nodes, edges = graph(small)
    got = {(r.depth, r.node, r.direction) for r in links.neighbors(nodes, edges, "c", 2).collect()}
    assert got == {(1, "a", "←"), (1, "b", "←")}
    assert [r.node for r in links.shortest_path(edges, "a", "c").orderBy("step").collect()] == ["a", "c"]
    assert links.shortest_path(edges, "a", "d").count() == 0
    assert [r.node for r in links.shortest_path(edges, "a", "a").collect()] == ["a"]


def test_find_and_suggest(spark):
    nodes = links.nodes(vault(spark, note("p/auth-flow.md"), note("p/flow-chart.md"), note("p/db.md")))
    assert links.find_node(nodes, "Auth").first().node == "auth-flow"
    assert links.find_node(nodes, "my-db-x").first().node == "db"
    assert [r.node for r in links.suggest_nodes(nodes, "flow-auth").collect()] == ["auth-flow", "flow-chart"]


def brute_components(names, pairs):
    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            for n in (a, b):
                if label[n] != low:
                    label[n], changed = low, True
    return label


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components_match_brute_force(spark, shape):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(120)]
    if shape == "random":
        pairs = [tuple(rng.sample(names, 2)) for _ in range(70)]
    elif shape == "chain":
        order = names[:]
        rng.shuffle(order)
        pairs = list(itertools.pairwise(order[:100]))
    else:
        pairs = [("n050", n) for n in names[:100] if n != "n050"]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    edges = spark.createDataFrame(sorted(set(pairs)), "source string, target string").withColumn("n", F.lit(1))
    got = {r.node: r.component for r in links.components(nodes, edges).collect()}
    assert got == brute_components(names, pairs)


def issues(df):
    return sorted((r.category, r.file, r.message) for r in df.collect())


def test_orphans(small):
    assert [f for _, f, _ in issues(lint.orphans(small))] == ["p/a.md", "q/d.md", "q/lone.md"]
    assert [f for _, f, _ in issues(lint.orphans(small, parity=True))] == ["q/d.md"]


def test_broken_links(small):
    assert issues(lint.broken_links(small)) == [
        ("broken_link", "q/d.md", "Broken WikiLink: [[nowhere]] — target not found")]


def test_stale(spark):
    notes = vault(spark, note("a/x.md", updated="2024-01-01"), note("a/y.md", created="2024-05-01"),
                  note("a/z.md", created="2023-01-01", updated="2024-05-20"), note("a/w.md", updated="soon"))
    assert issues(lint.stale(notes, "2024-06-01")) == [
        ("stale", "a/x.md", "Not updated for 152 days (since 2024-01-01)")]


def test_missing_concepts(spark):
    notes = vault(spark, note("a/x.md", "Flutter flutter FLUTTER redis Redis redis docker"),
                  note("a/concept-redis.md", ""))
    assert issues(lint.missing_concepts(notes)) == [
        ("missing_concept", "(vault-wide)", '"flutter" mentioned 3 times but has no concept page')]
    titled = vault(spark, note("a/x.md", "Flutter flutter FLUTTER", title="All about Flutter"))
    assert issues(lint.missing_concepts(titled)) == []


def test_todo_and_empty_sections(spark):
    notes = vault(spark, note("a/x.md", "# A\n\n## B\ntodo: x FIXME\n## C\n\n\n\n\ntext far below\n#\n"))
    assert issues(lint.todo_markers(notes)) == [("empty_section", "a/x.md", "Contains 2 TODO/FIXME markers")]
    assert [m for _, _, m in issues(lint.empty_sections(notes))] == ['Empty section: "A"', 'Empty section: "C"']


def test_front_matter(spark):
    notes = vault(spark, note("a/x.md", meta={}), note("a/y.md", meta={"type": "t", "tags": ""}))
    assert [m for _, _, m in issues(lint.front_matter(notes))] == [
        "Missing frontmatter entirely", "Missing recommended fields: created, updated",
        "Missing required fields: project"]


def test_lint_of_a_project_may_link_to_others(spark):
    notes = vault(spark, note("a/x.md", "[[y]]"), note("b/y.md", "[[x]]"))
    assert [r.category for r in lint.in_order(lint.lint(notes, "2024-01-01", "a")).collect()] == ["orphan"]


def test_a_long_chain_and_no_path(spark):
    chain = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(40)] + [("x", "y")]
    edges = spark.createDataFrame(chain, "source string, target string")
    path = [r.node for r in links.shortest_path(edges, "n00", "n40").orderBy("step").collect()]
    assert path == [f"n{k:02d}" for k in range(41)]
    assert links.shortest_path(edges, "n00", "y").count() == 0


def test_names_are_resolved(spark):
    nodes = spark.createDataFrame(
        [("auth-flow", "a.md", "Auth flow", "p"), ("billing", "b.md", "Billing", "p"), ("cache", "c.md", "Cache", "p")],
        "node string, path string, title string, project string")
    edges = spark.createDataFrame([("auth-flow", "billing"), ("billing", "cache")], "source string, target string")
    assert [r.node for r in links.find_path(nodes, edges, "Auth", "cache").orderBy("step").collect()] == ["auth-flow", "billing", "cache"]
    assert links.find_path(nodes, edges, "nothing", "cache").count() == 0
    assert [r.node for r in links.neighbors_of(nodes, edges, "BILL").orderBy("node").collect()] == ["auth-flow", "cache"]
