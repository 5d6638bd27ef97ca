import random
from collections import deque

from notespark.operators import paths


def brute(edges, source, target):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far, queue = {source: 0}, deque([source])
    while queue:
        a = queue.popleft()
        for b in near.get(a, ()):
            if b not in far:
                far[b] = far[a] + 1
                queue.append(b)
    return far.get(target)


def test_paths_of_many_pairs(spark):
    rnd = random.Random(9)
    names = [f"n{k:02d}" for k in range(60)]
    edges = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(9)]  # a chain
    edges += [tuple(rnd.sample(names[25:50], 2)) for _ in range(30)] + [("n00", "n30"), ("n55", "n56")]
    pairs = [tuple(rnd.sample(names, 2)) for _ in range(15)] + [("n00", "n09"), ("n05", "n05"), ("n55", "n00"), ("none", "n01"),
                                                              ("n56", "n55"), (None, "n01"), ("n00", "n09")]
    graph = spark.createDataFrame([(a, b, 1) for a, b in edges], "source string, target string, n long")
    asked = spark.createDataFrame(pairs, "source string, target string")
    want = {(s, t): brute(edges, s, t) for s, t in pairs if s is not None and brute(edges, s, t) is not None}
    assert {(r.source, r.target): r.length for r in paths.distances(graph, asked).collect()} == want
    found = {}
    for r in paths.shortest_paths(graph, asked).orderBy("step").collect():
        found.setdefault((r.source, r.target), []).append((r.step, r.node))
    assert set(found) == set(want)
    linked = {frozenset(e) for e in edges}
    for (source, target), path in found.items():
        assert [step for step, _ in path] == list(range(want[source, target] + 1))
        nodes = [node for _, node in path]
        assert nodes[0] == source and nodes[-1] == target
        assert all(frozenset(e) in linked for e in zip(nodes, nodes[1:]))


def test_pairs_that_meet_beyond_a_hub_do_not_list_its_links(spark):
    """Pages that link to one of two hubs, and one page to both: the widest layer is not written for each pair."""
    pages = [f"p{k:03d}" for k in range(80)]
    edges = [(p, "h0" if k < 40 else "h1") for k, p in enumerate(pages)] + [("p000", "h1")]
    graph = spark.createDataFrame([(a, b, 1) for a, b in edges], "source string, target string, n long")
    asked = spark.createDataFrame([(pages[k], pages[k + 40]) for k in range(1, 40)] + [("p001", "p002")], "source string, target string")
    reached, met = paths._searched(graph, asked)
    assert {r["length"] for r in met.where("source <> 'p001' OR target <> 'p002'").collect()} == {4}
    assert reached.count() <= 4 * 40
    rows = paths.shortest_paths(graph, asked).where("source = 'p005'").orderBy("step").collect()
    assert [r["node"] for r in rows] == ["p005", "h0", "p000", "h1", "p045"]


def test_lengths_are_the_same_without_the_test_of_frontiers(spark, monkeypatch):
    rnd = random.Random(4)
    names = [f"n{k:02d}" for k in range(70)]
    edges = [tuple(rnd.sample(names, 2)) for _ in range(75)] + [("hub", n) for n in names[:40]]
    pairs = [tuple(rnd.sample(names, 2)) for _ in range(60)]
    graph = spark.createDataFrame([(a, b, 1) for a, b in edges], "source string, target string, n long")
    asked = spark.createDataFrame(pairs, "source string, target string")
    want = {(s, t): brute(edges, s, t) for s, t in pairs if brute(edges, s, t) is not None}
    for few, tested in ((2, 4096), (32, 3), (32, 0)):
        monkeypatch.setattr(paths, "FEW_LINKS", few)
        monkeypatch.setattr(paths, "TESTED", tested)
        assert {(r.source, r.target): r.length for r in paths.distances(graph, asked).collect()} == want


def test_wide_frontiers_are_not_paired_where_a_layer_is_less_work(spark, monkeypatch):
    """Two stars of twenty arms, joined at the tip of one: 400 pairs of nodes are not listed to save a layer of 40 links."""
    edges = [pair for k in range(20) for pair in (("s", f"s{k}"), (f"s{k}", f"x{k}"), (f"x{k}", f"y{k}"),
                                                 ("t", f"t{k}"), (f"t{k}", f"u{k}"), (f"u{k}", f"v{k}"))] + [("y0", "v0")]
    graph = spark.createDataFrame([(a, b, 1) for a, b in edges], "source string, target string, n long")
    tried, cut = [], paths.cut_lineage

    def counted(df):
        out = cut(df)
        if "deep" in out.columns:
            tried.append(out.count())
        return out

    monkeypatch.setattr(paths, "cut_lineage", counted)
    rows = paths.shortest_paths(graph, spark.createDataFrame([("s", "t")], "source string, target string")).orderBy("step").collect()
    assert [r["node"] for r in rows] == ["s", "s0", "x0", "y0", "v0", "u0", "t0", "t"]
    assert tried and max(tried) <= 40


def test_pairs_of_different_components_are_not_searched(spark):
    """Two trees without a link between them: nothing is listed for a pair with an end in each, or with an end that has no links."""
    edges = [pair for t in "uv" for k in range(6) for pair in [(f"{t}", f"{t}{k}"), *((f"{t}{k}", f"{t}{k}{j}") for j in range(6))]]
    apart = [(f"u{k}", f"v{k}") for k in range(6)] + [("u", "none"), ("none", "v"), ("none", "other")]
    near = [("u00", "u55"), ("u", "u"), ("none", "none"), (None, "u"), ("v", None)]
    graph = spark.createDataFrame([(a, b, 1) for a, b in edges], "source string, target string, n long")
    reached, met = paths._searched(graph, spark.createDataFrame(apart + near, "source string, target string"))
    assert {(r["source"], r["target"]) for r in reached.collect()} == {("u00", "u55"), ("u", "u"), ("none", "none")}
    assert {(r["source"], r["target"]): r["length"] for r in met.collect()} == {("u00", "u55"): 4, ("u", "u"): 0, ("none", "none"): 0}
