"""The wikilink graph: nodes, edges, degrees, neighbourhoods, paths and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.functions import text as tx
from notespark.scale import top_per_key
from notespark.session import cut_lineage


def nodes(notes: DataFrame) -> DataFrame:
    """One node per lower-case file stem; of notes that share a stem the last path counts."""
    last = F.max_by(F.struct("path", "project", "note_type", "title"), F.col("path"))
    return (
        notes.groupBy(F.lower("stem").alias("node")).agg(last.alias("_n")).select("node", "_n.*")
    )


def narrow(notes: DataFrame) -> DataFrame:
    """What the graph needs of a note, without its text; the targets of its links in ``links``."""
    return notes.select("path", "stem", "project", "note_type", "title", tx.links("raw_content").alias("links"))


def link_rows(notes: DataFrame) -> DataFrame:
    """One row per written link: the note's path and node, the target as written and its key.

    Links that were extracted before (``links``) are not looked for again.
    """
    targets = F.col("links") if "links" in notes.columns else tx.links("raw_content")
    return notes.select(
        "path", "project", F.lower("stem").alias("source"), F.explode(targets).alias("target"),
    ).withColumn("key", tx.link_stem("target"))


def edges(notes: DataFrame) -> DataFrame:
    """Directed edges between existing, different nodes, with the number of links ``n``.

    Links are counted per pair before the join.  A hub's edges can be many; both sides of the
    join are plain shuffles, so that AQE can split the hub's partition.
    """
    pairs = (
        link_rows(notes).where("key <> source")
        .groupBy("source", F.col("key").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    )
    stems = notes.select(F.lower("stem").alias("target"))
    return pairs.join(stems, "target", "left_semi").select("source", "target", "n")


def degrees(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Distinct outgoing plus incoming neighbours of every node.

    Edges are distinct pairs, so both counts combine in each task before the shuffle.
    """
    ends = all_edges.select(F.col("source").alias("node")).unionByName(
        all_edges.select(F.col("target").alias("node"))
    )
    count = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return all_nodes.join(count, "node", "left").fillna({"degree": 0})


def hubs(with_degree: DataFrame, n: int = 10) -> DataFrame:
    return with_degree.where("degree > 0").orderBy(F.desc("degree"), "node").limit(n)


def graph_stats(with_degree: DataFrame, all_edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Node, edge and component counts, density and mean degree, as one row."""
    parts = [
        with_degree.agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("_d")),
        all_edges.agg(F.sum("n").alias("edges")),
    ]
    if labels is not None:
        parts.append(labels.agg(F.count_distinct("component").alias("components")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    out = rows.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in rows.columns])
    possible = F.when(F.col("nodes") > 1, F.col("nodes") * (F.col("nodes") - 1)).otherwise(F.lit(1))
    return out.select(
        "nodes", "edges", F.round(F.col("edges") / possible, 4).alias("density"),
        F.round(F.try_divide(F.col("_d"), F.col("nodes")), 2).alias("avg_degree"),
        *(["components"] if labels is not None else []),
    )


def clusters(with_degree: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per project: node count and connections, and its best connected nodes."""
    summary = with_degree.groupBy("project").agg(
        F.count(F.lit(1)).alias("node_count"), F.sum("degree").alias("total_connections")
    )
    best = top_per_key(with_degree, ["project"], [F.desc("degree"), F.col("node")], top)
    return summary, best


def undirected(all_edges: DataFrame) -> DataFrame:
    pairs = all_edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return pairs.union(pairs.select("b", "a")).distinct()


def _expand(both: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes one step from the frontier that were not seen before."""
    step = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi")
    return step.select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")


def layers(all_edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Nodes within ``depth`` undirected steps of ``start``, with their distance.

    Each step is a join of the frontier with the edges; layers are written to the checkpoint
    folder, so plans stay short and a lost executor costs one step.
    """
    spark = all_edges.sparkSession
    both = cut_lineage(undirected(all_edges))
    frontier = spark.createDataFrame([(start, 0)], "node string, depth int")
    seen = frontier
    for d in range(1, depth + 1):
        found = cut_lineage(
            _expand(both, frontier, seen.select("node")).withColumn("depth", F.lit(d))
        )
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        frontier = found
    return seen.where("depth > 0")


def neighbors(all_nodes: DataFrame, all_edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Layers with node details; direct neighbours carry the link's direction."""
    found = layers(all_edges, start, depth)
    out = all_edges.where(F.col("source") == start).select(
        F.col("target").alias("node"), F.lit(True).alias("_out"))
    inward = all_edges.where(F.col("target") == start).select(
        F.col("source").alias("node"), F.lit(True).alias("_in"))
    arrows = F.concat_ws(
        " ", F.when(F.col("_out"), F.lit("→")), F.when(F.col("_in"), F.lit("←"))
    )
    return (
        found.join(out, "node", "left").join(inward, "node", "left")
        .join(all_nodes, "node", "left")
        .select(
            "depth", "node", F.coalesce("title", "node").alias("title"),
            F.coalesce("project", F.lit("")).alias("project"),
            F.when(F.col("depth") == 1, arrows).otherwise(F.lit("indirect")).alias("direction"),
        )
    )


def shortest_path(all_edges: DataFrame, source: str, target: str) -> DataFrame:
    """The undirected shortest path, as rows ``(step, node)``; empty when there is none.

    Of several shortest paths the one least in node order is returned: distances are found
    from the target, then the path walks from the source, taking the least next node.  The search
    ends when it meets the source or has nowhere to go.
    """
    spark = all_edges.sparkSession
    both = cut_lineage(undirected(all_edges))
    schema = "step int, node string"
    if source == target:
        return spark.createDataFrame([(0, source)], schema)
    frontier = spark.createDataFrame([(target,)], "node string")
    seen = frontier
    found = [frontier]
    while True:
        frontier = cut_lineage(_expand(both, frontier, seen))
        if frontier.isEmpty():
            return spark.createDataFrame([], schema)
        if not frontier.where(F.col("node") == source).isEmpty():
            break
        seen = seen.unionByName(frontier)
        found.append(frontier)
    path = [source]
    for layer in reversed(found):
        step = both.where(F.col("a") == path[-1]).select(F.col("b").alias("node"))
        path.append(step.join(layer, "node", "left_semi").agg(F.min("node")).first()[0])
    return spark.createDataFrame(list(enumerate(path)), schema)


def components(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Weakly connected components as ``(node, component)``; a component is named by its
    least node.

    Alternates two kinds of steps: hang every greater neighbour of a node onto the node's least
    neighbour, then every smaller one.  The number of rounds grows with the logarithm of the
    largest component, not with its diameter.  A step is a minimum per node (combined in each
    task) and a join back; no neighbour list is ever gathered.
    """
    pairs = cut_lineage(undirected(all_edges).where("a < b"))
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        # the greater neighbours of u go to the least of u and its neighbours
        # (written out first: a join of two plain shuffles is one AQE can split at a hub)
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")))
        large = cut_lineage(
            both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
            .where("a <> b").distinct()
        )
        # u and its smaller neighbours go to the least of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
            .union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .where("a <> b").distinct()
        )
        pairs = cut_lineage(small)
        state = pairs.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == state:
            break
        before = state
    named = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return all_nodes.select("node").join(named, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def find_node(all_nodes: DataFrame, query: str) -> DataFrame:
    """The node named ``query``, else the first by path whose name contains it or is in it."""
    q = query.lower()
    exact = F.col("node") == q
    near = F.contains("node", F.lit(q)) | F.contains(F.lit(q), F.col("node"))
    return all_nodes.where(exact | near).orderBy(exact.desc(), "path").limit(1)


def neighbors_of(all_nodes: DataFrame, all_edges: DataFrame, query: str, depth: int = 1) -> DataFrame:
    """:func:`neighbors` of the node that ``query`` names; without one, of nothing."""
    found = find_node(all_nodes, query).first()  # one row at most
    return neighbors(all_nodes, all_edges, found["node"] if found else "", depth)


def find_path(all_nodes: DataFrame, all_edges: DataFrame, source: str, target: str) -> DataFrame:
    """:func:`shortest_path` between the nodes that two queries name; empty if one names none."""
    ends = [find_node(all_nodes, query).first() for query in (source, target)]
    if None in ends:
        return all_edges.sparkSession.createDataFrame([], "step int, node string")
    return shortest_path(all_edges, ends[0]["node"], ends[1]["node"])


def suggest_nodes(all_nodes: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Nodes that share dash-separated words with ``query``."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split("-"))])
    shared = F.size(F.array_intersect(F.split("node", "-"), words))
    return (
        all_nodes.withColumn("overlap", shared).where("overlap > 0")
        .orderBy(F.desc("overlap"), "path").limit(n)
    )
