"""Shortest paths between many pairs of nodes at once, searched from both ends.

All pairs advance together.  In each round the frontiers of an open pair are tested for a link or a common
neighbour between them, and the pairs that have none extend the end whose frontier has fewer links by one layer.
The test saves the widest layers: pages that all link to a hub are not listed for each pair that comes by
it.  Common neighbours with few links are written as a table once; those with many are tried by the
links of one node, and the other node's link is then looked up, so no hub's links are paired.

Pairs whose ends lie in different components are left out before: no path is left to find, and the search would
list both components for each of them.  A pair is done when its ends meet, or an end has nowhere to go.  Layers and the node each was reached
from are written to the checkpoint folder, and paths are read off these pointers by joins.  So rounds grow
with the distance, shared by both ends, and their jobs do not depend on the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.operators.links import components, undirected
from notespark.session import cut_lineage

PAIR = ["source", "target"]
#: Neighbours of a node with more links than this are not paired beforehand.
FEW_LINKS = 32
#: Frontiers with more pairs of nodes than this are extended without the test; results are the same.  So are
#: those with more pairs than the end that would be extended has links: there the layer is the lesser work.
TESTED = 4096


def _steps(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and common neighbours as ``(a, b, mid, steps)``, and the links ``(a, mid)`` to the other, crowded ones."""
    crowded = both.groupBy(F.col("a").alias("mid")).agg(F.count("*").alias("n")).where(F.col("n") > FEW_LINKS).select("mid")
    to = both.select("a", F.col("b").alias("mid"))
    few = to.join(crowded, "mid", "left_anti")
    wedges = few.join(few.withColumnRenamed("a", "b"), "mid").where("a <> b").groupBy("a", "b").agg(F.min("mid").alias("mid"))
    links = both.select("a", "b", F.lit(None).cast("string").alias("mid"), F.lit(1).cast("long").alias("steps"))
    return (cut_lineage(links.unionByName(wedges.withColumn("steps", F.lit(2).cast("long")))),
            cut_lineage(to.join(crowded, "mid", "left_semi")))


def _joined(both: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs whose ends are one node or lie in one component."""
    parts = cut_lineage(components(both.select(F.col("a").alias("node")).distinct(), both.toDF(*PAIR)))
    out = pairs.select(*PAIR).where("source IS NOT NULL AND target IS NOT NULL").distinct()
    for end in PAIR:
        out = out.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    return out.where("source = target OR _source = _target").select(*PAIR)


def _tested(open_: DataFrame, sizes: DataFrame, both: DataFrame, near: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs whose frontiers are one or two steps apart, by the least such nodes."""
    small = open_.join(sizes.where(F.col("a") * F.col("b") <= F.least(F.lit(TESTED), "links_a", "links_b")).select(*PAIR), PAIR, "left_semi")
    sides = [small.where(F.col("side") == side).select(*PAIR, F.col("node").alias(name), F.col("depth").alias(f"_{name}"))
             for side, name in (("from", "a"), ("to", "b"))]
    tried = cut_lineage(sides[0].join(sides[1], PAIR).select(*PAIR, "a", "b", (F.col("_a") + F.col("_b")).alias("deep")))
    met = tried.join(near, ["a", "b"])
    other = both.select(F.col("a").alias("mid"), "b")
    through = tried.join(crowded, "a").join(other, ["mid", "b"]).withColumn("steps", F.lit(2).cast("long"))
    found = met.unionByName(through.select(*met.columns))
    return found.groupBy(*PAIR).agg(F.min(F.struct((F.col("deep") + F.col("steps")).alias("length"), "a", "mid", "b")).alias("m")).select(
        *PAIR, "m.a", "m.mid", "m.b", "m.length")


def _searched(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What both ends reached (``source, target, side, node, parent, depth``), and where they met.

    A meeting is a node ``a`` that the source reached and ``b`` that the target reached: the same node,
    two with a link, or two with the neighbour ``mid``.
    """
    both = cut_lineage(undirected(edges))
    near, crowded = _steps(both)
    degrees = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links")))
    ends = F.array(F.struct(F.lit("from").alias("side"), F.col("source").alias("node")),
                   F.struct(F.lit("to").alias("side"), F.col("target").alias("node")))
    frontier = cut_lineage(_joined(both, pairs).select(
        *PAIR, F.inline(ends), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth")))
    reached = frontier
    met = cut_lineage(frontier.where("side = 'from' AND source = target").select(
        *PAIR, F.col("node").alias("a"), F.lit(None).cast("string").alias("mid"), F.col("node").alias("b"), F.lit(0).cast("long").alias("length")))
    while True:
        open_ = frontier.join(met.select(*PAIR), PAIR, "left_anti")
        # an end without links has nowhere to go, and no path is left to find
        sizes = cut_lineage(open_.join(degrees, "node").groupBy(*PAIR).agg(
            *[F.count_if(F.col("side") == side).alias(name) for side, name in (("from", "a"), ("to", "b"))],
            *[F.sum(F.when(F.col("side") == side, F.col("links"))).alias(name) for side, name in (("from", "links_a"), ("to", "links_b"))],
        ).where("a > 0 AND b > 0"))
        tested = cut_lineage(_tested(open_, sizes, both, near, crowded))
        met = met.unionByName(tested)
        turn = sizes.join(tested.select(*PAIR), PAIR, "left_anti").select(
            *PAIR, F.when(F.col("links_a") <= F.col("links_b"), "from").otherwise("to").alias("side"))
        going = open_.join(turn, [*PAIR, "side"], "left_semi")
        new = going.join(both, going["node"] == both["a"]).groupBy(*PAIR, "side", F.col("b").alias("node")).agg(
            F.min(going["node"]).alias("parent"), (F.max("depth") + 1).alias("depth"))
        layer = cut_lineage(new.join(reached.select(*PAIR, "side", "node"), [*PAIR, "side", "node"], "left_anti"))
        if layer.isEmpty():
            # pairs that turned and found nothing are stuck; others wait for no one
            return reached, met
        others = reached.select(*PAIR, F.when(F.col("side") == "from", "to").otherwise("from").alias("side"), "node",
                                F.col("depth").alias("rest"))
        here = layer.join(others, [*PAIR, "side", "node"]).groupBy(*PAIR).agg(
            F.min(F.struct((F.col("depth") + F.col("rest")).alias("length"), "node")).alias("m")).select(
            *PAIR, F.col("m.node").alias("a"), F.lit(None).cast("string").alias("mid"), F.col("m.node").alias("b"), "m.length")
        met = met.unionByName(cut_lineage(here))
        # the end that waited keeps its frontier
        waiting = open_.join(turn, PAIR, "left_semi").join(turn, [*PAIR, "side"], "left_anti")
        frontier = cut_lineage(waiting.unionByName(layer.select(*waiting.columns)))
        reached = reached.unionByName(layer.select(*reached.columns))


def distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, target, length`` of the pairs that a path of links, taken either way, connects."""
    return _searched(edges, pairs)[1].select(*PAIR, "length")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """One shortest path of each connected pair, as rows ``source, target, step, node``.

    Of several, the least meeting nodes and the least node before and after them are taken.
    """
    reached, met = _searched(edges, pairs)
    out = None
    for side, end in (("from", "a"), ("to", "b")):
        links = reached.where(F.col("side") == side).select(*PAIR, "node", "parent", "depth")
        at = cut_lineage(met.select(*PAIR, "length", "mid", F.col(end).alias("node")).join(links, [*PAIR, "node"]))
        if side == "from":
            out = at.where("mid IS NOT NULL").select(*PAIR, (F.col("depth") + 1).alias("step"), F.col("mid").alias("node"))
        while True:
            number = F.col("depth") if side == "from" else F.col("length") - F.col("depth")
            out = out.unionByName(at.select(*PAIR, number.alias("step"), "node"))
            before = at.where("parent IS NOT NULL").select(*PAIR, "length", F.col("parent").alias("node"))
            at = cut_lineage(before.join(links, [*PAIR, "node"]))
            if at.isEmpty():
                break
    return out.distinct()  # both ends name a meeting node
