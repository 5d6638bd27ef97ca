"""SimHash near-duplicates by a self-join of binary tries.

Each text gets a 64-bit fingerprint from its word shingles.  Texts link where fingerprints differ in
few bits; the result is the component of each text.

The distinct fingerprints form a binary trie.  Two fingerprints within ``budget`` bits differ in at
most half of them either in the first 32 bits or in the last 32, so two tries are walked, one over
each half first.  A walk goes over pairs of nodes, adds up the bits in which their paths differ, and
leaves a pair as soon as the half's budget is exceeded:

1. above, the trie is cut into nodes of bounded size (``LEAF`` fingerprints), by counts per prefix;
   pairs of cut nodes meet in a join on nearby prefixes;
2. below, one task walks each surviving pair of subtrees, level by level, and compares what remains.

The fingerprints of a cut node travel packed, ``LEAF`` in a row at most, so a pair of nodes is one row.
A task gives a spanning forest of the links it finds, never all pairs, so a ball of many near copies
costs as many rows as it has fingerprints.  No count of partners or candidates is capped.

Defined cases: a null or empty text, or one of white space only, has fingerprint 0 and links like
any other; equal texts share a fingerprint; a null id is no component's name unless all ids of the
component are null; repeated rows are listed each; an empty table gives no rows; other columns come
back inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import batch_of, documents, staged, task_number
from notespark.llm.components import stars

SHINGLE = 4
BUDGET = 4
SEED = 42
LEAF = 16_384
STEP = 2
CUT_DEPTHS = tuple(range(0, 33, STEP))
CHUNK = 1 << 20
PRODUCT = 64


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles, repeats included."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the hashes of all shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _prints(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 40
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                prints = np.array([fingerprint(t or "", shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield batch_of({
                    "row": part.column(0), "print": pa.array(prints.view(np.int64)),
                    "number": pa.array(np.arange(number, number + len(part)))})
                number += len(part)

    return work


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``row``, its ``print`` (the 64 bits as a signed long) and a ``number`` of its own."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_prints(shingle), f"row {rows.schema['row'].dataType.simpleString()}, print long, number long")


# ------------------------------------------------------------------- cutting the trie above



def _prefix(half, depth):
    """The first ``depth`` of 32 bits."""
    return F.call_function("shiftright", half, (F.lit(32) - depth).cast("int"))


def _node(depth, prefix):
    """One number for a node of the trie: its depth and its prefix."""
    return F.shiftleft(depth.cast("long"), 32).bitwiseOR(prefix)


def _nodes_above(halves: DataFrame) -> DataFrame:
    """Each fingerprint once for every depth at which the trie may be cut."""
    return halves.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in CUT_DEPTHS]))).withColumn(
        "prefix", _prefix(F.col("half"), F.col("depth")))


def _cut_nodes(halves: DataFrame, leaf: int) -> DataFrame:
    """The nodes ``(depth, prefix)`` where the trie is cut: the first with ``leaf`` fingerprints at most.

    Every fingerprint is below exactly one.  Below 32 bits nodes are not cut further.
    """
    counts = _nodes_above(halves).groupBy("depth", "prefix").agg(F.count("*").alias("n"))
    fits = counts.where((F.col("n") <= leaf) | (F.col("depth") == CUT_DEPTHS[-1]))
    # a node whose parent fits already is no cut
    parents = fits.select((F.col("depth") + STEP).alias("depth"), F.col("prefix").alias("above"))
    return fits.withColumn("above", F.shiftright("prefix", STEP)).join(
        parents, ["depth", "above"], "left_anti").select("depth", "prefix")


def _node_pairs(cuts: DataFrame, budget: int) -> DataFrame:
    """Pairs of cut nodes ``(ours, theirs)``, each once, whose common prefix differs in few bits.

    A node of depth ``d`` meets nodes of its depth or below through their prefixes of ``d`` bits,
    by equality after each choice of differing bits.
    """
    out = None
    found = cuts.select("depth").distinct().orderBy("depth").collect()  # as many as CUT_DEPTHS at most
    steps = [r["depth"] for r in found] or [0]
    for depth in steps:
        node = _node(F.col("depth"), F.col("prefix"))
        masks = F.array(*[F.lit(m).cast("long") for m in _flips(depth, budget)])
        near = cuts.where(F.col("depth") == depth).select(node.alias("ours"), F.col("prefix"), F.explode(masks).alias("mask")).select(
            "ours", F.col("prefix").bitwiseXOR(F.col("mask")).alias("key"))
        far = cuts.where(F.col("depth") >= depth).select(
            node.alias("theirs"),
            F.call_function("shiftright", F.col("prefix"), (F.col("depth") - depth).cast("int")).alias("key"))
        met = near.join(far, "key").where("ours <= theirs").select("ours", "theirs")
        out = met if out is None else out.unionByName(met)
    return out


def _flips(bits: int, budget: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in chosen) for n in range(min(bits, budget) + 1) for chosen in combinations(range(bits), n)]


# ------------------------------------------------------------------- walking below


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Components of numbered items, merged many links at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.root[a] != self.root[b]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(ra[differ], rb[differ]), np.maximum(ra[differ], rb[differ])
            self.root[high] = low
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def walk(prints: np.ndarray, split: int, budget: int, half_budget: int) -> np.ndarray:
    """The component of each fingerprint, given those of two subtrees.

    ``prints`` are unsigned, those of each subtree ascending; ``split`` is where the second starts,
    or their number for one subtree with itself.  Walks pairs of nodes level by level; a node is a
    range of its sorted subtree.  Links inside one of two subtrees are found by another walk.
    """
    forest = Forest(len(prints))
    same = split == len(prints)
    first = np.array([[0, split, 0 if same else split, len(prints), 0]], np.int64)
    stack = [(0, first)]
    while stack:
        level, pairs = stack.pop()
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        ready = (sizes <= PRODUCT) | (level == 32)
        _compare(prints, pairs[ready], budget, forest)
        pairs = pairs[~ready]
        if not len(pairs):
            continue
        children = _descend(prints, pairs, level, half_budget)
        for at in range(0, len(children), CHUNK // 4):
            stack.append((level + 1, children[at:at + CHUNK // 4]))
    return forest.root


def _descend(prints: np.ndarray, pairs: np.ndarray, level: int, half_budget: int) -> np.ndarray:
    """The pairs of children whose differing bits stay within the budget."""
    a, b = _middle(prints, pairs[:, 0], pairs[:, 1], level), _middle(prints, pairs[:, 2], pairs[:, 3], level)
    used = pairs[:, 4]
    own = pairs[:, 0] == pairs[:, 2]
    out = []
    for x in (0, 1):
        for y in (0, 1):
            spent = used + (x != y)
            a0, a1 = (a, pairs[:, 1]) if x else (pairs[:, 0], a)
            b0, b1 = (b, pairs[:, 3]) if y else (pairs[:, 2], b)
            keep = (a1 > a0) & (b1 > b0) & (spent <= half_budget)
            if x > y:
                keep &= ~own  # a node with itself: the mirrored pair is the same
            out.append(np.stack([a0[keep], a1[keep], b0[keep], b1[keep], spent[keep]], axis=1))
    return np.concatenate(out)


def _middle(prints: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where the bit of this level turns 1 in each range, by bisection of all ranges at once."""
    low, high = low.copy(), high.copy()
    bit = np.uint64(1 << (63 - level))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        set_ = (prints[np.minimum(mid, len(prints) - 1)] & bit) != 0
        high = np.where(open_ & set_, mid, high)
        low = np.where(open_ & ~set_, mid + 1, low)


def _compare(prints: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Compare all fingerprints of node pairs in full, in pieces of bounded size."""
    # a large node at the last level is taken row by row
    big = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) > CHUNK
    for a0, a1, b0, b1, _ in pairs[big]:
        for a in range(a0, a1):
            for at in range(b0, b1, CHUNK):
                b = np.arange(at, min(at + CHUNK, b1))
                _link(prints, np.full(len(b), a), b, budget, forest)
    pairs = pairs[~big]
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        part, n = pairs[at:to], sizes[at:to]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(part[:, 3] - part[:, 2], n)
        _link(prints, np.repeat(part[:, 0], n) + inside // width, np.repeat(part[:, 2], n) + inside % width, budget, forest)
        at = to


def _link(prints: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int, forest: Forest) -> None:
    close = (_bits(prints[a] ^ prints[b]) <= budget) & (a != b)
    a, b = a[close], b[close]
    apart = forest.apart(a, b)
    forest.link(a[apart], b[apart])


def _packed(leaf: int, turned: bool):
    """The fingerprints of each node in rows of ``leaf`` at most; partitions are sorted by node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, part = None, [], 0

        def row():
            prints = np.sort(np.concatenate(held))
            return batch_of({
                "node": pa.array([node], pa.int64()), "part": pa.array([part], pa.int32()),
                "prints": pa.array([prints.astype("<u8").tobytes()], pa.binary())})

        for batch in batches:
            nodes, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            edges = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(batch)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if held and nodes[i] != node:
                    yield row()
                    held, part = [], 0
                elif nodes[i] != node:
                    part = 0
                node = int(nodes[i])
                while i < j:
                    room = leaf - sum(map(len, held))
                    held.append(_turn(prints[i:min(j, i + room)], turned))
                    i += room
                    if sum(map(len, held)) == leaf:
                        yield row()
                        held, part = [], part + 1
        if held:
            yield row()

    return work


def _walks(budget: int, turned: bool):
    """Walk the two subtrees of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, ours, theirs = (batch.column(k) for k in range(3))
            for k in range(len(batch)):
                a = np.frombuffer(ours[k].as_buffer(), "<u8")
                b = a[:0] if same[k].as_py() else np.frombuffer(theirs[k].as_buffer(), "<u8")
                prints = np.concatenate((a, b))
                root = walk(prints, len(a), budget, budget // 2)
                moved = np.flatnonzero(root != np.arange(len(prints)))
                if len(moved):
                    yield batch_of({
                        "a": pa.array(_turn(prints[moved], turned).view(np.int64)),
                        "b": pa.array(_turn(prints[root[moved]], turned).view(np.int64))})

    return work


def _turn(prints: np.ndarray, turned: bool) -> np.ndarray:
    """Swap the halves, or not."""
    return (prints << np.uint64(32)) | (prints >> np.uint64(32)) if turned else prints


def links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``print`` within ``budget`` bits."""
    out = None
    for turned in (False, True):
        half = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)) if turned else F.shiftrightunsigned("print", 32)
        halves = prints.select("print", half.alias("half"))
        cuts = staged(_cut_nodes(halves, leaf), "simhash-cuts")
        pairs = staged(_node_pairs(cuts, budget // 2), "simhash-pairs")
        placed = _nodes_above(halves).join(cuts, ["depth", "prefix"]).select(
            _node(F.col("depth"), F.col("prefix")).alias("node"), "print")
        packed = staged(placed.repartition("node").sortWithinPartitions("node").mapInArrow(
            _packed(leaf, turned), "node long, part int, prints binary"), "simhash-packed")
        ours = packed.select(F.col("node").alias("ours"), F.col("part").alias("i"), F.col("prints").alias("a"))
        theirs = packed.select(F.col("node").alias("theirs"), F.col("part").alias("j"), F.col("prints").alias("b"))
        one = F.col("ours") == F.col("theirs")
        dealt = pairs.join(ours, "ours").join(theirs, "theirs").where(~one | (F.col("i") <= F.col("j"))).select(
            (one & (F.col("i") == F.col("j"))).alias("same"), "a", "b")
        found = dealt.mapInArrow(_walks(budget, turned), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def _classes(rows: DataFrame, doc_id: str, budget: int, leaf: int) -> DataFrame:
    """Each fingerprint with the ``root`` and the smallest id of its component."""
    distinct = staged(
        rows.groupBy("print").agg(F.min(F.col(f"row.`{doc_id}`")).alias("least")), "simhash-distinct")
    roots = staged(stars(links(distinct.select("print"), budget, leaf)), "simhash-roots")
    rooted = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        F.col("print").alias("_print"), "least", F.coalesce("root", "print").alias("root"))
    names = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    return rooted.join(names, F.col("root") == F.col("_root")).select("_print", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None,
                    shingle: int = SHINGLE, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Each row with its ``print`` and ``component_id``, the smallest id it is linked with."""
    rows = staged(fingerprints(docs, text, keep, shingle), "simhash-prints")
    classes = _classes(rows, doc_id, budget, leaf)
    return rows.join(classes, F.col("print") == F.col("_print")).select("row", "print", "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """One ``row`` of each component: that of the smallest id, any one of rows that share it."""
    rows = staged(fingerprints(docs, text, None, shingle), "simhash-prints")
    classes = _classes(rows, doc_id, budget, leaf)
    own = F.col(f"row.`{doc_id}`")
    placed = rows.select("number", "print", own.alias("_id")).join(classes, F.col("print") == F.col("_print"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "number")).alias("first"))
    # the rows that go are fewer than those that stay; their numbers are joined by the size of their file
    gone = staged(placed.select("number").join(
        first.select(F.col("first.number").alias("number")), "number", "left_anti"), "simhash-gone")
    return rows.join(gone, "number", "left_anti").select("row")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their fingerprint and near-duplicate component."""
    found = near_duplicates(documents(spark, folder), keep=("doc_id",))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE: dict = {}
