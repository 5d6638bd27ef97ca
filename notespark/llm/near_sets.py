"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, the sets decide.

1. Each text gets a SimHash fingerprint, and those within 4 bits are linked by the walk over binary
   tries of ``simhash``; the component is a key of all its texts.  Alone it would find few of the pairs
   just above the threshold, whose fingerprints differ in about 10 bits, so each text also gets ``BANDS``
   keys, each made of ``ROWS`` minima of its hashed shingles.  A pair of similarity s shares one of these
   with probability ``1 - (1 - s**ROWS)**BANDS``: 0.9996 at 0.8.
2. In each group with one key all are paired with the first.  The shingle sets of a pair are
   compared in full, and what is similar enough is linked.
3. Groups that still hold several components travel packed, in blocks of ``BLOCK_BYTES`` of sets, and
   blocks of one key meet pair by pair.  Inside, rows of different components meet by their rarest shingles
   only: two sets of similarity t of n shingles share one of the first ``n - ceil(t * n) + 1``, whatever
   the order.  A pair of blocks sends a spanning forest.  So of any two rows with a common key the sets
   were compared or cannot be similar, or the rows are linked already, and no row is made per pair.

Shingles are those of ``simhash``: ASCII white space and case; a shorter text is one shingle.

Defined cases: a null or empty text, or one of white space only, has the empty set, and equals all
others of its kind; of a component the row with the smallest id stays, a null id only if all are
null, any one of rows that share it; an empty table gives no rows; other columns come back inside
``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import batch_of, small_batches, staged, task_number
from notespark.llm.components import stars
from notespark.llm.simhash import links as trie_links, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SLICE = 2048
BLOCK_BYTES = 4 << 20

_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[at:at + SLICE, None] * _FACTORS).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        out = (out ^ part) * _MIX
        out ^= out >> np.uint64(32)
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets, sorted, have at least this Jaccard similarity; two empty ones have 1."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return True
    if small / large < similarity:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _keyed(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 40
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                hashes = [shingle_hashes(t or "", shingle) for t in part.column(1).to_pylist()]
                values = pa.array(np.concatenate([keys(h) for h in hashes]).view(np.int64))
                prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
                offsets = pa.array(np.arange(0, len(values) + 1, BANDS, dtype=np.int32))
                yield batch_of({
                    "row": part.column(0), "number": pa.array(np.arange(number, number + len(part))),
                    "print": pa.array(prints), "size": pa.array([len(h) for h in hashes], pa.int64()),
                    "keys": pa.ListArray.from_arrays(offsets, values)})
                number += len(part)

    return work


def _sets(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                sets = [np.unique(shingle_hashes(t or "", shingle)).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
                yield batch_of({"number": part.column(0), "shingles": pa.array(sets, pa.binary())})

    return work


def _compared(similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = batch.column(2), batch.column(3)
            keep = [
                similar(np.frombuffer(ours[k].as_buffer(), "<u8"), np.frombuffer(theirs[k].as_buffer(), "<u8"), similarity)
                for k in range(len(batch))]
            yield batch_of({n: batch.column(c).filter(pa.array(keep, pa.bool_())) for n, c in (("a", 0), ("b", 1))})

    return work


def _links(rows: DataFrame, pairs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """Of pairs of numbers ``(a, b)`` those that are similar."""
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct(), "near-wanted")
    sets = _wanted_sets(rows, wanted, text, shingle)
    ours = sets.select(F.col("number").alias("a"), F.col("shingles").alias("ours"))
    theirs = sets.select(F.col("number").alias("b"), F.col("shingles").alias("theirs"))
    both = pairs.join(ours, "a").join(theirs, "b").select("a", "b", "ours", "theirs")
    return staged(both.mapInArrow(_compared(similarity), "a long, b long"), "near-links")


def _prefixes(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the rarest elements one of which a similar set must hold, as ``(element, set)``.

    Ordered by element; elements that no other set has are left out.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((element, counts[element], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    enough = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    keep = order[(place < enough[owner]) & (counts[element[order]] > 1)]
    element, owner = element[keep], owner[keep]
    order = np.lexsort((owner, element))
    return element[order], owner[order]


def forest(sets: list[np.ndarray], roots: list[int], split: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join all similar sets of different roots; of two blocks (``split`` > 0) only those across."""
    top: dict[int, int] = {}

    def find(root: int) -> int:
        while top.get(root, root) != root:
            top[root] = root = top.get(top[root], top[root])
        return root

    element, owner = _prefixes(sets, similarity)
    edges = np.flatnonzero(np.diff(element, prepend=-1, append=-1)) if len(element) else []
    tried, out = set(), []
    for low, high in zip(edges, edges[1:]):
        members = owner[low:high].tolist()
        if len({find(roots[m]) for m in members}) < 2:
            continue
        for j, b in enumerate(members):
            for a in members[:j]:
                if (split and (a < split) == (b < split)) or find(roots[a]) == find(roots[b]) or (a, b) in tried:
                    continue
                tried.add((a, b))
                if similar(sets[a], sets[b], similarity):
                    top[find(roots[a])] = find(roots[b])
                    out.append((a, b))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, salt, number, root, shingles`` in order of key and salt, a row for each block."""
    held, name = [], None

    def packed() -> pa.RecordBatch:
        columns = [pa.concat_arrays([part.column(c) for part in held]) for c in (2, 3, 4)]
        ends = pa.array([0, len(columns[0])], pa.int32())
        return batch_of({"key": pa.array([name[0]], pa.int64()), "salt": pa.array([name[1]], pa.int64())} | {
            n: pa.ListArray.from_arrays(ends, column) for n, column in zip(("numbers", "roots", "sets"), columns)})

    for batch in batches:
        keys_, salts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        edges = [0, *(np.flatnonzero((keys_[1:] != keys_[:-1]) | (salts[1:] != salts[:-1])) + 1).tolist(), len(batch)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            here = int(keys_[i]), int(salts[i])
            if name != here:
                if held:
                    yield packed()
                held, name = [], here
            held.append(batch.slice(i, j - i))
    if held:
        yield packed()


def _met(similarity: float):
    """Links within one block, or across two."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {n: column[k] for n, column in zip(batch.schema.names, batch.columns)}
                both = row["numbers_b"].is_valid
                numbers, roots = (row[c].as_py() + (row[f"{c}_b"].as_py() if both else []) for c in ("numbers", "roots"))
                split = len(row["numbers"]) if both else 0
                # the sets stay where the batch has them
                sets = [np.frombuffer(s.as_buffer(), "<u8") for c in ("sets", "sets_b")[:1 + both] for s in row[c].values]
                found = forest(sets, roots, split, similarity)
                if found:
                    yield batch_of({n: pa.array([numbers[link[k]] for link in found], pa.int64()) for k, n in enumerate("ab")})

    return work


def _wanted_sets(rows: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    return staged(rows.select("number", F.col(f"row.`{text}`").alias("text")).join(wanted, "number", "left_semi").mapInArrow(
        _sets(shingle), "number long, shingles binary"), "near-sets")


def _links_within_keys(rows: DataFrame, apart: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """Links among rows ``key, number, root, size`` of one key and different roots."""
    groups = apart.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("number").cast("decimal(20,0)")).alias("who"),
        F.ceil(F.sum(8 * F.col("size") + 64) / BLOCK_BYTES).alias("blocks"))
    # keys with the same rows meet once
    groups = staged(groups.groupBy("n", "who").agg(F.min(F.struct("key", "blocks")).alias("g")).select("g.*"), "near-groups")
    dealt = staged(apart.join(groups, "key").select(
        "key", F.pmod(F.xxhash64("number"), "blocks").alias("salt"), "number", "root"), "near-dealt")
    sets = _wanted_sets(rows, dealt.select("number").distinct(), text, shingle)
    blocks = staged(dealt.join(sets, "number").select("key", "salt", "number", "root", "shingles").repartition(
        "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(
        _blocks, "key long, salt long, numbers array<long>, roots array<long>, sets array<binary>"), "near-blocks")
    alone = blocks.select("numbers", "roots", "sets", *[
        F.lit(None).cast(blocks.schema[c].dataType).alias(f"{c}_b") for c in ("numbers", "roots", "sets")])
    salts = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = groups.where("blocks > 1").select("key", "blocks", F.explode(salts).alias("salt")).select(
        "key", "salt", F.explode(salts).alias("salt_b")).where("salt < salt_b")
    theirs = blocks.select("key", F.col("salt").alias("salt_b"), *[F.col(c).alias(f"{c}_b") for c in ("numbers", "roots", "sets")])
    across = pairs.join(blocks, ["key", "salt"]).join(theirs, ["key", "salt_b"]).select(*alone.columns)
    return staged(alone.unionByName(across).mapInArrow(_met(similarity), "a long, b long"), "near-links")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    similarity: float = SIMILARITY) -> DataFrame:
    """One ``row`` of each component of similar texts."""
    with small_batches(docs.sparkSession):
        return _representatives(docs, text, doc_id, shingle, similarity)


def _representatives(docs: DataFrame, text: str, doc_id: str, shingle: int, similarity: float) -> DataFrame:
    plain = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    rows = staged(plain.mapInArrow(_keyed(shingle), (
        f"row {plain.schema['row'].dataType.simpleString()}, number long, print long, size long, keys array<long>")), "near-rows")
    walked = staged(stars(trie_links(rows.select("print").distinct())), "near-walked")
    families = rows.select("number", "print", "size").join(walked, F.col("print") == F.col("node"), "left").select(
        "number", "size", F.xxhash64(F.lit("trie"), F.coalesce("root", "print")).alias("key"))
    members = rows.select("number", "size", F.explode("keys").alias("key")).unionByName(families)
    groups = members.groupBy("key").agg(F.min("number").alias("first"), F.max("number").alias("last")).where("first < last")
    shared = staged(members.join(groups.select("key", "first"), "key"), "near-shared")
    pairs = staged(shared.where("number > first").select(F.col("first").alias("a"), F.col("number").alias("b")).distinct(), "near-pairs")
    found = _links(rows, pairs, text, shingle, similarity)
    roots = staged(stars(found), "near-roots")
    rooted = shared.join(roots, F.col("number") == F.col("node"), "left").select(
        "key", "number", "size", F.coalesce("root", "number").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    apart = staged(rooted.join(mixed, "key", "left_semi"), "near-apart")
    every = found.unionByName(_links_within_keys(rows, apart, text, shingle, similarity))
    roots = staged(stars(every), "near-roots")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    placed = staged(rows.select("number", F.col(f"row.`{doc_id}`").alias("_id")).join(
        linked, F.col("number") == F.col("node")).select("number", "_id", "root"), "near-placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "number")).alias("first"))
    # the rows that go are fewer than those that stay; their numbers are joined by the size of their file
    gone = staged(placed.select("number").join(
        first.select(F.col("first.number").alias("number")), "number", "left_anti"), "near-gone")
    return rows.join(gone, "number", "left_anti").select("row")
