"""Prefix trie of conversations by whole-sequence collapse.

1. Turns are numbered in their conversation and become digests; texts are not moved again.
2. A sequence of turns is named by its length and two sums of hashes of (position, turn), 128 bits.
   Identical conversations collapse into one weighted sequence, with the list of those that end there
   and the smallest of them as its representative; only representatives go on.
3. Sequences that are proper prefixes of others are dropped by an anti-join: what stays are the leaves.
4. Every prefix of a sequence carries its weight, and prefixes are aggregated into nodes.  Sums over
   subtrees need no walk: conversations times words below a node are weighted sums of what each sequence
   has left from there, and words counted once per node are charged to the smallest conversation through
   the node, whose nodes are the tail of its sequence from some depth on.

No conversation, node or group of copies has to fit a task: numbering and sums along a sequence go by
ranges of the order (``notespark.scale``), groups are summed before they are shuffled, joins on a node are
dealt by Spark where one is large.  The list of ends of a group is written as text in pieces of bounded
size and hashed as a stream; one SHA-256 is sequential, so a group's list goes through one task, piece by
piece, a row per ``PIECE`` conversations.

Defined cases: a null role or text is empty; null turns come first; equal turns of one conversation go by
the digest of role and text, repeated rows count each; rows without a conversation are left out; a
conversation without turns ends at the root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import WORD, batch_of, staged
from notespark.scale import running_sum, running_sums

#: Conversations in one piece of a list of ends.
PIECE = 1 << 15
#: Every ``FAMILY``-th conversation is the base of those after it, which share up to ``SHARED`` - 1 turns.
FAMILY = 20
SHARED = 4
SUM = "decimal(38,0)"


def numbered(talks: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             keep: Sequence[str] = ()) -> DataFrame:
    """Turns as ``conv_id, pos`` (from 1), digest ``d1, d2``, ``words`` and the columns to keep; staged.

    ``_range`` numbers ranges of the order, for sums along conversations.
    """
    said, by = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text, role))
    digest = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    turns = talks.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").isNotNull().alias("known"), F.col(f"`{turn}`").alias("turn"),
        half(1).alias("d1"), half(17).alias("d2"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
        *[F.col(f"`{c}`") for c in keep])
    order = ["conv_id", "known", "turn", "d1", "d2"]
    cut = staged(turns.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "trie-turns")
    placed = running_sum(cut.withColumn("_at", F.struct(*order[1:])), ["conv_id"], "_at", F.lit(1), "_before")
    return staged(placed.select(
        "conv_id", "_range", (F.col("_before") + 1).cast("long").alias("pos"), "d1", "d2", "words", *keep), "trie-numbered")


def shared_heads(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Numbered turns rebuilt so that the conversations of a family start alike, and all conversations.

    Conversation c takes the first h turns of its base ``c - c % family``, h being ``crc32(c) % shared``,
    and goes on with its own turns after its first h.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("long")
    lengths = staged(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "trie-lengths")
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = staged(lengths.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "trie-convs")
    rest = [c for c in turns.columns if c not in ("conv_id", "_range", "pos")]
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", "_range", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), *rest)
    first = turns.where((F.col("pos") < shared) & (F.col("conv_id") % family == 0)).select(
        F.col("conv_id").alias("base"), "pos", *rest)
    heads = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("pos <= taken").select(
        "conv_id", F.lit(-1).alias("_range"), "pos", *rest)
    return staged(own.unionByName(heads), "trie-rebuilt"), convs.select("conv_id")


def _name(depth: Column, s1: Column, s2: Column, name: str) -> list[Column]:
    """The two columns that name a node."""
    return [F.xxhash64(F.lit(k), depth, s1.cast(SUM), s2.cast(SUM)).alias(f"{name}{k}") for k in (1, 2)]


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the sequence of a batch's rows changes, with both ends."""
    q1, q2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    change = np.flatnonzero((q1[1:] != q1[:-1]) | (q2[1:] != q2[:-1])) + 1
    return np.concatenate(([0], change, [len(q1)]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by sequence and conversation, text pieces of the lists of ends."""
    for batch in batches:
        if not len(batch):
            continue
        ids = np.asarray(batch.column(2))
        runs = _runs(batch)
        cuts = [(k, min(k + PIECE, high)) for low, high in zip(runs, runs[1:]) for k in range(low, high, PIECE)]
        at = pa.array([low for low, _ in cuts], pa.int64())
        yield batch_of({
            **{n: batch.column(n).take(at) for n in ("q1", "q2", "size", "tokens")},
            "first": pa.array(ids[at]), "n": pa.array([high - low for low, high in cuts], pa.int64()),
            "ids": pa.array([",".join(map(str, ids[low:high].tolist())).encode() for low, high in cuts], pa.binary())})


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ordered pieces, a row for each sequence with the digest of its list."""
    held, digest, done = None, None, []

    def batch_out() -> pa.RecordBatch:
        names = ("q1", "q2", "size", "tokens", "rep", "weight", "ends")
        out = batch_of({n: pa.array([d[k] for d in done], pa.string() if n == "ends" else pa.int64()) for k, n in enumerate(names)})
        done.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("q1", "q2", "size", "tokens", "first", "n", "ids"))):
            if held is None or row[:2] != tuple(held[:2]):
                if held is not None:
                    done.append((*held, digest.hexdigest()))
                held, digest = [*row[:5], 0], hashlib.sha256(row[6])
            else:
                digest.update(b"," + row[6])
            held[5] += row[5]
        if len(done) >= 4096:
            yield batch_out()
    if held is not None:
        done.append((*held, digest.hexdigest()))
    if done:
        yield batch_out()


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct conversations: ``q1, q2`` (name), ``size``, ``tokens``, ``rep``, ``weight``, ``ends`` (digest); staged."""
    sums = turns.groupBy("conv_id").agg(
        F.count("*").alias("size"), F.sum("words").alias("tokens"),
        *[F.sum(_hashed(k)).alias(f"s{k}") for k in (1, 2)])
    zero = F.lit(0).cast(SUM)
    size = F.coalesce("size", F.lit(0).cast("long"))
    whole = staged(convs.join(sums, "conv_id", "left").select(
        *_name(size, F.coalesce(F.col("s1").cast(SUM), zero), F.coalesce(F.col("s2").cast(SUM), zero), "q"), "conv_id", size.alias("size"),
        F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens")), "trie-whole")
    order = ["q1", "q2", "conv_id"]
    pieces = whole.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "q1 long, q2 long, size long, tokens long, first long, n long, ids binary")
    return staged(pieces.repartition("q1", "q2").sortWithinPartitions("q1", "q2", "first").mapInArrow(
        _listed, "q1 long, q2 long, size long, tokens long, rep long, weight long, ends string"), "trie-sequences")


def _hashed(k: int) -> Column:
    """One of the two hashes of a turn at its place."""
    return F.xxhash64(F.lit(k), F.col("pos").cast("long"), "d1", "d2").cast("decimal(20,0)")


def _paths(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """All prefixes of the distinct sequences, each with its node, its parent, and the words left from there; staged."""
    of = seqs.select(F.col("rep").alias("conv_id"), "size", "weight", "tokens")
    rows = turns.join(of, "conv_id").select(
        "conv_id", "_range", "pos", "words", "size", "weight", "tokens", *[_hashed(k).alias(f"x{k}") for k in (1, 2)])
    summed = running_sums(
        rows, ["conv_id"], "pos", {"before1": F.col("x1"), "before2": F.col("x2"), "before_words": F.col("words")})
    inner = summed.select(
        F.col("conv_id").alias("rep"), "size", "weight", F.col("pos").cast("long").alias("depth"), "words",
        (F.col("tokens") - F.col("before_words")).cast("long").alias("left"),
        *_name(F.col("pos").cast("long"), F.col("before1") + F.col("x1"), F.col("before2") + F.col("x2"), "n"),
        *_name(F.col("pos").cast("long") - 1, F.col("before1"), F.col("before2"), "p"))
    none = F.lit(None).cast("long")
    zero, start = F.lit(0).cast("long"), F.lit(0).cast(SUM)
    roots = seqs.select(
        "rep", "size", "weight", zero.alias("depth"), zero.alias("words"), F.col("tokens").alias("left"),
        *_name(zero, start, start, "n"), none.alias("p1"), none.alias("p2"))
    return staged(inner.unionByName(roots), "trie-paths")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of numbered turns; ``convs`` has all conversations, those without turns too.

    Returns a row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    seqs = sequences(turns, convs)
    paths = _paths(turns, seqs)
    prefixes = paths.where("depth < size").select("n1", "n2").distinct()
    leaves = staged(seqs.join(prefixes, (F.col("q1") == F.col("n1")) & (F.col("q2") == F.col("n2")), "left_anti").select(
        F.col("rep").alias("leaf")), "trie-leaves")
    marked = paths.join(leaves, F.col("rep") == F.col("leaf"), "left")
    found = staged(marked.groupBy("n1", "n2").agg(
        F.min("rep").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("left")).alias("said")), "trie-nodes")
    owned = found.groupBy(F.col("conv_id").alias("owner")).agg(F.sum("words").alias("own"), F.min("depth").alias("from_depth"))
    once = paths.join(owned, F.col("rep") == F.col("owner")).groupBy("n1", "n2").agg(
        F.sum(F.when(F.col("depth") >= F.col("from_depth"), F.col("left")).otherwise(F.col("own"))).alias("once"))
    children = found.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("children"))
    parents = found.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = seqs.select(F.col("q1").alias("n1"), F.col("q2").alias("n2"), "ends")
    whole = found.join(once, ["n1", "n2"]).join(children, ["n1", "n2"], "left").join(ends, ["n1", "n2"], "left")
    return whole.join(parents, ["p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        (F.col("said") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def with_turns(trie: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with what :func:`numbered` kept of their last turn; the root has nulls."""
    last = turns.drop("_range", "d1", "d2", "words").withColumnRenamed("pos", "depth")
    return trie.join(last, ["conv_id", "depth"], "left")


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that families start alike."""
    return nodes(*shared_heads(numbered(spark.read.parquet(f"{folder}/conversations.parquet"))))


_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLE = {"op11_conversation_trie": rf"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, xor({_CRC}, 4294967295) % {SHARED} AS h, conv_id - conv_id % {FAMILY} AS base
          FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
    r AS (
        SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL
        SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
    s AS (
        SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN (
            SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY part, pos) AS turns FROM r GROUP BY conv_id
        ) USING (conv_id)),
    p AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM s, unnest(range(len(turns) + 1)) x(d)),
    n AS MATERIALIZED (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
               CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS words
        FROM p GROUP BY path, depth),
    k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    b AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
    u AS (
        SELECT b.path[1:x.d] AS path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
        FROM b, unnest(range(b.depth + 1)) x(d) GROUP BY 1)
    SELECT b.conv_id, b.depth, q.conv_id AS parent_conv_id, b.n_convs, b.n_children, u.n_leaves,
           CAST(u.saved_tokens AS BIGINT) AS saved_tokens, b.ends_sha256
    FROM b JOIN u USING (path) LEFT JOIN b q ON b.depth > 0 AND q.path = b.path[1:b.depth - 1]"""}
