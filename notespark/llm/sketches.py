"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in Spark expressions only.

A text is the set of the digests of its paragraphs: lines, and of long lines up to three sentences each.
Its sketch has a fixed number of cells in ``TABLES`` tables; a digest falls into one cell of each, and a cell holds
how many fell into it and the exclusive or of the digests and of their checks.  Sketches of two versions
are subtracted cell by cell, whereupon common paragraphs vanish, and peeled: a cell with one digest names
it, the digest is taken out of its other cells, and so on until all are empty.  What was taken out are
the paragraphs that differ.

If cells are left, larger sketches are taken: the digests are dealt by hash into blocks that hold about
``FIT`` of them, each a sketch of its own, and a block that does not peel is tried again with the larger
sizes in ``SIZES``; after the last of them (below one in a million blocks) the digests of that block are
compared as sets.  Dealing goes in two steps, so that a text of n paragraphs costs n times the root of
its number of blocks, and every array is bounded by its text.

Fingerprints of different tables agree: they depend on the text alone.

``neighbours`` finds the next document without a global order in one task: ids and hashes of texts are cut
into ranges of about ``BUCKET`` documents, ``MOST_BUCKETS`` ranges at most, whose first keys go to all tasks
as one row; documents meet in the bucket of their range, into which the first of the next is copied, and are
ordered there by Spark's sort, which spills.  Texts are shuffled once.

Defined cases: a null text is empty; a text without paragraphs has the empty sketch, likeness 1 to
another of that kind and 0 to any other; null ids come last, equal ids are ordered by a hash of the text;
rows with the same id and text are one place in the order and come back each; a single document is its
own next; an empty table gives no rows; other columns come back inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notespark.functions.text import let, once
from notespark.llm.common import as_rows, documents, staged

#: Up to three sentences of one line.
PARAGRAPH = r"(?:[^.!?\n]*+[.!?]++){1,3}|[^.!?\n]++"
TABLES = 3
#: Cells of a fingerprint, and the sizes a block is tried with; at most 63, a bit each.
CELLS = 24
SIZES = (24, 48, 60)
#: Digests for which a block is meant.
FIT = 12
ROUNDS = 12
BUCKET = 4096
MOST_BUCKETS = 1 << 15

_CELL = "struct<n:int,k:bigint,c:bigint>"
_FOUND = "array<struct<k:bigint,n:int>>"


def digests(text: Column) -> Column:
    """The distinct hashes of a text's paragraphs."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.btrim(p, F.lit(" \t\r\x0b\x0c")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(-1), digest)


def _mask(digest: Column, size: int) -> Column:
    """The cells of a digest as bits, one in each table."""
    per = size // TABLES

    def bit(h: Column, table: int) -> Column:
        return F.call_function(
            "shiftleft", F.lit(1).cast("long"), (F.lit(table * per) + F.pmod(F.shiftright(h, 20 * table), F.lit(per))).cast("int"))

    return let(F.xxhash64(F.lit(size), digest), lambda h: bit(h, 0).bitwiseOR(bit(h, 1)).bitwiseOR(bit(h, 2)))


def _in_cell(mask: Column, i: Column) -> Column:
    return F.call_function("getbit", mask, i) == 1


def _cells(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size - 1))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), c.alias("c"))


def _signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda d: F.struct(d.alias("k"), F.lit(sign).alias("n")))


def _filled(signed: Column, size: int) -> Column:
    """The cells of digests ``k`` that count ``n`` each."""
    marked = F.transform(signed, lambda e: F.struct(
        e["k"].alias("k"), e["n"].alias("n"), _check(e["k"]).alias("c"), _mask(e["k"], size).alias("m")))
    zero = F.lit(0).cast("long")
    return let(marked, lambda all_: F.transform(_cells(size), lambda i: F.aggregate(
        F.filter(all_, lambda e: _in_cell(e["m"], i)), _cell(F.lit(0), zero, zero),
        lambda a, e: _cell(a["n"] + e["n"], a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])))))


def sketch(keys: Column, size: int = CELLS) -> Column:
    """The cells of an array of digests."""
    return _filled(_signed(keys, 1), size)


def subtract(a: Column, b: Column) -> Column:
    """Cells of one version less those of another."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, size: int) -> Column:
    """``found`` (digests ``k`` with sign ``n``: 1 of the first version, -1 of the second), null if cells are left."""

    def pure(cell: Column) -> Column:
        return (F.abs(cell["n"]) == 1) & (_check(cell["k"]) == cell["c"])

    def empty(cell: Column) -> Column:
        return (cell["n"] == 0) & (cell["k"] == 0) & (cell["c"] == 0)

    def round_(state: Column, _: Column) -> Column:
        taken = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda c: F.struct(
            c["k"].alias("k"), c["n"].alias("n"), _mask(c["k"], size).alias("m"))))

        def without(p: Column) -> Column:
            left = F.transform(state["cells"], lambda cell, i: F.when(empty(cell), cell).otherwise(F.aggregate(
                F.filter(p, lambda e: _in_cell(e["m"], i)), cell,
                lambda c, e: _cell(c["n"] - e["n"], c["k"].bitwiseXOR(e["k"]), c["c"].bitwiseXOR(_check(e["k"]))))))
            names = F.transform(p, lambda e: F.struct(e["k"].alias("k"), e["n"].alias("n")))
            return F.when(F.size(p) == 0, F.struct(state["cells"], state["found"], F.lit(False).alias("on"))).otherwise(
                F.struct(left.alias("cells"), F.concat(state["found"], names).alias("found"), F.lit(True).alias("on")))

        return F.when(state["on"], let(taken, without)).otherwise(state)

    start = F.struct(cells.cast(f"array<{_CELL}>").alias("cells"), F.array().cast(_FOUND).alias("found"), F.lit(True).alias("on"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(F.forall(s["cells"], empty), s["found"]))


def _block(a: Column, b: Column) -> Column:
    """What differs within a block: larger sketches until one peels.

    Sketches are sums, so that of the signed digests is the difference of the two versions' sketches.
    """
    both = F.concat(_signed(a, 1), _signed(b, -1))
    exact = F.concat(_signed(F.array_except(a, b), 1), _signed(F.array_except(b, a), -1))
    return F.coalesce(*[peel(_filled(both, size), size) for size in SIZES], exact)


def _larger(a: Column, b: Column) -> Column:
    """What differs, by blocks of sketches."""

    def dealt(keys: Column, blocks: Column) -> Column:
        return F.transform(keys, lambda d: F.struct(d.alias("k"), F.pmod(F.xxhash64(F.lit(7), d), blocks).cast("int").alias("b")))

    def chosen(keys: Column, at: Column) -> Column:
        return F.transform(F.filter(keys, lambda e: e["b"] == at), lambda e: e["k"])

    def group(keys: Column, g: Column, inner: Column) -> Column:
        return F.filter(keys, lambda e: F.floor(e["b"] / inner) == g)

    def all_blocks(s: Column) -> Column:
        outer, inner = s["outer"], s["inner"]

        def one(g: Column) -> Column:
            return let(F.struct(group(s["a"], g, inner).alias("a"), group(s["b"], g, inner).alias("b")), lambda part: F.flatten(
                F.transform(F.sequence(F.lit(0), inner - 1), lambda t: let(
                    F.struct(chosen(part["a"], g * inner + t).alias("a"), chosen(part["b"], g * inner + t).alias("b")),
                    lambda keys: _block(keys["a"], keys["b"])))))

        return F.flatten(F.transform(F.sequence(F.lit(0), outer - 1), one))

    bits = F.ceil(F.log2(F.greatest((F.size(a) + F.size(b)) / F.lit(FIT), F.lit(1.0)))).cast("int")
    power = lambda n: F.call_function("shiftleft", F.lit(1), n)
    half = F.floor(bits / F.lit(2)).cast("int")
    return let(F.struct(
        power(half).alias("outer"), power(bits - half).alias("inner"),
        dealt(a, power(bits)).alias("a"), dealt(b, power(bits)).alias("b")), all_blocks)


def difference(a: Column, cells_a: Column, b: Column, cells_b: Column) -> Column:
    """The digests that differ between two versions, given as digests and fingerprint cells."""
    return F.coalesce(peel(subtract(cells_a, cells_b), CELLS), _larger(a, b))


def likeness(found: Column, a: Column, b: Column) -> Column:
    """Shared paragraphs by all paragraphs of both versions, from the digests that differ."""
    gone = F.size(F.filter(found, lambda e: e["n"] == 1))
    new = F.size(F.filter(found, lambda e: e["n"] == -1))
    both = F.size(a) - gone
    every = F.size(a) + new
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def fingerprint(cells: Column) -> Column:
    """Cells as hexadecimal digits: 8 of the count, 16 of the digests, 16 of the checks."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(
        F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 16, "0"))), ""))


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each ``row`` with its ``text`` and the ``next_text`` in ascending order of ids, the first after the last."""
    words = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    key = F.struct(F.col(f"row.`{doc_id}`").isNull().alias("none"), F.col(f"row.`{doc_id}`").alias("id"), F.xxhash64(words).alias("h"))
    rows = as_rows(docs).select("row", key.alias("key"))
    buckets = min(max(docs.count() // BUCKET, 1), MOST_BUCKETS)
    ranges = rows.select("key").repartitionByRange(buckets, "key").groupBy(F.spark_partition_id().alias("range")).agg(
        F.min("key").alias("first"))
    firsts = F.array_sort(F.collect_list("first"))
    wide = F.greatest(F.ceil(F.sqrt(F.size(firsts))).cast("int"), F.lit(1))
    cuts = staged(ranges.agg(firsts.alias("firsts"), wide.alias("wide")).select("wide", "firsts", F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("firsts") / F.col("wide")).cast("int") - 1, F.lit(0))),
        lambda i: F.slice("firsts", i * F.col("wide") + 1, F.col("wide"))).alias("groups")), "sketch-cuts")  # one row
    one = cuts.select(F.struct("wide", "groups", F.size("firsts").alias("n")).alias("cuts")).scalar()

    def place(k: Column, c: Column) -> Column:
        group = F.size(F.filter(c["groups"], lambda g: g[0] <= k)) - 1
        return let(group, lambda g: let(
            F.size(F.filter(c["groups"][g], lambda first: first <= k)) - 1, lambda inside: F.struct(
                (g * c["wide"] + inside).alias("bucket"), (c["groups"][g][inside] == k).alias("is_first"), c["n"].alias("n"))))

    placed = once(once(rows, cuts=one), place=place(F.col("key"), F.col("cuts"))).select("row", "key", "place.*")
    at = lambda bucket, wrapped, copy: F.struct(
        bucket.alias("bucket"), wrapped.alias("wrapped"), F.lit(copy).alias("copy"))
    before = F.when(F.col("is_first"), at(F.pmod(F.col("bucket") - 1, F.col("n")), F.col("bucket") == 0, True))
    dealt = placed.select("row", "key", F.inline(F.array_compact(F.array(at(F.col("bucket"), F.lit(False), False), before))))
    in_order = W.partitionBy("bucket").orderBy("wrapped", "key")
    ranked = dealt.withColumn("rank", F.dense_rank().over(in_order))
    following = F.first(words).over(W.partitionBy("bucket").orderBy("rank").rangeBetween(1, 1))
    return ranked.withColumn("next_text", following).where("NOT copy").select("row", words.alias("text"), "next_text")


def edited(text: Column, following: Column) -> Column:
    """A text whose last half of code points is replaced by the first of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compared(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document against its edited text and against the next document.

    Returns ``row``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``changed`` and
    ``changed_next`` (digests that differ, with the sign of the version that has them), ``near_edited`` and
    ``near_next``.
    """
    rows = once(neighbours(docs, text, doc_id), edited=edited(F.col("text"), F.col("next_text")))
    keyed = once(
        rows, a=digests(F.col("text")), b=digests(F.col("edited")), c=digests(F.col("next_text")),
        n_chars=F.length("text").cast("long"), edited_sha256=F.sha2("edited", 256)).select(
        "row", "a", "b", "c", "n_chars", "edited_sha256")
    drawn = once(keyed, cells_a=sketch(F.col("a")), cells_b=sketch(F.col("b")), cells_c=sketch(F.col("c")))
    found = once(
        drawn, changed=difference(*map(F.col, ("a", "cells_a", "b", "cells_b"))),
        changed_next=difference(*map(F.col, ("a", "cells_a", "c", "cells_c"))))
    return found.select(
        "row", "n_chars", "edited_sha256", fingerprint(F.col("cells_a")).alias("fingerprint"),
        fingerprint(F.col("cells_b")).alias("edited_fingerprint"), "changed", "changed_next",
        likeness(F.col("changed"), F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("changed_next"), F.col("a"), F.col("c")).alias("near_next"))


def op12_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their fingerprint and likeness to an edited version and to the next document."""
    out = compared(documents(spark, folder).select("doc_id", "text"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op12_sketches": op12_sketches}
#: Hashes and peeling are not SQL; tests compare with plain sets.
ORACLE: dict = {}
