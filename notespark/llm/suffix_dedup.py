"""Removal of repeated 100-byte strings by blockwise suffix sorting with a cover sample.

The suffixes that matter are the windows of ``LENGTH`` bytes, so ties never go deeper.  The cover
sample has, for every window, the k-gram of least hash inside it, the leftmost if tied: like a
difference cover it gives any two equal windows a sample position at the same distance from their
starts, but it needs one position per window and not several for each pair of phases.

1. Sample: the k-grams of the cover get their names, 64-bit hashes.  Only names found twice or more
   can have equal windows around them; a name seen twice in a block of documents is known there, and
   sends one row to the others.
2. Buckets: a repeated name is a bucket of suffixes, all windows that it covers.  Each of its
   occurrences brings the bytes around it.  Equal surroundings within a block send one.
3. One bucket at a time is sorted by window, with equal ones in the order of their places; a window
   is repeated if an earlier one is equal.  Ties are settled by precomputed ranks of the windows: two
   64-bit hashes, in place of comparing bytes.  A bucket too large for one task is dealt by windows
   instead of by name, and its first places are found by aggregation.
4. Runs of repeated windows go back to their documents and are cut out.

Equal windows are earlier by ``doc_id``, then by start, in the input as it is.

Defined cases: a null text is the empty text; texts shorter than a window keep all; rows with one
``doc_id`` and one text count as one document, so nothing in them is earlier by the row; different
texts of one id, or without an id, are documents of their own, told apart and ordered by ``twin``,
a hash of the text; a null id comes before all others; an empty table gives no rows; other columns
come back inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import batch_of, documents, staged, whole_text

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
PIECE = 1 << 19
BLOCK_BYTES = 16 << 20
PART_ROWS = 1 << 21
LARGE_BUCKET = 20_000
CHUNK_ROWS = 20_000
NULL_ID = -(1 << 63)

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                pair.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = tuple(pair)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def hashes(data: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    h = (sums[size:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def cover(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover sample: place and name of each sampled k-gram, and the first and last window it covers."""
    places, names, firsts, lasts = [], [], [], []
    windows = len(data) - LENGTH + 1
    for at in range(0, max(windows, 0), PIECE):
        n = min(PIECE, windows - at)
        h = hashes(data[at:at + n + LENGTH - 1], GRAM)
        # hash above, place below: the least is the least hash, the leftmost if tied
        m = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < SPAN:
            m = np.minimum(m[:n], m[SPAN - width:])
        place = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        edge = np.flatnonzero(place[1:] != place[:-1])
        first = np.concatenate(([0], edge + 1))
        last = np.concatenate((edge, [n - 1]))
        names.append(h[place[first]])
        places.append(place[first] + at)
        firsts.append(first + at)
        lasts.append(last + at)
    if not places:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    place, name, first, last = (np.concatenate(x) for x in (places, names, firsts, lasts))
    # a k-gram that covers windows on both sides of a piece's edge
    new = np.concatenate(([True], place[1:] != place[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(place) - 1]))
    return place[new], name[new], first[new], last[ends]


# ------------------------------------------------------------------------ 1: repeated names

#: Kinds of rows on their way: asks whether others have the name; asks, being known already; is known.
ASKS, ASKS_KNOWN, KNOWN = 0, 1, 2


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def block():
        ids = np.concatenate([np.full(len(p), d) for d, _, p, _ in held])
        twin = np.concatenate([np.full(len(p), t) for _, t, p, _ in held])
        place = np.concatenate([p for _, _, p, _ in held])
        name = np.concatenate([n for _, _, _, n in held])
        order = np.lexsort((place, twin, ids, name))
        ids, twin, place, name = ids[order], twin[order], place[order], name[order]
        # rows that repeat a document bring its places again; they are one
        fresh = np.ones(len(name), bool)
        fresh[1:] = (
            (name[1:] != name[:-1]) | (ids[1:] != ids[:-1]) | (twin[1:] != twin[:-1]) | (place[1:] != place[:-1]))
        ids, twin, place, name = ids[fresh], twin[fresh], place[fresh], name[fresh]
        start = np.ones(len(name), bool)
        start[1:] = name[1:] != name[:-1]
        first = np.flatnonzero(start)
        many = np.repeat(np.diff(np.append(first, len(name))) > 1, np.diff(np.append(first, len(name))))
        asks = first
        known = np.flatnonzero(many)
        take = np.concatenate((asks, known))
        kind = np.concatenate((np.where(many[asks], ASKS_KNOWN, ASKS), np.full(len(known), KNOWN))).astype(np.int8)
        names = name[take].view(np.int64)
        deal = np.where(kind == KNOWN, ids[take] + twin[take] + place[take], names)
        for k in range(0, len(take), 100_000):
            s = slice(k, k + 100_000)
            yield batch_of({
                "deal": pa.array(deal[s]), "name": pa.array(names[s]), "id": pa.array(ids[take][s]),
                "twin": pa.array(twin[take][s]), "place": pa.array(place[take][s]), "kind": pa.array(kind[s])})

    for batch in batches:
        ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        texts = batch.column(2)
        for k in range(len(batch)):
            data = np.frombuffer(texts[k].as_buffer(), np.uint8)
            place, name, _, _ = cover(data)
            if len(place):
                held.append((ids[k], twins[k], place, name))
                size += len(data)
            if size >= BLOCK_BYTES:
                yield from block()
                held, size = [], 0
    if held:
        yield from block()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition by name: the places of names found twice or more."""
    parts = []
    for batch in batches:
        kind = np.asarray(batch.column(5))
        known = batch.filter(pa.array(kind == KNOWN))
        if len(known):
            yield batch_of({n: known.column(c) for n, c in (("id", 2), ("twin", 3), ("place", 4))})
        asks = batch.filter(pa.array(kind != KNOWN))
        if len(asks):
            parts.append([np.asarray(asks.column(c)) for c in (1, 2, 3, 4, 5)])
    if not parts:
        return
    name, ids, twin, place, kind = (np.concatenate([p[c] for p in parts]) for c in range(5))
    order = np.argsort(name, kind="stable")
    name, ids, twin, place, kind = name[order], ids[order], twin[order], place[order], kind[order]
    same = name[1:] == name[:-1]
    many = np.concatenate((same, [False])) | np.concatenate(([False], same))
    many &= kind == ASKS
    if many.any():
        yield batch_of({"id": pa.array(ids[many]), "twin": pa.array(twin[many]), "place": pa.array(place[many])})


# ------------------------------------------------------------------------ 2: surroundings

BUCKETED = "name long, id long, twin long, first long, windows int, bytes binary, start long, until long"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of repeated names with their bytes, and runs repeated within the block.

    A row is an occurrence (``bytes``), or a run ``start`` to ``until`` of repeated bytes.
    """
    seen: dict[tuple, list] = {}
    size = 0

    def block():
        rows, runs = [], []
        for (name, raw), at in seen.items():
            at.sort()
            windows = len(raw) - LENGTH + 1
            rows.append((name, *at[0], windows, raw))
            runs += [(d, w, f, f + windows + LENGTH - 1) for d, w, f in at[1:] if (d, w, f) != at[0]]
        for k in range(0, len(rows), 20_000):
            c = list(zip(*rows[k:k + 20_000], strict=True))
            n = len(c[0])
            yield batch_of({
                "name": pa.array(c[0], pa.int64()), "id": pa.array(c[1], pa.int64()), "twin": pa.array(c[2], pa.int64()),
                "first": pa.array(c[3], pa.int64()), "windows": pa.array(c[4], pa.int32()), "bytes": pa.array(c[5], pa.binary()),
                "start": pa.nulls(n, pa.int64()), "until": pa.nulls(n, pa.int64())})
        for k in range(0, len(runs), 100_000):
            yield _runs([list(x) for x in zip(*runs[k:k + 100_000], strict=True)])

    for batch in batches:
        ids, twins, texts, places = (batch.column(c) for c in range(4))
        for k in range(len(batch)):
            raw = texts[k].as_buffer().to_pybytes()
            place, name, first, last = cover(np.frombuffer(raw, np.uint8))
            wanted = np.isin(place, np.asarray(places[k].values))
            doc, twin = ids[k].as_py(), twins[k].as_py()
            for n, f, t in zip(name[wanted].view(np.int64).tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                part = raw[f:t + LENGTH]
                seen.setdefault((n, part), []).append((doc, twin, f))
                size += len(part)
            if size >= BLOCK_BYTES:
                yield from block()
                seen.clear()
                size = 0
    yield from block()


def _runs(columns: list) -> pa.RecordBatch:
    n = len(columns[0])
    return batch_of({
        "name": pa.nulls(n, pa.int64()), "id": pa.array(columns[0], pa.int64()), "twin": pa.array(columns[1], pa.int64()),
        "first": pa.nulls(n, pa.int64()),
        "windows": pa.nulls(n, pa.int32()), "bytes": pa.nulls(n, pa.binary()),
        "start": pa.array(columns[2], pa.int64()), "until": pa.array(columns[3], pa.int64())})


# ------------------------------------------------------------------------ 3: sorting buckets


def _windows(first: np.ndarray, windows: np.ndarray, raw: pa.Array):
    """The two ranks of every window, the row it belongs to, and where it starts in its document."""
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    lengths = windows + LENGTH - 1
    row = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(lengths) - lengths, windows) + inside
    ranks = [hashes(data, LENGTH, base)[at] for base in _BASES]
    return ranks[0], ranks[1], row, first[row] + inside


def _sorted_runs(name, ids, twins, first, windows, raw) -> tuple[np.ndarray, ...]:
    """Runs of windows that have an equal earlier one, as ``(id, twin, start, until)``."""
    rank, check, row, start = _windows(first, windows, raw)
    order = np.lexsort((start, twins[row], ids[row], check, rank))
    new = np.ones(len(order), bool)
    r, c = rank[order], check[order]
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    a, b = row[order], row[head]
    later = (ids[a] != ids[b]) | (twins[a] != twins[b]) | (start[order] != start[head])
    repeated = np.zeros(len(order), bool)
    repeated[order] = later
    return _as_runs(ids[row], twins[row], start, row, repeated)


def _as_runs(ids, twins, start, row, repeated):
    """Neighbouring windows of a row together."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    breaks = np.ones(len(at), bool)
    breaks[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(breaks)
    tail = np.append(head[1:], len(at)) - 1
    return ids[at[head]], twins[at[head]], start[at[head]], start[at[tail]] + LENGTH


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort bucket after bucket of a partition sorted by name, some thousand rows at once."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def done(table: pa.Table):
        c = [table.column(k).combine_chunks() for k in range(6)]
        found = _sorted_runs(*(np.asarray(x) for x in c[:5]), c[5])
        if len(found[0]):
            yield batch_of({n: pa.array(x, pa.int64()) for n, x in zip(("id", "twin", "start", "until"), found, strict=True)})

    for batch in batches:
        for k in range(0, len(batch), CHUNK_ROWS):
            held.append(batch.slice(k, CHUNK_ROWS))
            rows += len(held[-1])
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                names = np.asarray(table.column(0).combine_chunks())
                cut = int(np.searchsorted(names, names[-1]))  # the last bucket may go on
                if cut:
                    yield from done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = len(names) - cut
    if rows:
        yield from done(pa.Table.from_batches(held))


def _deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 2000):
            part = batch.slice(k, 2000)
            first, windows = (np.asarray(part.column(c)) for c in (3, 4))
            rank, check, row, start = _windows(first, windows, part.column(5))
            yield batch_of({
                "rank": pa.array(rank.view(np.int64)), "check": pa.array(check.view(np.int64)),
                "id": pa.array(np.asarray(part.column(1))[row]), "twin": pa.array(np.asarray(part.column(2))[row]), "start": pa.array(start)})


def _large_buckets(rows: DataFrame) -> DataFrame:
    """The same for buckets dealt by window: the first place of each by aggregation, then a join."""
    dealt = rows.mapInArrow(_deal_windows, "rank long, check long, id long, twin long, start long")
    first = dealt.groupBy("rank", "check").agg(F.min(F.struct("id", "twin", "start")).alias("least"))
    later = dealt.join(first, ["rank", "check"]).where(F.struct("id", "twin", "start") > F.col("least"))
    return later.select("id", "twin", "start", (F.col("start") + LENGTH).alias("until"))


# ------------------------------------------------------------------------ 4: cutting


def kept_bytes(data: bytes, starts: np.ndarray, untils: np.ndarray) -> tuple[bytes, int]:
    """What is left without the runs, and how many maximal runs they make."""
    order = np.argsort(starts, kind="stable")
    start, until = starts[order], np.maximum.accumulate(untils[order])
    new = np.concatenate(([True], start[1:] > until[:-1]))
    heads, tails = start[new], until[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(until) - 1]))]
    out, at = [], 0
    for s, t in zip(heads.tolist(), tails.tolist(), strict=True):
        out.append(data[at:s])
        at = t
    return b"".join([*out, data[at:]]), len(heads)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, starts, untils = (batch.column(c) for c in range(4))
        for i in range(0, len(batch), 500):
            out = []
            for k in range(i, min(i + 500, len(batch))):
                raw = texts[k].as_buffer().to_pybytes()
                if starts[k].is_valid and len(starts[k].values):
                    kept, n = kept_bytes(raw, np.asarray(starts[k].values), np.asarray(untils[k].values))
                else:
                    kept, n = raw, 0
                out.append((len(raw), n, kept))
            sizes, spans, kept = zip(*out, strict=True)
            yield batch_of({
                "row": rows.slice(i, len(out)), "n_bytes": pa.array(sizes, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary())})


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None,
                    large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """Each row with the bytes that stay.

    Returns ``row`` (the columns ``keep``, or all), ``n_bytes``, ``n_spans`` and ``kept`` (binary).
    """
    raw = whole_text(f"`{text}`").cast("binary")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID))
    spark = docs.sparkSession
    # ids that stand beside different texts; in a table with unique ids there are none
    shared = staged(
        docs.select(key.alias("id"), F.xxhash64(raw).alias("h")).where(F.col("id") != NULL_ID).groupBy("id").agg(
            F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select(F.col("id").alias("shared")), "suffix-shared")
    apart = F.col("shared").isNotNull() | (F.col("id") == NULL_ID)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), key.alias("id"), raw.alias("bytes")).join(
        shared, F.col("id") == F.col("shared"), "left").select(
        "row", "id", F.when(apart, F.xxhash64("bytes")).otherwise(0).alias("twin"), "bytes")
    texts = whole.select("id", "twin", "bytes")
    total = docs.agg(F.sum(F.octet_length(raw))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (SPAN * PART_ROWS // 2) + 1)
    places = (
        texts.mapInArrow(_sample, "deal long, name long, id long, twin long, place long, kind tinyint")
        .repartition(parts, "deal").mapInArrow(_repeated, "id long, twin long, place long"))
    # of one document each, so a list is no longer than its document
    of_document = places.distinct().groupBy("id", "twin").agg(F.collect_list(F.col("place").cast("int")).alias("places"))
    joined = whole.join(of_document, ["id", "twin"], "left")
    touched = F.col("places").isNotNull()
    marked = staged(joined.select(
        "row", "id", "twin", "bytes", "places", touched.alias("touched")), "suffix-documents")
    found = staged(
        marked.where("touched").select("id", "twin", "bytes", "places").mapInArrow(_surroundings, BUCKETED), "suffix-buckets")
    occurrences = found.where("bytes IS NOT NULL").select("name", "id", "twin", "first", "windows", "bytes")
    large = staged(
        occurrences.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > large_bucket).select("name"), "suffix-large")
    small = occurrences.join(large, "name", "left_anti").repartition(parts, "name").sortWithinPartitions("name")
    runs = found.where("start IS NOT NULL").select("id", "twin", "start", "until").unionByName(
        small.mapInArrow(_sort_buckets, "id long, twin long, start long, until long")).unionByName(
        _large_buckets(occurrences.join(large, "name", "left_semi")))
    of_runs = runs.groupBy("id", "twin").agg(
        F.collect_list(F.struct("start", "until")).alias("runs")).select(
        "id", "twin", F.col("runs.start").alias("starts"), F.col("runs.until").alias("untils"))
    schema = f"row {marked.schema['row'].dataType.simpleString()}, n_bytes long, n_spans long, kept binary"
    cut = marked.where("touched").select("row", "id", "twin", "bytes").join(of_runs, ["id", "twin"], "left").select(
        "row", "bytes", "starts", "untils").mapInArrow(_cut, schema)
    rest = marked.where("NOT touched").select(
        "row", F.octet_length("bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_spans"),
        F.col("bytes").alias("kept"))
    return cut.unionByName(rest)


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without their repeated strings."""
    return without_repeats(documents(spark, folder), keep=("doc_id",)).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
#: Every window by itself; texts are taken in parts, as a place in a long string is slow to reach.
ORACLE = {"op7_suffix_dedup": """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    e AS (SELECT doc_id, n, lo, h[2 * lo + 1:2 * lo + 1198] AS part FROM (SELECT *, unnest(range(0, n, 500)) AS lo FROM d)),
    p AS (SELECT doc_id, n, lo, part, unnest(range(0, least(500, n - lo))) AS j FROM e),
    w AS (SELECT doc_id, lo + j AS i, part[2 * j + 1:2 * j + 2] AS b,
            CASE WHEN lo + j + 100 <= n THEN md5(part[2 * j + 1:2 * j + 200]) END AS k FROM p),
    f AS (SELECT k, min({'d': doc_id, 'i': i}) AS first FROM w WHERE k IS NOT NULL GROUP BY k),
    s AS (SELECT doc_id, i, b, coalesce({'d': doc_id, 'i': i} > first, FALSE) AS repeated FROM w LEFT JOIN f USING (k)),
    m AS (SELECT doc_id, i, b, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM s),
    r AS (SELECT *, lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m),
    g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
            string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""}
