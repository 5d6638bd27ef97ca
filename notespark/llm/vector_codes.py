"""Vector code compression: product codes whose nearest entries are found through memoised grid cells.

Vectors become integers and are cut into parts; each part position has a codebook, refined in rounds
of assigning parts to entries and replacing entries by the floor of their parts' mean.

To assign a part, the coarse grid cell it lies in is hashed.  For each cell the least and the greatest
distance of every entry to the cell's box are taken once: an entry whose least distance exceeds another
entry's greatest one cannot be nearest anywhere in the box.  The entries that remain are kept in a memo
of the worker, and only they are evaluated exactly.  The memo is bounded (``MEMO_CELLS`` a part); cells
beyond it are worked out for their batch.  Two cells of one hash are told apart by their coordinates.

A round is one pass over the staged integers: a task sends a sum and a count per part and entry, and the
driver holds the codebooks (``parts * entries`` rows of a part's length) and nothing per vector.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped.  The length
is that of the vector with the smallest id (null ids come last, ties go by the components); vectors of
another length stay with a null code and error.  A length the parts do not divide gives parts that differ
by one.  Fewer vectors than entries give shorter codebooks.  Components beyond ``limit(length)``, 32,768 at
64 components, count as that bound, so that distances fit a long.  Repeated rows are coded each, an empty
table gives no rows, and other columns come back inside ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import as_rows, batch_of, staged

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Grid cells across the widest spread of a codebook's entries.
CELLS_ACROSS = 4
MEMO_CELLS = 1 << 15
SLICE = 2048

_RNG = np.random.default_rng(13)
_FACTORS = _RNG.integers(0, 1 << 63, 4096).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def limit(length: int) -> int:
    """The greatest component whose squared distances summed over ``length`` components fit a long."""
    return 1 << ((62 - max(length - 1, 0).bit_length()) // 2 - 1)


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    cuts = [length * p // parts for p in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


class Grid:
    """One part's entries and the memo of what each cell leaves of them."""

    def __init__(self, entries: np.ndarray, across: int = CELLS_ACROSS) -> None:
        self.entries = entries
        self.low = entries.min(axis=0)
        spread = int((entries.max(axis=0) - self.low).max()) if entries.size else 0
        self.width = max(1, spread // across)
        self.keys = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, entries.shape[1]), np.int64)
        self.left = np.zeros((0, len(entries)), bool)

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """Which entries may be nearest somewhere in each cell's box."""
        low = (cells * self.width + self.low)[:, None, :]
        below, above = low - self.entries, self.entries - (low + (self.width - 1))
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        return (least * least).sum(axis=2) <= (most * most).sum(axis=2).min(axis=1)[:, None]

    def _memo(self, keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The entries left for distinct keys, ascending, of these cells."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        known[known] = (self.cells[at[known]] == cells[known]).all(axis=1)
        out = np.empty((len(keys), len(self.entries)), bool)
        out[known] = self.left[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._undominated(cells[new])
            add = new[:max(0, MEMO_CELLS - len(self.keys))]
            if len(add):
                keys_all = np.concatenate((self.keys, keys[add]))
                order = np.argsort(keys_all, kind="stable")
                self.keys = keys_all[order]
                self.cells = np.concatenate((self.cells, cells[add]))[order]
                self.left = np.concatenate((self.left, out[add]))[order]
        return out

    def candidates(self, x: np.ndarray) -> np.ndarray:
        cells = (x - self.low) // self.width
        keys = (cells.astype(np.uint64) * _FACTORS[:cells.shape[1]]).sum(axis=1, dtype=np.uint64)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        chosen = cells[first]
        left = self._memo(keys, chosen)[inverse]
        left[(chosen[inverse] != cells).any(axis=1)] = True  # another cell of the same hash: every entry
        return left

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, the lowest of equals, and its squared distance."""
        rows, entries = np.nonzero(self.candidates(x))
        apart = x[rows] - self.entries[entries]
        distance = (apart * apart).sum(axis=1)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[rows])
        firsts = hits[np.flatnonzero(np.diff(rows[hits], prepend=-1))]
        return entries[firsts], best


def _as_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with finite components only, and these as little-endian 32-bit integers."""
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            part = batch.slice(k, SLICE)
            vectors = part.column(1)
            offsets = np.asarray(vectors.offsets).astype(np.int64)
            x = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            finite = np.isfinite(x)
            bad = np.concatenate(([0], np.cumsum(~finite)))[offsets]
            keep = np.flatnonzero(np.asarray(vectors.is_valid()) & (np.diff(bad) == 0))
            bound = np.repeat([float(limit(n)) for n in np.diff(offsets).tolist()], np.diff(offsets)) / SCALE
            inside = np.where(finite, x, 0)[offsets[0]:offsets[-1]]
            ints = np.floor(np.clip(inside, -bound, bound) * SCALE).astype("<i4")
            starts = offsets - offsets[0]
            kept = pa.array(keep, pa.int64())
            yield batch_of({
                "row": part.column(0).take(kept), "id": part.column(2).take(kept),
                "ints": pa.array([ints[starts[i]:starts[i + 1]].tobytes() for i in keep], pa.binary())})


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """Binary values of one size as rows of integers."""
    if not len(column) or not length:
        return np.zeros((len(column), length), np.int64)
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view("<i4").reshape(len(column), length).astype(np.int64)


def _moments(books: list[np.ndarray], length: int):
    cuts = bounds(length, len(books))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                x = _matrix(batch.column(0).slice(k, SLICE), length)
                for p, (low, high) in enumerate(cuts):
                    entry, _ = grids[p].nearest(x[:, low:high])
                    np.add.at(sums[p], entry, x[:, low:high])
                    counts[p] += np.bincount(entry, minlength=len(counts[p]))
        found = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        yield batch_of({
            "part": pa.array([p for p, _ in found], pa.int32()), "entry": pa.array([e for _, e in found], pa.int32()),
            "n": pa.array([counts[p][e] for p, e in found], pa.int64()),
            "sums": pa.array([sums[p][e].tolist() for p, e in found], pa.list_(pa.int64()))})

    return work


def _coded(books: list[np.ndarray], length: int):
    cuts = bounds(length, len(books))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                part = batch.slice(k, SLICE)
                fits = np.asarray(pc.binary_length(part.column(1))) == 4 * length
                x = _matrix(part.column(1).filter(pa.array(fits)), length)
                codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
                for p, (low, high) in enumerate(cuts):
                    if len(x):
                        codes[:, p], distance = grids[p].nearest(x[:, low:high])
                        error += distance
                texts, errors = iter(c.tobytes().hex() for c in codes), iter(error.tolist())
                yield batch_of({
                    "row": part.column(0), "code": pa.array([next(texts) if f else None for f in fits], pa.string()),
                    "error": pa.array([next(errors) if f else None for f in fits], pa.int64())})

    return work


def _refined(ints: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round; an entry that no part chose stays."""
    widest = max(b.shape[1] for b in books)
    moments = ints.mapInArrow(_moments(books, length), "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)]
    after = [b.copy() for b in books]
    for r in moments.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # parts * entries rows
        after[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(after[r["part"]].shape[1])]
    return after


def encode(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes of all kept vectors, and the codebooks.

    Returns ``row``, ``code`` (two hexadecimal digits a part) and ``error`` (squared distance), staged.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, for two hexadecimal digits")
    plain = as_rows(vectors).select(
        "row", F.col(f"row.`{vector}`").cast("array<double>").alias("vector"), F.col(f"row.`{vec_id}`").alias("id"))
    types = {name: plain.schema[name].dataType.simpleString() for name in ("row", "id")}
    whole = staged(plain.mapInArrow(_as_integers, f"row {types['row']}, id {types['id']}, ints binary"), "codes-integers")
    order = [F.col("id").asc_nulls_last(), "ints"]
    first = whole.select("id", "ints").orderBy(*order).limit(1).collect()
    if not first:
        empty = whole.select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty, [np.zeros((0, 0), np.int64) for _ in range(parts)]
    length = len(first[0]["ints"]) // 4
    fitting = whole.where(F.octet_length("ints") == 4 * length)
    start = np.stack([np.frombuffer(r["ints"], "<i4").astype(np.int64) for r in fitting.select("id", "ints").orderBy(
        *order).limit(entries).collect()])
    books = [start[:, low:high].copy() for low, high in bounds(length, parts)]
    for _ in range(rounds):
        books = _refined(fitting.select("ints"), books, length)
    coded = whole.select("row", "ints").mapInArrow(
        _coded(books, length), f"row {types['row']}, code string, error long")
    return staged(coded, "codes"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """The digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for entry in b.tolist() for c in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Codes with ``label_error``, the errors summed over equal labels; null labels are one."""
    sums = staged(coded.groupBy(F.col(f"row.`{label}`").alias("_label")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    return coded.join(sums, F.col(f"row.`{label}`").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors with their codes and errors."""
    coded, books = encode(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding"))
    return with_label_error(coded).select(
        F.col("row.vec_id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    return f"""
    a{n} AS MATERIALIZED (
        SELECT vec_id, label, p, any_value(x) AS x,
               min(struct_pack(d := CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT),
                               e := e)) AS best
        FROM parts JOIN c{n} USING (p) GROUP BY vec_id, label, p)"""


def _replaced(n: int) -> str:
    return f"""
    m{n} AS (SELECT p, best.e AS e, i, CAST(sum(CAST(x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS k
             FROM a{n}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL),
    n{n} AS (SELECT p, e, list(CAST((s - ((s % k) + k) % k) // k AS DOUBLE) ORDER BY i) AS c FROM m{n} GROUP BY p, e),
    c{n + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{n} o LEFT JOIN n{n} n ON o.p = n.p AND o.e = n.e)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE = {"op13_vector_codes": f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * CAST(v AS DOUBLE))) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    parts AS MATERIALIZED (
        SELECT vec_id, label, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS x
        FROM kept, range({PARTS}) t(p)),
    c0 AS MATERIALIZED (
        SELECT p, e, x AS c FROM parts JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) f USING (vec_id)),
    {",".join(_assigned(n) + "," + _replaced(n) for n in range(ROUNDS))}, {_assigned(ROUNDS)},
    coded AS (
        SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
        FROM a{ROUNDS} GROUP BY vec_id, label),
    books AS (
        SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
        FROM c{ROUNDS}, unnest(range(1, len(c) + 1)) t(i))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded, books"""}
