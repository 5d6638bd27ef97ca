"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their content into buckets; a bucket that would not fit in
memory is partitioned again with another seed, until each fits an open-addressing table that
compares the complete content.  The partitions are tables in the shared folder, so a lost executor
costs one task and never the level.

Two things keep a hot text out of a single task.  Every task that reads records first folds the
equal ones it sees (a flush of its table), so a text that fills a third of the corpus travels once
per flush and not once per row.  And an oversized bucket is dealt out by hash *and* salt and folded
again, so a bucket of one text only shrinks level by level.

Defined cases: a null text counts as empty; only A-Z are lower-cased; rows with the same text and
the same largest ``doc_id`` (repeated rows) leave one row, null ids counting as smallest; an empty
table gives an empty result; other columns, whatever their names, come back inside ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import as_rows, batch_of, documents, staged, task_number

BUCKET_BYTES = 48 << 20
FLUSH_ROWS = 50_000


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self, capacity: int = 1024) -> None:
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def put(self, h: int, content: bytes) -> int:
        """The number of this content; a new one gets the next number."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        number = len(self.contents)
        self.slots[at] = number
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return number

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for number, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


class Fold:
    """Folds equal contents: how many rows, and the largest (id, row number) among them."""

    def __init__(self) -> None:
        self.table = ContentTable()
        self.counts: list[int] = []
        self.best: list[tuple] = []
        self.rows = 0

    def add(self, h: int, content: bytes, count: int, best: tuple) -> tuple[int, bool]:
        number = self.table.put(h, content)
        self.rows += 1
        if number == len(self.counts):
            self.counts.append(count)
            self.best.append(best)
            return number, True
        self.counts[number] += count
        self.best[number] = max(self.best[number], best)
        return number, False

    def full(self, limit: int) -> bool:
        return self.table.bytes >= limit or self.rows >= FLUSH_ROWS


#: Nulls sort below every id.
def _best(doc_id: int | None, row_no: int) -> tuple:
    return (doc_id is not None, doc_id or 0, row_no)


def _id_of(best: tuple) -> int | None:
    return best[1] if best[0] else None


def _scan(text_at: str, id_at: str, limit: int):
    """First level: number the rows, hash and fold their contents flush by flush.

    Of equal contents in a flush the best row stands for the others: it has the hash and the count.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 40
        for batch in batches:
            row = batch.column(0)
            texts, ids = row.field(text_at), row.field(id_at).cast(pa.int64())
            start = 0
            while start < len(batch):
                fold, shas, of_row, at = Fold(), [], [], start
                while at < len(batch) and not fold.full(limit):
                    content = (texts[at].as_py() or "").encode().lower()
                    entry, new = fold.add(
                        xxhash.xxh64_intdigest(content), content, 1, _best(ids[at].as_py(), number + at - start))
                    if new:
                        shas.append(hashlib.sha256(content).digest())
                    of_row.append(entry)
                    at += 1
                rep = [fold.best[e][2] for e in of_row]
                numbers = range(number, number + at - start)
                own = [r == k for r, k in zip(rep, numbers, strict=True)]
                yield batch_of({
                    "row": row.slice(start, at - start),
                    "row_no": pa.array(numbers, pa.int64()),
                    "rep": pa.array(rep, pa.int64()),
                    "sha": pa.array([shas[e] for e in of_row], pa.binary()),
                    "h": pa.array([fold.table.hashes[e] - (1 << 63) if o else None for e, o in zip(of_row, own, strict=True)], pa.int64()),
                    "n": pa.array([fold.counts[e] if o else None for e, o in zip(of_row, own, strict=True)], pa.int64()),
                    "best_id": pa.array([_id_of(fold.best[e]) if o else None for e, o in zip(of_row, own, strict=True)], pa.int64()),
                })
                number, start = number + at - start, at

    return work


def _fold_tasks(text_at: str, limit: int, whole: bool):
    """Fold each bucket of a partition that is sorted by bucket.

    ``whole``: one table per bucket, which is known to fit.  Otherwise the table is flushed when
    full, and what comes out is a smaller level.  Gives, for each record, the record it joined, and
    the row of the record that stands for the others.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, bucket, members, rows, stands = Fold(), None, [], {}, {}

        def flush():
            kept = [rows[fold.best[e][2]] if fold.best[e][2] == rep else None for rep, e in members]
            at = {k: n for n, k in enumerate(k for k, row in enumerate(kept) if row is not None)}
            held = pa.concat_arrays([row for row in kept if row is not None])
            best = [fold.best[e] for _, e in members]
            return batch_of({
                "old": pa.array([rep for rep, _ in members], pa.int64()),
                "into": pa.array([b[2] for b in best], pa.int64()),
                "of_n": pa.array([fold.counts[e] for _, e in members], pa.int64()),
                "of_id": pa.array([_id_of(b) for b in best], pa.int64()),
                "h": pa.array([fold.table.hashes[e] - (1 << 63) for _, e in members], pa.int64()),
                "row": held.take(pa.array([at.get(k) for k in range(len(kept))], pa.int64())),
            })

        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            texts = c["row"].field(text_at)
            for k in range(len(batch)):
                b = c["bucket"][k].as_py()
                if members and (b != bucket or not whole and fold.full(limit)):
                    yield flush()
                    fold, members, rows, stands = Fold(), [], {}, {}
                bucket = b
                rep, content = c["rep"][k].as_py(), (texts[k].as_py() or "").encode().lower()
                h = c["h"][k].as_py() + (1 << 63)
                entry, _ = fold.add(h, content, c["n"][k].as_py(), _best(c["best_id"][k].as_py(), rep))
                if fold.best[entry][2] == rep:
                    # a copy, so that the batch it came in is not held
                    rows.pop(stands.get(entry), None)
                    rows[rep] = c["row"].take(pa.array([k]))
                    stands[entry] = rep
                members.append((rep, entry))
        if members:
            yield flush()

    return work


def _grace(docs: DataFrame, text: str, doc_id: str, bucket_bytes: int, carried: Sequence[str]):
    """The scanned rows, and what became of the record that stands for each.

    ``carried``: the columns that travel with a record; the text is always one of them.
    """
    rows = as_rows(docs)
    kind = rows.schema["row"].dataType.simpleString()
    members = staged(
        rows.mapInArrow(
            _scan(text, doc_id, bucket_bytes // 2),
            f"row {kind}, row_no long, rep long, sha binary, h long, n long, best_id long"), "grace-scan")
    record = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in carried])
    level = members.where("n IS NOT NULL").select("rep", "h", record.alias("row"), "n", "best_id")
    folded_as = f"old long, into long, of_n long, of_id long, h long, row {level.schema['row'].dataType.simpleString()}"
    weigh = F.sum(F.coalesce(F.octet_length(F.col(f"row.`{text}`")), F.lit(0)) + 64)
    total = level.agg(weigh).first()[0] or 0
    buckets = max(1, -(-2 * total // bucket_bytes))
    level = level.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("string"))
    done, moved, depth = [], [], 0
    while True:
        sizes = level.groupBy("bucket").agg(weigh.alias("bytes"), F.count("*").alias("records"))
        large = sizes.where((F.col("bytes") > bucket_bytes) & (F.col("records") > 1))
        if large.isEmpty():
            done.append(level)
            break
        depth += 1
        marked = level.join(large, "bucket", "left")
        done.append(marked.where("bytes IS NULL").drop("bytes", "records"))
        # parts by content as far as contents differ, salts so that each task folds two records or more
        parts = F.ceil(2 * F.col("bytes") / F.lit(bucket_bytes))
        salts = F.least(parts, F.ceil(F.col("records") / 2)).cast("long")
        fresh = F.xxhash64("h", F.lit(depth))
        split = marked.where("bytes IS NOT NULL").withColumn(
            "bucket", F.concat_ws("/", "bucket", F.pmod(fresh, parts.cast("long")).cast("string")))
        folded = staged(
            split.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(depth)), salts))
            .select("rep", "h", "row", "n", "best_id", F.concat_ws("#", "bucket", "salt").alias("bucket"))
            .repartition(F.col("bucket")).sortWithinPartitions("bucket")
            .mapInArrow(_fold_tasks(text, bucket_bytes, False), folded_as), "grace-level")
        level = folded.where("old = into").select(
            F.col("into").alias("rep"), "h", "row", F.col("of_n").alias("n"), F.col("of_id").alias("best_id")
        ).join(split.select("rep", "bucket"), "rep")
        moved.append(folded.where("old <> into").select("old", "into"))
    names = ["rep", "h", "row", "n", "best_id", "bucket"]
    fitting = done[0].select(*names)
    for part in done[1:]:
        fitting = fitting.unionByName(part.select(*names))
    final = fitting.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        _fold_tasks(text, bucket_bytes, True), folded_as)
    return members, moved, final


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each row with the fate of its group of equal texts.

    Returns ``row`` (the input row), ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.
    """
    members, moved, final = _grace(docs, text, doc_id, bucket_bytes, [text])
    final = staged(final.select("old", "into", "of_n", "of_id"), "grace-final")
    for step in moved:
        members = members.join(step, F.col("rep") == F.col("old"), "left").withColumn(
            "rep", F.coalesce("into", "rep")).drop("old", "into")
    return members.join(final, F.col("rep") == F.col("old")).select(
        "row", F.col("of_id").alias("keep_id"), F.col("of_n").alias("group_size"),
        (F.col("row_no") == F.col("into")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def unique(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows that :func:`deduplicate` keeps, as they leave the tables: ``row``."""
    _, _, final = _grace(docs, text, doc_id, bucket_bytes, docs.columns)
    return final.where("old = into").select("row")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the copy that stays of each."""
    docs = documents(spark, folder).select("doc_id", "text")
    return deduplicate(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {"op8_exact_dedup": """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)"""}
