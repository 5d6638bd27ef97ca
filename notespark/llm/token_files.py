"""Token ids in binary files with a minimal perfect hash index.

Documents are ordered by id and cut into ranges; each range becomes one data file:

    payload   all ids of the range's documents, little-endian, 16 or 32 bits each

and one index file:

    header    8 little-endian unsigned 64-bit words: magic, documents, keys, levels, id bytes, seed,
              payload ids, 0
    levels    for each level: its number of bits, then the bits, in 64-bit words
    slots     for each key, at its hash's place: fingerprint (32 bits), first document (32 bits),
              documents with this key (32 bits)
    starts    documents + 1 offsets into the payload, counted in ids (64 bits)
    keys      for each document: its key (64 bits), and a byte that is 1 for a null key

The hash is minimal and perfect on the distinct keys of the file: a key takes the first level in
which no other remaining key falls on its bit, and its place is the number of bits set before.
A lookup hashes the key a few times, compares the stored fingerprint and reads one slice of the
payload; a key that is not there is refused with probability 1 - 2**-32.  Rows that repeat a key
lie side by side, and the slot counts them.

Files are named by attempt, and the manifest that a finished task returns names them, so the files
of a lost executor's attempt are never read.

Defined cases: a null text is the empty text and has the end id only; a null key sorts first and is
found as any other; repeated rows keep all their payloads; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notespark.llm import tokens
from notespark.llm.common import batch_of, documents, scratch, staged, whole_text

MAGIC = 0x4E4F_5445_4944_5331
SEED = 7
RANGE_BYTES = 24 << 20
NULL_KEY = -(1 << 63) + 12_345


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of integer keys (the finaliser of splitmix)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels of collision-free bits."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = []
        placed = 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(placed + np.concatenate(([0], np.cumsum(counts)))[:-1])
            placed += int(counts.sum())
        self.size = placed

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        levels, left = [], keys
        while len(left):
            words = max(1, -(-2 * len(left) // 64))
            at = (mixed(left, SEED + 1 + len(levels)) % np.uint64(64 * words)).astype(np.int64)
            hits = np.bincount(at, minlength=64 * words)
            alone = hits == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return PerfectHash(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; a key outside the set gets some place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for number, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = mixed(keys[left], SEED + 1 + number) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            hit = left[held]
            out[hit] = before[word[held]] + np.bitwise_count(below[held]).astype(np.int64)
            left = left[~held]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, SEED) >> np.uint64(32)).astype(np.uint32)


SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("count", "<u4")])


def index_bytes(keys: np.ndarray, nulls: np.ndarray, starts: np.ndarray, id_bytes: int) -> bytes:
    """The index file of documents in key order."""
    hashed = np.where(nulls, NULL_KEY, keys)
    new = np.concatenate(([True], hashed[1:] != hashed[:-1])) if len(hashed) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    distinct = hashed[first]
    perfect = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    place = perfect.places(distinct)
    slots["print"][place] = fingerprints(distinct)
    slots["first"][place] = first
    slots["count"][place] = np.diff(np.append(first, len(hashed)))
    parts = [struct.pack("<8Q", MAGIC, len(keys), len(distinct), len(perfect.levels), id_bytes, SEED, int(starts[-1]), 0)]
    for words in perfect.levels:
        parts += [struct.pack("<Q", 64 * len(words)), words.astype("<u8").tobytes()]
    parts += [slots.tobytes(), starts.astype("<i8").tobytes(), keys.astype("<i8").tobytes(), nulls.astype("u1").tobytes()]
    return b"".join(parts)


class Shard:
    """Keyed access to one data file through its index."""

    def __init__(self, index: bytes, payload) -> None:
        magic, self.documents, keys, levels, self.id_bytes, seed, self.ids, _ = struct.unpack_from("<8Q", index)
        if magic != MAGIC or seed != SEED:
            raise ValueError("not an index of token ids")
        at, read = 64, []
        for _ in range(levels):
            (bits,) = struct.unpack_from("<Q", index, at)
            read.append(np.frombuffer(index, "<u8", bits // 64, at + 8))
            at += 8 + bits // 8
        self.perfect = PerfectHash(read)
        self.slots = np.frombuffer(index, SLOT, keys, at)
        at += SLOT.itemsize * keys
        self.starts = np.frombuffer(index, "<i8", self.documents + 1, at)
        at += 8 * (self.documents + 1)
        self.keys = np.frombuffer(index, "<i8", self.documents, at)
        self.nulls = np.frombuffer(index, "u1", self.documents, at + 8 * self.documents)
        self.payload = payload  # an open file

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; the number is 0 where it is absent."""
        place = self.perfect.places(keys)
        known = place >= 0
        slot = self.slots[np.where(known, place, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        known &= slot["print"] == fingerprints(keys)
        return np.where(known, slot["first"], 0).astype(np.int64), np.where(known, slot["count"], 0).astype(np.int64)

    def ids_of(self, document: int) -> np.ndarray:
        start, end = int(self.starts[document]), int(self.starts[document + 1])
        self.payload.seek(start * self.id_bytes)
        raw = self.payload.read((end - start) * self.id_bytes)
        return np.frombuffer(raw, f"<u{self.id_bytes}")


def _uri(path: str) -> str:
    """A path as Spark names it as a URI of pyarrow's file systems."""
    if "://" in path and not path.startswith("file:"):
        return path
    return "file:///" + path.removeprefix("file:").lstrip("/")


def _store(path: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))


MANIFEST = "shard int, data string, index string, documents long, ids long, first_key long, last_key long"


def write_ids(docs: DataFrame, path: str, vocabulary: str, separated: bool, end_id: int,
              text: str = "text", doc_id: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encode the documents and write their files below ``path``; gives the manifest.

    ``shard`` numbers the files in ascending order of the keys.
    """
    from tokenizers import Tokenizer

    id_bytes = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("key"), whole_text(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    # equal keys may be split between files: their texts, then a spread, order them further
    ordered = rows.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.monotonically_increasing_id()) \
        .repartitionByRange(ranges, F.col("key").asc_nulls_first(), "_h", "_n") \
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "_h", "_n").select("key", "text")
    folder = _uri(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from notespark.llm.common import task_number

        name = f"ids-{task_number():06d}-{uuid.uuid4().hex}"
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        encoder = tokens.encoder(vocabulary, separated)
        keys, nulls, lengths = [], [], []
        data = None
        for batch in batches:
            if data is None and len(batch):
                data = store.open_output_stream(f"{at}/{name}.bin")
            for i, j in tokens.slices(batch.column(1)):
                part = batch.slice(i, j - i)
                ids, counts = encoder.encode(part.column(1))
                data.write(with_end(ids, counts, end_id).astype(f"<u{id_bytes}").tobytes())
                lengths.append(counts + 1)
                nulls.append(np.asarray(pc.is_null(part.column(0))))
                keys.append(np.asarray(pc.fill_null(part.column(0), 0)))
        if data is None:
            return
        data.close()
        starts = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int64)
        keys, nulls = np.concatenate(keys), np.concatenate(nulls)
        with store.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(index_bytes(keys, nulls, starts, id_bytes))
        edge = [None if nulls[k] else int(keys[k]) for k in (0, -1)]
        yield batch_of({
            "shard": pa.array([task_number()], pa.int32()),
            "data": pa.array([f"{folder}/{name}.bin"]), "index": pa.array([f"{folder}/{name}.idx"]),
            "documents": pa.array([len(keys)], pa.int64()), "ids": pa.array([int(starts[-1])], pa.int64()),
            "first_key": pa.array([edge[0]], pa.int64()), "last_key": pa.array([edge[1]], pa.int64()),
        })

    return staged(ordered.mapInArrow(work, MANIFEST), "ids-manifest")


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id after each text's."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)
    out[at] = ids
    return out


def _open(data: str, index: str):
    store, at = _store(index)
    with store.open_input_file(at) as source:
        raw = source.read()
    return Shard(raw, store.open_input_file(_store(data)[1]))


def read_ids(manifest: DataFrame) -> DataFrame:
    """All documents read back by key through the index: ``key``, ``start``, ``ids`` (32-bit, packed)."""
    # one row per file
    before = manifest.select("shard", F.sum("ids").over(
        W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    files = manifest.join(before, "shard").select("data", "index", F.coalesce("before", F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                shard = _open(file["data"], file["index"])
                hashed = np.where(shard.nulls == 1, NULL_KEY, shard.keys)
                distinct = hashed[np.concatenate(([True], hashed[1:] != hashed[:-1]))]
                first, count = shard.find(distinct)
                held: list = []
                size = 0
                for one, many in zip(first.tolist(), count.tolist(), strict=True):
                    for document in range(one, one + many):
                        ids = shard.ids_of(document).astype("<u4").tobytes()
                        held.append((None if shard.nulls[document] else int(shard.keys[document]),
                                     file["before"] + int(shard.starts[document]), ids))
                        size += len(ids)
                        if size >= 8 << 20:
                            yield _read_batch(held)
                            held, size = [], 0
                if held:
                    yield _read_batch(held)

    spread = max(1, manifest.count())
    return files.repartition(spread, "data").mapInArrow(work, "key long, start long, ids binary")


def _read_batch(held: list) -> pa.RecordBatch:
    keys, starts, ids = zip(*held, strict=True)
    return batch_of({"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "ids": pa.array(ids, pa.binary())})


def lookup(manifest: DataFrame, key: int | None) -> list[np.ndarray]:
    """The ids of the documents with one key; reads the index and a slice of each file that may hold it."""
    inside = F.lit(True) if key is None else (
        (F.col("last_key") >= key) & (F.coalesce("first_key", F.lit(key)) <= key))
    found = []
    for file in manifest.where(inside).orderBy("shard").select("data", "index").toLocalIterator():
        shard = _open(file["data"], file["index"])
        first, count = shard.find(np.array([NULL_KEY if key is None else key], np.int64))
        found += [shard.ids_of(d) for d in range(int(first[0]), int(first[0] + count[0]))]
    return found


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' ids written to files and read back through the index."""
    import public_tokenizers

    manifest = write_ids(
        documents(spark, folder).select("doc_id", "text"), scratch(spark, "token-ids"),
        public_tokenizers.path("word_bpe_49k.json"), True, 1)
    return read_ids(manifest).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_files": op2_token_files}
ORACLE: dict = {}
