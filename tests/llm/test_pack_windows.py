import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notespark.llm import pack_windows as pw
from tests_llm_data import ODD_TEXTS

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rebuilt(rows):
    """Ids of each document from its pieces."""
    by = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        at = by.setdefault(r["row"]["doc_id"], [])
        assert r["start"] == len(at)
        at += np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(r["ids"]) // 4
    return by


def fills(rows, window):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    out = []
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        out.append(at)
    return out


def test_every_id_once_and_little_padding(docs):
    table = docs([f"word{k} " * (1 + k * 7 % 400) for k in range(600)]).repartition(24)
    rows = pw.pack(table, BYTES, open_windows=8, window=512).collect()
    library = Tokenizer.from_file(BYTES)
    ids = rebuilt(rows)
    for r in table.collect():
        assert ids[r["doc_id"]] == library.encode(r["text"]).ids + [1]
    full = fills(rows, 512)
    assert sum(full) / (512 * len(full)) > 0.93
    assert all(r["doc_tokens"] == len(ids[r["row"]["doc_id"]]) for r in rows)


def test_odd_texts_and_an_empty_table(docs):
    table = docs(ODD_TEXTS).withColumn("offset", F.lit("clash"))
    ids = rebuilt(pw.pack(table, BYTES).collect())
    library = Tokenizer.from_file(BYTES)
    for r in table.collect():
        assert ids[r["doc_id"]] == library.encode(r["text"] or "").ids + [1]
    assert pw.pack(docs([]), BYTES).count() == 0


def test_best_fit_and_the_fullest_leaves():
    open_windows = pw.OpenWindows(10, 2)
    for size in (6, 3, 8):
        open_windows.place(size, size)
    assert open_windows.done == []  # 6 and 3 share a window, 8 has its own
    open_windows.place(7, 7)
    assert open_windows.done == [[(6, 6), (3, 3)]]
    open_windows.place(2, 2)
    assert open_windows.done[1] == [(8, 8), (2, 2)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = pw.op3_pack_windows(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    library = Tokenizer.from_file(BYTES)
    full = fills(rows, 2048)
    assert sum(full) / (2048 * len(full)) > 0.97
    import zlib
    for r in rows:
        ids = library.encode(texts[r["doc_id"]]).ids + [1]
        piece = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert (len(ids), zlib.crc32(piece)) == (r["doc_tokens"], r["ids_crc32"])
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t).ids) + 1 for t in texts.values())
