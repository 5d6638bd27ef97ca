import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notespark.llm import token_files as tf
from notespark.llm.tokens import Encoder
from tests_llm_data import ODD_TEXTS

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize(("path", "separated"), [(WORDS, True), (BYTES, False)])
def test_pieces_give_the_ids_of_the_whole_text(path, separated):
    rnd = random.Random(1)
    texts = [t or "" for t in ODD_TEXTS] + [" a  b ", "c \n\n d", "x   y", "a\x01b \x01", "'s it's"]
    texts += ["<|endoftext|> b", "x <|endoftext|> b", "in<|endoftext|>side <|endoftext|>", "<|endoftext|>", "é<|endoftext|>\n<|endoftext|>  y",
              "<|endoftext|><|endoftext|> 's", "<|ENDOFTEXT|> <|startoftext|>a <|endoftext| >", "a <|endoftext|>'s", " <|endoftext|> <|endoftext|>1"]
    texts += ["".join(rnd.choice(" \n\tab1'.,é sS \x1c") for _ in range(rnd.randrange(30))) for _ in range(3000)]
    library = Tokenizer.from_file(path)
    ids, counts = Encoder(path, separated).encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_files_hold_what_was_written(spark, docs, tmp_path):
    table = docs([(7, "seven"), (None, "no key"), (7, "again"), *[(k, t) for k, t in enumerate(ODD_TEXTS, 10)]])
    table = table.unionByName(table.limit(1)).withColumn("key", F.lit("clash"))
    manifest = tf.write_ids(table, str(tmp_path / "ids"), WORDS, True, 1, range_bytes=60_000)
    assert manifest.count() > 1
    rows = sorted(tf.read_ids(manifest).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(WORDS)
    want = sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, tuple(library.encode(r["text"] or "").ids + [1]))
        for r in table.collect())
    got = [(r["key"] is not None, r["key"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sorted(got) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert [x.tolist() for x in tf.lookup(manifest, 10)] == [library.encode(ODD_TEXTS[0]).ids + [1]]
    assert len(tf.lookup(manifest, 7)) == len([w for w in want if w[1] == 7])
    assert len(tf.lookup(manifest, None)) == 1
    assert tf.lookup(manifest, 999) == []


def test_empty_table(docs, tmp_path):
    manifest = tf.write_ids(docs([]), str(tmp_path / "none"), WORDS, True, 1)
    assert manifest.count() == 0
    assert tf.read_ids(manifest).count() == 0


def test_the_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 20_000))
    places = tf.PerfectHash.build(keys).places(keys)
    assert sorted(places) == list(range(len(keys)))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORDS)
    at, want = 0, []
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "").ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tf.op2_token_files(spark, folder).collect()) == want
