import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from test_mixing import brute as brute_mix
from test_near_sets import brute as brute_near

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = cp.documents(spark, FOLDER)
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.count() > 0


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before = stages[0].join(labels, "doc_id").where("quality = 1")
    long_enough = before.where(F.size(F.split(F.trim("text"), r"\s+")) >= 20)
    lost = long_enough.join(stages[1], "doc_id", "left_anti")
    assert lost.count() == 0
    assert stages[1].join(labels, "doc_id").where("quality = 0").count() <= 2


def test_exact_and_near_duplicates_go(stages):
    rows = {r["doc_id"]: (r["text"] or "") for r in stages[1].collect()}
    last = {}
    for d in sorted(rows):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[d])
        last[hashlib.sha256(low.encode()).digest()] = d
    assert ids(stages[2]) == sorted(last.values())
    assert ids(stages[3]) == brute_near([(d, rows[d]) for d in sorted(last.values())])


def test_mixing_by_plain_python(stages):
    rows = [
        (r["doc_id"], f"domain{int(r['source'][3:]) % 4}", r["lang"], r["source"], len((r["text"] or "").encode().split()))
        for r in stages[3].collect()]
    assert ids(stages[4]) == sorted(d for d, _ in brute_mix(rows, cp.MIX))


def test_packing_holds_every_id(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in stages[4].collect()}
    seen = {}
    for r in stages[5].collect():
        token_ids = library.encode(texts[r["doc_id"]]).ids + [1]
        piece = np.array(token_ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(piece) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == len(token_ids)
    assert seen == {d: len(library.encode(t).ids) + 1 for d, t in texts.items()}


def test_an_empty_table(spark, docs, tmp_path):
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
