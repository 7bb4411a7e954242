import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from granary.llm import token_files as token_files_module
from granary.llm.token_files import CHECKPOINT_STEPS, LANES, Coded, Table, decode_block, encode_block, joined_crc, read_files, scaled, token_files, write_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def table_of(ids):
    values, counts = np.unique(ids, return_counts=True)
    return Table.of(*scaled(dict(zip(values.tolist(), counts.tolist()))))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=2_000))
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (decode_block(encode_block(ids, table_of(ids)), table_of(ids)) == ids).all()


def test_long_skewed_block_from_every_checkpoint():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.2, 5 * LANES * CHECKPOINT_STEPS // 2 + 17) % 49_000).astype(np.uint32)
    table = table_of(ids)
    coded = encode_block(ids, table)
    for k in range(3):
        at = k * LANES * CHECKPOINT_STEPS
        assert (decode_block(coded, table, k) == ids[at:]).all()
        assert (decode_block(coded, table, k, 1) == ids[at : at + LANES * CHECKPOINT_STEPS]).all()
    n = np.bincount(ids)[np.unique(ids)]
    bits = -(n * np.log2(n / n.sum())).sum()
    assert len(coded.words) * 8 < 1.02 * bits + 64 * LANES
    assert len(decode_block(Coded(0, b"", b""), table)) == 0


def test_scaled_frequencies():
    ids, freq = scaled({5: 10**12, 7: 1, 9: 1})
    assert freq.sum() == 1 << 20 and freq.min() >= 1 and ids.tolist() == [5, 7, 9]


TEXTS = ["Hello  world's\tend\x0b.", "", None, "naïve Ünïcode  É x\u0301y 10 234 'll don't", "<|endoftext|> a", "A<|startoftext|>B c", "<|ENDOFTEXT|> <|endofteXt|>x", "don't<|endoftext|>'s  É<|endoftext|><|endoftext|>", "x" * 50_000, "tab\x1cfs\x85nel nbsp\xa0x 東京タワー 🎉", "same", "same"] * 3


def test_files_hold_every_document(spark, tmp_path):
    rows = [(i * 7 % 41, t, "a", 1.5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start double").repartition(5)
    write_files(spark, docs, str(tmp_path / "f"), PATH)
    found = {r["doc_id"]: r for r in read_files(spark, str(tmp_path / "f"), with_ids=True).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        r = found[d]
        assert (r["ids"], r["start"], r["n_tokens"], r["ids_crc32"]) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a"), (1, None), (None, None)], "doc_id long, text string")
    rows = sorted(token_files(spark, docs, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 2]
    assert [r["n_tokens"] for r in rows] == [1, 2, 1, 2, 2] and [r["start"] for r in rows] == [0, 1, 3, 4, 6]
    assert token_files(spark, docs.limit(0), PATH).collect() == []


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    write_files(spark, docs, str(tmp_path / "f"), PATH)
    blocks = spark.read.parquet(str(tmp_path / "f/blocks")).withColumn("crc32", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(5).cast("long"))
    blocks.write.parquet(str(tmp_path / "g/blocks"))
    spark.read.parquet(str(tmp_path / "f/table")).write.parquet(str(tmp_path / "g/table"))
    with pytest.raises(Exception, match="damaged"):
        read_files(spark, str(tmp_path / "g")).collect()


def test_long_blocks_are_decoded_from_their_checkpoints(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    long_text = " ".join(rng.choice(["one", "two", "three", "fourteen", "antidisestablishment"], 150_000).tolist())
    rows = [(1, "a b"), (2, long_text), (3, None), (4, "c"), (None, long_text[:900_000]), (5, "d " * 140_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    write_files(spark, docs, str(tmp_path / "f"), PATH)
    whole = sorted(map(tuple, read_files(spark, str(tmp_path / "f"), with_ids=True).collect()), key=lambda r: r[1])
    monkeypatch.setattr(token_files_module, "LONG_IDS", 100)
    parts = sorted(map(tuple, read_files(spark, str(tmp_path / "f"), with_ids=True).collect()), key=lambda r: r[1])
    assert parts == whole and [r[0] for r in whole] == [None, 1, 2, 3, 4, 5] and max(r[2] for r in whole) > LANES * CHECKPOINT_STEPS
    damaged = spark.read.parquet(str(tmp_path / "f/blocks")).withColumn("crc32", F.col("crc32") + 1)
    damaged.write.parquet(str(tmp_path / "g/blocks"))
    spark.read.parquet(str(tmp_path / "f/table")).write.parquet(str(tmp_path / "g/table"))
    with pytest.raises(Exception, match="damaged"):
        read_files(spark, str(tmp_path / "g")).collect()


@given(st.binary(), st.binary())
def test_checksums_of_parts_are_put_together(a, b):
    assert joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
