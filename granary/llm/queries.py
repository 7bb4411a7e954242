"""The numbered queries: each operator with production parameters over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import ann, hard_negatives, html_text, licenses, minhash, mixing, packing, quality, resampling, sampling, sharding, token_files, url_filter
from granary.llm.url_filter import Rule

#: The rules of op1.
URL_RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(spark, table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3.0)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark, table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: source, language and the id's hundred stand for directories."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scanned(spark, docs, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(spark, table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(spark, vectors, vectors.where(F.col("vec_id") % 100 == 0), top=10)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1, buckets=10_000, seed="2024")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, negatives=3, low=50, high=95)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_token_files, op4_html_text, op5_licenses, op6_quality, op7_sharding, op8_minhash, op9_sampling, op10_nearest, op11_resampling, op12_packing, op13_hard_negatives)}
