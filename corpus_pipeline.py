"""A corpus pipeline: quality rules, near-duplicates, mixing to weights, sampled segmentation."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import minhash, mixing, quality, sampling
from granary.llm.common import dropped, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail.

    Null, empty and blank texts don't pass, long ones are judged whole, repeated rows each for themselves; columns may
    be null and have any name.
    """
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by five-word shingles, similarity 0.8 or more.

    Ties can't be: ids order rows. Texts without words link with nothing, rows of one id stay or go together, rows
    without id stay.
    """
    return minhash.deduplicated(spark, docs, size=5, percent=80)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating, none is taken more than three times; a row for each epoch.

    A null source is one of its own, rows without id are ordered by their text, rows without words are in no epoch.
    """
    return mixing.mix_documents(spark, docs, weights=(5.0, 2.0, 1.0), cap=3.0)


def sentencepiece_sampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every row's whole text, with the proof that they decode to it.

    The epochs of a document are segmented each by itself. Null and empty texts have no piece.
    """
    return sampling.sampled(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), copies=True)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("mixing", mixing_to_weights), ("sentencepiece", sentencepiece_sampling)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            dropped(before)
        before = docs
    return docs


#: Sampling over a lattice and near-duplicate groups can't be stated in SQL.
ORACLE_SQL = None
