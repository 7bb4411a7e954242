"""Rows of objects that keep arriving in a folder: measured on arrival, counted by window and class."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """A stream over the folder's Parquet files; at most ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(df: DataFrame, time: str, size: str, late: str, traits: list[str], by: str = "cls") -> DataFrame:
    """Count and sums of each trait for each window and class. State ends where the watermark passes."""
    sums = [f(F.col(t) if p == "sum" else F.col(t) * F.col(t)).alias(f"{t}_{p}") for t in traits for p, f in (("sum", F.sum), ("squares", F.sum))]
    return df.withWatermark(time, late).groupBy(F.window(time, size).start.alias("start"), by).agg(F.count("*").alias("n"), *sums)


def appended(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Adds all rows that have arrived to the folder, each once, and ends."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def updated(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes what changed in each batch to a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Of the rows written by :func:`updated`, the last of each key."""
    rows = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(folder)
    rest = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest])
