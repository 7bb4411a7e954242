"""Deterministic object tables made from the event and embedding tables; the same arithmetic in Spark and DuckDB."""

from pyspark.sql import DataFrame, SparkSession

BASE = {
    "image": "concat('tray_', cast(user_id as string))", "seed_id": "event_id", "cls": "event_type", "confidence": "0.05e0 + 0.9e0 * ((event_id * 17) % 100) / 100.0e0", "length_px": "40 + value / 10",
    "wr": "0.70e0 + (event_id % 29) / 100.0e0", "ar": "0.80e0 + (event_id % 41) / 100.0e0", "cx": "cast((event_id * 37) % 1000 as double)", "cy": "cast((event_id * 91) % 800 as double)", "img_w": "1000", "img_h": "800",
    "fragments": "case when event_id % 50 = 0 then 1 else 0 end", "segment_method": "case when event_id % 10 < 6 then 'otsu' when event_id % 10 < 8 then 'adaptive' when event_id % 10 < 9 then 'otsu_lab' else 'otsu_sat' end",
    "mean_L": "cast(20 + (event_id % 70) as double)", "spot_count": "event_id % 20", "spot_coverage": "(event_id % 13) / 100.0e0", "largest_spot": "(event_id % 23) / 100.0e0",
}
SIZED = {"feret_max_px": "length_px * 1.05e0", "width_px": "length_px * wr", "area_px2": "pi() / 4 * length_px * (length_px * wr) * ar"}
BOXED = {
    "perimeter_px": "pi() * (3 * (length_px + width_px) / 2 - sqrt((3 * length_px + width_px) * (length_px + 3 * width_px)) / 2)",
    "x1": "cast({t}(cx - length_px / 2) as int)", "y1": "cast({t}(cy - length_px / 2) as int)", "x2": "cast({t}(cx + length_px / 2) as int)", "y2": "cast({t}(cy + length_px / 2) as int)",
}


def _items(columns: dict[str, str], truncate: str = "") -> list[str]:
    return [f"{e.format(t=truncate)} as {n}" for n, e in columns.items()]


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event; a cast to int truncates."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*_items(BASE)).selectExpr("*", *_items(SIZED)).selectExpr("*", *_items(BOXED)).drop("wr", "ar")


SEEDS_SQL = f"(SELECT * EXCLUDE (wr, ar), {', '.join(_items(BOXED, 'trunc'))} FROM (SELECT *, {', '.join(_items(SIZED))} FROM (SELECT {', '.join(_items(BASE))} FROM events)))"
QC = {"focus": "40.0e0 + sum(event_id * 7) % 60", "clip_frac": "(count(*) % 17) / 1000.0e0", "illum_cv": "(sum(event_id) % 20) / 100.0e0"}


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each image with stand-ins for its measured quality."""
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.expr(BASE["image"]).alias("image")).agg(*[F.expr(e).cast("double").alias(n) for n, e in QC.items()])


PHOTOGRAPHS_SQL = f"(SELECT {BASE['image']} AS image, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in QC.items())} FROM events GROUP BY 1)"
CALIPER = "length_mm * 1.02e0 + ((seed_id * 53) % 21 - 10) / 200.0e0"


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and a closed outline of points (x, y), from pairs of each vector's components."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.selectExpr("vec_id", "transform(sequence(0, size(embedding) div 2 - 1), i -> struct(cast(embedding[2 * i] as double) as x, cast(embedding[2 * i + 1] as double) as y)) as contour")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs of 64 lines: image, y and the line's ``levels``, 64 numbers around 0, from the vectors in their order."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.selectExpr("vec_id div 64 as image", "cast(vec_id % 64 as int) as y", "cast(embedding as array<double>) as levels")


CELLS_SQL = "(SELECT vec_id // 64 AS image, vec_id % 64 AS y, i AS x, embedding[i + 1]::DOUBLE AS level FROM embeddings, range(64) AS t(i))"


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same photographs with ``levels`` of r, g, b from 0 to 255, whose channels are the vectors' thirds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    level = lambda i: f"cast(least(255, greatest(0, floor(128 + 400 * cast(embedding[({i}) % 64] as double)))) as int)"
    return vectors.selectExpr("vec_id div 64 as image", "cast(vec_id % 64 as int) as y", f"transform(sequence(0, 63), x -> struct({level('x')} as r, {level('x + 21')} as g, {level('x + 42')} as b)) as levels")


COLOURED_SQL = "(SELECT vec_id // 64 AS image, vec_id % 64 AS y, i AS x, " + ", ".join(f"least(255, greatest(0, floor(128 + 400 * embedding[(i + {k}) % 64 + 1]::DOUBLE))) AS {c}" for k, c in ((0, "r"), (21, "g"), (42, "b"))) + " FROM embeddings, range(64) AS t(i))"
