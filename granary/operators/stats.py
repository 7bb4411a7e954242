"""Lot, image and class statistics: each a single aggregation over all traits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.config import PATTERNS
from granary.functions.exprs import cv, finite, skew
from granary.operators.quantiles import summarised

QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def long_traits(df: DataFrame, traits: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[finite(t).alias(t) for t in traits]).unpivot(list(keep), traits, "trait", "x")


def lot_summary(df: DataFrame, traits: list[str]) -> DataFrame:
    """A row for each trait with finite values."""
    x = F.col("x")
    figures = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), cv(x).alias("cv_pct"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), F.min(x).alias("min"), F.max(x).alias("max"), skew(x).alias("skew")]
    out = summarised(long_traits(df, traits).where(x.isNotNull()), ["trait"], "x", list(QUANTILES.values()), figures)
    return out.select("trait", "n", "mean", "sd", "cv_pct", "se", "min", *[F.col("quantiles")[i].alias(k) for i, k in enumerate(QUANTILES)], "max", "skew")


def per_group(df: DataFrame, traits: list[str], by: str | None = "image") -> DataFrame:
    """n_seeds, and count, mean and sd of each trait, for each group (None: the lot)."""
    parts = [F.count(F.lit(1)).alias("n_seeds")]
    for t in traits:
        parts += [F.count(finite(t)).alias(f"{t}_count"), F.avg(finite(t)).alias(f"{t}_mean"), F.stddev_samp(finite(t)).alias(f"{t}_std")]
    return (df.groupBy(by) if by else df.groupBy()).agg(*parts)


def gwas_wide(df: DataFrame, traits: list[str], lot_id: str, by_image: bool) -> DataFrame:
    out = per_group(df, traits, "image" if by_image else None)
    key = F.col("image") if by_image else F.lit(lot_id)
    return out.select(key.alias("id"), "n_seeds", *[F.col(f"{t}_{a}").alias(b) for t in traits for a, b in (("mean", t), ("std", f"{t}_sd"))])


def shares(df: DataFrame, column: str) -> DataFrame:
    """Value, count and share of all, in percent; a window over the few counted values."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("value", "n", (100 * F.col("n") / F.col("total")).alias("share_pct"))


def modes(df: DataFrame, by: str, column: str) -> DataFrame:
    """The commonest value of each group, ties by the smaller value."""
    n = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
    return n.groupBy(by).agg(best.alias("m")).select(by, F.col("m.v").alias(f"modal_{column}"))


def composition(df: DataFrame) -> DataFrame:
    """Number and share of each class and its commonest pattern, and its place: commonest first, ties by name."""
    from pyspark.sql import Window

    out = _composition(df)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.col("cls").asc_nulls_last())))  # a row a class


def _composition(df: DataFrame) -> DataFrame:
    return shares(df, "cls").withColumnRenamed("value", "cls").join(modes(df, "cls", "pattern_class"), "cls", "left")


def crosstab_long(df: DataFrame) -> DataFrame:
    return df.groupBy("cls", "pattern_class").agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame) -> DataFrame:
    return df.groupBy("cls").pivot("pattern_class", list(PATTERNS)).agg(F.count(F.lit(1))).fillna(0)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal bins from least to greatest, the last one closed; empty ones too. No row below three values."""
    x = df.select(finite(column).alias("x")).where(F.col("x").isNotNull())
    ends = x.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n >= 3")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1))).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    out = summarised(df.select("cls", finite(column).alias("x")), ["cls"], "x", [0.25, 0.5, 0.75], [F.min("x").alias("min"), F.max("x").alias("max")])
    return out.select("cls", "min", *[F.col("quantiles")[i].alias(k) for i, k in enumerate(("p25", "p50", "p75"))], "max")


def class_counts(df: DataFrame, classes: list[str]) -> DataFrame:
    """Known classes, 0 where none was seen, and all others."""
    known = df.sparkSession.createDataFrame([(c,) for c in classes], "cls string")
    return known.join(df.groupBy("cls").agg(F.count("*").alias("n")), "cls", "full").select("cls", F.coalesce("n", F.lit(0)).alias("n"))


def unknown_classes(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.select("cls").where(~F.col("cls").isin(classes)).distinct()


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_in_image(df: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("image").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ordinals(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Each row's place from 0 in its photograph."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("image").orderBy(*order)) - 1)


def available(df: DataFrame, traits: list[str]) -> DataFrame:
    """trait, n, present for every trait: is there a finite value? One aggregation for all."""
    counts = df.agg(*[F.count(finite(t)).alias(t) if t in df.columns else F.lit(0).cast("long").alias(t) for t in traits])
    return counts.unpivot([], traits, "trait", "n").withColumn("present", F.col("n") > 0)


def quality_totals(qc: DataFrame) -> DataFrame:
    focus, light = (summarised(qc, [], c, [0.5], more) for c, more in (("focus", [F.count(F.lit(1)).alias("photographs"), F.count_if("qc_pass").alias("passed")]), ("illum_cv", [])))
    out = focus.withColumnRenamed("quantiles", "f").crossJoin(light)  # a row each
    return out.select("photographs", "passed", F.col("f")[0].alias("median_focus"), F.col("quantiles")[0].alias("median_illum_cv"))


def check_totals(checks: DataFrame) -> DataFrame:
    names = ("detected", "duplicate_pairs", "merged_suspects", "edge_truncated", "weak_detections")
    return checks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def axis_limit(df: DataFrame, column: str) -> DataFrame:
    """A tenth above the 99th percentile."""
    return summarised(df.select(finite(column).alias("x")), [], "x", [0.99]).select((1.1 * F.col("quantiles")[0]).alias("axis_limit"))


def off_diagonal(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Share of the objects whose pattern isn't the one expected of their class; other classes don't count."""
    pattern = F.create_map(*[F.lit(v) for pair in expected.items() for v in pair])[F.col("cls")]
    known = df.select(F.col("pattern_class"), pattern.alias("expected")).where("expected is not null and pattern_class is not null")
    return known.agg(F.count("*").alias("n"), F.avg((F.col("pattern_class") != F.col("expected")).cast("int")).alias("off_diagonal"))


def template(df: DataFrame, traits: tuple[str, ...] = ("length_mm", "width_mm"), n: int = 20, seed: int = 0) -> DataFrame:
    """A blank sheet for ``n`` objects drawn by hash, so a rerun draws the same, in the order of image and id."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "image", F.col("seed_id").cast("string")).cast("binary"))
    drawn = df.select("image", "seed_id").orderBy(key, "image", "seed_id").limit(n)
    return drawn.orderBy("image", "seed_id").select("image", "seed_id", *[F.lit(None).cast("double").alias(t) for t in traits])
