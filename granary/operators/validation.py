"""Agreement with reference measurements."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.exprs import finite


def paired(seeds: DataFrame, reference: DataFrame, trait: str, how: str = "seed_id") -> DataFrame:
    """measured and reference of each pair, joined by id or by rank of size in the image."""
    m = seeds.select("image", "seed_id", finite(trait).alias("measured"))
    r = reference.select("image", "seed_id", finite(trait).alias("reference"))
    if how == "rank":
        rank = lambda x: F.row_number().over(Window.partitionBy("image").orderBy(F.col(x).asc_nulls_last(), "seed_id")) - 1
        m, r = m.withColumn("rank", rank("measured")).drop("seed_id"), r.withColumn("rank", rank("reference")).drop("seed_id")
    out = m.join(r, ["image", "rank" if how == "rank" else "seed_id"])
    return out.where("measured is not null and reference is not null")


def bland_altman(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"mean_of_pair": (F.col("measured") + F.col("reference")) / 2, "difference": F.col("measured") - F.col("reference")})


def agreement(pairs: DataFrame, z: float = 1.96, by: Sequence[str] = ()) -> DataFrame:
    """Regression of measured on reference, concordance, errors and limits of agreement; no row below three pairs.

    Moments are those of samples. Without spread in one of the two, r2, the correlation and, of the reference, the line
    are null.
    """
    m, r, d = F.col("measured"), F.col("reference"), F.col("measured") - F.col("reference")
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(m).alias("measured_mean"), F.avg(r).alias("reference_mean"), F.var_samp(m).alias("mm"), F.var_samp(r).alias("rr"), F.covar_samp("measured", "reference").alias("mr"),
        F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd_of_difference"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.min(m).alias("m0"), F.max(m).alias("m1"), F.min(r).alias("r0"), F.max(r).alias("r1"),
    ).where("n >= 3")
    # of equal values, which rounding might give a variance, there is no correlation
    mm, rr, mr, bias, sd = (F.when(F.col("m0") < F.col("m1"), F.col("mm")).otherwise(0.0), F.when(F.col("r0") < F.col("r1"), F.col("rr")).otherwise(0.0), F.col("mr"), F.col("bias"), F.col("sd_of_difference"))
    gap = F.col("measured_mean") - F.col("reference_mean")
    slope = F.try_divide(mr, rr)
    return out.select(
        *by, "n", F.try_divide(mr * mr, mm * rr).alias("r2"), F.try_divide(mr, F.sqrt(mm * rr)).alias("pearson_r"), F.try_divide(2 * mr, mm + rr + gap * gap).alias("ccc"), "rmse", "mae", "bias",
        (100 * F.try_divide(bias, F.col("reference_mean"))).alias("bias_pct"), "sd_of_difference", (bias - z * sd).alias("loa_low"), (bias + z * sd).alias("loa_high"), slope.alias("slope"),
        (F.col("measured_mean") - slope * F.col("reference_mean")).alias("intercept"), "reference_mean", "measured_mean",
    )


def verdict(stats: DataFrame) -> DataFrame:
    off = F.abs(F.col("bias_pct"))
    text = (
        F.when(F.col("r2").isNull(), "not enough spread to judge")
        .when(off > 5, F.concat(F.lit("reads "), F.format_string("%.1f", off), F.when(F.col("bias_pct") > 0, "% over").otherwise("% under")))
        .when((F.col("ccc") >= 0.95) & (F.col("r2") >= 0.95), "agrees")
        .when((F.col("r2") >= 0.90) & (F.col("ccc") < 0.90), "follows but is shifted")
        .when(F.col("r2") >= 0.80, "follows loosely")
        .otherwise("does not agree")
    )
    return stats.withColumn("verdict", text)


def validated(seeds: DataFrame, reference: DataFrame, traits: tuple[str, ...], z: float = 1.96) -> DataFrame:
    """trait, agreement and verdict for every trait that both tables hold; the join is made once for all traits."""
    have = [t for t in traits if t in seeds.columns and t in reference.columns]
    long = lambda df, name: df.select("image", "seed_id", *[finite(t).alias(t) for t in have]).unpivot(["image", "seed_id"], have, "trait", name)
    pairs = long(seeds, "measured").join(long(reference, "reference"), ["image", "seed_id", "trait"]).where("measured is not null and reference is not null")
    return verdict(agreement(pairs, z, ["trait"]))
