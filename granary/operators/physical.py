"""Pixels to millimetres, and mass from volume and density."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import MM_TRAITS, Physical
from granary.functions.exprs import finite


def to_physical(df: DataFrame, px_per_mm: float | None, cfg: Physical = Physical()) -> DataFrame:
    """Adds the millimetre traits and units; without a scale they are null and units are px.

    The diameter of the circle of equal area comes from the area; the largest Feret diameter is null where it wasn't measured.
    """
    if not px_per_mm or px_per_mm <= 0:
        return df.withColumns({c: F.lit(None).cast("double") for c in MM_TRAITS} | {"units": F.lit("px")})
    s, density = float(px_per_mm), cfg.density
    length, width = F.col("length_mm"), F.col("width_mm")
    out = df.withColumns({"length_mm": F.col("length_px") / s, "width_mm": F.col("width_px") / s, "perimeter_mm": F.col("perimeter_px") / s, "area_mm2": F.col("area_px2") / (s * s)})
    feret = F.col("feret_max_px") if "feret_max_px" in df.columns else F.lit(None).cast("double")
    out = out.withColumns({"feret_max_mm": feret / s, "eq_diameter_mm": 2 * F.sqrt(F.col("area_mm2") / F.pi())})
    out = out.withColumn("thickness_mm", width * cfg.thickness_of_width)
    product = length * width * F.col("thickness_mm")
    out = out.withColumns({"gmd_mm": F.pow(product, F.lit(1 / 3)), "amd_mm": (length + width + F.col("thickness_mm")) / 3, "volume_mm3": F.pi() / 6 * product})
    return out.withColumns({
        "sphericity": F.try_divide(F.col("gmd_mm"), length), "surface_area_mm2": F.pi() * F.col("gmd_mm") * F.col("gmd_mm"),
        "mass_mg": F.col("volume_mm3") * F.lit(density).cast("double"), "units": F.lit("mm"),
    })


def thousand_seed_weight(df: DataFrame) -> DataFrame:
    """Mass of a thousand in grams is the mean mass in milligrams."""
    m = F.col("mass_mg")
    se = F.stddev_samp(m) / F.sqrt(F.count(m))
    return df.agg(F.count(m).alias("n"), F.avg(m).alias("tsw_g"), se.alias("se"), (1.96 * se).alias("ci95"), (100 * F.try_divide(F.stddev_samp(m), F.avg(m))).alias("cv_pct"))


def calibrated_density(df: DataFrame, mass_g: float, n_weighed: int) -> DataFrame:
    """Density in g/cm3 by which the mean volume weighs what was weighed; fails when no object has a volume."""
    if mass_g <= 0 or n_weighed <= 0:
        raise ValueError("a positive mass of a positive number is needed")
    volume = df.agg(F.avg(finite("volume_mm3")).alias("v"))
    checked = F.when(F.col("v").isNull(), F.raise_error(F.lit("no object has a volume: a scale is needed first")).cast("double")).otherwise(F.col("v"))
    return volume.select((F.lit(mass_g * 1000 / n_weighed) / checked).alias("density"))
