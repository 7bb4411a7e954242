"""Photograph quality rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import QC

#: Phrases of the flags, in their order.
PHRASES = {"flag_focus": "out of focus", "flag_clip": "clipped exposure", "flag_illum": "uneven light", "flag_size": "seeds too small", "flag_sparse": "too few seeds"}


def qc_rules(photos: DataFrame, seeds: DataFrame, cfg: QC = QC()) -> DataFrame:
    """Flags, verdict, reason and size grade of each photograph; a missing measure raises no flag but sparseness."""
    widths = seeds.groupBy("image").agg(F.percentile("width_px", F.lit(0.5)).alias("seed_width_px"), F.count("*").alias("n_seeds"))
    out = photos.join(widths, "image", "left").withColumn("n_seeds", F.coalesce("n_seeds", F.lit(0)))
    tests = {
        "flag_focus": F.col("focus") < cfg.focus_min, "flag_clip": F.col("clip_frac") > cfg.clip_max, "flag_illum": F.col("illum_cv") > cfg.illum_cv_max,
        "flag_size": F.col("seed_width_px") < cfg.seed_min_px, "flag_sparse": F.col("n_seeds") < cfg.min_seeds,
    }
    out = out.withColumns({k: F.coalesce(t, F.lit(False)) for k, t in tests.items()})
    reason = F.concat_ws("; ", *[F.when(F.col(k), p) for k, p in PHRASES.items()])
    grade = F.when(F.col("seed_width_px") >= cfg.seed_good_px, "good").when(F.col("seed_width_px") >= cfg.seed_min_px, "workable").otherwise("too small")
    return out.withColumns({"qc_pass": reason == "", "qc_reason": F.when(reason == "", "passes every check").otherwise(reason), "size_grade": grade})
