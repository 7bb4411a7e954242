"""Noise of the measurement itself: a photograph measured again after flips, turns and scaling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.exprs import finite

TRANSFORMS = ("original", "flip_h", "rot90", "scale_80")


def factor(kind: str) -> float:
    """The linear scale of a transform; an unknown one raises."""
    if kind in ("original", "flip_h", "flip_v", "rot90", "rot180"):
        return 1.0
    head, _, percent = kind.partition("_")
    if head != "scale" or not percent.isdigit() or int(percent) == 0:
        raise ValueError(f"no such transform: {kind}")
    return int(percent) / 100


def power(trait: str) -> int:
    """By how many factors of length a trait grows: its unit tells."""
    return 2 if trait.endswith(("_px2", "_mm2")) else 1 if trait.endswith(("_px", "_mm")) else 0


def _placed(kind: str) -> dict[str, Column]:
    x1, y1, x2, y2, w, h = (F.col(c) for c in ("x1", "y1", "x2", "y2", "img_w", "img_h"))
    if kind == "flip_h":
        box = (w - x2, y1, w - x1, y2, w, h)
    elif kind == "flip_v":
        box = (x1, h - y2, x2, h - y1, w, h)
    elif kind == "rot90":  # clockwise
        box = (h - y2, x1, h - y1, x2, h, w)
    elif kind == "rot180":
        box = (w - x2, h - y2, w - x1, h - y1, w, h)
    elif factor(kind) != 1:
        p = F.lit(factor(kind))
        box = (x1 * p, y1 * p, x2 * p, y2 * p, F.greatest(w * p, F.lit(1.0)), F.greatest(h * p, F.lit(1.0)))
    else:
        box = (x1, y1, x2, y2, w, h)
    return dict(zip(("x1", "y1", "x2", "y2", "img_w", "img_h"), (c.cast("int") for c in box)))


def replicates(df: DataFrame, kinds: tuple[str, ...] = TRANSFORMS, image: str | None = None) -> DataFrame:
    """image, seed_id, replicate, factor, and the box and frame size after each transform, in one narrow pass; of the one
    photograph, if it is named."""
    df = df if image is None else df.where(F.col("image") == image)
    each = [F.struct(F.lit(k).alias("replicate"), F.lit(factor(k)).alias("factor"), *[c.alias(n) for n, c in _placed(k).items()]) for k in kinds]
    return df.select("image", "seed_id", F.inline(F.array(*each)))


def replicate_means(df: DataFrame, traits: list[str]) -> DataFrame:
    """n_seeds and the mean of each trait, scaled back, for each photograph and replicate."""
    back = lambda t: finite(t) / F.pow(F.col("factor"), F.lit(power(t))) if power(t) else finite(t)
    return df.groupBy("image", "replicate").agg(F.count("*").alias("n_seeds"), *[F.avg(back(t)).alias(t) for t in traits])


def noise(means: DataFrame, traits: list[str]) -> DataFrame:
    """Spread of the replicates' means for each photograph and trait; none below two means or around zero."""
    x = F.col("x")
    long = means.unpivot(["image", "replicate"], traits, "trait", "x").where("x is not null")
    out = long.groupBy("image", "trait").agg(
        F.count(x).alias("n"), F.max(F.when(F.col("replicate") == "original", x)).alias("original"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")
    ).where("n >= 2 and mean <> 0")
    cv = 100 * F.col("sd") / F.abs("mean")
    shift = F.greatest(F.col("hi") - F.col("original"), F.col("original") - F.col("lo"))
    verdict = F.when(F.col("cv_pct") < 1, "stable").when(F.col("cv_pct") < 3, "acceptable").otherwise("noisy")
    out = out.withColumns({"cv_pct": cv, "max_shift_pct": 100 * F.try_divide(shift, F.abs("original"))}).withColumn("verdict", verdict)
    return out.select("image", "trait", "original", "mean", "sd", "cv_pct", "max_shift_pct", "verdict")


def noisiest(summary: DataFrame) -> DataFrame:
    """Each photograph's trait of greatest variation, ties to the first by name."""
    best = F.min(F.struct((-F.col("cv_pct")).alias("c"), F.col("trait").alias("t")))
    return summary.groupBy("image").agg(best.alias("b")).select("image", F.col("b.t").alias("trait"), (-F.col("b.c")).alias("cv_pct"))


def count_noise(means: DataFrame) -> DataFrame:
    return means.groupBy("image").agg((100 * F.try_divide(F.stddev_samp("n_seeds"), F.avg("n_seeds"))).alias("count_cv_pct"))
