"""Self-checks: outlines, detections, duplicates, drift over the frame, matching of two photographs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.config import MATCHED_TRAITS, Detect, Reliability
from granary.functions.exprs import box, containment, edge_cut, finite, iou
from granary.operators.quantiles import summarised


def outline(df: DataFrame, cfg: Reliability = Reliability()) -> DataFrame:
    """Error of the measured area against the ellipse of its length and width; an area without any ellipse is flagged."""
    ellipse = F.pi() / 4 * F.col("length_px") * F.col("width_px")
    error = F.try_divide(F.col("area_px2"), ellipse) - 1
    return df.withColumns({"ellipse_area_px2": ellipse, "outline_error": error, "outline_flag": F.coalesce(F.abs(error) > cfg.outline_tol, (ellipse == 0) & (F.col("area_px2") > 0), F.lit(False))})


def outline_summary(df: DataFrame) -> DataFrame:
    figures = [F.count("e").alias("n"), F.count_if("outline_flag").alias("flagged"), (100 * F.avg(F.col("outline_flag").cast("int"))).alias("flagged_pct")]
    out = summarised(df.select(finite("outline_error").alias("e"), "outline_flag"), [], "e", [0.25, 0.5, 0.75], figures)
    p = F.col("quantiles")
    return out.select("n", (100 * p[1]).alias("median_error_pct"), (100 * (p[2] - p[0])).alias("iqr_error_pct"), "flagged", "flagged_pct")


def outline_by_method(df: DataFrame) -> DataFrame:
    return df.groupBy("segment_method").agg(F.bround(100 * F.avg(F.col("outline_flag").cast("int")), 1).alias("flagged_pct"))


def box_pairs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of an image's boxes that overlap, each once: image, a_ and b_ seed_id, x1, y1, x2, y2 and columns ``keep``.

    Boxes have size classes, powers of two. Each lies in the grid of its class, in at most four cells, and looks in
    the grids of its class and all larger ones: a box of any size, or an image with very many, makes no all-pairs join.
    A pair is kept in the cell of its overlap's corner alone.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    own = ("seed_id", "x1", "y1", "x2", "y2", *keep)
    boxes = df.where("x2 > x1 and y2 > y1").select("image", *own, F.ceil(F.log2(side)).cast("int").alias("class"))
    grids = boxes.select(F.col("class").alias("grid")).distinct()  # at most as many as a size has bits
    span = lambda c: F.explode(F.expr(f"sequence(cast(floor({c}1 / cell) as int), cast(floor({c}2 / cell) as int))")).alias(f"g{c}")

    def cells(x: DataFrame, name: str) -> DataFrame:
        """A row for each cell that the box lies in, its columns as <name>_<column>."""
        x = x.withColumn("cell", F.expr("shiftleft(1L, grid)"))
        x = x.select("*", span("x")).select("*", span("y"))
        return x.select("image", "grid", "gx", "gy", *[F.col(c).alias(f"{name}_{c}") for c in (*own, "class")])

    lying, looking = cells(boxes.withColumn("grid", F.col("class")), "b"), cells(boxes.join(F.broadcast(grids), F.col("grid") >= F.col("class")), "a")
    corner = lambda c, g: F.expr(f"floor(greatest(a_{c}, b_{c}) / shiftleft(1L, grid)) = {g}")
    met = looking.join(lying, ["image", "grid", "gx", "gy"]).where(((F.col("a_class") < F.col("grid")) | (F.col("a_seed_id") < F.col("b_seed_id"))) & corner("x1", "gx") & corner("y1", "gy"))
    overlap = (F.least("a_x2", "b_x2") > F.greatest("a_x1", "b_x1")) & (F.least("a_y2", "b_y2") > F.greatest("a_y1", "b_y1"))
    return met.where(overlap).select("image", *[f"{x}_{c}" for x in "ab" for c in own])


def duplicate_pairs(df: DataFrame, threshold: float) -> DataFrame:
    """Pairs of boxes of an image that overlap more than ``threshold``, with their overlap and containment."""
    both = box_pairs(df).withColumns({"iou": iou(box("a_"), box("b_")), "containment": containment(box("a_"), box("b_"))})
    return both.where(F.col("iou") > threshold).select("image", F.least("a_seed_id", "b_seed_id").alias("seed_a"), F.greatest("a_seed_id", "b_seed_id").alias("seed_b"), "iou", "containment")


def detection_checks(df: DataFrame, cfg: Reliability = Reliability(), margin: int = 2) -> DataFrame:
    """Counts of doubtful detections for each image, medians taken in the image by aggregation."""
    medians = df.groupBy("image").agg(F.percentile("area_px2", F.lit(0.5)).alias("ma"), F.percentile("confidence", F.lit(0.5)).alias("mc"))
    counts = df.join(medians, "image").groupBy("image").agg(
        F.count("*").alias("detected"), F.count_if((F.col("area_px2") > cfg.merged_area_factor * F.col("ma")) | (F.col("fragments") > 0)).alias("merged_suspects"),
        F.count_if(edge_cut(margin)).alias("edge_truncated"), F.count_if(F.col("confidence") < 0.5 * F.col("mc")).alias("weak_detections"),
    )
    doubles = duplicate_pairs(df, cfg.dup_iou).groupBy("image").agg(F.count("*").alias("duplicate_pairs"))
    out = counts.join(doubles, "image", "left").withColumn("duplicate_pairs", F.coalesce("duplicate_pairs", F.lit(0)))
    doubt = F.col("duplicate_pairs") + F.col("merged_suspects")
    return out.withColumn("count_confidence", F.when(doubt == 0, "counts look clean").otherwise(F.concat(doubt.cast("string"), F.lit(" of "), F.col("detected").cast("string"), F.lit(" detections need a look"))))


def position_drift(df: DataFrame, traits: list[str], cfg: Reliability = Reliability()) -> DataFrame:
    """Least squares of each trait on the place in the frame, in closed form from one aggregation; no row below twelve values."""
    x, y, t = F.col("cx") / F.col("img_w"), F.col("cy") / F.col("img_h"), F.col("t")
    rows = df.select(x.alias("fx"), y.alias("fy"), *[finite(c).alias(c) for c in traits]).unpivot(["fx", "fy"], traits, "trait", "t").where("t is not null and fx is not null and fy is not null")
    m = rows.groupBy("trait").agg(F.count("*").alias("n"), F.avg(t).alias("mean"), F.var_samp("fx").alias("xx"), F.var_samp("fy").alias("yy"), F.covar_samp("fx", "fy").alias("xy"), F.covar_samp("fx", "t").alias("xt"), F.covar_samp("fy", "t").alias("yt"), F.var_samp("t").alias("tt")).where("n >= 12")
    m = m.where("n >= 12").withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    bx = F.try_divide(F.col("xt") * F.col("yy") - F.col("yt") * F.col("xy"), F.col("det"))
    by = F.try_divide(F.col("yt") * F.col("xx") - F.col("xt") * F.col("xy"), F.col("det"))
    r2 = F.try_divide(bx * F.col("xt") + by * F.col("yt"), F.col("tt"))
    return m.select("trait", "n", (100 * F.try_divide(bx, F.col("mean"))).alias("slope_x_pct"), (100 * F.try_divide(by, F.col("mean"))).alias("slope_y_pct"), r2.alias("r2"), F.coalesce(r2 > cfg.drift_r2_flag, F.lit(False)).alias("flag"))


def drift_grid(df: DataFrame, trait: str, bins: int = 3) -> DataFrame:
    bins = max(2, bins)
    cell = lambda c, size: F.least(F.greatest((F.col(c) / F.col(size) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    whole = df.agg(F.avg(finite(trait)).alias("whole"))
    cells = df.groupBy(cell("cy", "img_h").alias("row"), cell("cx", "img_w").alias("col")).agg(F.avg(finite(trait)).alias("mean"), F.count(finite(trait)).alias("n"))
    return cells.crossJoin(F.broadcast(whole)).select("row", "col", "mean", "n", (100 * F.try_divide(F.col("mean"), F.col("whole"))).alias("pct_of_frame_mean"))


def matched(a: DataFrame, b: DataFrame, traits: Sequence[str] = MATCHED_TRAITS, cfg: Reliability = Reliability(), by: Sequence[str] = ()) -> DataFrame:
    """Mutual nearest neighbours at most match_max_dist apart, ties by the smaller id, with their traits and differences.

    ``by`` names columns that tell pairs of photographs apart, so many are matched at once. Both of an accepted pair
    have their nearest neighbour within that distance, so rows meet in grid cells: no cross join. A cell is as wide as four
    such distances, and a row of ``b`` goes to each cell within reach, 2.25 on average. Spark's estimate of a table's size
    doesn't see that these copies are made and would have the driver broadcast them; the hint has both sides shuffled.
    Traits that a side lacks are left out.
    """
    d, traits = cfg.match_max_dist, [t for t in traits if t in a.columns and t in b.columns]
    width, reach = 4 * d, d * (1 + 1e-6)  # reach: a bit more, so that rounding hides no cell
    place = lambda df, s: df.select(*by, F.col("image").alias(f"image_{s}"), F.col("seed_id").alias(f"seed_{s}"), (F.col("cx") / F.col("img_w")).alias(f"fx_{s}"), (F.col("cy") / F.col("img_h")).alias(f"fy_{s}"), *[finite(t).alias(f"{t}_{s}") for t in traits])
    left = place(a, "a").withColumns({"gx": F.floor(F.col("fx_a") / width), "gy": F.floor(F.col("fy_a") / width)})
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width)))
    right = place(b, "b").withColumn("gx", around("fx_b")).withColumn("gy", around("fy_b")).hint("merge")
    gap = F.sqrt((F.col("fx_a") - F.col("fx_b")) * (F.col("fx_a") - F.col("fx_b")) + (F.col("fy_a") - F.col("fy_b")) * (F.col("fy_a") - F.col("fy_b")))
    near = left.join(right, [*by, "gx", "gy"]).withColumn("distance", gap).where(F.col("distance") <= d)
    first = lambda own, other: F.row_number().over(Window.partitionBy(*by, own).orderBy("distance", other))
    both = near.withColumns({"ra": first("seed_a", "seed_b"), "rb": first("seed_b", "seed_a")}).where("ra = 1 and rb = 1")
    values = [c for t in traits for c in (F.col(f"{t}_a"), F.col(f"{t}_b"), (F.col(f"{t}_b") - F.col(f"{t}_a")).alias(f"{t}_diff"))]
    return both.select(*by, "image_a", "image_b", "seed_a", "seed_b", "distance", *values)


def matching_summary(pairs: DataFrame, trait: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Repeatability of a trait, or of each of several, over matched pairs, which are made once for all of them; no row
    without a difference or with a mean level of 0."""
    traits = [trait] if isinstance(trait, str) else trait
    rows = pairs.select(*by, F.inline(F.array(*[F.struct(F.lit(t).alias("trait"), *[F.col(f"{t}_{x}").alias(f"_{x}") for x in ("a", "b", "diff")]) for t in traits])))
    a, b, d = F.col("_a"), F.col("_b"), F.col("_diff")
    level, sd = (F.sum(a) + F.sum(b)) / (F.count(a) + F.count(b)), F.stddev_samp(d)
    out = rows.groupBy(*by, "trait").agg(
        F.count(d).alias("pairs"), F.avg(d).alias("bias"), sd.alias("sd_of_difference"), (100 * F.try_divide(sd, level)).alias("repeatability_cv_pct"),
        (F.avg(d) - 1.96 * sd).alias("loa_low"), (F.avg(d) + 1.96 * sd).alias("loa_high"), level.alias("_level"),
    )
    return out.where("pairs > 0 and _level <> 0").drop("_level")


def drift_reading(drift: DataFrame) -> DataFrame:
    return drift.withColumn("reading", F.when(F.col("flag"), "the place in the frame explains a part: look at light and lens").otherwise("no effect of the place"))


def strategy(width: int, height: int, cfg: Detect = Detect()) -> str:
    """How the detector looked at a frame of that size."""
    if cfg.tiled and max(width, height) > cfg.tile_size:
        step = max(1, int(cfg.tile_size * (1 - cfg.tile_overlap)))
        n = [len(range(0, max(1, x - cfg.tile_size + step), step)) for x in (width, height)]
        return f"{n[0] * n[1]} tiles of {cfg.tile_size} px"
    return f"whole frame at {cfg.imgsz} px"


def detection_report(raw: DataFrame, kept: DataFrame, looked: str, margin: int = 2) -> DataFrame:
    """How many boxes each photograph had, kept and lost to deduplication, how many of the kept touch the edge, how it was
    looked at, and the kept ones' mean confidence.

    raw: image; kept: image, box, frame size, confidence.
    """
    all_ = raw.groupBy("image").agg(F.count("*").alias("raw_detections"))
    left = kept.groupBy("image").agg(F.count("*").alias("kept"), F.count_if(edge_cut(margin)).alias("truncated"), F.avg("confidence").alias("mean_confidence"))
    out = all_.join(left, "image", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kept", "truncated")})
    return out.select("image", "raw_detections", "kept", (F.col("raw_detections") - F.col("kept")).alias("duplicates_removed"), "truncated", F.lit(looked).alias("strategy"), "mean_confidence")


def confidence_margin(df: DataFrame, threshold: float) -> DataFrame:
    """Least confidence, and whether it is well above the detector's threshold, so that none was cut off."""
    least = F.min(finite("confidence"))
    return df.agg(least.alias("least_confidence"), F.coalesce(least > 1.5 * threshold, F.lit(False)).alias("clear"))


def above(df: DataFrame, threshold: float, most: int = 600) -> DataFrame:
    """Each photograph's surest boxes at or above the threshold, ``most`` of them: the limit is the detector's."""
    w = Window.partitionBy("image").orderBy(F.col("confidence").desc(), "seed_id")
    return df.where(F.col("confidence") >= threshold).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
