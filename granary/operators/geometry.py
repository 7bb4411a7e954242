"""Boxes and outlines: tiles, regions, greedy deduplication, area, perimeter, Fourier descriptors, principal axes."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import Detect, Segment, Shape
from granary.functions.exprs import box, containment, iou, let
from granary.functions.storage import dropped, saved
from granary.operators.reliability import above, box_pairs


def tiles(frames: DataFrame, size: int = 1024, overlap: float = 0.2, width: str = "img_w", height: str = "img_h") -> DataFrame:
    """Rows of ``frames`` with x1, y1, x2, y2 of each of their tiles: as large as ``size``, a share of it overlapping the next,
    cut at the frame's edge. A frame without a size has none."""
    step = max(1, int(size * (1 - overlap)))
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(n) - size + step) - 1, F.lit(step)))
    grid = frames.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("y1", starts(height)).withColumn("x1", starts(width))
    return grid.withColumns({"x2": F.least(F.col("x1") + size, F.col(width)), "y2": F.least(F.col("y1") + size, F.col(height))})


def roi(pad: int = 6) -> dict[str, Column]:
    return {"rx1": F.greatest(F.col("x1") - pad, F.lit(0)), "ry1": F.greatest(F.col("y1") - pad, F.lit(0)), "rx2": F.least(F.col("x2") + pad, F.col("img_w")), "ry2": F.least(F.col("y2") + pad, F.col("img_h"))}


def deduplicated(df: DataFrame, cfg: Detect = Detect()) -> DataFrame:
    """Of each image's boxes by falling confidence (ties by the smaller id), those that neither overlap a kept one too much
    nor hold or lie in one."""
    return _settled(df, (iou(box("a_"), box("b_")) > cfg.dedup_iou) | (containment(box("a_"), box("b_")) > cfg.containment))


def suppressed(df: DataFrame, cfg: Detect = Detect()) -> DataFrame:
    """Non-maximum suppression over all classes: boxes by falling confidence that overlap no kept one by more than cfg.iou."""
    return _settled(df, iou(box("a_"), box("b_")) > cfg.iou)


def detected(df: DataFrame, cfg: Detect = Detect()) -> DataFrame:
    """What a detector hands on: boxes of enough confidence, suppressed, the surest max_det of each image."""
    return above(suppressed(df.where(F.col("confidence") >= cfg.conf), cfg), cfg.conf, cfg.max_det)


def _settled(df: DataFrame, conflict: Column) -> DataFrame:
    """Of each image's boxes by falling confidence, those in conflict with no kept one.

    Conflicting pairs come from the grid join. Then, in rounds, a box with no surer undecided conflict is kept and those
    in conflict with it go; so each round settles every box whose surer ones are settled, in all images at once, and no
    image is gathered. There are as many rounds as the longest chain of boxes, each decided by the one before.
    """
    pairs = box_pairs(df, ("confidence",))
    both = pairs.where(conflict)
    ids, (p, q) = (F.col("a_seed_id"), F.col("b_seed_id")), (F.coalesce(F.col(f"{x}_confidence"), F.lit(float("-inf"))) for x in "ab")
    surer = (p > q) | (p == q) & (ids[0] < ids[1])
    open_ = saved(both.select("image", F.when(surer, ids[0]).otherwise(ids[1]).alias("win"), F.when(surer, ids[1]).otherwise(ids[0]).alias("lose")), "conflicts")
    gone: list[DataFrame] = []
    while not open_.isEmpty():
        beaten = open_.select("image", F.col("lose").alias("win")).distinct()
        out = saved(open_.join(beaten, ["image", "win"], "left_anti").select("image", "lose").distinct(), "gone")
        gone.append(out)
        # conflicts with a box that is out, and those of a box that is kept, are settled
        left = open_.join(beaten, ["image", "win"], "left_semi").join(out, ["image", "lose"], "left_anti").join(out.select("image", F.col("lose").alias("win")), ["image", "win"], "left_anti")
        left = saved(left.select("image", "win", "lose"), "conflicts")
        dropped(open_)
        open_ = left
    dropped(open_)
    cols = df.select("image", "seed_id", "x1", "y1", "x2", "y2", "confidence", *[c for c in ("img_w", "img_h") if c in df.columns])
    if not gone:
        return cols
    every = reduce(DataFrame.unionAll, gone).select("image", F.col("lose").alias("seed_id"))
    return cols.join(every, ["image", "seed_id"], "left_anti")


def _steps(contour: str) -> Column:
    """Pairs of a closed outline's neighbouring points."""
    c = F.col(contour)
    return F.arrays_zip(c.alias("p"), F.concat(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, 1)).alias("q"))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + f(s))


def area_perimeter(df: DataFrame, contour: str = "contour") -> DataFrame:
    """Shoelace area and closed arc length, by higher-order functions."""
    steps = _steps(contour)
    cross = _sum(steps, lambda s: s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])
    way = _sum(steps, lambda s: F.sqrt((s["q"]["x"] - s["p"]["x"]) * (s["q"]["x"] - s["p"]["x"]) + (s["q"]["y"] - s["p"]["y"]) * (s["q"]["y"] - s["p"]["y"])))
    return df.withColumns({"area": F.abs(cross) / 2, "perimeter": way})


def morphology(df: DataFrame) -> DataFrame:
    """Adds the ratios of shape that lengths, areas and, where they are there, hull and ellipse give; null over zero.

    Columns: length_px, width_px, area_px2, perimeter_px; optional hull_area, hull_perimeter, ellipse_major_px,
    ellipse_minor_px (without them the sides stand for the axes).
    """
    c = lambda name, other=None: F.col(name) if name in df.columns else F.lit(None).cast("double") if other is None else F.col(other)
    area, way, length, width = (F.col(x) for x in ("area_px2", "perimeter_px", "length_px", "width_px"))
    axes = F.try_divide(c("ellipse_minor_px", "width_px"), c("ellipse_major_px", "length_px"))
    radius = F.sqrt(area / F.pi())
    return df.withColumns({
        "roundness": F.try_divide(4 * F.pi() * area, way * way), "aspect_ratio": F.try_divide(length, width), "elongation": 1 - F.try_divide(width, length), "extent": F.try_divide(area, length * width),
        "area_ratio": F.try_divide(area, F.pi() / 4 * length * width), "eq_radius_px": radius, "eq_diameter_px": 2 * radius, "eccentricity": F.sqrt(F.greatest(F.lit(0.0), 1 - axes * axes)),
        "solidity": F.try_divide(area, c("hull_area")), "convexity": F.try_divide(c("hull_perimeter"), way),
    })


def plausible(df: DataFrame, mask: str = "mask", cfg: Segment = Segment()) -> DataFrame:
    """Adds fill (share of the mask's cells that are set), border_touch (share of its first and last rows and columns) and
    plausible. mask: an array of rows."""
    share = lambda cells: F.try_divide(F.size(F.filter(cells, lambda v: v > 0)), F.size(cells))
    rows = F.col(mask)
    border = F.concat(rows[0], F.element_at(rows, -1), F.transform(rows, lambda r: r[0]), F.transform(rows, lambda r: F.element_at(r, -1)))
    out = df.withColumns({"fill": share(F.flatten(rows)), "border_touch": share(border)})
    ok = F.col("fill").between(cfg.min_fill, cfg.max_fill) & (F.col("border_touch") <= cfg.max_border_touch)
    return out.withColumn("plausible", F.coalesce(ok, F.lit(False)))


#: Fewest points of an outline, the length of a step between equal points, the least size to divide by.
LEAST_POINTS, NO_STEP, NO_SIZE = 8, 1e-9, 1e-12


def fourier(df: DataFrame, key: str | Sequence[str], harmonics: int = 10, normalize: bool = True, contour: str = "contour") -> DataFrame:
    """key, efd: elliptic Fourier coefficients of the closed outline, a, b, c, d for each harmonic; null below LEAST_POINTS.

    Each coefficient is a sum over the outline's steps, of the step's rate times the change of cosine or sine at its
    harmonic's phase. Normalised ones start at the first harmonic's major axis, which lies along x and has length 1.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # one expression: as columns its parts would be written out anew wherever a filter is pushed below them
    gap = "transform(c, (p, i) -> struct(cast(c[(i + 1) % size(c)].x - p.x as double) as dx, cast(c[(i + 1) % size(c)].y - p.y as double) as dy))"
    steps = f"transform({gap}, g -> struct(g.dx, g.dy, if(g.dx = 0 and g.dy = 0, {NO_STEP}D, sqrt(g.dx * g.dx + g.dy * g.dy)) as dt))"
    phase = lambda t: f"2 * pi() * h * ({t}) / element_at(t, -1)"
    change = lambda f, rate: f"aggregate(zip_with(s, t, (u, v) -> u.{rate} / u.dt * ({f}({phase('v')}) - {f}({phase('v - u.dt')}))), 0D, (a, v) -> a + v)"
    terms = ", ".join(f"element_at(t, -1) / (2 * h * h * pi() * pi()) * {change(f, rate)} as {name}" for name, f, rate in (("a", "cos", "dx"), ("b", "sin", "dx"), ("c", "cos", "dy"), ("d", "sin", "dy")))
    sums = f"transform(sequence(1, {harmonics}), h -> struct(h, {terms}))"
    flat = lambda array, scale: f"flatten(transform({array}, x -> array(x.a / {scale}, x.b / {scale}, x.c / {scale}, x.d / {scale})))"
    if normalize:
        cos, sin = "cos(x.h * theta)", "sin(x.h * theta)"
        turned = f"transform(e, x -> struct(x.h, x.a * {cos} + x.b * {sin} as a, x.b * {cos} - x.a * {sin} as b, x.c * {cos} + x.d * {sin} as c, x.d * {cos} - x.c * {sin} as d))"
        laid = "transform(f, x -> struct(x.h, x.a * cos(psi) + x.c * sin(psi) as a, x.b * cos(psi) + x.d * sin(psi) as b, x.c * cos(psi) - x.a * sin(psi) as c, x.d * cos(psi) - x.b * sin(psi) as d))"
        theta = "0.5D * atan2(2 * (e[0].a * e[0].b + e[0].c * e[0].d), e[0].a * e[0].a - e[0].b * e[0].b + e[0].c * e[0].c - e[0].d * e[0].d)"
        size = f"if(abs(g[0].a) > {NO_SIZE}D, abs(g[0].a), 1D)"
        body = let("e", sums, let("theta", theta, let("f", turned, let("psi", "atan2(f[0].c, f[0].a)", let("g", laid, let("z", size, flat("g", "z")))))))
    else:
        body = flat(sums, "1D")
    whole = let("c", f"`{contour}`", let("s", steps, let("t", "slice(aggregate(s, array(0D), (a, x) -> array_append(a, element_at(a, -1) + x.dt)), 2, size(s))", body)))
    return df.select(*keys, F.expr(f"case when size(`{contour}`) >= {LEAST_POINTS} then {whole} end").alias("efd"))


def atlas(efd: DataFrame, key: str, most: int = Shape().atlas_max, points: int = 180) -> DataFrame:
    """The outlines of the first ``most`` objects by key, and their mean shape's (key null): a picture shows no more.

    The mean is that of all objects.
    """
    shown = efd.where("efd is not null").orderBy(key).limit(most)
    kind = dict(efd.dtypes)[key]
    mean = mean_shape(efd.where("efd is not null")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("efd"))  # four numbers a harmonic
    return reconstructed(shown.select(key, "efd"), key, points).unionAll(reconstructed(mean.select(F.lit(None).cast(kind).alias(key), "efd"), key, points))


def mean_shape(efd: DataFrame) -> DataFrame:
    # filtered by what comes out: a filter on the descriptors would compute them again
    return efd.select(F.posexplode_outer("efd").alias("pos", "v")).where("v is not null").groupBy("pos").agg(F.avg("v").alias("mean"))


@dataclass(frozen=True)
class Axes:
    """Mean, components (columns) and their share of the variance, of ``n`` descriptors without their first harmonic."""

    n: int
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float


def principal_axes(efd: DataFrame, components: int = 4) -> Axes | None:
    """The first components; the sign makes the largest loading positive. None below three outlines.

    Sums and products of the few dimensions are added up by the cluster; only they reach the driver.
    """
    rows = efd.select(F.slice("efd", 5, 1 << 20).alias("x"))

    def partial(batches):
        n, s, ss = 0, 0.0, 0.0
        for pdf in batches:
            found = pdf["x"].dropna()
            if len(found):
                x = np.stack(found)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pd.DataFrame({"what": ["n", "s", "ss"], "x": [[float(n)], s.tolist(), ss.ravel().tolist()]})

    cells = rows.mapInPandas(partial, "what string, x array<double>").select("what", F.posexplode("x").alias("pos", "v"))
    sums = cells.groupBy("what", "pos").agg(F.sum("v").alias("v")).orderBy("what", "pos").toPandas()
    n, total, products = (sums.loc[sums["what"] == c, "v"].to_numpy() for c in ("n", "s", "ss"))
    n = int(n[0]) if len(n) else 0
    if n < 3:
        return None
    mean = total / n
    cov = (products.reshape(len(mean), -1) - n * np.outer(mean, mean)) / (n - 1)
    values, axes = np.linalg.eigh(cov)
    k = min(components, n - 1, len(mean))
    values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1][:, :k]
    return Axes(n, mean, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)]), values[:k], float(values.sum()))


def principal(efd: DataFrame, key: str | Sequence[str], components: int = 4) -> DataFrame:
    """Scores on the first components, first harmonic left out. No row below three outlines."""
    keys = [key] if isinstance(key, str) else list(key)
    names = [f"pc{i + 1}" for i in range(components)]
    schema = ", ".join([*(f"{k} {dict(efd.dtypes)[k]}" for k in keys), *(f"{c} double" for c in names)])
    model = principal_axes(efd, components)
    if model is None:
        return efd.sparkSession.createDataFrame([], schema)
    # sums of a row's numbers times a component's, fewer than a hundred each
    rows = efd.where("efd is not null").select(*keys, F.slice("efd", 5, 1 << 20).alias("x"))
    dot = lambda w: F.aggregate(F.zip_with("x", F.lit(w.tolist()), lambda v, u: v * u), F.lit(-float(w @ model.mean)), lambda s, v: s + v)
    k = model.components.shape[1]
    return rows.select(*keys, *[(dot(model.components[:, i]) if i < k else F.lit(float("nan"))).alias(c) for i, c in enumerate(names)])


def with_scores(objects: DataFrame, scores: DataFrame, components: int = 4, least: int = 4) -> DataFrame:
    """``objects`` with shape_pc1 and on: their outlines' scores by image and seed_id, null for one without an outline.
    No column is added for fewer than ``least`` outlines."""
    if scores.limit(least).count() < least:
        return objects
    named = scores.select("image", "seed_id", *[F.col(f"pc{i + 1}").alias(f"shape_pc{i + 1}") for i in range(components)])
    return objects.join(named, ["image", "seed_id"], "left")


def explained(spark: SparkSession, model: Axes | None) -> DataFrame:
    """pc, explained, explained_cum: shares of the variance."""
    share = [] if model is None else (model.variances / model.total if model.total else model.variances).tolist()
    rows = [(i + 1, float(x), float(sum(share[: i + 1]))) for i, x in enumerate(share)]
    return spark.createDataFrame(rows, "pc int, explained double, explained_cum double")


def along(spark: SparkSession, model: Axes | None, pc: int = 0, deviations: float = 2.0) -> DataFrame:
    """side (-1 or 1), efd: the shapes so many deviations of scores below and above the mean on a component."""
    rows = []
    if model is not None and pc < model.components.shape[1]:
        reach = deviations * float(np.sqrt(model.variances[pc] * (model.n - 1) / model.n))
        rows = [(side, [1.0, 0.0, 0.0, 0.0, *(model.mean + side * reach * model.components[:, pc]).tolist()]) for side in (-1, 1)]
    return spark.createDataFrame(rows, "side int, efd array<double>")


def reconstructed(efd: DataFrame, key: str, points: int = 180) -> DataFrame:
    """key, i, x, y: the outline of each descriptor at ``points`` even steps, first and last the same."""
    turn = lambda n: 2 * F.pi() * n * F.col("i") / (points - 1)
    at = lambda n, k: F.element_at("efd", (4 * n - 3 + k).cast("int"))
    harmonics = F.sequence(F.lit(1), F.floor(F.size("efd") / 4).cast("int"))
    along_ = lambda k: F.aggregate(harmonics, F.lit(0.0), lambda s, n: s + at(n, k) * F.cos(turn(n)) + at(n, k + 1) * F.sin(turn(n)))
    rows = efd.where("size(efd) >= 4").select(key, "efd", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return rows.select(key, "i", along_(0).alias("x"), along_(2).alias("y"))


def otsu(df: DataFrame, value: str, by: str | Sequence[str]) -> DataFrame:
    """For each group, the threshold on a 256-level histogram with the greatest between-class variance, ties to the lowest."""
    from pyspark.sql import Window

    keys = [by] if isinstance(by, str) else list(by)
    h = df.groupBy(*keys, F.col(value).alias("level")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    h = h.select(*keys, "level", F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col("level")).over(run).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    gap = F.col("s0") * F.col("w") - F.col("s") * F.col("w0")
    score = F.try_divide(gap.cast("double") * gap, F.col("w0").cast("double") * (F.col("w") - F.col("w0")))
    return h.groupBy(*keys).agg(F.max(F.struct(F.round(score, 6).alias("score"), (-F.col("level")).alias("level"))).alias("m")).select(*keys, (-F.col("m.level")).alias("threshold"))
