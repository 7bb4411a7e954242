"""Column expressions: numbers made finite, overlaps of boxes, classes by rule."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.config import Patterns


def finite(c: str | Column) -> Column:
    """As double; NaN and infinities are null, as is what isn't a number."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def cv(x: Column) -> Column:
    return 100 * ratio(F.stddev_samp(x), F.avg(x))


def skew(x: Column) -> Column:
    """Bias-corrected; null below three values, 0 if all are equal."""
    n = F.count(x)
    return F.when((n > 2) & (F.max(x) == F.min(x)), 0.0).when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")}


def box_centre(b: dict[str, Column]) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0


def box_area(b: dict[str, Column]) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = intersection(a, b)
    return F.when(inter == 0, 0.0).otherwise(ratio(inter.cast("double"), box_area(a) + box_area(b) - inter))


def containment(a: dict[str, Column], b: dict[str, Column]) -> Column:
    least = F.least(box_area(a), box_area(b))
    return F.when(least == 0, 0.0).otherwise(ratio(intersection(a, b).cast("double"), least))


def pattern_class(rules: Patterns = Patterns()) -> Column:
    light, largest, n, cover = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("mean_L", 100.0), ("largest_spot", 0.0), ("spot_count", 0), ("spot_coverage", 0.0)))
    return (
        F.when(light < rules.black_L_max, "black")
        .when(largest > rules.marbled_largest, "marbled")
        .when((n == 0) | (cover < rules.plain_coverage_max), "plain")
        .when(n >= rules.dotted_count_min, "dotted")
        .otherwise("spotted")
    )


def hue_angle(a: Column, b: Column) -> Column:
    """Degrees in [0, 360) from the means of a* and b*."""
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """#RRGGBB of channel means, cut to whole numbers; null if one is missing."""
    return F.when(red.isNotNull() & green.isNotNull() & blue.isNotNull(), F.format_string("#%02X%02X%02X", *[c.cast("int") for c in (red, green, blue)]))


def moved(contour: str, dx: Column, dy: Column) -> Column:
    """An outline's points from its region's to the photograph's frame."""
    return F.transform(contour, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def edge_cut(margin: int = 2) -> Column:
    """Does the box touch the frame's edge?"""
    return (F.col("x1") <= margin) | (F.col("y1") <= margin) | (F.col("x2") >= F.col("img_w") - margin) | (F.col("y2") >= F.col("img_h") - margin)


def let(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
