"""Pixels of photographs or their regions as rows: colour spaces, blur, thresholds, colour and coat of an object.

A photograph is a row for each line: the key columns, y and ``levels``, an array of numbers or of structs (r, g, b) from 0 to
255. Conversions are expressions, with the rounding to bytes that 8-bit imaging has. Masks are those of
:mod:`granary.operators.masks`.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import Colour, Patterns, Segment
from granary.functions.exprs import hex_colour, hue_angle, let, pattern_class
from granary.functions.storage import saved
from granary.operators import geometry, masks

#: sRGB's curve, its primaries as rows X, Y, Z under D65, that white's X and Z, and the bend of L*a*b*.
CURVE = (0.04045, 12.92, 0.055, 1.055, 2.4)
PRIMARIES = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE_X, WHITE_Z = 0.950456, 1.088754
BEND, SLOPE, DARK = 0.008856, 7.787, 903.3
#: Weights of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)


#: Thresholds in the order in which they are tried.
METHODS = ("otsu", "adaptive", "otsu_lab", "otsu_sat")


def _byte(x: Column) -> Column:
    return F.floor(x + 0.5)


def grey(r: Column, g: Column, b: Column) -> Column:
    return _byte(GREY[0] * r + GREY[1] * g + GREY[2] * b)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees below 180, saturation and value up to 255."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = most - least
    turn = F.when(span == 0, 0.0).when(most == r, 60.0 * F.try_divide(g - b, span)).when(most == g, 120 + 60.0 * F.try_divide(b - r, span)).otherwise(240 + 60.0 * F.try_divide(r - g, span))
    return F.pmod(_byte(F.when(turn < 0, turn + 360).otherwise(turn) / 2), F.lit(180)), _byte(F.coalesce(255.0 * F.try_divide(span, most), F.lit(0.0))), most


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L* from 0 to 100, a* and b*, each rounded as a byte has it."""
    knee, low, shift, high, power = CURVE
    linear = [F.when(c / 255.0 <= knee, c / 255.0 / low).otherwise(F.pow((c / 255.0 + shift) / high, F.lit(power))) for c in (r, g, b)]
    x, y, z = (sum((w * c for w, c in zip(row[1:], linear[1:])), row[0] * linear[0]) for row in PRIMARIES)
    bent = lambda t: F.when(t > BEND, F.cbrt(t)).otherwise(SLOPE * t + 16 / 116)
    fx, fy, fz = bent(x / WHITE_X), bent(y), bent(z / WHITE_Z)
    lightness = F.when(y > BEND, 116 * F.cbrt(y) - 16).otherwise(DARK * y)
    return _byte(lightness * 255 / 100) * 100 / 255, _byte(500 * (fx - fy) + 128) - 128, _byte(200 * (fy - fz) + 128) - 128


def channel(lines: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Lines of one channel (grey, L as a byte, or saturation) of lines of (r, g, b)."""
    of = {"grey": grey, "L": lambda *c: _byte(lab(*c)[0] * 255 / 100), "saturation": lambda *c: hsv(*c)[1]}[name]
    return lines.select(*keys, "y", F.transform("levels", lambda p: of(p["r"], p["g"], p["b"]).cast("double")).alias("levels"))


def turned(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns as lines: each pixel goes to its column, whose height bounds what meets there."""
    at = lines.select(*keys, "y", F.posexplode("levels").alias("_x", "v"))
    met = at.groupBy(*keys, F.col("_x").alias("y")).agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("_l"))
    return met.select(*keys, "y", F.expr("transform(_l, p -> p.v)").alias("levels"))


def _along(kernel: str, place: str) -> str:
    """Sum over the kernel's steps around i of weight times level; ``place`` says which level stands for one outside."""
    summed = f"transform(l, (v, i) -> aggregate(sequence(0, size(k) - 1), 0D, (s, n) -> s + k[n] * l[{let('p', 'i + n - size(k) div 2', place)}]))"
    return let("l", "levels", let("k", kernel, summed))


#: Fixed value: weights of the blur over five pixels.
FIVE = "array(1 / 16D, 4 / 16D, 6 / 16D, 4 / 16D, 1 / 16D)"
_MIRRORED = "if(size(l) = 1, 0, abs(pmod(p + size(l) - 1, 2 * size(l) - 2) - size(l) + 1))"
_HELD = "least(greatest(p, 0), size(l) - 1)"


def blurred(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each pixel's weighted mean over 5 x 5 pixels, rounded; the picture is mirrored at its edges."""
    once = lambda df: df.withColumn("levels", F.expr(_along(FIVE, _MIRRORED)))
    both = turned(once(turned(once(lines), keys)), keys)
    return saved(both.withColumn("levels", F.transform("levels", lambda v: _byte(v).cast("double"))), "blurred")


def otsu_mask(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mask of pixels at most as bright as the threshold of each blurred picture; turned over where most of its edge is set."""
    soft = blurred(lines, keys)
    levels = soft.select(*keys, F.explode("levels").alias("level"))
    cut = geometry.otsu(levels.withColumn("level", F.col("level").cast("int")), "level", keys)
    return oriented(masks.packed(soft.join(cut, list(keys)), keys, F.expr("transform(levels, v -> if(v <= threshold, 1, 0))")), keys)


def adaptive_mask(lines: DataFrame, keys: Sequence[str], cfg: Segment = Segment()) -> DataFrame:
    """The mask of pixels darker, by adaptive_c, than the Gaussian mean around them in the blurred picture.

    The window's odd side is a share of the picture's longer one, from 11 to 255; outside it the edge's pixels stand. Each
    direction is one pass along lines, the second over columns.
    """
    soft = blurred(lines, keys)
    size = soft.groupBy(*keys).agg(F.greatest(F.max("y") + 1, F.max(F.size("levels"))).alias("_long"))
    odd = F.floor(F.col("_long") * cfg.adaptive_block_frac).cast("int").bitwiseOR(F.lit(1))
    size = size.select(*keys, F.least(F.greatest(odd, F.lit(11)), F.lit(255)).alias("_side"))
    wide = "(0.3D * ((_side - 1) * 0.5D - 1) + 0.8D)"  # the deviation that goes with a side
    kernel = let("w", f"transform(sequence(0, _side - 1), n -> exp(-(n - _side div 2) * (n - _side div 2) / (2 * {wide} * {wide})))", let("t", "aggregate(w, 0D, (s, v) -> s + v)", "transform(w, v -> v / t)"))
    once = lambda df: df.join(size, list(keys)).withColumn("levels", F.expr(_along(kernel, _HELD))).drop("_side")
    around = turned(once(turned(once(soft), keys)), keys).withColumnRenamed("levels", "_mean")
    dark = F.expr(f"zip_with(levels, _mean, (v, m) -> if(v - floor(m + 0.5D) <= -floor({cfg.adaptive_c}D), 1, 0))")
    return oriented(masks.packed(soft.join(around, [*keys, "y"]), keys, dark), keys)


def edges(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, border_touch, fill: shares of the mask's edge (corners counted twice) and of all its pixels that are set."""
    bit = lambda x: f"shiftrightunsigned(bits[({x}) div 64], ({x}) % 64) & 1"
    ends = mask.select(*keys, "y", "width", F.expr(f"({bit('0')}) + ({bit('width - 1')})").alias("_sides"), F.expr("aggregate(bits, 0L, (a, w) -> a + bit_count(w))").alias("_set"))
    sums = ends.groupBy(*keys).agg(F.sum("_sides").alias("_s"), F.count("*").alias("_h"), F.max("width").alias("_w"), F.min_by("_set", "y").alias("_first"), F.max_by("_set", "y").alias("_last"), F.sum("_set").alias("_all"))
    return sums.select(*keys, ((F.col("_s") + F.col("_first") + F.col("_last")) / (2 * (F.col("_h") + F.col("_w")))).alias("border_touch"), (F.col("_all") / (F.col("_h") * F.col("_w"))).alias("fill"))


def oriented(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mask, or its complement where more than half of its edge is set."""
    mask = saved(mask, "mask")
    both = masks.complement(mask).withColumnRenamed("bits", "_other").join(mask.select(*keys, "y", "bits"), [*keys, "y"]).join(edges(mask, keys), list(keys))
    return both.select(*keys, "y", "width", F.when(F.col("border_touch") > 0.5, F.col("_other")).otherwise(F.col("bits")).alias("bits"))


def segmented(lines: DataFrame, keys: Sequence[str], cfg: Segment = Segment(), methods: Sequence[str] = METHODS) -> tuple[DataFrame, DataFrame]:
    """The mask of one object in each picture of (r, g, b); and keys, method, area, fragments, fill, border_touch, plausible.

    Methods are tried in turn, each on the pictures only for which none before gave a plausible mask; where none does, the
    first that gave any stays. A mask of fewer than min_area_px pixels is none. Pictures without any have no row.
    """
    left, done = lines, []
    for method in methods:
        threshold = {"otsu": lambda x: otsu_mask(channel(x, keys, "grey"), keys), "adaptive": lambda x: adaptive_mask(channel(x, keys, "grey"), keys, cfg), "otsu_lab": lambda x: otsu_mask(channel(x, keys, "L"), keys), "otsu_sat": lambda x: otsu_mask(channel(x, keys, "saturation"), keys)}[method]
        mask, main = masks.cleaned(threshold(left), keys, cfg)
        touch = edges(mask, keys).join(mask.groupBy(*keys).agg(F.sum(F.expr("aggregate(bits, 0L, (a, w) -> a + bit_count(w))")).alias("_px")), list(keys)).where(F.col("_px") >= cfg.min_area_px)
        ok = F.col("fill").between(cfg.min_fill, cfg.max_fill) & (F.col("border_touch") <= cfg.max_border_touch)
        told = saved(main.join(touch, list(keys)).select(*keys, F.lit(method).alias("method"), F.lit(len(done)).alias("_turn"), F.col("_px").alias("area"), "fragments", "fill", "border_touch", ok.alias("plausible")), "tried")
        done.append((mask.withColumn("_turn", F.lit(len(done))), told))
        left = left.join(told.where("plausible").select(*keys), list(keys), "left_anti")
    tried, every = done[0][1], done[0][0]
    for mask, told in done[1:]:
        tried, every = tried.unionAll(told), every.unionByName(mask)
    best = tried.groupBy(*keys).agg(F.min(F.struct((~F.col("plausible")).alias("not_"), "_turn")).alias("_b")).select(*keys, F.col("_b._turn").alias("_turn"))
    best = saved(best.join(tried, [*keys, "_turn"]), "segmented")
    return every.join(best.select(*keys, "_turn"), [*keys, "_turn"], "left_semi").drop("_turn"), best.drop("_turn")


def inside(lines: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y, x, r, g, b of the mask's pixels."""
    met = lines.join(mask.select(*keys, "y", "bits"), [*keys, "y"]).select(*keys, "y", "bits", F.posexplode("levels").alias("x", "_p"))
    return met.where("shiftrightunsigned(bits[x div 64], x % 64) & 1 = 1").select(*keys, "y", "x", "_p.*")


def colours(lines: DataFrame, mask: DataFrame, keys: Sequence[str], cfg: Colour = Colour()) -> DataFrame:
    """Means of the object's colour, a step inside its rim: keys, mean_R, mean_G, mean_B, mean_L, lab_a, lab_b (means of
    a* and b*; mean_b would be mean_B here), chroma, hue_angle, mean_hue, saturation, brightness, texture_std (of grey), hex.

    Where the inner part has fewer than min_px pixels, all of the mask counts; a mask with fewer has no row.
    """
    some = lambda m: m.groupBy(*keys).agg(F.sum(F.expr("aggregate(bits, 0L, (a, w) -> a + bit_count(w))")).alias("_n")).where(F.col("_n") >= cfg.min_px).select(*keys)
    core = masks.eroded(mask, keys, cfg.erode_iter)
    enough = some(core)
    used = core.join(enough, list(keys), "left_semi").unionByName(mask.join(some(mask), list(keys), "left_semi").join(enough, list(keys), "left_anti"))
    red, green, blue = (F.col(c) for c in "rgb")
    (hue, saturation, _), (light, a, b) = hsv(red, green, blue), lab(red, green, blue)
    px = inside(lines, used, keys).select(*keys, "r", "g", "b", hue.alias("hue"), saturation.alias("sat"), light.alias("L"), a.alias("a_"), b.alias("b_"), grey(red, green, blue).alias("grey"))
    means = px.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c.upper()}") for c in "rgb"], F.avg("L").alias("mean_L"), F.avg("a_").alias("lab_a"), F.avg("b_").alias("lab_b"), F.avg(F.hypot("a_", "b_")).alias("chroma"),
        F.avg("hue").alias("mean_hue"), F.avg("sat").alias("saturation"), F.avg("grey").alias("brightness"), F.stddev_pop("grey").alias("texture_std"),
    )
    return means.withColumns({"hue_angle": hue_angle(F.col("lab_a"), F.col("lab_b")), "hex": hex_colour(F.col("mean_R"), F.col("mean_G"), F.col("mean_B"))})


def opened_by_two(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the 2 x 2 squares that the mask holds."""
    right = "transform(bits, (w, j) -> shiftrightunsigned(w, 1) | if(j < size(bits) - 1, shiftleft(bits[j + 1], 63), 0L))"
    left = "transform(bits, (w, j) -> shiftleft(w, 1) | if(j > 0, shiftrightunsigned(bits[j - 1], 63), 0L))"
    beside = lambda df, step, name: df.select(*keys, (F.col("y") - step).alias("y"), F.col("bits").alias(name))
    # a square is known by its upper left pixel
    pairs = mask.withColumn("bits", F.expr(f"zip_with(bits, {right}, (v, w) -> v & w)"))
    squares = pairs.join(beside(pairs, 1, "_below"), [*keys, "y"], "left").withColumn("bits", F.expr("transform(bits, (w, j) -> w & coalesce(_below[j], 0L))")).drop("_below")
    wide = squares.withColumn("bits", F.expr(f"zip_with(bits, {left}, (v, w) -> v | w)"))
    return wide.join(beside(wide, -1, "_above"), [*keys, "y"], "left").select(*keys, "y", "width", F.expr("transform(bits, (w, j) -> w | coalesce(_above[j], 0L))").alias("bits"))


def coat(lines: DataFrame, mask: DataFrame, keys: Sequence[str], rules: Patterns = Patterns(), cfg: Colour = Colour()) -> DataFrame:
    """keys, spot_count, spot_coverage, largest_spot, mean_spot_px, spot_contrast_dE, dark_fraction, pattern_class.

    Each object's own threshold parts its grey levels; where the parts' means lie closer than spot_min_separation, or one is
    empty, the coat is plain. Spots are blobs of the dark part, opened by a 2 x 2 square, of at least spot_min_area_px pixels;
    if they cover more than shading_share of the object, they are shading and none counts. The contrast is the distance of the
    mean colours of dark and other pixels, 0 below five of either. Masks of fewer than min_px pixels have no row.
    """
    red, green, blue = (F.col(c) for c in "rgb")
    light, a, b = lab(red, green, blue)
    mask = saved(mask, "mask")
    px = inside(lines, mask, keys).select(*keys, "y", "x", light.alias("L"), a.alias("a_"), b.alias("b_"), grey(red, green, blue).cast("int").alias("grey"))
    px = saved(px, "pixels")
    cut = geometry.otsu(px, "grey", keys)
    sides = px.join(cut, list(keys)).groupBy(*keys).agg(F.count("*").alias("_n"), F.first("threshold").alias("_t"), F.avg(F.when(F.col("grey") <= F.col("threshold"), F.col("grey"))).alias("_d"), F.avg(F.when(F.col("grey") > F.col("threshold"), F.col("grey"))).alias("_l"), F.avg("grey").alias("_m"), F.stddev_pop("grey").alias("_s"))
    apart = F.coalesce(F.col("_l") - F.col("_d") >= rules.spot_min_separation, F.lit(False))
    sides = saved(sides.where(F.col("_n") >= cfg.min_px).select(*keys, "_n", F.when(apart, F.col("_t")).otherwise(-1).alias("_t"), (F.col("_m") - F.col("_s")).alias("_low")), "sides")
    dark = px.join(sides, list(keys)).where(F.col("grey") <= F.col("_t")).select(*keys, "y", F.col("x").alias("x1"), F.col("x").alias("x2"))
    spots = saved(opened_by_two(masks.painted(dark, mask.join(sides.select(*keys), list(keys), "left_semi"), keys), keys), "spots")
    found = masks.blobs(masks.labelled(masks.runs(spots, keys), keys), keys).where(F.col("area") >= rules.spot_min_area_px)
    areas = found.groupBy(*keys).agg(F.count("*").alias("_c"), F.sum("area").alias("_sum"), F.max("area").alias("_most"))
    kept = sides.join(areas, list(keys), "left").withColumn("_shade", F.coalesce(F.col("_sum") / F.col("_n") > rules.shading_share, F.lit(False)))
    spotted = px.join(spots.select(*keys, "y", "bits"), [*keys, "y"]).join(kept.select(*keys, "_shade", "_low"), list(keys))
    spotted = spotted.withColumn("_spot", F.expr("shiftrightunsigned(bits[x div 64], x % 64) & 1 = 1") & ~F.col("_shade"))
    of = lambda c, is_spot: F.avg(F.when(F.col("_spot") == is_spot, F.col(c)))
    gap = lambda c: (of(c, True) - of(c, False)) * (of(c, True) - of(c, False))
    enough = (F.sum(F.col("_spot").cast("int")) >= 5) & (F.sum((~F.col("_spot")).cast("int")) >= 5)
    tones = spotted.groupBy(*keys).agg(F.avg("L").alias("_L"), F.coalesce(F.when(enough, F.sqrt(gap("L") + gap("a_") + gap("b_"))), F.lit(0.0)).alias("spot_contrast_dE"), F.avg((F.col("grey") < F.col("_low")).cast("int")).alias("dark_fraction"))
    lights = colours(lines, mask, keys, cfg).select(*keys, "mean_L")
    share = lambda c: F.coalesce(F.when(~F.col("_shade"), F.col(c) / F.col("_n")), F.lit(0.0))
    whole = kept.join(tones, list(keys)).join(lights, list(keys)).withColumns({
        "spot_count": F.when(F.col("_shade"), 0).otherwise(F.coalesce("_c", F.lit(0))).cast("int"), "spot_coverage": share("_sum"), "largest_spot": share("_most"),
        "mean_spot_px": F.coalesce(F.when(~F.col("_shade"), F.col("_sum") / F.col("_c")), F.lit(0.0)),
    })
    return whole.select(*keys, "spot_count", "spot_coverage", "largest_spot", "mean_spot_px", "spot_contrast_dE", "dark_fraction", pattern_class(rules).alias("pattern_class"))
