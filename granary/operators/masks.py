"""Masks of photographs or their regions: morphology, connected blobs, cleaning, outlines.

A mask is a row for each of its lines: the key columns, y, width, and ``bits``, an array of 64-bit words (the pixel at x is
bit x % 64 of word x / 64). Work along a line is shifts and masks of words; across lines, each line goes to the lines that
need it and groups hold a few lines, so a photograph of any size spreads over tasks. Blobs come from runs of set pixels:
those of a band of lines are joined in its task, and bands by rounds over the links between their blobs.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import Segment
from granary.functions.storage import dropped, saved
from granary.operators import linked

#: Lines of a band, and columns of a cell in which runs of two bands meet.
BAND, CELL = 32, 64


def packed(df: DataFrame, keys: Sequence[str], cells: Column) -> DataFrame:
    """A mask from rows of ``cells`` (array, set where above 0), one for each line; null cells are not set."""
    word = "transform(sequence(0, (width - 1) div 64), j -> aggregate(reverse(slice(_cells, 64 * j + 1, 64)), 0L, (a, v) -> shiftleft(a, 1) | if(v > 0, 1L, 0L)))"
    return df.select(*keys, "y", cells.alias("_cells")).where("size(_cells) > 0").withColumn("width", F.size("_cells")).select(*keys, "y", "width", F.expr(word).alias("bits"))


#: The bits of word j that lie within the width.
_INSIDE = "if(width >= 64 * (j + 1), -1L, shiftleft(1L, width % 64) - 1)"


def complement(mask: DataFrame) -> DataFrame:
    return mask.withColumn("bits", F.expr(f"transform(bits, (w, j) -> ~w & {_INSIDE})"))


def dilated(mask: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    """Set wherever a pixel within ``times`` steps, also slanting ones, is set: so many rounds of a 3 x 3 square at once."""
    if not times:
        return mask
    if times > 63:
        return dilated(dilated(mask, keys, 63), keys, times - 63)
    up = " | ".join(f"shiftleft(w, {s}) | if(j > 0, shiftrightunsigned(bits[j - 1], {64 - s}), 0L)" for s in range(1, times + 1))
    down = " | ".join(f"shiftrightunsigned(w, {s}) | if(j < size(bits) - 1, shiftleft(bits[j + 1], {64 - s}), 0L)" for s in range(1, times + 1))
    wide = mask.withColumn("bits", F.expr(f"transform(bits, (w, j) -> (w | {up} | {down}) & {_INSIDE})"))
    given = wide.select(*keys, F.explode(F.sequence(F.col("y") - times, F.col("y") + times)).alias("_to"), "y", "width", "bits")
    met = given.groupBy(*keys, F.col("_to").alias("y")).agg(F.max(F.col("y") == F.col("_to")).alias("own"), F.max("width").alias("width"), F.collect_list("bits").alias("_lines"))
    return met.where("own").select(*keys, "y", "width", F.expr("aggregate(_lines, transform(_lines[0], w -> 0L), (a, l) -> zip_with(a, l, (v, w) -> v | w))").alias("bits"))


def eroded(mask: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    """Set where all pixels within ``times`` steps are; what lies outside the mask counts as set."""
    return complement(dilated(complement(mask), keys, times)) if times else mask


def closed(mask: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    return eroded(dilated(mask, keys, times), keys, times)


def opened(mask: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    return dilated(eroded(mask, keys, times), keys, times)


def runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y, x1, x2 (both included) of each run of set pixels."""
    places = lambda word: f"flatten(transform({word}, (s, j) -> if(s = 0, array(), transform(filter(sequence(0, 63), b -> shiftrightunsigned(s, b) & 1 = 1), b -> 64 * j + b))))"
    starts = "transform(bits, (w, j) -> w & ~(shiftleft(w, 1) | if(j > 0, shiftrightunsigned(bits[j - 1], 63), 0L)))"
    ends = "transform(bits, (w, j) -> w & ~(shiftrightunsigned(w, 1) | if(j < size(bits) - 1, shiftleft(bits[j + 1], 63), 0L)))"
    ends_at = mask.select(*keys, "y", F.expr(f"arrays_zip({places(starts)}, {places(ends)})").alias("_r"))
    return ends_at.select(*keys, "y", F.explode("_r").alias("_r")).select(*keys, "y", F.col("_r.0").cast("int").alias("x1"), F.col("_r.1").cast("int").alias("x2"))


def painted(runs_: DataFrame, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mask of runs, on all lines of ``frame`` (keys, y, width)."""
    held = runs_.groupBy(*keys, "y").agg(F.collect_list(F.struct("x1", "x2")).alias("_r"))  # those of one line
    part = "shiftleft(-1L, greatest(r.x1 - 64 * j, 0)) & shiftrightunsigned(-1L, 63 - least(r.x2 - 64 * j, 63))"
    word = f"transform(sequence(0, (width - 1) div 64), j -> aggregate(coalesce(_r, array()), 0L, (a, r) -> if(r.x1 < 64 * (j + 1) and r.x2 >= 64 * j, a | ({part}), a)))"
    return frame.select(*keys, "y", "width").join(held, [*keys, "y"], "left").select(*keys, "y", "width", F.expr(word).alias("bits"))


def _joined_lines(y: np.ndarray, x1: np.ndarray, x2: np.ndarray, reach: int) -> np.ndarray:
    """For runs in order, the first run of those that each hangs together with: a union-find over neighbouring lines."""
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    starts = np.searchsorted(y, [y - 1, y]) if len(y) else np.empty((2, 0), int)
    above = 0
    for i, (first, own) in enumerate(starts.T.tolist()):
        above = max(above, first)
        while above < own and x2[above] + reach < x1[i]:
            above += 1
        k = above
        while k < own and x1[k] - reach <= x2[i]:
            a, b = find(k), find(i)
            root[max(a, b)] = min(a, b)
            k += 1
    return np.array([find(i) for i in range(len(root))], int)


def labelled(runs_: DataFrame, keys: Sequence[str], slanting: bool = True, band: int = BAND) -> DataFrame:
    """Runs with ``blob``: y * 2^32 + x1 of the first run, line by line, of those that touch, at corners too if ``slanting``.

    Bands of so many lines are joined each in a task. Runs along the bands' edges are joined cell by cell, so a line's many
    runs don't all meet each other, and link the blobs of the bands.
    """
    reach = int(slanting)
    schema = runs_.select(*keys, "y", "x1", "x2").withColumn("blob", F.lit(0).cast("long")).schema

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x1"], ignore_index=True)
        at = _joined_lines(*(rows[c].to_numpy() for c in ("y", "x1", "x2")), reach)
        return rows.assign(blob=((rows["y"].to_numpy(np.int64) << 32) + rows["x1"].to_numpy())[at])[schema.names]

    banded = runs_.select(*keys, "y", "x1", "x2", F.floor(F.col("y") / band).alias("_band"))
    own = saved(banded.groupBy(*keys, "_band").applyInPandas(join, schema), "bands")
    cells = lambda df, more: df.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("x1") - more) / CELL), F.floor((F.col("x2") + more) / CELL))))
    last, first = own.where(F.pmod("y", F.lit(band)) == band - 1), own.where(F.pmod("y", F.lit(band)) == 0)
    above = cells(last, reach).select(*keys, (F.col("y") + 1).alias("y"), "_cell", F.col("x1").alias("_a1"), F.col("x2").alias("_a2"), F.col("blob").alias("_above"))
    met = cells(first, 0).join(above, [*keys, "y", "_cell"]).where((F.col("x1") <= F.col("_a2") + reach) & (F.col("_a1") - reach <= F.col("x2")))
    links = saved(met.select(F.struct(*keys, F.col("_above").alias("blob")).alias("a"), F.struct(*keys, "blob").alias("b")).distinct(), "links")
    if links.isEmpty():
        return own
    roots = linked.components(links).select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.blob").alias("blob"), F.col("root.blob").alias("_root"))
    return own.join(roots, [*keys, "blob"], "left").select(*keys, "y", "x1", "x2", F.coalesce("_root", "blob").alias("blob"))


def blobs(labelled_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, blob, area, x1, y1, x2, y2 (all included) of each blob."""
    return labelled_.groupBy(*keys, "blob").agg(
        F.sum(F.col("x2") - F.col("x1") + 1).alias("area"), F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), F.max("y").alias("y2")
    )


def main_blobs(labelled_: DataFrame, frame: DataFrame, keys: Sequence[str], cfg: Segment = Segment()) -> DataFrame:
    """keys, blob, area, fragments: the blob at the middle of each mask, or the largest one (the first of several) if none
    is there, and how many others have more than a share of its area."""
    size = frame.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), F.max("width").alias("_w"))
    middle = (F.col("y") == F.floor(F.col("_h") / 2)) & (F.floor(F.col("_w") / 2)).between(F.col("x1"), F.col("x2"))
    of = labelled_.join(size, list(keys)).groupBy(*keys, "blob").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("area"), F.max(middle).alias("_middle"))
    best = of.groupBy(*keys).agg(F.max(F.struct("_middle", "area", (-F.col("blob")).alias("_first"))).alias("_best"))
    counted = of.join(best, list(keys)).groupBy(*keys).agg(F.first("_best").alias("_best"), F.sum((F.col("area") > cfg.fragment_share * F.col("_best.area")).cast("int")).alias("_n"))
    return counted.select(*keys, (-F.col("_best._first")).alias("blob"), F.col("_best.area").alias("area"), (F.col("_n") - 1).alias("fragments"))


def filled(runs_: DataFrame, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mask of runs with its holes set: all that doesn't hang together, over sides, with the mask's edge from outside."""
    outside = labelled(runs(complement(painted(runs_, frame, keys)), keys), keys, slanting=False)
    size = frame.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), F.max("width").alias("_w"))
    edge = (F.col("y") == 0) | (F.col("y") == F.col("_h") - 1) | (F.col("x1") == 0) | (F.col("x2") == F.col("_w") - 1)
    open_ = outside.join(size, list(keys)).groupBy(*keys, "blob").agg(F.max(edge).alias("_edge")).where("_edge").select(*keys, "blob")
    return complement(painted(outside.join(open_, [*keys, "blob"], "left_semi"), frame, keys))


def cleaned(mask: DataFrame, keys: Sequence[str], cfg: Segment = Segment()) -> tuple[DataFrame, DataFrame]:
    """The mask closed, opened, cut down to its main blob and filled; and keys, area before filling, fragments of each.

    A mask without a set pixel after opening has no line in the first and no row in the second. Lines must be numbered
    from 0; a null key is a key like others only where Spark's joins take it as one, so give keys without nulls.
    """
    frame = saved(mask.select(*keys, "y", "width"), "frame")
    parts = saved(labelled(runs(opened(closed(mask, keys, cfg.close_iter), keys, cfg.open_iter), keys), keys), "blobs")
    main = saved(main_blobs(parts, frame, keys, cfg), "main")
    kept = frame.join(main.select(*keys), list(keys), "left_semi")
    out = saved(filled(parts.join(main.select(*keys, "blob"), [*keys, "blob"], "left_semi"), kept, keys), "clean")
    dropped(parts, frame)
    return out, main.drop("blob")


#: Steps of an outline: right, down, left, up.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def outlined(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, contour, edges: the outline of a mask that holds one blob without holes, along the pixels' sides.

    Corners (x, y) of a closed ring, clockwise as seen, from the uppermost (then leftmost) one; it encloses as much area as
    pixels are set. Sides between a set pixel and another make steps with the set one on their right; where two pixels
    touch at a corner, the ring goes on to the other one, so a blob has one ring. Pointer doubling orders the steps.
    """
    lines = mask.select(*keys, F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("_to"), "y", "width", "bits")
    of = lambda d: F.max(F.when(F.col("y") == F.col("_to") + d, F.col("bits")))
    met = lines.groupBy(*keys, F.col("_to").alias("y")).agg(F.max("width").alias("width"), of(0).alias("bits"), of(-1).alias("_up"), of(1).alias("_down")).where("bits is not null")
    bare = lambda other: met.withColumn("bits", F.expr(f"transform(bits, (w, j) -> w & ~coalesce({other}[j], 0L))"))
    sides = lambda other, dx, dy, step: runs(bare(other), keys).select(*keys, F.explode(F.sequence("x1", "x2")).alias("x"), "y").select(*keys, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(step).alias("d"))
    own = runs(mask, keys)
    steps = sides("_up", 0, 0, 0).unionAll(own.select(*keys, F.col("x2") + 1, "y", F.lit(1))).unionAll(sides("_down", 1, 1, 2)).unionAll(own.select(*keys, "x1", F.col("y") + 1, F.lit(3)))
    number = lambda x, y, d: (F.shiftleft(y.cast("long"), 31) + x) * 4 + d
    steps = saved(steps.withColumn("step", number(F.col("x"), F.col("y"), F.col("d"))), "steps")
    dx, dy = (F.element_at(F.array(*[F.lit(s[i]) for s in STEPS]), F.col("d") + 1) for i in (0, 1))
    ends = steps.select(*keys, "step", F.col("d").alias("_d"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    # left turn, straight on, right turn
    turn = F.pmod(F.col("d") - F.col("_d") + 1, F.lit(4))
    then = ends.join(steps.select(*keys, "x", "y", "d", F.col("step").alias("next")), [*keys, "x", "y"]).groupBy(*keys, "step").agg(F.min(F.struct(turn.alias("turn"), "next")).alias("n")).select(*keys, "step", F.col("n.next").alias("next"))
    placed = linked.ranked_rings(then, keys).join(steps, [*keys, "step"])
    ring = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "d"))).alias("_r"))  # one blob's outline
    corners = "transform(filter(transform(_r, (p, i) -> struct(p.x, p.y, p.d <> _r[(i + size(_r) - 1) % size(_r)].d as turns)), p -> p.turns), p -> struct(p.x as x, p.y as y))"
    return ring.select(*keys, F.expr(corners).alias("contour"), F.size("_r").alias("edges"))
