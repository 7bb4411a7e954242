import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.config import Segment
from granary.operators import masks, pixels

KEYS = ["lot", "image"]


def table(spark, pictures):
    """Lines of (r, g, b) from arrays of height x width x 3."""
    rows = [(*k, y, [tuple(int(v) for v in p) for p in line]) for k, m in pictures.items() for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "lot string, image int, y int, levels array<struct<r:int,g:int,b:int>>").repartition(3)


def seed(h=40, w=46, base=(230, 232, 235), colour=(120, 80, 40), spots=(), noise=3):
    """A picture of an ellipse with round spots; and the pixels of it."""
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:h, :w]
    inside = ((x - w / 2) / 14) ** 2 + ((y - h / 2) / 10) ** 2 < 1
    m = np.where(inside[..., None], colour, base).astype(float)
    for sy, sx, size, c in spots:
        m[np.hypot(y - sy, x - sx) < size] = c
    return np.clip(m + rng.normal(0, noise, (h, w, 1)), 0, 255).astype(int), inside


def test_known_colours(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0), (128, 128, 128)], "r int, g int, b int")
    light, a, b = pixels.lab(F.col("r"), F.col("g"), F.col("b"))
    hue, saturation, value = pixels.hsv(F.col("r"), F.col("g"), F.col("b"))
    rows = df.select(F.round(light * 255 / 100).cast("int"), (a + 128).cast("int"), (b + 128).cast("int"), hue.cast("int"), saturation.cast("int"), value, pixels.grey(F.col("r"), F.col("g"), F.col("b")).cast("int")).collect()
    # published bytes of the primaries
    assert [tuple(r) for r in rows] == [(136, 208, 195, 0, 255, 255, 76), (224, 42, 211, 60, 255, 255, 150), (82, 207, 20, 120, 255, 255, 29), (255, 128, 128, 0, 0, 255, 255), (0, 128, 128, 0, 0, 0, 0), (137, 128, 128, 0, 0, 128, 128)]


def blur(m):
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(m, 2, "reflect")
    return np.floor(sum(k[i] * k[j] * p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(5) for j in range(5)) + 0.5)


def test_blur_and_adaptive_mask_are_as_pixel_by_pixel(spark):
    rng = np.random.default_rng(2)
    pictures = {("a", 1): rng.integers(0, 256, (13, 70)), ("a", 2): rng.integers(0, 256, (50, 9)), ("b", 1): rng.integers(90, 110, (6, 6))}
    lines = spark.createDataFrame([(*k, y, [float(v) for v in line]) for k, m in pictures.items() for y, line in enumerate(m)], "lot string, image int, y int, levels array<double>").repartition(4)
    soft = {}
    for r in pixels.blurred(lines, KEYS).collect():
        soft.setdefault((r["lot"], r["image"]), {})[r["y"]] = r["levels"]
    found = {}
    for r in pixels.adaptive_mask(lines, KEYS).collect():
        found.setdefault((r["lot"], r["image"]), {})[r["y"]] = [r["bits"][x // 64] >> x % 64 & 1 for x in range(r["width"])]
    for k, m in pictures.items():
        want = blur(m)
        assert (np.array([soft[k][y] for y in range(len(m))]) == want).all()
        side = min(max(11, int(max(m.shape) * 0.35) | 1), 255)
        deviation = 0.3 * ((side - 1) * 0.5 - 1) + 0.8
        w = np.exp(-((np.arange(side) - side // 2) ** 2) / (2 * deviation**2))
        w /= w.sum()
        p = np.pad(want, side // 2, "edge")
        mean = sum(w[i] * w[j] * p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(side) for j in range(side))
        dark = want - np.floor(mean + 0.5) <= -4
        edge = np.concatenate([dark[0], dark[-1], dark[:, 0], dark[:, -1]])
        assert (np.array([found[k][y] for y in range(len(m))], bool) == (~dark if edge.mean() > 0.5 else dark)).all()


def test_objects_are_cut_out_and_the_next_method_helps_where_one_fails(spark):
    pale, inside = seed(base=(200, 200, 200), colour=(200, 200, 200), noise=0)
    hidden = pale.copy()
    hidden[inside] = (218, 207, 150)  # near the ground in grey, apart in saturation
    pictures = {("a", 1): seed()[0], ("a", 2): hidden, ("a", 3): np.full((30, 30, 3), 240), ("b", 1): 255 - seed()[0]}
    mask, told = pixels.segmented(table(spark, pictures), KEYS, Segment())
    told = {(r["lot"], r["image"]): r for r in told.collect()}
    assert told["a", 1]["method"] == "otsu" and told["b", 1]["method"] == "otsu" and told["a", 2]["plausible"]
    for k in (("a", 1), ("b", 1), ("a", 2)):
        assert abs(told[k]["area"] - inside.sum()) < 0.12 * inside.sum() and told[k]["fragments"] == 0
    assert told["a", 1]["fill"] == pytest.approx(told["a", 1]["area"] / inside.size)
    held = {(r["lot"], r["image"]) for r in mask.collect()}
    assert held == set(told) and (("a", 3) not in told or not told["a", 3]["plausible"])


def masked(spark, inside):
    return masks.packed(spark.createDataFrame([(*k, y, [int(v) for v in line]) for k, m in inside.items() for y, line in enumerate(m)], "lot string, image int, y int, c array<int>"), KEYS, F.col("c"))


def test_colours_inside_the_rim(spark):
    m, inside = seed(noise=0)
    rim = inside & ~np.pad(inside, 1)[2:, 1:-1]
    m[rim] = 255  # the rim isn't sampled
    thin = np.zeros((9, 20), bool)
    thin[4, 3:15] = True
    df = table(spark, {("a", 1): m, ("a", 2): np.full((9, 20, 3), (10, 20, 30)), ("a", 3): np.zeros((9, 9, 3))})
    mask = masked(spark, {("a", 1): inside, ("a", 2): thin, ("a", 3): np.eye(9, dtype=bool)})
    got = {(r["lot"], r["image"]): r for r in pixels.colours(df, mask, KEYS).collect()}
    assert ("a", 3) not in got  # too few pixels
    r = got["a", 1]
    assert (r["mean_R"], r["mean_G"], r["mean_B"], r["texture_std"], r["hex"]) == (120, 80, 40, 0, "#785028")
    assert r["chroma"] == pytest.approx(math.hypot(r["lab_a"], r["lab_b"])) and 50 < r["hue_angle"] < 90
    assert (got["a", 2]["mean_R"], got["a", 2]["brightness"]) == (10, 18)


def test_coats(spark):
    spots = [(14, 20, 2.3, (20, 15, 10)), (20, 28, 2.3, (20, 15, 10)), (25, 18, 2.3, (20, 15, 10))]
    spotted, inside = seed(colour=(200, 170, 120), spots=spots, noise=0)
    plain, _ = seed(colour=(200, 170, 120), noise=1)
    black, _ = seed(colour=(25, 22, 20), noise=1)
    marbled, _ = seed(colour=(200, 170, 120), spots=[(20, 20, 6, (90, 60, 30))], noise=0)
    pictures = {("a", 1): spotted, ("a", 2): plain, ("a", 3): black, ("a", 4): marbled, ("a", 5): plain}
    held = {k: inside for k in pictures} | {("a", 5): np.zeros_like(inside)}
    got = {r["image"]: r for r in pixels.coat(table(spark, pictures), masked(spark, held), KEYS).collect()}
    assert [got[i]["pattern_class"] for i in (1, 2, 3, 4)] == ["spotted", "plain", "black", "marbled"] and 5 not in got
    dark = (spotted.sum(-1) < 100) & inside
    assert got[1]["spot_count"] == 3 and got[1]["spot_coverage"] == pytest.approx(dark.sum() / inside.sum(), abs=0.02) and got[1]["spot_contrast_dE"] > 50
    assert got[2]["spot_count"] == 0 and got[2]["spot_contrast_dE"] == 0
