import math
import random

import numpy as np
import pytest

from granary.config import Segment
from granary.operators.outlines import circle, ellipse, measured, simplified


def frame(spark, outlines, kind="double"):
    rows = [(k, None if p is None else [None if q is None else (q[0], q[1]) for q in p], 1.0) for k, p in outlines.items()]
    return spark.createDataFrame(rows, f"k string, contour array<struct<x:{kind},y:{kind}>>, _hull double").drop("_hull").repartition(2)


def cloud(n, seed):
    rng = random.Random(seed)
    return [(rng.gauss(0, 30), rng.gauss(0, 10)) for _ in range(n)]


def oval(n, a=30.0, b=12.0, turn=0.6, x0=100.0, y0=40.0):
    return [(x0 + a * math.cos(t) * math.cos(turn) - b * math.sin(t) * math.sin(turn), y0 + a * math.cos(t) * math.sin(turn) + b * math.sin(t) * math.cos(turn)) for t in (2 * math.pi * i / n for i in range(n))]


def brute(points):
    """Hull area and perimeter, least rectangle and breadth over all directions between points that have all others on one side."""
    p = sorted(set(points))
    sides = []
    for a in p:
        for b in p:
            c = [(b[0] - a[0]) * (o[1] - a[1]) - (b[1] - a[1]) * (o[0] - a[0]) for o in p]
            if a != b and min(c) >= -1e-9:
                size = math.dist(a, b)
                along = [((b[0] - a[0]) * o[0] + (b[1] - a[1]) * o[1]) / size for o in p]
                sides.append((max(along) - min(along), max(c) / size))
    area, length = min((w * h, -max(w, h)) for w, h in sides)
    return area, -length, min(h for _, h in sides), max(math.dist(a, b) for a in p for b in p)


@pytest.mark.parametrize("turn", range(0, 90, 15))
def test_rectangle_keeps_length_and_width_under_turning(spark, turn):
    t = math.radians(turn)
    box = [(x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)) for x, y in ((0, 0), (20, 0), (40, 0), (40, 7), (40, 15), (3, 15), (0, 15), (0, 0))]
    r = measured(frame(spark, {"box": box})).first()
    assert (r["length_px"], r["width_px"], r["feret_min_px"], r["breadth_min_px"]) == pytest.approx((40, 15, 15, 15))
    assert (r["hull_area"], r["hull_perimeter"], r["feret_max_px"]) == pytest.approx((600, 110, math.hypot(40, 15)))
    assert r["rect_angle"] % 90 == pytest.approx(turn % 90, abs=1e-6) or r["rect_angle"] == pytest.approx(90)


def test_measures_are_as_brute_force(spark):
    outlines = {f"c{i}": cloud(3 + i * 4, i) for i in range(12)} | {"oval": oval(60), "grid": [(float(x), float(y)) for x in range(5) for y in range(4)]}
    for r in measured(frame(spark, outlines)).collect():
        area, length, thin, far = brute(outlines[r["k"]])
        assert (r["length_px"] * r["width_px"], r["length_px"], r["breadth_min_px"], r["feret_max_px"]) == pytest.approx((area, length, thin, far)), r["k"]


def test_degenerate_outlines(spark):
    inf, nan = float("inf"), float("nan")
    given = {"null": None, "empty": [], "nulls": [None, (None, 1.0)], "point": [(2.0, 3.0)] * 4, "line": [(0.0, 0.0), (3.0, 4.0), (1.5, 2.0)], "odd": [(0.0, 0.0), (nan, 1.0), (4.0, 0.0), (inf, 2.0), (0.0, 3.0), None]}
    df = frame(spark, given)
    got = {r["k"]: r for r in circle(ellipse(measured(df))).collect()}
    for k in ("null", "empty", "nulls"):
        assert got[k]["length_px"] is None and got[k]["radius_px"] is None and got[k]["ellipse_major_px"] is None and got[k]["hull_area"] is None
    assert (got["point"]["length_px"], got["point"]["rect_angle"], got["point"]["radius_px"]) == (0, None, 0)
    assert (got["line"]["length_px"], got["line"]["width_px"], got["line"]["radius_px"], got["line"]["hull_perimeter"]) == pytest.approx((5, 0, 2.5, 10))
    assert (got["odd"]["hull_area"], got["odd"]["radius_px"], got["odd"]["feret_max_px"]) == pytest.approx((6, 2.5, 5))
    few = {r["k"]: r["contour"] for r in simplified(df).collect()}
    assert few["null"] is None and few["empty"] == [] and len(few["line"]) == 3 and len(few["odd"]) == 3


def test_ellipse_is_recovered_and_lines_have_none(spark):
    given = {"oval": oval(40), "turned": oval(30, 9.0, 8.0, 2.2, -5.0, 3.0), "line": [(float(i), 2.0 * i) for i in range(9)], "four": oval(4), "far": oval(50, 3.0, 1.0, 1.0, 1e6, -1e6)}
    got = {r["k"]: r for r in ellipse(frame(spark, given)).collect()}
    for k, a, b, turn in (("oval", 60, 24, 0.6), ("turned", 18, 16, 2.2), ("far", 6, 2, 1.0)):
        assert (got[k]["ellipse_major_px"], got[k]["ellipse_minor_px"], got[k]["ellipse_angle"]) == pytest.approx((a, b, (math.degrees(turn) + 90) % 180), rel=1e-3)
    assert got["four"]["ellipse_major_px"] is None and got["line"]["ellipse_major_px"] is None


def test_circle_holds_all_points_and_none_is_less(spark):
    given = {f"c{i}": cloud(2 + i, 50 + i) for i in range(14)} | {"right": [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)], "flat": [(0.0, 0.0), (10.0, 0.0), (5.0, 1.0)]}

    def least(p):
        centres = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a in p for b in p if a < b]
        for a in p:
            for b in p:
                for c in p:
                    d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
                    if a < b < c and abs(d) > 1e-12:
                        u, v = math.dist(a, b) ** 2, math.dist(a, c) ** 2
                        centres.append((a[0] + ((c[1] - a[1]) * u - (b[1] - a[1]) * v) / d, a[1] + ((b[0] - a[0]) * v - (c[0] - a[0]) * u) / d))
        return min(max(math.dist(c, q) for q in p) for c in centres)

    for r in circle(frame(spark, given)).collect():
        assert r["radius_px"] == pytest.approx(least(given[r["k"]])), r["k"]


def test_simplified_is_as_splitting_one_side_after_another(spark):
    cfg = Segment(smooth_epsilon=0.01)
    given = {"oval": oval(90), "cloud": cloud(40, 9), "few": oval(12), "twice": [p for p in oval(20) for _ in (0, 1)]}

    def brute(c):
        if len(c) <= 12:
            return c
        far = lambda p, o: max(range(len(p)), key=lambda i: (math.dist(p[i], p[o]), -i))
        f = far(c, far(c, 0))
        ring = c[f:] + c[: f + 1]
        eps = cfg.smooth_epsilon * sum(math.dist(p, q) for p, q in zip(c, c[1:] + c[:1]))

        def split(a, b):
            size = math.dist(ring[a], ring[b])
            off = lambda i: abs((ring[b][0] - ring[a][0]) * (ring[i][1] - ring[a][1]) - (ring[b][1] - ring[a][1]) * (ring[i][0] - ring[a][0])) / size if size else math.dist(ring[i], ring[a])
            k = max(range(a + 1, b), key=lambda i: (off(i), -i), default=None)
            return split(a, k) + split(k, b) if k is not None and off(k) > eps else [a]

        g = far(ring, 0)
        kept = split(0, g) + split(g, len(ring) - 1)
        return [ring[i] for i in kept] if len(kept) >= 8 else c

    for r in simplified(frame(spark, given), "contour", cfg).collect():
        assert [(p["x"], p["y"]) for p in r["contour"]] == brute(given[r["k"]]), r["k"]


def test_long_outlines_take_little_time(spark):
    import time

    df = frame(spark, {str(i): oval(400) for i in range(40)}).cache()
    measured(df).write.format("noop").mode("overwrite").save()
    began = time.time()
    measured(df).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 5


def test_whole_numbers_are_taken(spark):
    r = measured(frame(spark, {"a": [(0, 0), (6, 0), (6, 2), (0, 2)]}, "int")).first()
    assert (r["length_px"], r["width_px"], r["hull_area"]) == (6, 2, 12) and np.isfinite(r["rect_angle"])
