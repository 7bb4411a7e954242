import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.config import Segment
from granary.operators import geometry, linked, masks
from granary.operators.outlines import simplified

KEYS = ["image"]


def noise(h, w, share, seed):
    return np.random.default_rng(seed).random((h, w)) < share


def table(spark, images):
    """A mask of boolean arrays."""
    rows = [(k, y, [int(v) for v in line]) for k, m in images.items() for y, line in enumerate(m)]
    return masks.packed(spark.createDataFrame(rows, "image string, y int, cells array<int>").repartition(3), KEYS, F.col("cells"))


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], {})[r["y"]] = [bool(r["bits"][x // 64] >> x % 64 & 1) for x in range(r["width"])]
        assert r["width"] > 64 * (len(r["bits"]) - 1) and not any(r["bits"][-1] >> x & 1 for x in range((r["width"] - 1) % 64 + 1, 64))
    return {k: np.array([m[y] for y in sorted(m)]) for k, m in out.items()}


def box(m, k, most):
    h, w = m.shape
    out = np.zeros_like(m)
    for y in range(h):
        for x in range(w):
            part = m[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]
            out[y, x] = part.any() if most else part.all()
    return out


def flood(m, slanting=True):
    """Blob number of each set pixel, 0 elsewhere, in the order of their first pixels."""
    label, n = np.zeros(m.shape, int), 0
    for start in zip(*np.nonzero(m)):
        if label[start]:
            continue
        n += 1
        label[start], todo = n, [start]
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if (slanting or not dy * dx) and 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and not label[q]:
                        label[q] = n
                        todo.append(q)
    return label


IMAGES = {"a": noise(70, 130, 0.3, 1), "b": noise(5, 64, 0.5, 2), "c": noise(40, 65, 0.2, 3), "one": np.ones((1, 1), bool), "none": np.zeros((3, 7), bool), "all": np.ones((33, 128), bool)}


@pytest.mark.parametrize("times", [1, 2, 70])
def test_morphology_is_as_pixel_by_pixel(spark, times):
    found, thin = back(masks.dilated(table(spark, IMAGES), KEYS, times)), back(masks.eroded(table(spark, IMAGES), KEYS, times))
    for k, m in IMAGES.items():
        assert (found[k] == box(m, times, True)).all() and (thin[k] == box(m, times, False)).all()


def test_no_rounds_change_nothing(spark):
    found = back(masks.opened(masks.closed(table(spark, IMAGES), KEYS, 0), KEYS, 0))
    assert all((found[k] == m).all() for k, m in IMAGES.items())


@pytest.mark.parametrize(("slanting", "band"), [(True, 32), (True, 3), (False, 32), (False, 1)])
def test_blobs_are_as_by_flood_fill(spark, slanting, band):
    snake = np.zeros((31, 40), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    images = IMAGES | {"snake": snake}
    got = {}
    for r in masks.blobs(masks.labelled(masks.runs(table(spark, images), KEYS), KEYS, slanting, band), KEYS).collect():
        got.setdefault(r["image"], set()).add((r["blob"] >> 32, r["blob"] & 0xFFFFFFFF, r["area"], r["x1"], r["y1"], r["x2"], r["y2"]))
    for k, m in images.items():
        label, wanted = flood(m, slanting), set()
        for n in range(1, label.max() + 1):
            y, x = np.nonzero(label == n)
            wanted.add((y[0], x[0], len(y), x.min(), y.min(), x.max(), y.max()))
        assert got.get(k, set()) == wanted


def clean(m, cfg):
    m = box(box(m, cfg.close_iter, True), cfg.close_iter, False)
    m = box(box(m, cfg.open_iter, False), cfg.open_iter, True)
    label = flood(m)
    if not label.max():
        return None
    sizes = np.bincount(label.ravel())[1:]
    own = label[m.shape[0] // 2, m.shape[1] // 2] or 1 + sizes.argmax()
    free = flood(label != own, slanting=False)
    outside = set(np.concatenate([free[0], free[-1], free[:, 0], free[:, -1]])) - {0}
    return ~np.isin(free, list(outside)), sizes[own - 1], (sizes > 0.25 * sizes[own - 1]).sum() - 1


def test_cleaning_and_outline(spark):
    ring = np.zeros((40, 80), bool)
    ring[5:35, 10:70] = True
    ring[8:32, 13:67] = False
    ring[15:20, 30:40] = True  # an island in the hole
    images = {"ring": ring, "corner": np.eye(20, 33, dtype=bool), "none": np.zeros((9, 9), bool), "one": np.ones((1, 1), bool)} | {f"n{i}": noise(40, 70, 0.04 * i, i) for i in range(1, 6)}
    for cfg in (Segment(), Segment(close_iter=0, open_iter=0)):
        mask, main = masks.cleaned(table(spark, images), KEYS, cfg)
        got, figures = back(mask), {r["image"]: (r["area"], r["fragments"]) for r in main.collect()}
        rings = {r["image"]: r for r in geometry.area_perimeter(masks.outlined(mask, KEYS)).collect()}
        for k, m in images.items():
            wanted = clean(m, cfg)
            if wanted is None:
                assert k not in got and k not in figures and k not in rings
                continue
            assert (got[k] == wanted[0]).all() and figures[k] == wanted[1:]
            r, pad = rings[k], np.pad(wanted[0], 1)
            assert r["area"] == wanted[0].sum() and r["perimeter"] == r["edges"] == sum((np.diff(p.astype(int), axis=a) != 0).sum() for p, a in ((pad, 0), (pad, 1)))
            points = [(p["x"], p["y"]) for p in r["contour"]]
            assert all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(points, points[1:] + points[:1])) and points[0] == min(points, key=lambda p: (p[1], p[0]))


def test_components_of_links_of_any_shape(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(3000 + int(a), 3000 + int(b)) for a, b in rng.integers(0, 150, (120, 2))] + [(5, 5), (9999, 9999)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in linked.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {x: find(x) for x in root}
    assert linked.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_traced_outlines_keep_eight_points_or_stay(spark):
    disc = np.hypot(*np.mgrid[-20:21, -20:21]) < 18
    found = masks.outlined(table(spark, {"disc": disc, "box": np.ones((4, 9), bool)}), KEYS)
    few = {r["image"]: r["contour"] for r in simplified(found, "contour", Segment(smooth_epsilon=0.02)).collect()}
    whole = {r["image"]: r["contour"] for r in found.collect()}
    assert 8 <= len(few["disc"]) < len(whole["disc"]) and len(few["box"]) == 4
