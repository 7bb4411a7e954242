import math

import numpy as np
from pyspark.sql import functions as F

from granary.llm import ann
from granary.llm.ann import Codebook, directions, fit, nearest, packed, unpacked


def distance(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist()):  # sum() would compensate for rounding
        total += (a - b) ** 2
    return math.sqrt(total)


def brute(rows, top):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((distance(x, y), i) for i, y in ok if i != q)[:top]
            out |= {(q, k + 1, i, d) for k, (d, i) in enumerate(near)}
    return out


def rows_of(seed=0, n=900, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[300:600] = x[300]  # copies
    x[600:700] = x[600] + rng.normal(size=(100, d)).astype(np.float32) * 1e-3
    x[50] *= 1e4
    return [(i, v.tolist()) for i, v in enumerate(x)]


def search(spark, rows, top=10):
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<float>, score double, rank string").repartition(5)
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(spark, df, df.where(F.col("vec_id") % 100 == 0), top).collect()]


def test_neighbours_are_the_true_ones(spark):
    rows = rows_of()
    rows[5] = (5, [0.0] * 16)
    rows[200], rows[7], rows[8], rows[9] = (200, None), (7, [None] * 16), (8, [float("nan")] + [1.0] * 15), (9, [float("inf")] + [1.0] * 15)
    found = search(spark, rows)
    want = brute(rows, 10)
    assert len(found) == len(want) and {f[:3] for f in found} == {w[:3] for w in want}
    scores = {w[:3]: w[3] for w in want}
    assert all(f[3] == scores[f[:3]] for f in found)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0])]
    assert {f[:3] for f in search(spark, rows)} == {(0, 1, 1), (0, 2, 2)}
    assert search(spark, rows[:1]) == [] and search(spark, []) == []


def test_huge_tiny_and_mixed_components(spark):
    rows = rows_of(3, 700)
    for k, factor in enumerate((1e20, 1e30, 1e-30, 3e38, 1e-40, 1e18)):
        for i in range(100 * k, 100 * k + 40):
            rows[i] = (i, [float(np.float32(np.clip(v * factor, -3.4e38, 3.4e38))) for v in rows[i][1]])
    found, want = search(spark, rows), brute([(i, np.array(v, np.float32).tolist()) for i, v in rows], 10)
    assert set(found) == want and len(found) == 70


def test_vectors_of_several_lengths_meet_their_own(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)  # several blocks of queries
    rows = rows_of(5)
    rows = [(i, v[:9] if i % 3 == 0 else v[:5] if i % 50 == 1 else v) for i, v in rows] + [(1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (1100, [0.5] * 40)]
    want = set()
    for d in (2, 5, 9, 16, 40):
        want |= brute([(i, v) for i, v in rows if len(v) == d], 10)
    assert set(search(spark, rows)) == want


def test_codes_are_packed_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 7))
    norm, unit = directions(x)
    book = fit(unit)
    codes = book.encode(unit)
    assert (unpacked(packed(codes), 7) == codes).all() and np.allclose(norm, np.linalg.norm(x, axis=1))


def test_codes_prefer_the_parallel_part():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = fit(x, width=1, threshold=0.5)
    plain = Codebook(book.centres, 1.0)
    along = lambda b: np.abs(((x - b.decode(b.encode(x))) * x).sum(1)).mean()
    assert book.weight > 1 and along(book) < 0.6 * along(plain)
