import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.hard_negatives import Best, mined, window

SCHEMA = "vec_id long, label int, embedding array<double>, score string, `key` string, rank array<int>"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    ok = [(k, i, str((n + 1) % 10 if i % 7 == 0 else n), [math.floor(Fraction(v) * 256) for v in x]) for k, (i, n, x) in enumerate(rows) if None not in (i, n, x) and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for k, i, n, x in ok:
        if i % 50:
            continue
        near = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), j, m, o) for m, j, o, y in ok if m != k and len(y) == len(x)]
        for p, j, *_ in sorted(t for t in near if t[3] == n)[:positives]:
            inside = sorted(t for t in near if t[3] != n and low * -p <= 100 * -t[0] <= high * -p)
            out += [(i, j, r + 1, t[1], -p, -t[0]) for r, t in enumerate(inside[:negatives])]
    return sorted(out)


def run(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", "y", [1]) for r in rows], SCHEMA).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, mined(spark, df, F.col("vec_id") % 50 == 0, label, **args).collect()))


def rows_of(seed=0, n=600, d=6, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 1
    x[100:260] = x[100]  # one very common vector
    return [(i, int(rng.integers(labels)), v.tolist()) for i, v in enumerate(x)]


def test_is_as_brute_force(spark):
    rows = rows_of()
    assert run(spark, rows) == brute(rows) != []


def test_blocks_of_anchors_give_the_same(spark):
    rows = rows_of(1)
    assert run(spark, rows, anchor_block=3) == brute(rows)


def test_other_numbers(spark):
    rows = rows_of(2, labels=2)
    assert run(spark, rows, positives=2, negatives=9, low=10, high=100) == brute(rows, 2, 9, 10, 100)


def test_nulls_lengths_repeats_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(3, 120) + [(50, None, [1.0] * 6), (None, 1, [1.0] * 6), (51, 1, None), (52, 1, [nan] * 6), (53, 1, [inf] * 6), (54, 1, [None] * 6), (700, 1, []), (701, 1, []), (702, 2, [])]
    rows += [(750, 1, [1.0, 2.0]), (751, 1, [1.0, 1.9]), (752, 2, [1.0, 1.5]), (752, 2, [1.0, 1.5]), (800, 1, [0.0] * 6), (50, 2, rows[50][2]), (50, 2, rows[50][2]), (850, 0, [-1.0] * 6)]
    assert run(spark, rows) == brute(rows)


def test_scores_that_doubles_would_round_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), [float(v) for v in rng.integers(-(2**40), 2**40, 3)]) for i in range(60)] + [(100 + i, i % 2, [2.0**18 + i / 256, 1.0, 0.0]) for i in range(20)]
    rows += [(200, 1, [1e300, 1.0, 1.0]), (201, 1, [1e300, 1.0, 1.0]), (203, 0, [1e10, 1.0, 1.0]), (250, 1, [1e308, 1e308, -1e308]), (251, 0, [-1e308, 1.0, 1.0])]
    assert run(spark, rows, low=1) == brute(rows, low=1)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0])]) == []
    assert run(spark, [(50, 1, [1.0]), (51, 2, [1.0])]) == []


@pytest.mark.parametrize("positive", [-7, -1, 0, 1, 2, 3, 99, 100, 10**17])
def test_window_is_exact(positive):
    lo, hi = window(positive, 50, 95)
    for s in (lo - 1, lo, hi, hi + 1):
        assert (lo <= s <= hi) == (50 * positive <= 100 * s <= 95 * positive)


def test_best_keeps_the_first_of_ties():
    b = Best(3)
    for ids in ([9, 4], [7, 2, 8], [1]):
        b.add(np.full(len(ids), 5), np.array(ids), np.array(ids))
    b.add(np.array([6]), np.array([10]), np.array([10]))
    assert b.id.tolist() == [10, 1, 2]
