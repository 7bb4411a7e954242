import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.config import MM_TRAITS, Detect, Physical
from granary.functions.exprs import finite, pattern_class
from granary.operators import geometry, outlines, physical, qc, reliability, stats, validation
from granary.operators.photo import profile_scale
from granary.operators.quantiles import summarised


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_finite(spark):
    df = frame(spark, [("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "x string")
    assert [r[0] for r in df.select(finite("x")).collect()] == [1.5, None, None, None, None]


def test_lot_summary_of_odd_columns(spark):
    df = frame(spark, [(1.0, None, 2.0), (2.0, math.nan, 2.0), (3.0, math.inf, 2.0), (10.0, None, 2.0)], "a double, b double, c double")
    rows = {r["trait"]: r for r in stats.lot_summary(df, ["a", "b", "c"]).collect()}
    assert rows.keys() == {"a", "c"}
    assert rows["a"]["skew"] == pytest.approx(1.763632614803888) and rows["a"]["sd"] == pytest.approx(statistics.stdev([1, 2, 3, 10])) and rows["a"]["p25"] == 1.75
    assert rows["c"]["cv_pct"] == 0 and stats.lot_summary(df.limit(0), ["a"]).collect() == []


def test_physical_without_scale_and_density(spark):
    df = frame(spark, [(10.0, 8.0, 60.0, 28.0)], "length_px double, width_px double, area_px2 double, perimeter_px double")
    assert all(physical.to_physical(df, None).first()[c] is None for c in MM_TRAITS)
    row = physical.to_physical(df, 2.0).first()
    assert row["units"] == "mm" and row["length_mm"] == 5 and row["area_mm2"] == 15 and row["mass_mg"] is None
    row = physical.to_physical(df, 2.0, Physical(density_g_cm3=2.0)).first()
    assert row["mass_mg"] == pytest.approx(2 * math.pi / 6 * 5 * 4 * 2.48)
    with pytest.raises(ValueError):
        physical.calibrated_density(df, 0, 5)


def test_qc_reasons_and_missing_measures(spark):
    photos = frame(spark, [("a", 10.0, 0.5, 0.5), ("b", 100.0, 0.0, None), ("c", None, None, math.nan)], "image string, focus double, clip_frac double, illum_cv double")
    photos = photos.withColumn("illum_cv", finite("illum_cv"))
    seeds = frame(spark, [("b", 70.0)] * 5 + [("a", 20.0)], "image string, width_px double")
    rows = {r["image"]: r for r in qc.qc_rules(photos, seeds).collect()}
    assert rows["a"]["qc_reason"] == "; ".join(qc.PHRASES.values()) and not rows["a"]["qc_pass"]
    assert rows["b"]["qc_reason"] == "passes every check" and rows["b"]["size_grade"] == "good"
    assert rows["c"]["qc_reason"] == "too few seeds" and rows["c"]["size_grade"] == "too small"


def test_pattern_of_missing_values(spark):
    df = frame(spark, [(None, None, None, None), (34.0, 9, 0.5, 0.5), (90.0, 12, 0.5, 0.1), (90.0, 3, 0.5, 0.1)], "mean_L double, spot_count int, spot_coverage double, largest_spot double")
    assert [r[0] for r in df.select(pattern_class()).collect()] == ["plain", "black", "dotted", "spotted"]


def test_histogram_of_equal_and_few_values(spark):
    df = frame(spark, [(5.0,)] * 4, "x double")
    assert [r["n"] for r in stats.histogram(df, "x", 3).orderBy("bin").collect()] == [4, 0, 0]
    assert stats.histogram(df.limit(2), "x").collect() == []


def test_a_photograph_matches_itself(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, float(x), float(y), 1000, 800, float(i)) for i, (x, y) in enumerate(rng.uniform(0, 800, (60, 2)))], "seed_id long, cx double, cy double, img_w int, img_h int, length_px double")
    df = df.withColumn("image", F.lit("i"))
    pairs = reliability.matched(df, df)
    assert all(r["seed_a"] == r["seed_b"] and r["image_a"] == "i" for r in pairs.collect()) and pairs.count() == 60
    assert reliability.matching_summary(pairs, "length_px").first()["bias"] == 0
    assert reliability.matching_summary(pairs.limit(0), "length_px").collect() == []


def test_matching_sends_no_photograph_to_the_driver(spark, tmp_path):
    """Spark's estimate of a table's size knows nothing of the copies in cells, so a small table would be broadcast with them."""
    spark.range(6000).selectExpr("id as event_id", "timestamp'2024-01-01' as ts", "pmod(hash(id), 90) as user_id", "'view' as event_type", "id % 50 + 0.5e0 as value", "'' as props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        rows = {r["trait"]: r for r in entry.queries()["matching_summary"](spark, str(tmp_path)).collect()}
        assert entry.queries()["match_seeds"](spark, str(tmp_path)).count() == rows["length_px"]["pairs"] == rows["length_mm"]["pairs"] > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_matching_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    places = [(int(x), int(y)) for x, y in rng.integers(-60, 1060, (300, 2))] + [(30 * k, 120 * (k % 9)) for k in range(40)]  # the latter on edges of cells, a limit apart
    rows = [(k % 2, k, float(x), float(y), 1000, 1000, float(k)) for k, (x, y) in enumerate(places)]
    df = frame(spark, rows, "side int, seed_id long, cx double, cy double, img_w int, img_h int, length_px double").withColumn("image", F.lit("i"))
    a, b = ([(k, x / 1000, y / 1000) for s, k, x, y, *_ in rows if s == side] for side in (0, 1))
    gap = lambda p, q: math.sqrt((p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]))
    nearest = lambda p, others: min(others, key=lambda q: (gap(p, q), q[0]))
    want = {(p[0], q[0]) for p in a for q in [nearest(p, b)] if nearest(q, a) == p and gap(p, q) <= 0.03}
    got = reliability.matched(df.where("side = 0"), df.where("side = 1")).collect()
    assert {(r["seed_a"], r["seed_b"]) for r in got} == want and len(got) == len(want) > 20


def test_traits_summarised_at_once(spark):
    rows = [("i", 1.0, 2.0, 1.0, 5.0, 5.0, 0.0), ("i", 3.0, 5.0, 2.0, 1.0, None, None), ("j", 1.0, 1.0, 0.0, None, 2.0, None)]
    pairs = frame(spark, rows, "image string, x_a double, x_b double, x_diff double, y_a double, y_b double, y_diff double")
    for by in ([], ["image"]):
        one = [tuple(r) for t in "xy" for r in reliability.matching_summary(pairs, t, by).collect()]
        assert sorted(map(str, one)) == sorted(str(tuple(r)) for r in reliability.matching_summary(pairs, ["x", "y"], by).collect()) and len(one) == 2 + len(by)


def test_repeatability_of_matched_pairs(spark):
    rows = [("i", 1, 10.0, 11.0, 1.0), ("i", 2, 12.0, 15.0, 3.0), ("i", 3, 11.0, None, None)]
    got = reliability.matching_summary(frame(spark, rows, "image string, seed_a long, x_a double, x_b double, x_diff double"), "x").first()
    sd = statistics.stdev([1, 3])
    assert got["pairs"] == 2 and got["bias"] == 2 and got["repeatability_cv_pct"] == pytest.approx(100 * sd / statistics.mean([10, 12, 11, 11, 15]))


def test_a_box_dropped_by_a_dropped_box_stays(spark):
    boxes = [("i", 1, 0, 0, 10, 10, 0.9), ("i", 2, 2, 0, 12, 10, 0.8), ("i", 3, 4, 0, 14, 10, 0.7)]
    df = frame(spark, boxes, "image string, seed_id long, x1 int, y1 int, x2 int, y2 int, confidence double")
    assert sorted(r["seed_id"] for r in geometry.deduplicated(df).collect()) == [1, 3]
    assert geometry.deduplicated(df.limit(0)).collect() == []


def test_a_frame_sized_box_and_chains_against_a_loop(spark):
    rng = np.random.default_rng(2)
    boxes = []
    for image in "ab":
        for i in range(150):
            x, y, w, h = rng.integers(0, 300), rng.integers(0, 200), rng.integers(1, 60), rng.integers(1, 60)
            boxes.append((image, i, int(x), int(y), int(x + w), int(y + h), float(rng.integers(0, 20))))
        boxes += [(image, 500, 0, 0, 4000, 3000, 5.0), (image, 501, 5, 5, 5, 90, 9.0), (image, 502, 0, 0, 3990, 3000, None)]
        boxes += [(image, 600 + k, 1000 + 3 * k, 0, 1020 + 3 * k, 20, 90.0 - k) for k in range(30)]  # each in conflict with the next ones
    df = frame(spark, boxes, "image string, seed_id long, x1 int, y1 int, x2 int, y2 int, confidence double")
    area = lambda b: max(0, b[4] - b[2]) * max(0, b[5] - b[3])

    def inter(a, b):
        return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))

    met, kept = set(), []
    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            if a[0] == b[0] and (n := inter(a, b)) and n > 0.3 * (area(a) + area(b) - n):
                met.add((a[0], *sorted((a[1], b[1]))))
    for b in sorted(boxes, key=lambda b: (b[0], -(b[6] if b[6] is not None else -1e9), b[1])):
        near = [(inter(b, k), area(b), area(k)) for k in kept if k[0] == b[0]]
        if not any(n > 0.55 * (p + q - n) and n or n > 0.8 * min(p, q) and min(p, q) for n, p, q in near):
            kept.append(b)
    assert {(r["image"], r["seed_a"], r["seed_b"]) for r in reliability.duplicate_pairs(df, 0.3).collect()} == met and met
    assert sorted((r["image"], r["seed_id"]) for r in geometry.deduplicated(df).collect()) == sorted((b[0], b[1]) for b in kept)


def test_planted_reference_is_found(spark):
    rows = [("a", i, 5 + i / 10) for i in range(40)]
    s = frame(spark, rows, "image string, seed_id long, length_mm double")
    ref = s.withColumn("length_mm", F.col("length_mm") * 1.02)
    got = validation.verdict(validation.agreement(validation.paired(s, ref, "length_mm"))).first()
    assert got["r2"] == pytest.approx(1) and got["bias"] < 0 and got["verdict"] == "agrees"
    assert validation.agreement(validation.paired(s.limit(2), ref, "length_mm")).collect() == []


def test_agreement_by_sample_moments_and_without_spread(spark):
    m, ref = np.array([5.0, 6.0, 7.5, 8.0]), np.array([5.1, 6.4, 7.1, 8.9])
    pairs = lambda m, ref: frame(spark, [(float(x), float(y)) for x, y in zip(m, ref)], "measured double, reference double")
    got = validation.agreement(pairs(m, ref)).first()
    slope, intercept = np.polyfit(ref, m, 1)
    assert got["ccc"] == pytest.approx(2 * np.cov(m, ref)[0, 1] / (m.var(ddof=1) + ref.var(ddof=1) + (m.mean() - ref.mean()) ** 2))
    assert (got["slope"], got["intercept"]) == pytest.approx((slope, intercept)) and got["r2"] == pytest.approx(1 - ((m - slope * ref - intercept) ** 2).sum() / ((m - m.mean()) ** 2).sum())
    flat = validation.verdict(validation.agreement(pairs([0.1] * 4, ref))).first()
    assert flat["r2"] is None and flat["pearson_r"] is None and flat["ccc"] == pytest.approx(0) and flat["slope"] == pytest.approx(0) and flat["verdict"] == "not enough spread to judge"
    both = validation.agreement(pairs([0.0] * 4, [0.0] * 4)).first()
    assert both["ccc"] is None and both["slope"] is None and both["bias_pct"] is None and both["bias"] == 0


def test_columns_of_equal_values_and_zero_ellipses(spark):
    df = frame(spark, [(2.0, 0.0, 0.0, 5.0), (2.0, 3.0, 0.0, 0.0), (2.0, 2.0, 2.0, 3.1)], "c double, length_px double, width_px double, area_px2 double")
    assert stats.lot_summary(df, ["c"]).first()["skew"] == 0
    assert [r["outline_flag"] for r in reliability.outline(df).collect()] == [True, False, False]
    with pytest.raises(Exception, match="no object has a volume"):
        physical.calibrated_density(df.withColumn("volume_mm3", F.lit(None).cast("double")), 5.0, 10).collect()


@pytest.mark.parametrize("gathered", [10**6, 7])
def test_quantiles_of_large_groups(spark, gathered):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=500), "b": np.concatenate([[1e12], rng.integers(0, 4, 300)]), "c": np.full(50, 7.0), "d": np.array([1.5]), None: rng.exponential(size=90)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    df = frame(spark, rows, "g string, x double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in summarised(df, ["g"], "x", probs, [F.max("x").alias("top")], gathered).collect()}
    assert got.keys() == {*values, "empty"} and not any(got["empty"]["quantiles"] or [])
    for g, vs in values.items():
        assert got[g]["quantiles"] == pytest.approx(np.quantile(vs, probs).tolist()) and got[g]["top"] == vs.max()
    assert summarised(df.select("x"), [], "x", [0.5], (), gathered).first()["quantiles"] == pytest.approx([np.median(np.concatenate(list(values.values())))])


def descriptors(points, harmonics, normalize):
    """Plain sums, harmonic by harmonic."""
    step = np.roll(points, -1, 0) - points
    dt = np.maximum(np.hypot(*step.T), 1e-9)
    t = np.cumsum(dt)
    out = []
    for n in range(1, harmonics + 1):
        w = 2 * np.pi * n / t[-1]
        change = [f(w * t) - f(w * (t - dt)) for f in (np.cos, np.sin)]
        out.append([t[-1] / (2 * n * n * np.pi**2) * (step[:, k] / dt * c).sum() for k in (0, 1) for c in change])
    if not normalize:
        return np.array(out)
    (a, b, c, d), m = out[0], []
    theta = 0.5 * np.arctan2(2 * (a * b + c * d), a * a - b * b + c * c - d * d)
    for n, x in enumerate(out, 1):
        z = np.exp(1j * n * theta)
        m.append([[x[0] * z.real + x[1] * z.imag, x[1] * z.real - x[0] * z.imag], [x[2] * z.real + x[3] * z.imag, x[3] * z.real - x[2] * z.imag]])
    psi = np.arctan2(m[0][1][0], m[0][0][0])
    m = np.array([[np.cos(psi), np.sin(psi)], [-np.sin(psi), np.cos(psi)]]) @ np.array(m)
    return (m / abs(m[0, 0, 0])).reshape(-1, 4)


def test_outline_descriptors(spark):
    t = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    shape = np.stack([2 * np.cos(t) + 0.3 * np.cos(3 * t), np.sin(t)], 1)
    turned = 7 * shape @ np.array([[0.6, -0.8], [0.8, 0.6]]) + 3
    rng = np.random.default_rng(5)
    outlines = {1: np.stack([np.cos(t), np.sin(t)], 1), 2: shape, 3: turned, 4: shape[:7], 5: np.repeat(rng.normal(size=(20, 2)), 2, 0), 6: None}
    rows = [(k, None if c is None else [(float(x), float(y)) for x, y in c]) for k, c in outlines.items()]
    df = frame(spark, rows, "k long, contour array<struct<x:double,y:double>>")
    for normalize in (False, True):
        got = {r["k"]: r["efd"] for r in geometry.fourier(df, "k", 5, normalize).collect()}
        assert got[4] is None and got[6] is None
        for k in (1, 2, 3, 5):
            assert got[k] == pytest.approx(descriptors(outlines[k], 5, normalize).ravel().tolist(), abs=1e-9)
    assert np.abs(got[1][:4]) == pytest.approx([1, 0, 0, 1], abs=1e-2) and np.abs(got[2]) == pytest.approx(np.abs(got[3]), abs=1e-6)


def test_hulls_and_ratios(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0), (0.0, 1.0), (0.0, 0.0)]
    rows = [(1, square), (2, [(1.0, 1.0)]), (3, [(0.0, 0.0), (3.0, 4.0)]), (4, []), (5, None)]
    got = {r["k"]: (r["hull_area"], r["hull_perimeter"]) for r in outlines.measured(frame(spark, rows, "k long, contour array<struct<x:double,y:double>>")).collect()}
    assert got == {1: (4, 8), 2: (0, 0), 3: (0, 10), 4: (None, None), 5: (None, None)}
    zero = geometry.morphology(frame(spark, [(0.0, 0.0, 0.0, 0.0)], "length_px double, width_px double, area_px2 double, perimeter_px double")).first()
    assert zero["roundness"] is None and zero["solidity"] is None and zero["eq_diameter_px"] == 0


def test_masks_and_shape_scores(spark):
    full, ring = [[1] * 4] * 4, [[0] * 4, [0, 1, 1, 0], [0, 1, 1, 0], [0] * 4]
    got = geometry.plausible(frame(spark, [(full,), (ring,), (None,)], "mask array<array<int>>")).collect()
    assert [(r["fill"], r["border_touch"], r["plausible"]) for r in got] == [(1, 1, False), (0.25, 0, True), (None, None, False)]
    objects = frame(spark, [("i", k) for k in range(5)], "image string, seed_id long")
    scores = frame(spark, [("i", k, float(k), 0.0, 0.0, 0.0) for k in range(4)], "image string, seed_id long, pc1 double, pc2 double, pc3 double, pc4 double")
    joined = {r["seed_id"]: r["shape_pc1"] for r in geometry.with_scores(objects, scores).collect()}
    assert joined == {0: 0, 1: 1, 2: 2, 3: 3, 4: None} and geometry.with_scores(objects, scores.limit(3)).columns == objects.columns


def test_suppression_and_tiles(spark):
    rows = [("i", 1, 0, 0, 10, 10, 0.9), ("i", 2, 0, 0, 10, 9, 0.8), ("i", 3, 0, 0, 10, 4, 0.7), ("i", 4, 50, 50, 60, 60, 0.05), ("i", 5, 2, 2, 4, 4, 0.6), ("j", 6, 0, 0, 10, 10, 0.3)]
    df = frame(spark, rows, "image string, seed_id long, x1 int, y1 int, x2 int, y2 int, confidence double")
    assert {r["seed_id"] for r in geometry.suppressed(df).collect()} == {1, 3, 4, 5, 6}  # one inside another stays, one mostly alike goes
    assert {r["seed_id"] for r in geometry.detected(df, Detect(max_det=2)).collect()} == {1, 3, 6}
    frames = frame(spark, [("a", 100, 30), ("b", 0, 5), ("c", None, None), ("d", 9, 9)], "image string, img_w int, img_h int")
    got = {}
    for r in geometry.tiles(frames, 40, 0.25).collect():
        got.setdefault(r["image"], set()).add((r["x1"], r["y1"], r["x2"], r["y2"]))
    assert got == {"a": {(0, 0, 40, 30), (30, 0, 70, 30), (60, 0, 100, 30)}, "d": {(0, 0, 9, 9)}}


def test_profiles_without_a_period(spark):
    wave = [float(i % 6 == 0) for i in range(120)]
    rows = [(1, wave), (2, [5.0] * 50), (3, []), (4, None), (5, [1.0, 2.0]), (6, np.random.default_rng(0).random(400).tolist())]
    got = {r["k"]: (r["px_per_mm"], r["strength"]) for r in profile_scale(frame(spark, rows, "k long, profile array<double>"), ["k"], 2.0).collect()}
    assert got[1][0] == 3 and got[1][1] > 0.8 and got[2] == got[3] == got[4] == got[5] == (None, None) and got[6][0] is None


def test_principal_axes_of_a_line(spark):
    df = frame(spark, [(i, [1.0, 0.0, 0.0, 1.0, float(i), 2.0 * i, 0.0, 1.0]) for i in range(9)] + [(99, None)], "vec_id long, efd array<double>")
    rows = geometry.principal(df, "vec_id").orderBy("vec_id").toPandas()
    assert rows["pc1"].to_numpy() == pytest.approx((np.arange(9) - 4) * 5**0.5) and rows["pc2"].abs().max() < 1e-9
    assert geometry.principal(df.limit(2), "vec_id").collect() == []


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 4
    assert entry.oracle_sql().keys() <= entry.queries().keys()
