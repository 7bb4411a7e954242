import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.exprs import hex_colour, hue_angle, moved
from granary.operators import geometry, photo, reliability, repeatability, stats, validation
from granary.plans.__main__ import main
from granary.plans.run import Settings, assumptions, px_per_mm
from granary.sources import export, files
from granary.streaming import trays


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def png(bgr):
    """Bytes of a PNG file."""
    h, w, _ = bgr.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bgr[i, :, ::-1].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


BOXES = "image string, seed_id long, x1 int, y1 int, x2 int, y2 int, img_w int, img_h int"


def test_a_turn_four_times_is_no_turn(spark):
    df = frame(spark, [("a", 1, 10, 20, 30, 60, 100, 80)], BOXES)
    back = df
    for _ in range(4):
        back = repeatability.replicates(back, ("rot90",)).drop("replicate", "factor")
    assert back.collect() == df.collect()
    rows = {r["replicate"]: r for r in repeatability.replicates(df, ("flip_h", "flip_v", "rot90", "rot180", "scale_50")).collect()}
    assert (rows["flip_h"]["x1"], rows["flip_v"]["y1"], rows["rot90"]["x1"], rows["rot180"]["x2"], rows["scale_50"]["y2"]) == (70, 20, 20, 90, 30)
    for bad in ("shear", "scale_x", "scale_0"):
        with pytest.raises(ValueError):
            repeatability.replicates(df, (bad,))


def test_noise_of_replicates(spark):
    means = frame(spark, [("a", "original", 4, 10.0, 0.0, None), ("a", "rot90", 4, 10.2, 0.0, 1.0), ("a", "scale_80", 2, 9.9, 0.0, None)], "image string, replicate string, n_seeds long, length_px double, z double, one double")
    row = repeatability.noise(means, ["length_px", "z", "one"]).collect()
    assert [r["trait"] for r in row] == ["length_px"] and row[0]["max_shift_pct"] == pytest.approx(2) and row[0]["verdict"] == "acceptable"
    assert row[0]["cv_pct"] == pytest.approx(100 * np.std([10, 10.2, 9.9], ddof=1) / np.mean([10, 10.2, 9.9]))
    assert repeatability.count_noise(means).first()["count_cv_pct"] == pytest.approx(100 * np.std([4, 4, 2], ddof=1) / np.mean([4, 4, 2]))
    assert repeatability.noise(means.limit(0), ["length_px"]).collect() == []
    scaled = frame(spark, [("a", "scale_80", 0.8, 8.0, 64.0, 0.5)], "image string, replicate string, factor double, length_px double, area_px2 double, roundness double")
    r = repeatability.replicate_means(scaled, ["length_px", "area_px2", "roundness"]).first()
    assert (r["length_px"], r["area_px2"], r["roundness"]) == (pytest.approx(10), pytest.approx(100), 0.5)


def test_photographs_are_found_decoded_and_measured(spark, tmp_path):
    rng = np.random.default_rng(3)
    flat = np.full((40, 60, 3), 128, np.uint8)
    busy = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    lamp = np.repeat(np.linspace(40, 220, 60)[None, :, None], 40, 0).repeat(3, 2).astype(np.uint8)
    (tmp_path / "in").mkdir()
    for name, bgr in (("flat.PNG", flat), ("in/busy.png", busy), ("in/lamp.png", lamp)):
        (tmp_path / name).write_bytes(png(bgr))
    (tmp_path / "broken.jpg").write_bytes(b"no picture")
    (tmp_path / "notes.txt").write_text("x")
    images = files.photographs(spark, str(tmp_path))
    assert sorted(r["name"] for r in images.select("name").collect()) == ["busy.png", "flat.PNG", "lamp.png"]
    m = {r["image"].rpartition("/")[2]: r for r in photo.photo_metrics(images).collect()}
    assert m["flat.PNG"]["focus"] == 0 and m["flat.PNG"]["illum_cv"] == pytest.approx(0, abs=1e-9) and m["flat.PNG"]["colour_cast"] < 0.1 and m["flat.PNG"]["mean_intensity"] == 128
    grey = np.rint(busy @ np.array([0.114, 0.587, 0.299]))
    at = lambda i, j: grey[abs(i) if i < 40 else 78 - i, abs(j) if j < 60 else 118 - j]
    brute = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j) for i in range(40) for j in range(60)]
    assert m["busy.png"]["focus"] == pytest.approx(np.var(brute)) and m["busy.png"]["clip_low"] == (grey <= 2).mean()
    assert m["lamp.png"]["illum_cv"] > 0.3 and (m["lamp.png"]["width"], m["lamp.png"]["height"]) == (60, 40)
    field = photo.light_field(images, 6).where("image like '%lamp%'").groupBy("col").agg(F.avg("level").alias("v")).orderBy("col").collect()
    assert len(field) == 6 and all(a["v"] < b["v"] for a, b in zip(field, field[1:]))
    assert photo.photo_metrics(images.limit(0)).collect() == []


def test_blurred_means_against_brute_force():
    x = np.random.default_rng(0).uniform(size=50)
    k = photo.gauss(2.0)
    blurred = np.convolve(np.pad(x, len(k) // 2, "reflect"), k, "valid")
    assert photo.blurred_means(50, 5, 2.0) @ x == pytest.approx(blurred.reshape(5, 10).mean(1))


def test_a_red_cast_is_seen():
    a, b = photo.lab_ab(np.array([[0, 0, 255]]))[0]
    assert a == pytest.approx(80.1, abs=0.3) and b == pytest.approx(67.2, abs=0.3)


def test_marks_of_a_ruler(spark):
    strip = np.full((20, 400, 3), 250, np.uint8)
    strip[:, ::16] = strip[:, 1::16] = 10
    rows = [(n, {"height": h, "width": w, "nChannels": 3, "data": bytearray(x.tobytes())}) for n, h, w, x in (("r", 20, 400, strip), ("tall", 400, 20, strip.transpose(1, 0, 2)), ("blank", 20, 400, np.full((20, 400, 3), 99, np.uint8)))]
    got = {r["image"]: r["px_per_mm"] for r in photo.ruler_scale(frame(spark, rows, "path string, image struct<height int, width int, nChannels int, data binary>"), 2.0).collect()}
    assert got == {"r": 8.0, "tall": 8.0, "blank": None}


def test_reference_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image,seed_id,length_mm,note\ni,1,5.5,x\ni,2,long,y\n")
    rows = files.reference_sheet(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["image", "seed_id", "length_mm"] and [tuple(r) for r in rows.collect()] == [("i", 1, 5.5), ("i", 2, None)]
    (tmp_path / "b.csv").write_text("image,height\ni,1\n")
    with pytest.raises(ValueError):
        files.reference_sheet(spark, str(tmp_path / "b.csv"))


def test_expressions(spark):
    row = frame(spark, [(0.0, -1.0, 255.9, None)], "a double, b double, r double, g double").select(
        hue_angle(F.col("a"), F.col("b")), hex_colour(F.col("r"), F.lit(0), F.lit(10)), hex_colour(F.col("r"), F.col("g"), F.lit(10))
    ).first()
    assert row[0] == 270 and row[1] == "#FF000A" and row[2] is None
    outline = frame(spark, [([(1, 2)],)], "contour array<struct<x int, y int>>").select(moved("contour", F.lit(3), F.lit(4)).alias("c")).first()["c"]
    assert [tuple(p) for p in outline] == [(4, 6)]


def test_principal_axes_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(30, 8)) * np.arange(1, 9)
    efd = frame(spark, [(i, [1.0, 0.0, 0.0, 1.0, *map(float, v)]) for i, v in enumerate(x)] + [(99, None)], "vec_id long, efd array<double>")
    model = geometry.principal_axes(efd, 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    share = s**2 / (s**2).sum()
    got = geometry.explained(spark, model).orderBy("pc").toPandas()
    assert got["explained"].to_numpy() == pytest.approx(share[:3]) and got["explained_cum"].to_numpy() == pytest.approx(np.cumsum(share)[:3])
    ends = {r["side"]: np.array(r["efd"]) for r in geometry.along(spark, model, 1).collect()}
    assert np.linalg.norm(ends[1] - ends[-1]) == pytest.approx(4 * (u[:, 1] * s[1]).std()) and (ends[1] + ends[-1])[4:] / 2 == pytest.approx(x.mean(0))
    assert geometry.principal_axes(efd.limit(2)) is None and geometry.explained(spark, None).collect() == [] and geometry.along(spark, None).collect() == []


def test_an_outline_comes_back(spark):
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    points = [(float(3 * np.cos(a)), float(2 * np.sin(a))) for a in t]
    df = frame(spark, [(1, points), (2, points[:5])], "vec_id long, contour array<struct<x double, y double>>")
    rows = geometry.reconstructed(geometry.fourier(df, "vec_id", normalize=False), "vec_id", 50).toPandas()
    assert len(rows) == 50 and np.abs((rows["x"] / 3) ** 2 + (rows["y"] / 2) ** 2 - 1).max() < 0.02


def test_totals_and_limits(spark):
    s = frame(spark, [("a", 1, "c", "plain", 0.9), ("a", 2, "c", "dotted", 0.2), ("b", 3, "d", "plain", 0.5), ("b", 4, "d", None, None)], "image string, seed_id long, cls string, pattern_class string, confidence double")
    assert tuple(stats.off_diagonal(s, {"c": "plain"}).first()) == (2, 0.5)
    assert [r["seed_id"] for r in reliability.above(s, 0.3, 1).orderBy("seed_id").collect()] == [1, 3]
    assert tuple(reliability.confidence_margin(s, 0.1).first()) == (0.2, True) and tuple(reliability.confidence_margin(s.limit(0), 0.1).first()) == (None, False)
    assert [tuple(r) for r in stats.available(s, ["confidence", "none"]).collect()] == [("confidence", 3, True), ("none", 0, False)]
    sheet = stats.template(s, n=3)
    assert sheet.columns == ["image", "seed_id", "length_mm", "width_mm"] and sheet.count() == 3 and sheet.collect() == stats.template(s, n=3).collect()
    assert [r["ordinal"] for r in stats.ordinals(s, [F.col("confidence").desc_nulls_last()]).orderBy("seed_id").collect()] == [0, 1, 0, 1]


def test_few_values_show_no_drift(spark):
    rows = [(float(i % 4), float(i // 4), 10, 10, float(i % 4)) for i in range(16)]
    schema = "cx double, cy double, img_w int, img_h int, length_px double"
    got = reliability.drift_reading(reliability.position_drift(frame(spark, rows, schema), ["length_px"])).first()
    assert got["r2"] == pytest.approx(1) and got["reading"].startswith("the place")
    assert reliability.position_drift(frame(spark, rows[:11], schema), ["length_px"]).collect() == []


def test_validation_of_each_trait(spark):
    s = frame(spark, [("a", i, 5 + i / 10, 3.0 + i % 7) for i in range(40)], "image string, seed_id long, length_mm double, width_mm double")
    ref = s.withColumn("width_mm", F.col("width_mm") * 2)
    rows = {r["trait"]: r for r in validation.validated(s, ref, ("length_mm", "width_mm", "none")).collect()}
    assert rows["length_mm"]["verdict"] == "agrees" and rows["width_mm"]["slope"] == pytest.approx(0.5) and len(rows) == 2


def test_assumptions():
    assert len(assumptions(Settings())) == 1 and len(assumptions(Settings(px_per_mm=10.0))) == 3
    assert px_per_mm(100, 8) == 12.5
    with pytest.raises(ValueError):
        px_per_mm(0, 1)


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_a_run_is_written(spark, tmp_path, kind):
    from granary.sources import adapter

    d = "/root/testdata/sf0.001"
    for name, df in (("seeds", adapter.seeds(spark, d)), ("photos", adapter.photographs(spark, d))):
        df.write.parquet(str(tmp_path / name))
    out = tmp_path / "out"
    assert main([str(tmp_path / "seeds"), str(tmp_path / "photos"), str(out), "--px-per-mm", "12.5", "--format", kind]) == 0
    n = spark.read.parquet(str(tmp_path / "seeds")).count()
    assert spark.read.parquet(f"{out}/tables/per_seed").count() == n
    config = json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/config").collect()))
    assert config["px_per_mm"] == 12.5 and config["qc"]["focus_min"] == 60
    assert f"{n} objects" in spark.read.text(f"{out}/summary").first()[0]
    page = "".join(r[0] for r in spark.read.text(f"{out}/report").collect())
    assert "<h2>quality_control</h2>" in page and page.count("<rect") == 30
    back = spark.read.option("header", True).csv(f"{out}/tables/lot_statistics") if kind == "csv" else spark.read.json(f"{out}/tables/lot_statistics")
    assert {r["trait"] for r in back.collect()} >= {"length_mm", "volume_mm3"}
    spark.createDataFrame([], spark.read.parquet(str(tmp_path / "seeds")).schema).write.parquet(str(tmp_path / "none"))
    if kind == "json":
        assert main([str(tmp_path / "none"), str(tmp_path / "photos"), str(tmp_path / "out2")]) == 1


def test_names_for_internal_use_are_left_out(spark):
    df = frame(spark, [(1, 2, [1])], "a int, _mask int, c array<int>")
    assert [tuple(r) for r in export.cleaned(df).collect()] == [(1, "[1]")]


def test_rows_that_arrive_are_taken_once(spark, tmp_path):
    schema = "ts timestamp, cls string, value double"
    add = lambda rows: frame(spark, rows, schema).selectExpr("cast(ts as timestamp) as ts", "cls", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    add([(at(1), "a", 1.0), (at(1), "b", 2.0)])
    stream = lambda: trays.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    counts = lambda: trays.windowed(stream(), "ts", "1 hour", "1 day", ["value"])
    for _ in range(2):  # the second time finds nothing new
        trays.appended(stream(), str(tmp_path / "rows"), str(tmp_path / "c1"))
        trays.updated(counts(), str(tmp_path / "batches"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2
    add([(at(1), "a", 3.0), (at(5), "a", 4.0)])
    trays.updated(counts(), str(tmp_path / "batches"), str(tmp_path / "c2"))
    rows = trays.latest(spark, str(tmp_path / "batches"), counts().schema, ["start", "cls"]).collect()
    assert sorted((r["cls"], r["n"], r["value_sum"], r["value_squares"]) for r in rows) == [("a", 1, 4.0, 16.0), ("a", 2, 4.0, 10.0), ("b", 1, 2.0, 4.0)]
