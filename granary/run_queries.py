"""More named queries: repeatability, totals, shapes, whole runs, streams."""

from pyspark.sql import functions as F

from granary.config import Physical
from granary.functions.exprs import edge_cut, hex_colour, hue_angle, moved
from granary.functions.storage import new_folder
from granary.operators import geometry, qc, reliability, repeatability, stats, validation
from granary.operators.photo import profile_scale
from granary.plans.run import Settings, measured, passing, px_per_mm, resting_on
from granary.queries import DEDUP_SQL, EFD_SQL, POINTS_SQL, _descriptors, _pca, PAIRS_SQL, QC_SQL, S, SCALE, VERDICT_SQL, agree_sql, calibrated, caliper, query, r, rounded, seeds
from granary.sources import adapter, export, files
from granary.streaming import trays

_KINDS = ("original", "flip_h", "flip_v", "rot90", "rot180", "scale_80")
_BOX = {
    "flip_h": ("img_w - x2", "y1", "img_w - x1", "y2", "img_w", "img_h"), "flip_v": ("x1", "img_h - y2", "x2", "img_h - y1", "img_w", "img_h"), "rot90": ("img_h - y2", "x1", "img_h - y1", "x2", "img_h", "img_w"),
    "rot180": ("img_w - x2", "img_h - y2", "img_w - x1", "img_h - y1", "img_w", "img_h"), "scale_80": tuple(f"trunc({c} * 8e-1)" for c in ("x1", "y1", "x2", "y2", "img_w", "img_h")),
}
_NAMES = ("x1", "y1", "x2", "y2", "img_w", "img_h")
_PLACED = ", ".join(f"CAST(CASE replicate {' '.join(f"WHEN '{k}' THEN {e[i]}" for k, e in _BOX.items())} ELSE {n} END AS INT) AS {n}" for i, n in enumerate(_NAMES))
REPLICATES_SQL = f"(SELECT image, seed_id, replicate, factor, {_PLACED} FROM {S}, (VALUES {', '.join(f"('{k}', {8 if k == 'scale_80' else 10}e-1)" for k in _KINDS)}) AS t(replicate, factor))"
MEANS_SQL = f"""(SELECT image, replicate, count(*) AS n_seeds, avg(greatest(x2 - x1, y2 - y1) / factor) AS length_px, avg((x2 - x1) * (y2 - y1) / (factor * factor)) AS area_px2 FROM {REPLICATES_SQL} GROUP BY ALL)"""
NOISE_SQL = f"""(SELECT image, trait, original, mean, sd, 100 * sd / abs(mean) AS cv_pct, 100 * greatest(hi - original, original - lo) / nullif(abs(original), 0) AS max_shift_pct FROM
(SELECT image, trait, max(x) FILTER (replicate = 'original') AS original, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM (UNPIVOT {MEANS_SQL} ON length_px, area_px2 INTO NAME trait VALUE x) GROUP BY ALL HAVING count(x) >= 2 AND avg(x) <> 0))"""
_TRAITS = ["length_px", "area_px2"]


def _means(spark, d):
    boxes = repeatability.replicates(seeds(spark, d), _KINDS)
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return repeatability.replicate_means(boxes.withColumns({"length_px": F.greatest(wide, high), "area_px2": wide * high}), _TRAITS)


@query(f"SELECT * FROM {REPLICATES_SQL}")
def box_transforms(spark, d):
    return repeatability.replicates(seeds(spark, d), _KINDS)


@query(f"SELECT image, replicate, n_seeds, {r('length_px AS length_px; area_px2 AS area_px2', 4)} FROM {MEANS_SQL}")
def replicate_means(spark, d):
    return rounded(_means(spark, d), 4)


@query(f"SELECT image, trait, CASE WHEN cv_pct < 1 THEN 'stable' WHEN cv_pct < 3 THEN 'acceptable' ELSE 'noisy' END AS verdict, {r('original AS original; mean AS mean; sd AS sd; cv_pct AS cv_pct; max_shift_pct AS max_shift_pct', 4)} FROM {NOISE_SQL}")
def repeatability_noise(spark, d):
    return rounded(repeatability.noise(_means(spark, d), _TRAITS), 4)


@query(f"SELECT image, trait, {r('cv_pct AS cv_pct', 4)} FROM {NOISE_SQL} QUALIFY row_number() OVER (PARTITION BY image ORDER BY cv_pct DESC, trait) = 1")
def noisiest_trait(spark, d):
    return rounded(repeatability.noisiest(repeatability.noise(_means(spark, d), _TRAITS)), 4)


@query(f"SELECT image, {r('100 * stddev_samp(n_seeds) / avg(n_seeds) AS count_cv_pct')} FROM {MEANS_SQL} GROUP BY image")
def replicate_count_noise(spark, d):
    return rounded(repeatability.count_noise(_means(spark, d)))


_KEPT = "(SELECT * FROM {S} WHERE confidence >= 25e-2 QUALIFY row_number() OVER (PARTITION BY image ORDER BY confidence DESC, seed_id) <= 40)".format(S=S)


@query(f"SELECT image, seed_id, {r('confidence AS confidence')} FROM {_KEPT}")
def detections_above(spark, d):
    return rounded(reliability.above(seeds(spark, d), 0.25, 40).select("image", "seed_id", "confidence"))


@query(f"""SELECT a.image, raw_detections, coalesce(kept, 0) AS kept, raw_detections - coalesce(kept, 0) AS duplicates_removed, coalesce(truncated, 0) AS truncated, 'whole frame at 640 px' AS strategy, {r('mean_confidence AS mean_confidence')} FROM (SELECT image, count(*) AS raw_detections FROM {S} GROUP BY image) AS a
LEFT JOIN (SELECT image, count(*) AS kept, count(*) FILTER (x1 <= 2 OR y1 <= 2 OR x2 >= img_w - 2 OR y2 >= img_h - 2) AS truncated, avg(confidence) AS mean_confidence FROM {DEDUP_SQL} GROUP BY image) AS k ON a.image = k.image""")
def detection_report(spark, d):
    s = seeds(spark, d)
    return rounded(reliability.detection_report(s, geometry.deduplicated(s), reliability.strategy(1000, 800)))


@query(f"SELECT {r('min(confidence) AS least_confidence')}, min(confidence) > 15e-1 * 3e-2 AS clear FROM {S}")
def confidence_margin(spark, d):
    return rounded(reliability.confidence_margin(seeds(spark, d), 0.03))


@query(f"SELECT image, seed_id, (row_number() OVER (PARTITION BY image ORDER BY confidence DESC, seed_id) - 1)::INT AS ordinal FROM {S}")
def image_ordinals(spark, d):
    return stats.ordinals(seeds(spark, d), [F.col("confidence").desc(), F.col("seed_id")]).select("image", "seed_id", "ordinal")


@query(f"SELECT trait, n, n > 0 AS present FROM (UNPIVOT (SELECT count(length_px) AS length_px, 0::BIGINT AS mass_mg FROM {S}) ON length_px, mass_mg INTO NAME trait VALUE n)")
def trait_menu(spark, d):
    return stats.available(seeds(spark, d).withColumn("mass_mg", F.lit(None).cast("double")), ["length_px", "mass_mg"])


@query(f"SELECT count(*) AS photographs, count(*) FILTER (qc_pass) AS passed, {r('median(focus) AS median_focus; median(illum_cv) AS median_illum_cv')} FROM {QC_SQL}")
def quality_totals(spark, d):
    return rounded(stats.quality_totals(qc.qc_rules(adapter.photographs(spark, d), seeds(spark, d))))


@query(f"""WITH m AS (SELECT *, median(area_px2) OVER (PARTITION BY image) AS ma, median(confidence) OVER (PARTITION BY image) AS mc FROM {S})
SELECT count(*) AS detected, (SELECT count(*) FROM {PAIRS_SQL} WHERE iou > 30e-2) AS duplicate_pairs, count(*) FILTER (area_px2 > 18e-1 * ma OR fragments > 0) AS merged_suspects, count(*) FILTER (x1 <= 2 OR y1 <= 2 OR x2 >= img_w - 2 OR y2 >= img_h - 2) AS edge_truncated,
count(*) FILTER (confidence < 5e-1 * mc) AS weak_detections FROM m""")
def check_totals(spark, d):
    return stats.check_totals(reliability.detection_checks(seeds(spark, d)))


@query(f"SELECT {r('11e-1 * quantile_cont(area_px2, 99e-2) AS axis_limit', 4)} FROM {S}")
def axis_limit(spark, d):
    return rounded(stats.axis_limit(seeds(spark, d), "area_px2"), 4)


_EXPECTED = {"click": "spotted", "view": "dotted", "purchase": "black"}


@query(f"SELECT count(*) AS n, {r('avg((pattern_class <> e)::INT) AS off_diagonal')} FROM {S} JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _EXPECTED.items())}) AS x(c, e) ON c = cls")
def off_diagonal(spark, d):
    return rounded(stats.off_diagonal(seeds(spark, d), _EXPECTED))


@query(f"SELECT image, seed_id, CAST(NULL AS DOUBLE) AS length_mm, CAST(NULL AS DOUBLE) AS width_mm FROM {S} ORDER BY md5('0:' || image || ':' || seed_id), image, seed_id LIMIT 20")
def reference_template(spark, d):
    """A blank sheet for twenty objects, written and read back."""
    return files.reference_template(spark, seeds(spark, d), new_folder(spark, "template"))


@query(f"SELECT image, seed_id FROM {S} WHERE cls = 'click' ORDER BY image, seed_id LIMIT 24")
def class_gallery(spark, d):
    return stats.top(seeds(spark, d).where("cls = 'click'").select("image", "seed_id"), [F.col("image"), F.col("seed_id")], 24)


@query(f"SELECT seed_id, {r('mean_L * 100 / 255 AS light')}, format('#{{:02X}}{{:02X}}{{:02X}}', trunc(mean_L)::INT, (event_id_ % 256)::INT, (spot_count * 12)::INT) AS hex, {r("((degrees(atan2(mean_L - 50, spot_count - 10)) % 360) + 360) % 360 AS hue_angle")} FROM (SELECT *, seed_id AS event_id_ FROM {S})")
def colour_columns(spark, d):
    light, n, k = (F.col(c) for c in ("mean_L", "spot_count", "seed_id"))
    return rounded(seeds(spark, d).select("seed_id", (light * 100 / 255).alias("light"), hex_colour(light, k % 256, n * 12).alias("hex"), hue_angle(n - 10, light - 50).alias("hue_angle")))


@query(f"SELECT vec_id, i::INT AS i, {r('x + 10 AS x; y - 20 AS y')} FROM {POINTS_SQL}")
def outline_moved(spark, d):
    rows = adapter.outlines(spark, d).select("vec_id", F.posexplode(moved("contour", F.lit(10.0), F.lit(-20.0))).alias("i", "p"))
    return rounded(rows.select("vec_id", "i", "p.x", "p.y"))


@query(f"SELECT vec_id, i::INT AS i, {r('sum(a * cos(2 * pi() * n * i / 59) + b * sin(2 * pi() * n * i / 59)) AS x; sum(c * cos(2 * pi() * n * i / 59) + d * sin(2 * pi() * n * i / 59)) AS y')} FROM {EFD_SQL}, range(60) AS t(i) GROUP BY ALL")
def efd_reconstruct(spark, d):
    return rounded(geometry.reconstructed(geometry.fourier(adapter.outlines(spark, d), "vec_id", normalize=False), "vec_id", 60))


_ALL_PC = " UNION ALL ".join(f"SELECT {i} AS pc, variance FROM v{i}" for i in range(1, 5))


@query(f"WITH RECURSIVE {_pca(_descriptors())} SELECT pc::INT AS pc, {r('variance / total AS explained; sum(variance / total) OVER (ORDER BY pc) AS explained_cum', 5)} FROM ({_ALL_PC}), (SELECT list_sum(list_transform(range(36), lambda i: m[i + 1][i + 1])) AS total FROM cov)")
def pca_explained(spark, d):
    return rounded(geometry.explained(spark, geometry.principal_axes(geometry.fourier(adapter.outlines(spark, d), "vec_id"))), 5)


@query(f"""WITH RECURSIVE {_pca(_descriptors(), 1)}, ends AS (SELECT side, list_concat([1e0, 0e0, 0e0, 0e0], list_transform(range(36), lambda i: mean[i + 1] + side * 2 * sqrt(variance * (n - 1) / n) * v[i + 1])) AS e FROM mean, v1, n, (VALUES (-1), (1)) AS t(side))
SELECT side, i::INT AS i, {r('list_sum(list_transform(range(10), lambda h: e[4 * h + 1] * cos(2 * pi() * (h + 1) * i / 179) + e[4 * h + 2] * sin(2 * pi() * (h + 1) * i / 179))) AS x; list_sum(list_transform(range(10), lambda h: e[4 * h + 3] * cos(2 * pi() * (h + 1) * i / 179) + e[4 * h + 4] * sin(2 * pi() * (h + 1) * i / 179))) AS y', 3)} FROM ends, range(180) AS t(i)""")
def shape_along_pc(spark, d):
    ends = geometry.along(spark, geometry.principal_axes(geometry.fourier(adapter.outlines(spark, d), "vec_id")))
    return rounded(geometry.reconstructed(ends, "side"), 3)


_WIDTH = "(width_mm * 98e-2 + ((seed_id * 31) % 11 - 5) / 100e0)"
_VALID = f"(SELECT 'length_mm' AS trait, length_mm AS measured, {adapter.CALIPER} AS reference FROM {S} WHERE seed_id % 4 = 0 UNION ALL SELECT 'width_mm', width_mm, {_WIDTH} FROM {S} WHERE seed_id % 4 = 0)"


@query(f"SELECT trait, n, {r('; '.join(f'{c} AS {c}' for c in ('r2', 'ccc', 'rmse', 'mae', 'bias', 'bias_pct', 'loa_low', 'loa_high', 'slope', 'intercept')))}, {VERDICT_SQL} AS verdict FROM {agree_sql(_VALID)}")
def validate_traits(spark, d):
    s = calibrated(spark, d)
    wide = s.select("image", "seed_id", F.expr("(width_mm * 0.98e0 + ((seed_id * 31) % 11 - 5) / 100.0e0)").alias("width_mm"))
    got = validation.validated(s, caliper(s).join(wide, ["image", "seed_id"]), ("length_mm", "width_mm"))
    return rounded(got.select("trait", "n", "r2", "ccc", "rmse", "mae", "bias", "bias_pct", "loa_low", "loa_high", "slope", "intercept", "verdict"))


_COUNTED = {"image": "", "seed_id": "", "cls": "", "confidence": "0-1", "cx": "px", "cy": "px", "length_px": "px", "width_px": "px", "area_px2": "px^2", "perimeter_px": "px", "segment_method": "", "mean_L": "CIE-Lab", "spot_count": "", "spot_coverage": "0-1", "largest_spot": "0-1", "pattern_class": "", "outline_error": "", "outline_flag": "", "feret_max_px": "px"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{u}' AS units, count({c}) AS n_rows FROM {S}""" for c, u in _COUNTED.items()))
def data_dictionary(spark, d):
    """The known columns of the objects' table, and how many objects have each."""
    return export.described(seeds(spark, d)).where(F.col("column") != "area_ratio").select("column", "units", "n_rows")


@query(f"""WITH m AS (SELECT trait, avg(x) AS mean, var_samp(fx) AS xx, var_samp(fy) AS yy, covar_samp(fx, fy) AS xy, covar_samp(fx, x) AS xt, covar_samp(fy, x) AS yt, var_samp(x) AS tt FROM (UNPIVOT (SELECT cx / img_w AS fx, cy / img_h AS fy, length_px, mean_L FROM {S}) ON length_px, mean_L INTO NAME trait VALUE x) GROUP BY trait)
SELECT trait, ((xt * yy - yt * xy) * xt + (yt * xx - xt * xy) * yt) / (xx * yy - xy * xy) / tt > 1e-1 AS flag, CASE WHEN ((xt * yy - yt * xy) * xt + (yt * xx - xt * xy) * yt) / (xx * yy - xy * xy) / tt > 1e-1 THEN 'the place in the frame explains a part: look at light and lens' ELSE 'no effect of the place' END AS reading FROM m""")
def drift_readings(spark, d):
    return reliability.drift_reading(reliability.position_drift(seeds(spark, d), ["length_px", "mean_L"])).select("trait", "flag", "reading")


_NOTES = {"There is no scale: sizes are in pixels and no physical trait was derived.": "length_px", "Scale: 12.50 pixels a millimetre (manual).": "length_mm", "Thickness is 0.62 of the width, not measured; mean diameters, volume and mass rest on it.": "width_mm", "Density: 1.300 g/cm3 (literature).": "width_mm * length_mm"}


@query(" UNION ALL ".join(f"SELECT '{note}' AS note, count({c}) AS n_seeds FROM {S}" for note, c in _NOTES.items()))
def assumption_notes(spark, d):
    """Of a run without a scale, and of one whose scale is that of 125 pixels on 10 mm: objects that rest on each."""
    scaled = Settings("lot1", px_per_mm(125, 10), "manual", physical=Physical(density_source="literature"))
    return resting_on(seeds(spark, d), Settings()).unionAll(resting_on(measured(adapter.seeds(spark, d), scaled), scaled))


@query(f"SELECT image, seed_id, {r(f'{adapter.CALIPER} AS length_mm')} FROM {S} WHERE seed_id % 4 = 0")
def reference_sheets(spark, d):
    """Reference measurements written as a sheet, and read back."""
    s = calibrated(spark, d)
    folder = new_folder(spark, "sheet")
    caliper(s).write.option("header", True).csv(folder)
    return rounded(files.reference_sheet(spark, folder))


_PASSED = [("detect.conf", "0.1", "confidence >= 1e-1", S), ("reliability.outline_tol", "0.15", "abs(outline_error) <= 15e-2", S), ("patterns.black_L_max", "35.0", "mean_L >= 35", S), ("patterns.plain_coverage_max", "0.02", "spot_coverage >= 2e-2", S), ("patterns.marbled_largest", "0.15", "largest_spot <= 15e-2", S), ("qc.focus_min", "60.0", "focus >= 60", adapter.PHOTOGRAPHS_SQL), ("qc.clip_max", "0.01", "clip_frac <= 1e-2", adapter.PHOTOGRAPHS_SQL), ("qc.illum_cv_max", "0.12", "illum_cv <= 12e-2", adapter.PHOTOGRAPHS_SQL)]


@query(" UNION ALL ".join(f"SELECT '{name}' AS setting, '{value}' AS value, count(*) FILTER ({ok}) AS n_rows FROM {of}" for name, value, ok, of in _PASSED))
def default_settings(spark, d):
    """Thresholds as they are by default, and what passes them."""
    return passing(seeds(spark, d), adapter.photographs(spark, d))


#: A wide blur, mirrored at the ends, is taken from each profile; then what it has in common with itself some steps on.
_PROFILE = """(WITH p AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS t(i)), k AS (SELECT o, exp(-5e-1 * (o / 12e0) * (o / 12e0)) / sum(exp(-5e-1 * (o / 12e0) * (o / 12e0))) OVER () AS w FROM range(-36, 37) AS t(o)),
b AS (SELECT a.vec_id, a.i, any_value(a.v) - sum(w * c.v) AS v FROM p AS a, k JOIN p AS c ON c.vec_id = a.vec_id AND c.i = abs((a.i + o + 63 + 126) % 126 - 63) GROUP BY 1, 2), z AS MATERIALIZED (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM b),
m AS (SELECT vec_id, lag, sum(a.v * c.v) AS s FROM z AS a JOIN z AS c USING (vec_id), range(3, 16) AS t(lag) WHERE c.i = a.i + lag GROUP BY ALL) SELECT m.vec_id, lag, s / power AS strength FROM m JOIN (SELECT vec_id, sum(v * v) AS power FROM z GROUP BY 1) USING (vec_id))"""


@query(f"SELECT vec_id, CASE WHEN strength >= 2e-1 THEN lag / 2e0 END AS px_per_mm, {r('round(strength, 9) AS strength')} FROM {_PROFILE} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(strength, 9) DESC, lag) = 1")
def ruler_periods(spark, d):
    """The period of each vector's components, read as a ruler strip's brightness; null where none is clear."""
    profiles = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as profile")
    return rounded(profile_scale(profiles, ["vec_id"], 2.0))


@query(f"SELECT count(*) AS n_seeds, count(DISTINCT image) AS photographs FROM {S}")
def bundle_totals(spark, d):
    return export.totals(seeds(spark, d))


@query(f"SELECT cls, count(*) AS n_seeds, {r('avg(length_mm) AS length_mm')} FROM {S} GROUP BY cls")
def run_written(spark, d):
    """A whole run written as files; the objects' table read back."""
    folder = new_folder(spark, "run")
    settings = Settings("lot1", SCALE, "manual", physical=Physical(density_source="literature"))
    export.written(adapter.seeds(spark, d), adapter.photographs(spark, d), settings, folder)
    back = spark.read.parquet(f"{folder}/tables/per_seed")
    return rounded(back.groupBy("cls").agg(F.count("*").alias("n_seeds"), F.avg("length_mm").alias("length_mm")))


def _events(spark, d):
    return trays.arriving(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, "events.parquet")


@query("SELECT event_id AS seed_id, event_type AS cls FROM events")
def stream_appended(spark, d):
    folder = new_folder(spark, "stream")
    rows = _events(spark, d).selectExpr("event_id as seed_id", "event_type as cls")
    trays.appended(rows, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query(f"SELECT CAST(ts AS DATE) AS day, event_type AS cls, count(*) AS n, {r('sum(value) AS value_sum; sum(value * value) AS value_squares', 3)} FROM events GROUP BY ALL")
def stream_windows(spark, d):
    folder = new_folder(spark, "stream")
    utc = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)) as ts"
    counts = trays.windowed(_events(spark, d).selectExpr(utc, "event_type as cls", "value"), "ts", "1 day", "90 days", ["value"])
    trays.updated(counts, f"{folder}/batches", f"{folder}/checkpoint")
    last = trays.latest(spark, f"{folder}/batches", counts.schema, ["start", "cls"])
    return rounded(last.selectExpr("date_add(date'1970-01-01', cast(unix_seconds(start) div 86400 as int)) as day", "cls", "n", "value_sum", "value_squares"), 3)


@query(f"SELECT image, count(*) AS truncated FROM {S} WHERE x1 <= 2 OR y1 <= 2 OR x2 >= img_w - 2 OR y2 >= img_h - 2 GROUP BY image")
def truncated_counts(spark, d):
    return seeds(spark, d).where(edge_cut()).groupBy("image").agg(F.count("*").alias("truncated"))
