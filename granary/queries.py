"""Named queries over the test tables, with the SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import MATCHED_TRAITS, MM_TRAITS, Physical
from granary.functions.exprs import box, box_area, box_centre, pattern_class
from granary.operators import geometry, outlines, physical, qc, reliability, stats, validation
from granary.sources import adapter

SCALE = 12.5
TRAITS = ["length_px", "width_px", "area_px2", "perimeter_px"]
CLASSES = ["click", "view", "purchase", "Spotted seeds"]
QUERIES, ORACLES = {}, {}

#: The seed table with its classes, outline errors and millimetre traits.
S = f"""(SELECT *, {SCALE}e0 AS s, length_px / {SCALE}e0 AS length_mm, width_px / {SCALE}e0 AS width_mm, area_px2 / ({SCALE}e0 * {SCALE}e0) AS area_mm2,
  area_px2 / nullif(pi() / 4 * length_px * width_px, 0) - 1 AS outline_error, coalesce(abs(area_px2 / nullif(pi() / 4 * length_px * width_px, 0) - 1) > 15e-2, false) AS outline_flag,
  CASE WHEN mean_L < 35 THEN 'black' WHEN largest_spot > 15e-2 THEN 'marbled' WHEN spot_count = 0 OR spot_coverage < 2e-2 THEN 'plain' WHEN spot_count >= 12 THEN 'dotted' ELSE 'spotted' END AS pattern_class
  FROM {adapter.SEEDS_SQL})"""
VOLUME = "(pi() / 6 * length_mm * width_mm * (width_mm * 62e-2))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as two engines add in different orders; minus zero as zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(names: str, digits: int = 6) -> str:
    """SQL that rounds 'expression AS name' items, parted by '; '."""
    return ", ".join(f"round({x.rpartition(' AS ')[0]}, {digits}) + 0e0 AS {x.rpartition(' AS ')[2]}" for x in names.split("; "))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return reliability.outline(adapter.seeds(spark, d)).withColumn("pattern_class", pattern_class())


def calibrated(spark: SparkSession, d: str, cfg: Physical = Physical(density_source="literature")) -> DataFrame:
    return physical.to_physical(seeds(spark, d), SCALE, cfg)


def caliper(df: DataFrame) -> DataFrame:
    return df.where("seed_id % 4 = 0").select("image", "seed_id", F.expr(adapter.CALIPER).alias("length_mm"))


@query(f"SELECT image, seed_id, cls, segment_method, fragments, x1, y1, x2, y2, spot_count, {r('confidence AS confidence; length_px AS length_px; width_px AS width_px; area_px2 AS area_px2; perimeter_px AS perimeter_px')} FROM {S}")
def seeds_adapter(spark, d):
    return rounded(adapter.seeds(spark, d).select("image", "seed_id", "cls", "segment_method", "fragments", "x1", "y1", "x2", "y2", "spot_count", "confidence", *TRAITS))


@query(f"SELECT seed_id, 'mm' AS units, {r(f'length_mm AS length_mm; width_mm * 62e-2 AS thickness_mm; area_mm2 AS area_mm2; pow(length_mm * width_mm * (width_mm * 62e-2), 1e0 / 3e0) AS gmd_mm; (length_mm + width_mm + width_mm * 62e-2) / 3 AS amd_mm; pow(length_mm * width_mm * (width_mm * 62e-2), 1e0 / 3e0) / length_mm AS sphericity; pi() * pow(pow(length_mm * width_mm * (width_mm * 62e-2), 1e0 / 3e0), 2) AS surface_area_mm2; {VOLUME} AS volume_mm3; feret_max_px / {SCALE}e0 AS feret_max_mm; 2 * sqrt(area_px2 / pi()) / {SCALE}e0 AS eq_diameter_mm; perimeter_px / {SCALE}e0 AS perimeter_mm; width_mm AS width_mm')} FROM {S}")
def to_physical_calibrated(spark, d):
    return rounded(calibrated(spark, d).select("seed_id", "units", "length_mm", "width_mm", "perimeter_mm", "feret_max_mm", "eq_diameter_mm", "thickness_mm", "area_mm2", "gmd_mm", "amd_mm", "sphericity", "surface_area_mm2", "volume_mm3"))


@query(f"SELECT seed_id, 'px' AS units, {', '.join(f'CAST(NULL AS DOUBLE) AS {t}' for t in MM_TRAITS)} FROM {S}")
def to_physical_uncalibrated(spark, d):
    return physical.to_physical(seeds(spark, d), None).select("seed_id", "units", *MM_TRAITS)


@query(f"SELECT seed_id, {r(f'{VOLUME} * 130e-2 AS mass_mg')} FROM {S}")
def mass_literature_density(spark, d):
    return rounded(calibrated(spark, d).select("seed_id", "mass_mg"))


@query(f"SELECT {r(f'(5e0 * 1000 / 100) / avg({VOLUME}) AS density')} FROM {S}")
def calibrate_density(spark, d):
    return rounded(physical.calibrated_density(calibrated(spark, d), 5.0, 100))


@query(f"SELECT n, {r('m AS tsw_g; sd / sqrt(n) AS se; 196e-2 * sd / sqrt(n) AS ci95; 100 * sd / m AS cv_pct')} FROM (SELECT count(*) AS n, avg({VOLUME} * 130e-2) AS m, stddev_samp({VOLUME} * 130e-2) AS sd FROM {S})")
def thousand_seed_weight(spark, d):
    return rounded(physical.thousand_seed_weight(calibrated(spark, d)))


LONG = f"(UNPIVOT (SELECT image, cls, {', '.join(TRAITS)} FROM {S}) ON {', '.join(TRAITS)} INTO NAME trait VALUE x)"


@query(f"SELECT trait, count(*) AS n, {r('avg(x) AS mean; stddev_samp(x) AS sd; 100 * stddev_samp(x) / avg(x) AS cv_pct; stddev_samp(x) / sqrt(count(*)) AS se; min(x) AS min; quantile_cont(x, 5e-2) AS p5; quantile_cont(x, 25e-2) AS p25; median(x) AS median; quantile_cont(x, 75e-2) AS p75; quantile_cont(x, 95e-2) AS p95; max(x) AS max; skewness(x) AS skew')} FROM {LONG} GROUP BY trait")
def lot_summary(spark, d):
    return rounded(stats.lot_summary(seeds(spark, d), TRAITS))


_SIX = [*TRAITS, "feret_max_px", "confidence"]


@query(f"SELECT image, count(*) AS n_seeds, {', '.join(f'count({t}) AS {t}_count' for t in _SIX)}, {r('; '.join(f'avg({t}) AS {t}_mean; stddev_samp({t}) AS {t}_std' for t in _SIX), 5)} FROM {S} GROUP BY image")
def per_image_summary(spark, d):
    return rounded(stats.per_group(seeds(spark, d), _SIX), 5)


@query(f"SELECT 'lot1' AS id, count(*) AS n_seeds, {r('avg(length_px) AS length_px; stddev_samp(length_px) AS length_px_sd; avg(area_px2) AS area_px2; stddev_samp(area_px2) AS area_px2_sd')} FROM {S}")
def gwas_wide_lot(spark, d):
    return rounded(stats.gwas_wide(seeds(spark, d), ["length_px", "area_px2"], "lot1", False))


@query(f"SELECT image AS id, count(*) AS n_seeds, {r('avg(length_px) AS length_px; stddev_samp(length_px) AS length_px_sd; avg(area_px2) AS area_px2; stddev_samp(area_px2) AS area_px2_sd')} FROM {S} GROUP BY image")
def gwas_wide_image(spark, d):
    return rounded(stats.gwas_wide(seeds(spark, d), ["length_px", "area_px2"], "lot1", True))


@query(f"""WITH p AS (SELECT cls, pattern_class, count(*) AS k FROM {S} GROUP BY ALL), m AS (SELECT cls, pattern_class FROM p QUALIFY row_number() OVER (PARTITION BY cls ORDER BY k DESC, pattern_class) = 1)
SELECT c.cls, n, {r('100e0 * n / sum(n) OVER () AS share_pct')}, m.pattern_class AS modal_pattern_class, row_number() OVER (ORDER BY n DESC, c.cls)::INT AS place FROM (SELECT cls, count(*) AS n FROM {S} GROUP BY cls) AS c LEFT JOIN m USING (cls)""")
def composition(spark, d):
    return rounded(stats.composition(seeds(spark, d)))


@query(f"SELECT cls, pattern_class, count(*) AS n FROM {S} GROUP BY ALL")
def agreement_crosstab_long(spark, d):
    return stats.crosstab_long(seeds(spark, d))


@query(f"SELECT cls, {', '.join(f"count(*) FILTER (pattern_class = '{p}') AS {p}" for p in ('black', 'dotted', 'marbled', 'plain', 'spotted'))} FROM {S} GROUP BY cls")
def agreement_crosstab_wide(spark, d):
    return stats.crosstab_wide(seeds(spark, d))


@query(f"SELECT segment_method AS value, n, {r('100e0 * n / sum(n) OVER () AS share_pct')} FROM (SELECT segment_method, count(*) AS n FROM {S} GROUP BY 1)")
def value_share(spark, d):
    return rounded(stats.shares(seeds(spark, d), "segment_method"))


@query(f"""SELECT count(*) AS n, count(DISTINCT image) AS photographs, {r('avg(length_px) AS mean_length; 100 * stddev_samp(length_px) / avg(length_px) AS length_cv_pct')},
(SELECT pattern_class FROM {S} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS commonest FROM {S}""")
def headline(spark, d):
    s = seeds(spark, d)
    top = s.groupBy("pattern_class").agg(F.count("*").alias("k")).agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("pattern_class").alias("v")))["v"].alias("commonest"))
    return rounded(s.agg(F.count("*").alias("n"), F.countDistinct("image").alias("photographs"), F.avg("length_px").alias("mean_length"), (100 * F.stddev_samp("length_px") / F.avg("length_px")).alias("length_cv_pct")).crossJoin(F.broadcast(top)))


@query(f"""WITH e AS (SELECT min(length_px) AS lo, (max(length_px) - min(length_px)) / 30 AS w FROM {S}), c AS (SELECT least(floor((length_px - lo) / w), 29)::INT AS bin, count(*) AS n FROM {S}, e GROUP BY 1)
SELECT b.bin::INT AS bin, {r('lo + b.bin * w AS left_edge')}, coalesce(n, 0) AS n FROM e, range(30) AS b(bin) LEFT JOIN c ON c.bin = b.bin""")
def trait_histogram(spark, d):
    return rounded(stats.histogram(seeds(spark, d), "length_px"))


@query(f"SELECT cls, {r('min(area_px2) AS min; quantile_cont(area_px2, 25e-2) AS p25; median(area_px2) AS p50; quantile_cont(area_px2, 75e-2) AS p75; max(area_px2) AS max')} FROM {S} GROUP BY cls")
def class_distribution(spark, d):
    return rounded(stats.class_distribution(seeds(spark, d), "area_px2"))


_CLASSES = ", ".join(f"('{c}')" for c in CLASSES)


@query(f"SELECT coalesce(k.cls, c.cls) AS cls, coalesce(n, 0) AS n FROM (VALUES {_CLASSES}) AS k(cls) FULL JOIN (SELECT cls, count(*) AS n FROM {S} GROUP BY cls) AS c USING (cls)")
def class_dimension_counts(spark, d):
    return stats.class_counts(seeds(spark, d), CLASSES)


@query(f"SELECT DISTINCT cls FROM {S} WHERE cls NOT IN (SELECT * FROM (VALUES {_CLASSES}))")
def unknown_classes(spark, d):
    return stats.unknown_classes(seeds(spark, d), CLASSES)


_FLAGS = {"flag_focus": "focus < 60", "flag_clip": "clip_frac > 1e-2", "flag_illum": "illum_cv > 12e-2", "flag_size": "seed_width_px < 35", "flag_sparse": "coalesce(n_seeds, 0) < 5"}
QC_SQL = f"""(SELECT *, CASE WHEN reason = '' THEN 'passes every check' ELSE reason END AS qc_reason, reason = '' AS qc_pass, CASE WHEN seed_width_px >= 60 THEN 'good' WHEN seed_width_px >= 35 THEN 'workable' ELSE 'too small' END AS size_grade FROM
(SELECT *, concat_ws('; ', {', '.join(f"CASE WHEN {t} THEN '{qc.PHRASES[f]}' END" for f, t in _FLAGS.items())}) AS reason, {', '.join(f'coalesce({t}, false) AS {f}' for f, t in _FLAGS.items())}
FROM {adapter.PHOTOGRAPHS_SQL} LEFT JOIN (SELECT image, median(width_px) AS seed_width_px, count(*) AS n_seeds FROM {S} GROUP BY image) USING (image)))"""
_QC = ["image", *_FLAGS, "qc_pass", "qc_reason", "size_grade", "n_seeds"]


@query(f"SELECT {', '.join(_QC)}, {r('seed_width_px AS seed_width_px')} FROM {QC_SQL}")
def qc_rules(spark, d):
    return rounded(qc.qc_rules(adapter.photographs(spark, d), seeds(spark, d)).select(*_QC, "seed_width_px"))


@query(f"SELECT image, qc_reason FROM {QC_SQL} WHERE NOT qc_pass")
def failed_photographs(spark, d):
    return qc.qc_rules(adapter.photographs(spark, d), seeds(spark, d)).where(~F.col("qc_pass")).select("image", "qc_reason")


@query(f"SELECT seed_id, pattern_class FROM {S}")
def pattern_classes(spark, d):
    return seeds(spark, d).select("seed_id", "pattern_class")


@query(f"SELECT seed_id, outline_flag, {r('outline_error AS outline_error')} FROM {S}")
def outline_flags(spark, d):
    return rounded(seeds(spark, d).select("seed_id", "outline_flag", "outline_error"))


@query(f"SELECT count(outline_error) AS n, {r('100 * median(outline_error) AS median_error_pct; 100 * (quantile_cont(outline_error, 75e-2) - quantile_cont(outline_error, 25e-2)) AS iqr_error_pct')}, count(*) FILTER (outline_flag) AS flagged, {r('100 * avg(outline_flag::INT) AS flagged_pct')} FROM {S}")
def outline_summary(spark, d):
    return rounded(reliability.outline_summary(seeds(spark, d)))


@query(f"SELECT segment_method, round_even(100 * avg(outline_flag::INT), 1) AS flagged_pct FROM {S} GROUP BY 1")
def outline_by_method(spark, d):
    return reliability.outline_by_method(seeds(spark, d))


_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREAS = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"
PAIRS_SQL = f"(SELECT a.image, a.seed_id AS seed_a, b.seed_id AS seed_b, ({_INTER})::DOUBLE / nullif({_AREAS} - {_INTER}, 0) AS iou, ({_INTER})::DOUBLE / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS containment FROM {S} AS a JOIN {S} AS b ON a.image = b.image AND a.seed_id < b.seed_id)"


@query(f"SELECT image, seed_a, seed_b, {r('iou AS iou')} FROM {PAIRS_SQL} WHERE iou > 30e-2")
def duplicate_pairs(spark, d):
    return rounded(reliability.duplicate_pairs(seeds(spark, d), 0.30).drop("containment"))


@query(f"SELECT image, seed_a, seed_b, {r('containment AS containment')} FROM {PAIRS_SQL} WHERE iou > 0")
def containment_pairs(spark, d):
    return rounded(reliability.duplicate_pairs(seeds(spark, d), 0.0).select("image", "seed_a", "seed_b", "containment"))


@query(f"""WITH m AS (SELECT *, median(area_px2) OVER (PARTITION BY image) AS ma, median(confidence) OVER (PARTITION BY image) AS mc FROM {S}), c AS (SELECT image, count(*) AS detected, count(*) FILTER (area_px2 > 18e-1 * ma OR fragments > 0) AS merged_suspects,
count(*) FILTER (x1 <= 2 OR y1 <= 2 OR x2 >= img_w - 2 OR y2 >= img_h - 2) AS edge_truncated, count(*) FILTER (confidence < 5e-1 * mc) AS weak_detections FROM m GROUP BY image), p AS (SELECT image, count(*) AS k FROM {PAIRS_SQL} WHERE iou > 30e-2 GROUP BY image)
SELECT c.*, coalesce(k, 0) AS duplicate_pairs, CASE WHEN coalesce(k, 0) + merged_suspects = 0 THEN 'counts look clean' ELSE (coalesce(k, 0) + merged_suspects) || ' of ' || detected || ' detections need a look' END AS count_confidence FROM c LEFT JOIN p USING (image)""")
def detection_checks(spark, d):
    return reliability.detection_checks(seeds(spark, d))


@query(f"""WITH m AS (SELECT trait, count(*) AS n, avg(x) AS mean, var_samp(fx) AS xx, var_samp(fy) AS yy, covar_samp(fx, fy) AS xy, covar_samp(fx, x) AS xt, covar_samp(fy, x) AS yt, var_samp(x) AS tt
FROM (UNPIVOT (SELECT cx / img_w AS fx, cy / img_h AS fy, length_px, area_px2 FROM {S}) ON length_px, area_px2 INTO NAME trait VALUE x) GROUP BY trait), b AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS bx, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS by_ FROM m)
SELECT trait, n, {r('100 * bx / mean AS slope_x_pct; 100 * by_ / mean AS slope_y_pct; (bx * xt + by_ * yt) / tt AS r2')}, (bx * xt + by_ * yt) / tt > 1e-1 AS flag FROM b""")
def position_drift(spark, d):
    return rounded(reliability.position_drift(seeds(spark, d), ["length_px", "area_px2"]))


@query(f"SELECT least(greatest(trunc(cy / img_h * 3)::INT, 0), 2) AS row, least(greatest(trunc(cx / img_w * 3)::INT, 0), 2) AS col, {r('avg(length_px) AS mean')}, count(*) AS n, {r(f'100 * avg(length_px) / (SELECT avg(length_px) FROM {S}) AS pct_of_frame_mean')} FROM {S} GROUP BY 1, 2")
def drift_grid(spark, d):
    return rounded(reliability.drift_grid(seeds(spark, d), "length_px"))


#: Each tray and the next: two photographs to match.
_MATCH_TRAITS = [t for t in MATCHED_TRAITS if t != "roundness"]
_SIDE = f"SELECT CAST(substr(image, 6) AS BIGINT) AS n, image, seed_id, {', '.join(_MATCH_TRAITS)}, cx / img_w AS fx, cy / img_h AS fy FROM {S}"
MATCH_SQL = f"""(WITH s AS ({_SIDE}), p AS (SELECT a.n AS pair, a.image AS image_a, b.image AS image_b, a.seed_id AS seed_a, b.seed_id AS seed_b, sqrt((a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy)) AS distance,
{', '.join(f'a.{t} AS {t}_a, b.{t} AS {t}_b, b.{t} - a.{t} AS {t}_diff' for t in _MATCH_TRAITS)} FROM s AS a JOIN s AS b ON b.n = a.n + 1)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY pair, seed_a ORDER BY distance, seed_b) = 1 AND row_number() OVER (PARTITION BY pair, seed_b ORDER BY distance, seed_a) = 1 AND distance <= 3e-2)"""


def _matched(spark, d):
    s = calibrated(spark, d).withColumn("n", F.expr("cast(substring(image, 6) as bigint)"))
    return reliability.matched(s.withColumn("pair", F.col("n")), s.withColumn("pair", F.col("n") - 1), _MATCH_TRAITS, by=["pair"])


@query(f"SELECT pair, image_a, image_b, seed_a, seed_b, {r('distance AS distance; ' + '; '.join(f'{t}_{x} AS {t}_{x}' for t in _MATCH_TRAITS for x in ('a', 'b', 'diff')))} FROM {MATCH_SQL}")
def match_seeds(spark, d):
    return rounded(_matched(spark, d))


_LEVEL = "((sum({t}_a) + sum({t}_b)) / (count({t}_a) + count({t}_b)))"
_REPEAT = "SELECT '{t}' AS trait, count({t}_diff) AS pairs, {figures} FROM {m} HAVING count({t}_diff) > 0"


@query(" UNION ALL ".join(
    _REPEAT.format(t=t, m=MATCH_SQL, figures=r(f"avg({t}_diff) AS bias; stddev_samp({t}_diff) AS sd_of_difference; 100 * stddev_samp({t}_diff) / {_LEVEL.format(t=t)} AS repeatability_cv_pct; avg({t}_diff) - 196e-2 * stddev_samp({t}_diff) AS loa_low; avg({t}_diff) + 196e-2 * stddev_samp({t}_diff) AS loa_high", 5))
    for t in ("length_px", "length_mm")
))
def matching_summary(spark, d):
    return rounded(reliability.matching_summary(_matched(spark, d), ["length_px", "length_mm"]), 5)


JOIN_SQL = f"(SELECT image, seed_id, length_mm AS measured, {adapter.CALIPER} AS reference FROM {S} WHERE seed_id % 4 = 0)"


def _paired(spark, d):
    s = calibrated(spark, d)
    return validation.paired(s, caliper(s), "length_mm")


@query(f"SELECT image, seed_id, {r('measured AS measured; reference AS reference')} FROM {JOIN_SQL}")
def join_seed_id(spark, d):
    return rounded(_paired(spark, d))


@query(f"""WITH m AS (SELECT image, length_mm AS measured, (row_number() OVER (PARTITION BY image ORDER BY length_mm, seed_id) - 1)::INT AS rank FROM {S}), c AS (SELECT image, reference, (row_number() OVER (PARTITION BY image ORDER BY reference, seed_id) - 1)::INT AS rank FROM {JOIN_SQL})
SELECT image, rank, {r('measured AS measured; reference AS reference')} FROM m JOIN c USING (image, rank)""")
def join_rank(spark, d):
    s = calibrated(spark, d)
    return rounded(validation.paired(s, caliper(s), "length_mm", "rank"))


@query(f"SELECT image, seed_id, {r('(measured + reference) / 2 AS mean_of_pair; measured - reference AS difference')} FROM {JOIN_SQL}")
def bland_altman(spark, d):
    return rounded(validation.bland_altman(_paired(spark, d)).select("image", "seed_id", "mean_of_pair", "difference"))


#: From the sums that define them: least squares of measured on reference by residuals, concordance by sample moments.
def agree_sql(pairs: str) -> str:
    """pairs: SQL of trait, measured, reference."""
    return f"""(WITH p AS (SELECT trait, measured AS m, reference AS r FROM {pairs}), a AS (SELECT trait, count(*) AS n, avg(m) AS measured_mean, avg(r) AS reference_mean FROM p GROUP BY trait HAVING count(*) >= 3),
c AS (SELECT p.*, n, measured_mean, reference_mean, m - measured_mean AS dm, r - reference_mean AS dr FROM p JOIN a USING (trait)),
l AS (SELECT trait, sum(dm * dr) / sum(dr * dr) AS slope, sum(dm * dr) / (n - 1) AS cov, sum(dm * dm) / (n - 1) AS vm, sum(dr * dr) / (n - 1) AS vr FROM c GROUP BY trait, n),
s AS (SELECT trait, n, measured_mean, reference_mean, sum(power(m - (measured_mean + slope * dr), 2)) AS ss_res, sum(dm * dm) AS ss_tot, avg(m - r) AS bias, sqrt(avg(power(m - r, 2))) AS rmse, avg(abs(m - r)) AS mae, stddev_samp(m - r) AS sd_of_difference FROM c JOIN l USING (trait) GROUP BY trait, n, measured_mean, reference_mean)
SELECT s.*, slope, measured_mean - slope * reference_mean AS intercept, 1 - ss_res / ss_tot AS r2, cov / sqrt(vm * vr) AS pearson_r, 2 * cov / (vm + vr + power(measured_mean - reference_mean, 2)) AS ccc, 100 * bias / reference_mean AS bias_pct, bias - 196e-2 * sd_of_difference AS loa_low, bias + 196e-2 * sd_of_difference AS loa_high FROM s JOIN l USING (trait))"""


VERDICT_SQL = "CASE WHEN r2 IS NULL THEN 'not enough spread to judge' WHEN abs(bias_pct) > 5 THEN 'reads ' || printf('%.1f', abs(bias_pct)) || CASE WHEN bias_pct > 0 THEN '% over' ELSE '% under' END WHEN ccc >= 95e-2 AND r2 >= 95e-2 THEN 'agrees' WHEN r2 >= 90e-2 AND ccc < 90e-2 THEN 'follows but is shifted' WHEN r2 >= 80e-2 THEN 'follows loosely' ELSE 'does not agree' END"
AGREE_SQL = agree_sql(f"(SELECT 'length_mm' AS trait, * FROM {JOIN_SQL})")
_AGREE = ("r2", "pearson_r", "ccc", "rmse", "mae", "bias", "bias_pct", "sd_of_difference", "loa_low", "loa_high", "slope", "intercept", "reference_mean", "measured_mean")


@query(f"SELECT n, {r('; '.join(f'{c} AS {c}' for c in _AGREE))} FROM {AGREE_SQL}")
def agreement_stats(spark, d):
    return rounded(validation.agreement(_paired(spark, d)))


@query(f"SELECT {VERDICT_SQL} AS verdict FROM {AGREE_SQL}")
def verdict(spark, d):
    return validation.verdict(validation.agreement(_paired(spark, d))).select("verdict")


@query(f"SELECT image, detected, n_seeds FROM (SELECT image, count(*) AS detected FROM {S} GROUP BY image) JOIN (SELECT image, count(*) AS n_seeds FROM {S} WHERE x1 <= 2 OR y1 <= 2 OR x2 >= img_w - 2 OR y2 >= img_h - 2 GROUP BY image) USING (image)")
def edge_truncated(spark, d):
    edge = (F.col("x1") <= 2) | (F.col("y1") <= 2) | (F.col("x2") >= F.col("img_w") - 2) | (F.col("y2") >= F.col("img_h") - 2)
    return seeds(spark, d).groupBy("image").agg(F.count("*").alias("detected"), F.count_if(edge).alias("n_seeds")).where("n_seeds > 0")


@query(f"SELECT image, x::INT AS x1, y::INT AS y1, least(x + 256, img_w)::INT AS x2, least(y + 256, img_h)::INT AS y2 FROM (SELECT image, max(img_w) AS img_w, max(img_h) AS img_h FROM {S} GROUP BY image), LATERAL (SELECT unnest(range(0, img_w - 256 + 204, 204)) AS x), LATERAL (SELECT unnest(range(0, img_h - 256 + 204, 204)) AS y)")
def tile_grid(spark, d):
    """The tiles of every photograph."""
    frames = seeds(spark, d).groupBy("image").agg(F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"))
    return geometry.tiles(frames, 256).select("image", "x1", "y1", "x2", "y2")


@query(f"SELECT seed_id, {r('(x1 + x2) / 2e0 AS mid_x; (y1 + y2) / 2e0 AS mid_y')}, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area FROM {S}")
def box_measures(spark, d):
    """Centre and area of every box."""
    (x, y), area = box_centre(box()), box_area(box())
    return rounded(seeds(spark, d).select("seed_id", x.alias("mid_x"), y.alias("mid_y"), area.alias("area")))


@query(f"SELECT seed_id, greatest(x1 - 6, 0) AS rx1, greatest(y1 - 6, 0) AS ry1, least(x2 + 6, img_w) AS rx2, least(y2 + 6, img_h) AS ry2 FROM {S}")
def roi_bounds(spark, d):
    return seeds(spark, d).select("seed_id", *[c.alias(n) for n, c in geometry.roi().items()])


#: Box by box in each image's order of confidence: one is kept if it is in conflict with none of those kept before.
_HIT = f"""({{i}} > 0 AND ({{i}} > 55e-2 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - {{i}}) OR {{i}} > 80e-2 * least((b.x2 - b.x1) * (b.y2 - b.y1), (k.x2 - k.x1) * (k.y2 - k.y1))))""".format(
    i="(greatest(least(b.x2, k.x2) - greatest(b.x1, k.x1), 0) * greatest(least(b.y2, k.y2) - greatest(b.y1, k.y1), 0))"
)
DEDUP_SQL = f"""(WITH RECURSIVE b AS (SELECT image, seed_id, x1, y1, x2, y2, img_w, img_h, confidence, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, seed_id) AS i FROM {S}),
g AS (SELECT image, 1::BIGINT AS i, [{{'seed_id': seed_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM b WHERE i = 1
UNION ALL SELECT g.image, b.i, CASE WHEN len(list_filter(kept, lambda k: {_HIT})) > 0 THEN kept ELSE list_append(kept, {{'seed_id': seed_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) END FROM g JOIN b ON b.image = g.image AND b.i = g.i + 1)
SELECT b.* FROM b JOIN (SELECT image, unnest(list_transform(arg_max(kept, i), lambda k: k.seed_id)) AS seed_id FROM g GROUP BY image) USING (image, seed_id))"""


_CUT = "(greatest(least(b.x2, k.x2) - greatest(b.x1, k.x1), 0) * greatest(least(b.y2, k.y2) - greatest(b.y1, k.y1), 0))"
_OVER = f"({_CUT} > 50e-2 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - {_CUT}))"


@query(f"SELECT image, seed_id, {r('confidence AS confidence')} FROM {DEDUP_SQL.replace(_HIT, _OVER).replace(f'FROM {S})', f'FROM {S} WHERE confidence >= 10e-2)')} QUALIFY row_number() OVER (PARTITION BY image ORDER BY confidence DESC, seed_id) <= 600")
def boxes_suppressed(spark, d):
    """Boxes of enough confidence that overlap no surer kept one by more than half, the surest 600 of a photograph."""
    return rounded(geometry.detected(seeds(spark, d)).select("image", "seed_id", "confidence"))


@query(f"SELECT image, seed_id, {r('confidence AS confidence')} FROM {DEDUP_SQL}")
def dedup_greedy(spark, d):
    return rounded(geometry.deduplicated(seeds(spark, d)).select("image", "seed_id", "confidence"))


@query(f"SELECT image, seed_id, {r('outline_error AS outline_error')} FROM {S} QUALIFY row_number() OVER (PARTITION BY image ORDER BY abs(outline_error) DESC, seed_id) = 1")
def top_suspect_outline(spark, d):
    return rounded(stats.top_in_image(seeds(spark, d), [F.abs("outline_error").desc(), F.col("seed_id")]).select("image", "seed_id", "outline_error"))


@query(f"SELECT seed_id, mean_L FROM {S} ORDER BY mean_L, seed_id LIMIT 400")
def lightness_topk(spark, d):
    return stats.top(seeds(spark, d).select("seed_id", "mean_L"), [F.col("mean_L"), F.col("seed_id")], 400)


_RATIOS = "4 * pi() * area_px2 / (perimeter_px * perimeter_px) AS roundness; length_px / width_px AS aspect_ratio; 1 - width_px / length_px AS elongation; area_px2 / (length_px * width_px) AS extent; area_px2 / (pi() / 4 * length_px * width_px) AS area_ratio; sqrt(area_px2 / pi()) AS eq_radius_px; 2 * sqrt(area_px2 / pi()) AS eq_diameter_px; sqrt(greatest(0, 1 - power(width_px / length_px, 2))) AS eccentricity"


@query(f"SELECT seed_id, {r(_RATIOS)} FROM {S}")
def morph_ratios(spark, d):
    return rounded(geometry.morphology(seeds(spark, d)).select("seed_id", *[x.rpartition(" AS ")[2] for x in _RATIOS.split("; ")]))


POINTS_SQL = "(SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y, embedding[(2 * i + 2) % 64 + 1]::DOUBLE AS nx, embedding[(2 * i + 3) % 64 + 1]::DOUBLE AS ny FROM embeddings, range(32) AS r(i))"


@query(f"SELECT vec_id, {r('abs(sum(x * ny - nx * y)) / 2 AS area; sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter')} FROM {POINTS_SQL} GROUP BY vec_id")
def contour_area_perimeter(spark, d):
    return rounded(geometry.area_perimeter(adapter.outlines(spark, d)).select("vec_id", "area", "perimeter"))


@query(f"SELECT a.vec_id, {r('max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS feret_max')} FROM {POINTS_SQL} AS a JOIN {POINTS_SQL} AS b USING (vec_id) GROUP BY 1")
def contour_feret(spark, d):
    return rounded(outlines.measured(adapter.outlines(spark, d)).select("vec_id", F.col("feret_max_px").alias("feret_max")))


#: Edges of the hull: pairs of points with no point on the right, or further out on their line.
EDGES_SQL = f"""(SELECT p.vec_id, p.i, p.x, p.y, q.x AS qx, q.y AS qy FROM {POINTS_SQL} AS p JOIN {POINTS_SQL} AS q ON p.vec_id = q.vec_id AND p.i <> q.i JOIN {POINTS_SQL} AS o ON o.vec_id = p.vec_id GROUP BY ALL
HAVING min((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x)) >= 0)"""
HULL_SQL = f"(SELECT vec_id, abs(sum(x * qy - qx * y)) / 2 AS hull_area, sum(sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y))) AS hull_perimeter FROM {EDGES_SQL} GROUP BY vec_id)"
#: For each edge, how far the points reach along it and away from it.
REACH_SQL = f"""(SELECT vec_id, dx, dy, (max(dx * o.x + dy * o.y) - min(dx * o.x + dy * o.y)) / sqrt(dx * dx + dy * dy) AS w, (max(dx * o.y - dy * o.x) - min(dx * o.y - dy * o.x)) / sqrt(dx * dx + dy * dy) AS h
FROM (SELECT vec_id, qx - x AS dx, qy - y AS dy FROM {EDGES_SQL}) JOIN {POINTS_SQL} AS o USING (vec_id) GROUP BY vec_id, dx, dy)"""


@query(f"""SELECT vec_id, {r('greatest(w, h) AS length_px; least(w, h) AS width_px; least(w, h) AS feret_min_px; thin AS breadth_min_px; 90 - (90 - degrees(atan2(dy, dx)) + 360) % 90 AS rect_angle')}
FROM (SELECT *, min(h) OVER (PARTITION BY vec_id) AS thin FROM {REACH_SQL}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(w * h, 9), greatest(w, h) DESC) = 1""")
def outline_rectangle(spark, d):
    """Length and width of each outline: the sides of the least rectangle around it."""
    return rounded(outlines.measured(adapter.outlines(spark, d)).select("vec_id", "length_px", "width_px", "feret_min_px", "breadth_min_px", "rect_angle"))


@query(f"SELECT vec_id, {r('area / hull_area AS solidity; hull_perimeter / perimeter AS convexity')} FROM {HULL_SQL} JOIN (SELECT vec_id, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter FROM {POINTS_SQL} GROUP BY vec_id) USING (vec_id)")
def hull_ratios(spark, d):
    made = geometry.area_perimeter(outlines.measured(adapter.outlines(spark, d))).withColumnsRenamed({"area": "area_px2", "perimeter": "perimeter_px"}).withColumns({"length_px": F.lit(1.0), "width_px": F.lit(1.0)})
    return rounded(geometry.morphology(made).select("vec_id", "solidity", "convexity"))


_MASK = "list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)"
_EDGE = "list_concat(list_concat(m[1:8], m[57:64]), list_concat(list_transform(range(8), lambda k: m[8 * k + 1]), list_transform(range(8), lambda k: m[8 * k + 8])))"


@query(f"SELECT vec_id, {r('fill AS fill; touch AS border_touch')}, fill BETWEEN 10e-2 AND 95e-2 AND touch <= 35e-2 AS plausible FROM (SELECT vec_id, list_sum(m) / 64e0 AS fill, list_sum({_EDGE}) / 32e0 AS touch FROM (SELECT vec_id, {_MASK} AS m FROM embeddings))")
def mask_plausible(spark, d):
    """The signs of each vector's components as a mask of eight rows."""
    masks = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "transform(sequence(0, 7), i -> transform(slice(embedding, 8 * i + 1, 8), v -> if(v > 0, 1, 0))) as mask")
    return rounded(geometry.plausible(masks).select("vec_id", "fill", "border_touch", "plausible"))


EFD_SQL = f"""(WITH s AS (SELECT vec_id, i, nx - x AS dx, ny - y AS dy, greatest(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 1e-300) AS dt FROM {POINTS_SQL}), t AS (SELECT *, sum(dt) OVER (PARTITION BY vec_id ORDER BY i) AS t1, sum(dt) OVER (PARTITION BY vec_id) AS whole FROM s),
h AS (SELECT *, 2 * pi() * n * t1 / whole AS p1, 2 * pi() * n * (t1 - dt) / whole AS p0, whole / (2 * n * n * pi() * pi()) AS k FROM t, range(1, 11) AS r(n))
SELECT vec_id, n, sum(k * dx / dt * (cos(p1) - cos(p0))) AS a, sum(k * dx / dt * (sin(p1) - sin(p0))) AS b, sum(k * dy / dt * (cos(p1) - cos(p0))) AS c, sum(k * dy / dt * (sin(p1) - sin(p0))) AS d FROM h GROUP BY 1, 2)"""


@query(f"SELECT vec_id, n::INT AS n, {r('a AS a; b AS b; c AS c; d AS d')} FROM {EFD_SQL}")
def efd_coefficients(spark, d):
    return rounded(_flat(geometry.fourier(adapter.outlines(spark, d), "vec_id", normalize=False)))


@query(f"SELECT (4 * (n - 1) + k)::INT AS pos, {r('avg([a, b, c, d][k + 1]) AS mean')} FROM {EFD_SQL}, range(4) AS r(k) GROUP BY 1")
def mean_shape(spark, d):
    return rounded(geometry.mean_shape(geometry.fourier(adapter.outlines(spark, d), "vec_id", normalize=False)))


#: Turned to the first harmonic's start and axis, and divided by its length.
NORMAL_SQL = f"""(WITH e AS {EFD_SQL}, f AS (SELECT vec_id, 5e-1 * atan2(2 * (a * b + c * d), a * a - b * b + c * c - d * d) AS theta FROM e WHERE n = 1),
t AS (SELECT vec_id, n, a * cos(n * theta) + b * sin(n * theta) AS a, b * cos(n * theta) - a * sin(n * theta) AS b, c * cos(n * theta) + d * sin(n * theta) AS c, d * cos(n * theta) - c * sin(n * theta) AS d FROM e JOIN f USING (vec_id)),
u AS (SELECT vec_id, atan2(c, a) AS psi, sqrt(a * a + c * c) AS size FROM t WHERE n = 1)
SELECT vec_id, n, (a * cos(psi) + c * sin(psi)) / size AS a, (b * cos(psi) + d * sin(psi)) / size AS b, (c * cos(psi) - a * sin(psi)) / size AS c, (d * cos(psi) - b * sin(psi)) / size AS d FROM t JOIN u USING (vec_id))"""


def _flat(efd, n: int = 10):
    rows = efd.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select("vec_id", "n", *[F.col("efd")[4 * (F.col("n") - 1) + i].alias(c) for i, c in enumerate("abcd")])


@query(f"SELECT vec_id, n::INT AS n, {r('a AS a; b AS b; c AS c; d AS d', 5)} FROM {NORMAL_SQL}")
def efd_normalised(spark, d):
    return rounded(_flat(geometry.fourier(adapter.outlines(spark, d), "vec_id")), 5)


@query(f"SELECT (4 * (n - 1) + k)::INT AS pos, count(*) AS n, {r('avg(v) AS mean; var_samp(v) AS variance', 5)} FROM (SELECT n, k, [a, b, c, d][k + 1] AS v FROM {NORMAL_SQL}, range(4) AS r(k) WHERE n > 1) GROUP BY 1")
def descriptor_moments(spark, d):
    """Mean and variance of each number of the descriptor matrix, which leaves the first harmonic out."""
    x = geometry.fourier(adapter.outlines(spark, d), "vec_id").select(F.posexplode("efd").alias("pos", "v")).where("pos >= 4")
    return rounded(x.groupBy("pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance")), 5)


_CURVE = "SELECT {key} AS vec_id, i::INT AS i, sum(a * cos(2 * pi() * n * i / 59) + b * sin(2 * pi() * n * i / 59)) AS x, sum(c * cos(2 * pi() * n * i / 59) + d * sin(2 * pi() * n * i / 59)) AS y FROM {efd}, range(60) AS t(i) GROUP BY ALL"
_FIRST = f"(SELECT * FROM {NORMAL_SQL} WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 250))"
_MEAN = f"(SELECT n, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d FROM {NORMAL_SQL} GROUP BY n)"


@query(f"SELECT vec_id, i, {r('x AS x; y AS y', 4)} FROM ({_CURVE.format(key='vec_id', efd=_FIRST)} UNION ALL {_CURVE.format(key='NULL::BIGINT', efd=_MEAN)})")
def shape_atlas(spark, d):
    return rounded(geometry.atlas(geometry.fourier(adapter.outlines(spark, d), "vec_id"), "vec_id", points=60), 4)


def _pca(rows: str, components: int = 4, squarings: int = 26) -> str:
    """CTEs c (means, covariance, trace) and v1 to v4 of the descriptors (id, x: a list) in ``rows``.

    A matrix squared often enough, scaled by its trace each time, is the outer product of its first axis; taking that axis's
    part from the covariance gives the next. Signs make the largest loading positive.
    """
    dims = "range(36)"
    squared = lambda m: f"list_transform({m}, lambda p: list_transform({m}, lambda q: list_dot_product(p, q)))"
    scaled = lambda m: f"list_transform({m}, lambda p: list_transform(p, lambda e: e / list_sum(list_transform({dims}, lambda i: {m}[i + 1][i + 1]))))"
    out = f"""flat AS MATERIALIZED (SELECT * FROM {rows}), n AS (SELECT count(*) AS n FROM flat), mean AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x[i + 1]) AS m FROM flat, {dims} AS t(i) GROUP BY i)),
cov AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT i, j, covar_samp(x[i + 1], x[j + 1]) AS c FROM flat, {dims} AS s(i), {dims} AS t(j) GROUP BY i, j) GROUP BY i)),
d0 AS MATERIALIZED (SELECT m AS a FROM cov)"""
    for k in range(1, components + 1):
        out += f", w{k} AS (SELECT {scaled('a')} AS m, 0 AS i FROM d{k - 1} UNION ALL SELECT {scaled('s')}, i + 1 FROM (SELECT {squared('m')} AS s, i FROM w{k} WHERE i < {squarings}))"
        column = f"list_transform({dims}, lambda i: m[i + 1][list_position(g, list_max(g))])"
        out += f", u{k} AS (SELECT list_transform(u, lambda e: e / sqrt(list_dot_product(u, u)) * CASE WHEN list_max(u) >= -list_min(u) THEN 1 ELSE -1 END) AS v FROM (SELECT {column} AS u FROM (SELECT m, list_transform({dims}, lambda i: m[i + 1][i + 1]) AS g FROM w{k} WHERE i = {squarings})))"
        out += f", v{k} AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(m, lambda p: list_dot_product(p, v))) AS variance FROM u{k}, cov)"
        out += f", d{k} AS MATERIALIZED (SELECT list_transform({dims}, lambda i: list_transform({dims}, lambda j: a[i + 1][j + 1] - variance * v[i + 1] * v[j + 1])) AS a FROM d{k - 1}, v{k})"
    return out


def _descriptors(keys: str = "vec_id", join: str = "") -> str:
    return f"(SELECT {keys}, list(z ORDER BY n, k) AS x FROM (SELECT {keys}, n, k, [a, b, c, d][k + 1] AS z FROM {NORMAL_SQL} AS e {join}, range(4) AS t(k) WHERE n > 1) GROUP BY ALL)"


_PC = "; ".join(f"list_dot_product(list_transform(list_zip(x, mean), lambda z: z[1] - z[2]), v{i}.v) AS {{}}{i}" for i in range(1, 5))


@query(f"WITH RECURSIVE {_pca(_descriptors('image, seed_id', f'JOIN {S} AS s ON s.seed_id = e.vec_id'))}, scores AS (SELECT image, seed_id, {r(_PC.format(*['shape_pc'] * 4), 4)} FROM flat, mean, v1, v2, v3, v4) SELECT s.image, s.seed_id, shape_pc1, shape_pc2, shape_pc3, shape_pc4 FROM {S} AS s LEFT JOIN scores USING (image, seed_id)")
def shape_scores(spark, d):
    """Objects whose outlines' scores were joined back onto them; there are outlines for the objects whose number is a
    vector's alone, the others have nulls."""
    s = seeds(spark, d)
    outlines = adapter.outlines(spark, d).withColumnRenamed("vec_id", "seed_id").join(s.select("image", "seed_id"), "seed_id")
    scores = geometry.principal(geometry.fourier(outlines, ["image", "seed_id"]), ["image", "seed_id"])
    return rounded(geometry.with_scores(s, scores).select("image", "seed_id", *[f"shape_pc{i}" for i in range(1, 5)]), 4)


@query(f"WITH RECURSIVE {_pca(_descriptors())} SELECT vec_id, {r(_PC.format(*['pc'] * 4), 4)} FROM flat, mean, v1, v2, v3, v4")
def pca_scores(spark, d):
    return rounded(geometry.principal(geometry.fourier(adapter.outlines(spark, d), "vec_id"), "vec_id"), 4)


@query(f"""WITH h AS (SELECT image, (spot_count * 12)::BIGINT AS level, count(*) AS n FROM {S} GROUP BY ALL), c AS (SELECT image, level, sum(n) OVER q AS w0, sum(n * level) OVER q AS s0, sum(n) OVER (PARTITION BY image) AS w, sum(n * level) OVER (PARTITION BY image) AS s FROM h WINDOW q AS (PARTITION BY image ORDER BY level))
SELECT image, level AS threshold FROM c QUALIFY row_number() OVER (PARTITION BY image ORDER BY round((s0 * w - s * w0)::DOUBLE * (s0 * w - s * w0) / nullif(w0::DOUBLE * (w - w0), 0), 6) DESC NULLS LAST, level) = 1""")
def otsu_threshold(spark, d):
    return geometry.otsu(seeds(spark, d).withColumn("level", F.col("spot_count") * 12), "level", "image")
