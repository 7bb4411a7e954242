"""Named queries on masks and outlines, with the SQL that gives the same rows, pixel by pixel."""

from pyspark.sql import functions as F

from granary.config import Segment
from granary.operators import geometry, masks, outlines, pixels
from granary.queries import POINTS_SQL, query, r, rounded
from granary.sources import adapter

KEYS = ["image"]
#: Levels from which a pixel is set: scattered pixels, and few enough for closing to leave several blobs.
SOME, FEW = 0.1, 0.22


def mask(spark, d, least: float):
    rows = adapter.lines(spark, d)
    return masks.packed(rows, KEYS, F.transform("levels", lambda v: F.when(v > least, 1).otherwise(0)))


def shown(df):
    """A mask's lines as text."""
    return df.select("image", "y", F.expr("array_join(transform(sequence(0, width - 1), x -> shiftrightunsigned(bits[x div 64], x % 64) & 1), '')").alias("line"))


def _cells(least: float) -> str:
    return f"(SELECT image, y, x, level > {least:e} AS set FROM {adapter.CELLS_SQL})"


def _box(cells: str, k: int, joined: str) -> str:
    """Each pixel's neighbours within k steps, joined by bool_or or bool_and."""
    return f"(SELECT image, y + dy AS y, x + dx AS x, {joined}(set) AS set FROM {cells}, range(-{k}, {k + 1}) AS r(dy), range(-{k}, {k + 1}) AS s(dx) GROUP BY image, y + dy, x + dx HAVING bool_or(dy = 0 AND dx = 0))"


MORPHED_SQL = _box(_box(_box(_box(_cells(FEW), 2, "bool_or"), 2, "bool_and"), 1, "bool_and"), 1, "bool_or")


def _reached(cells: str) -> str:
    """CTEs of which blob_of has the first pixel that each set one hangs together with."""
    return f"""s AS MATERIALIZED (SELECT image, y, x, y * 64 + x AS id FROM {cells} WHERE set),
e AS MATERIALIZED (SELECT a.image, a.id AS a, b.id AS b FROM s AS a, range(-1, 2) AS r(dy), range(-1, 2) AS t(dx) JOIN s AS b ON a.image = b.image AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.id <> b.id),
c(image, id, reached) AS (SELECT image, id, id FROM s UNION SELECT c.image, c.id, e.b FROM c JOIN e ON c.image = e.image AND c.reached = e.a),
blob_of AS (SELECT s.image, s.y, s.x, root FROM s JOIN (SELECT image, id, min(reached) AS root FROM c GROUP BY ALL) USING (image, id))"""


@query(f"WITH RECURSIVE {_reached(_cells(SOME))} SELECT image, (root // 64)::INT AS first_y, (root % 64)::INT AS first_x, count(*) AS area, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM blob_of GROUP BY image, root")
def mask_blobs(spark, d):
    """Every blob of each photograph's mask, by its first pixel."""
    found = masks.blobs(masks.labelled(masks.runs(mask(spark, d, SOME), KEYS), KEYS), KEYS)
    return found.select("image", F.shiftright("blob", 32).cast("int").alias("first_y"), (F.col("blob") % (1 << 32)).cast("int").alias("first_x"), "area", "x1", "y1", "x2", "y2")


@query(f"SELECT image, y::INT AS y, string_agg(set::INT::VARCHAR, '' ORDER BY x) AS line FROM {MORPHED_SQL} GROUP BY image, y")
def mask_closed_opened(spark, d):
    return shown(masks.opened(masks.closed(mask(spark, d, FEW), KEYS, 2), KEYS, 1))


#: The blob at the middle, or else the largest, of each mask, without its holes: what can't be reached from the edge over sides.
CLEAN_SQL = f"""WITH RECURSIVE {_reached(MORPHED_SQL)}, frame AS MATERIALIZED (SELECT DISTINCT image, y, x, max(y) OVER (PARTITION BY image) AS last FROM {_cells(FEW)}),
area AS (SELECT image, root, count(*) AS n, bool_or(y = (last + 1) // 2 AND x = 32) AS middle FROM blob_of JOIN frame USING (image, y, x) GROUP BY image, root),
main AS MATERIALIZED (SELECT * FROM area QUALIFY row_number() OVER (PARTITION BY image ORDER BY middle DESC, n DESC, root) = 1),
fragments AS (SELECT main.image, count(*) - 1 AS fragments FROM main JOIN area ON main.image = area.image AND area.n > 25e-2 * main.n GROUP BY 1),
free AS MATERIALIZED (SELECT image, y, x, last FROM frame SEMI JOIN main USING (image) ANTI JOIN (SELECT image, y, x FROM blob_of JOIN main USING (image, root)) AS b USING (image, y, x)),
outside(image, y, x) AS (SELECT image, y, x FROM free WHERE y = 0 OR y = last OR x = 0 OR x = 63
  UNION SELECT f.image, f.y, f.x FROM outside AS o, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS w(dy, dx) JOIN free AS f ON f.image = o.image AND f.y = o.y + dy AND f.x = o.x + dx),
inside AS MATERIALIZED (SELECT image, y, x FROM frame SEMI JOIN main USING (image) ANTI JOIN outside USING (image, y, x))"""


@query(f"{CLEAN_SQL} SELECT image, n AS area, fragments, filled FROM main JOIN fragments USING (image) JOIN (SELECT image, count(*) AS filled FROM inside GROUP BY 1) USING (image)")
def mask_cleaned(spark, d):
    """The main blob of each photograph's mask: its pixels before and after filling, and the other large ones."""
    clean, main = masks.cleaned(mask(spark, d, FEW), KEYS)
    inside = clean.groupBy("image").agg(F.sum(F.expr("aggregate(bits, 0L, (a, w) -> a + bit_count(w))")).alias("filled"))
    return main.join(inside, "image").select("image", "area", "fragments", "filled")


@query(f"""{CLEAN_SQL}, vertex AS (SELECT image, y + dy AS y, x + dx AS x, count(*) AS n, sum(2 * dy + dx) AS which FROM inside, range(2) AS r(dy), range(2) AS t(dx) GROUP BY ALL),
corner AS (SELECT image, sum(CASE WHEN n % 2 = 1 THEN 1 WHEN n = 2 AND which = 3 AND NOT straight THEN 2 ELSE 0 END) AS corners FROM (SELECT vertex.*, d.image IS NULL AS straight FROM vertex LEFT JOIN (
  SELECT a.image, a.y, a.x FROM inside AS a JOIN inside AS b ON a.image = b.image AND b.y = a.y - 1 AND b.x = a.x - 1 UNION SELECT a.image, a.y, a.x + 1 FROM inside AS a JOIN inside AS b ON a.image = b.image AND b.y = a.y - 1 AND b.x = a.x + 1) AS d USING (image, y, x)) GROUP BY 1),
side AS (SELECT a.image, count(*) FILTER (b.image IS NULL) AS edges FROM inside AS a CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS w(dy, dx) LEFT JOIN inside AS b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1)
SELECT image, count(*)::DOUBLE AS area, edges, corners::INT AS corners, edges::DOUBLE AS perimeter FROM inside JOIN side USING (image) JOIN corner USING (image) GROUP BY image, edges, corners""")
def mask_outline(spark, d):
    """The outline traced around each cleaned mask; it encloses as much as there are pixels."""
    clean, _ = masks.cleaned(mask(spark, d, FEW), KEYS)
    found = geometry.area_perimeter(masks.outlined(clean, KEYS))
    return found.select("image", "area", F.col("edges").cast("long").alias("edges"), F.size("contour").alias("corners"), "perimeter")


#: For these outlines, whose points lie at random.
COARSE = Segment(smooth_epsilon=0.03)
#: The ring from one of two points far apart on, then splits at the farthest points of sides, until none lies too far.
SIMPLE_SQL = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id, i, x, y, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) OVER (PARTITION BY vec_id) * {COARSE.smooth_epsilon:e} AS eps FROM {POINTS_SQL}),
one AS (SELECT vec_id, arg_max(q.i, {{{{'d': (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), 'i': -q.i}}}}) AS f FROM p JOIN p AS q USING (vec_id) WHERE p.i = 0 GROUP BY 1),
two AS (SELECT vec_id, arg_max(q.i, {{{{'d': (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), 'i': -q.i}}}}) AS f FROM one JOIN p USING (vec_id) JOIN p AS q USING (vec_id) WHERE p.i = f GROUP BY 1),
ring AS MATERIALIZED (SELECT vec_id, (i - f + 32) % 32 AS j, x, y, eps FROM p JOIN two USING (vec_id) UNION ALL SELECT vec_id, 32, x, y, eps FROM p JOIN two USING (vec_id) WHERE i = f),
three AS (SELECT vec_id, arg_max(q.j, {{{{'d': (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), 'j': -q.j}}}}) AS g FROM ring AS p JOIN ring AS q USING (vec_id) WHERE p.j = 0 GROUP BY 1),
side(vec_id, a, b) AS (SELECT vec_id, unnest([0, g]), unnest([g, 32]) FROM three UNION ALL
  SELECT vec_id, unnest([a, k]), unnest([k, b]) FROM (SELECT s.vec_id, s.a, s.b, any_value(o.eps) AS eps, max(d) AS most, arg_max(o.j, {{{{'d': d, 'j': -o.j}}}}) AS k FROM (
    SELECT s.vec_id, s.a, s.b, o.j, o.eps, abs((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x)) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d
    FROM side AS s JOIN ring AS p ON p.vec_id = s.vec_id AND p.j = s.a JOIN ring AS q ON q.vec_id = s.vec_id AND q.j = s.b JOIN ring AS o ON o.vec_id = s.vec_id AND o.j > s.a AND o.j < s.b) AS o JOIN side AS s USING (vec_id, a, b) GROUP BY ALL) WHERE most > eps),
few AS (SELECT DISTINCT vec_id, a AS j FROM side), kept AS (SELECT ring.* FROM ring JOIN (SELECT vec_id FROM few GROUP BY 1 HAVING count(*) >= 8) USING (vec_id) WHERE j < 32 AND (vec_id, j) IN (SELECT vec_id, j FROM few) UNION ALL SELECT * FROM ring WHERE j < 32 AND vec_id NOT IN (SELECT vec_id FROM few GROUP BY 1 HAVING count(*) >= 8)),
next AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM kept WINDOW w AS (PARTITION BY vec_id ORDER BY j))
SELECT vec_id, count(*)::INT AS n_points, {r('abs(sum(x * ny - nx * y)) / 2 AS area; sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter')} FROM next GROUP BY vec_id""".replace("{{", "{").replace("}}", "}")


@query(SIMPLE_SQL)
def outline_simplified(spark, d):
    found = outlines.simplified(adapter.outlines(spark, d), "contour", COARSE)
    return rounded(geometry.area_perimeter(found).select("vec_id", F.size("contour").alias("n_points"), "area", "perimeter"))


def _eliminated(table: str, n: int) -> str:
    """Rows of n equations ``m``, with n + 1 numbers each, brought to solved form one unknown at a time."""
    for p in range(1, n + 1):
        table = f"(SELECT * EXCLUDE (m), list_transform(range({n}), lambda i: CASE WHEN i + 1 = {p} THEN list_transform(m[{p}], lambda v: v / m[{p}][{p}]) ELSE list_transform(range({n + 1}), lambda k: m[i + 1][k + 1] - m[{p}][k + 1] * m[i + 1][{p}] / m[{p}][{p}]) END) AS m FROM {table})"
    return table


def _normal(terms: list[str], points: str, keep: str = "") -> str:
    rows = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in [*terms, "1e0"]) + "]" for a in terms)
    return f"(SELECT vec_id{keep}, [{rows}] AS m FROM {points} GROUP BY ALL)"


_U = f"(SELECT vec_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM {POINTS_SQL} WINDOW w AS (PARTITION BY vec_id))"
_K = f"(SELECT vec_id, list_transform(m, lambda row: row[6]) AS k FROM {_eliminated(_normal(['x * x', 'y * y', 'x * y', 'x', 'y'], _U), 5)})"
_O = f"(SELECT vec_id, (k[3] * k[5] - 2 * k[2] * k[4]) / (4 * k[1] * k[2] - k[3] * k[3]) AS ox, (k[3] * k[4] - 2 * k[1] * k[5]) / (4 * k[1] * k[2] - k[3] * k[3]) AS oy FROM {_K} WHERE 4 * k[1] * k[2] > k[3] * k[3])"
_G = f"(SELECT vec_id, m[1][4] AS a, m[2][4] AS b, m[3][4] AS c FROM {_eliminated(_normal(['x * x', 'y * y', 'x * y'], f'(SELECT vec_id, x - ox AS x, y - oy AS y FROM {_U} JOIN {_O} USING (vec_id))'), 3)})"


@query(f"""SELECT vec_id, {r('e.major AS ellipse_major_px; e.minor AS ellipse_minor_px; e.angle AS ellipse_angle; sqrt(1 - power(e.minor / e.major, 2)) AS eccentricity', 5)}
FROM (SELECT vec_id FROM embeddings) LEFT JOIN (SELECT vec_id, 2 * sqrt(2 / (a + b - w)) AS major, 2 * sqrt(2 / (a + b + w)) AS minor, (degrees(atan2(c, a - b)) / 2 + 180) % 180 AS angle FROM (SELECT *, sqrt((a - b) * (a - b) + c * c) AS w FROM {_G}) WHERE a + b > w) AS e USING (vec_id)""")
def outline_ellipse(spark, d):
    """Axes of the ellipse that fits each outline best, and the eccentricity that they give."""
    made = outlines.ellipse(outlines.measured(adapter.outlines(spark, d))).withColumns({"area_px2": F.lit(1.0), "perimeter_px": F.lit(1.0)})
    fitted = F.col("ellipse_major_px").isNotNull()
    return rounded(geometry.morphology(made).select("vec_id", "ellipse_major_px", "ellipse_minor_px", "ellipse_angle", F.when(fitted, F.col("eccentricity")).alias("eccentricity")), 5)


#: The least circle of all points is the greatest of the least circles of three: half the longest side, or around all corners.
@query(f"""SELECT vec_id, {r('max(CASE WHEN c2 >= a2 + b2 THEN sqrt(c2) / 2 ELSE sqrt(a2 * b2 * c2) / (2 * twice) END) AS radius_px')} FROM (
SELECT vec_id, twice, list_sort([u, v, w])[1] AS a2, list_sort([u, v, w])[2] AS b2, list_sort([u, v, w])[3] AS c2 FROM (
SELECT p.vec_id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS u, (p.x - o.x) ** 2 + (p.y - o.y) ** 2 AS v, (o.x - q.x) ** 2 + (o.y - q.y) ** 2 AS w, abs((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x)) AS twice
FROM {POINTS_SQL} AS p JOIN {POINTS_SQL} AS q ON p.vec_id = q.vec_id AND p.i < q.i JOIN {POINTS_SQL} AS o ON o.vec_id = p.vec_id AND o.i > q.i)) GROUP BY vec_id""")
def outline_circle(spark, d):
    return rounded(outlines.circle(adapter.outlines(spark, d)).select("vec_id", "radius_px"))


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255 <= 4045e-5 THEN {c} / 255 / 1292e-2 ELSE power(({c} / 255 + 55e-3) / 1055e-3, 24e-1) END"


def _bent(t: str) -> str:
    return f"CASE WHEN {t} > 8856e-6 THEN cbrt({t}) ELSE 7787e-3 * {t} + 16e0 / 116 END"


#: Pixels with grey, hue, saturation, L*, a* and b* as bytes have them.
PIXELS_SQL = f"""(SELECT image, y, x, r, g, b, floor(299e-3 * r + 587e-3 * g + 114e-3 * b + 5e-1) AS grey, CASE WHEN most = 0 THEN 0 ELSE floor(255 * (most - least) / most + 5e-1) END AS sat,
floor((CASE WHEN turn < 0 THEN turn + 360 ELSE turn END) / 2 + 5e-1) % 180 AS hue, floor((CASE WHEN cy > 8856e-6 THEN 116 * cbrt(cy) - 16 ELSE 9033e-1 * cy END) * 255 / 100 + 5e-1) * 100 / 255 AS l,
floor(500 * ({_bent('cx')} - {_bent('cy')}) + 128 + 5e-1) - 128 AS a_, floor(200 * ({_bent('cy')} - {_bent('cz')}) + 128 + 5e-1) - 128 AS b_
FROM (SELECT *, (412453e-6 * lr + 357580e-6 * lg + 180423e-6 * lb) / 950456e-6 AS cx, 212671e-6 * lr + 715160e-6 * lg + 72169e-6 * lb AS cy, (19334e-6 * lr + 119193e-6 * lg + 950227e-6 * lb) / 1088754e-6 AS cz,
CASE WHEN most = least THEN 0e0 WHEN most = r THEN 60e0 * (g - b) / (most - least) WHEN most = g THEN 120 + 60e0 * (b - r) / (most - least) ELSE 240 + 60e0 * (r - g) / (most - least) END AS turn
FROM (SELECT *, greatest(r, g, b) AS most, least(r, g, b) AS least, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM {adapter.COLOURED_SQL})))"""
#: The pixels of each cleaned mask whose neighbours all belong to it, or all of them where these are fewer than ten.
CORE_SQL = f"""{CLEAN_SQL}, deep AS (SELECT image, y, x FROM inside ANTI JOIN (SELECT image, y + dy AS y, x + dx AS x FROM (SELECT image, y, x FROM frame ANTI JOIN inside USING (image, y, x)), range(-1, 2) AS r(dy), range(-1, 2) AS t(dx)) AS o USING (image, y, x)),
core AS (SELECT image, y, x FROM deep WHERE image IN (SELECT image FROM deep GROUP BY 1 HAVING count(*) >= 10) UNION ALL SELECT image, y, x FROM inside WHERE image NOT IN (SELECT image FROM deep GROUP BY 1 HAVING count(*) >= 10) AND image IN (SELECT image FROM inside GROUP BY 1 HAVING count(*) >= 10))"""
_MEANS = "avg(r) AS mean_R; avg(g) AS mean_G; avg(b) AS mean_B; avg(l) AS mean_L; avg(a_) AS lab_a; avg(b_) AS lab_b; avg(sqrt(a_ * a_ + b_ * b_)) AS chroma; (degrees(atan2(avg(b_), avg(a_))) + 360) % 360 AS hue_angle; avg(hue) AS mean_hue; avg(sat) AS saturation; avg(grey) AS brightness; stddev_pop(grey) AS texture_std"


@query(f"{CORE_SQL} SELECT image, {r(_MEANS)}, '#' || upper(lpad(to_hex(floor(avg(r))::INT), 2, '0') || lpad(to_hex(floor(avg(g))::INT), 2, '0') || lpad(to_hex(floor(avg(b))::INT), 2, '0')) AS hex FROM {PIXELS_SQL} JOIN core USING (image, y, x) GROUP BY image")
def object_colours(spark, d):
    """Colour of the object in each photograph, sampled inside its rim."""
    clean, _ = masks.cleaned(mask(spark, d, FEW), KEYS)
    return rounded(pixels.colours(adapter.coloured(spark, d), clean, KEYS).select("image", *[x.rpartition(" AS ")[2] for x in _MEANS.split("; ")], "hex"))


def _otsu(pixels_: str) -> str:
    """image, t from rows of image and level."""
    return f"""(SELECT image, level AS t FROM (SELECT image, level, sum(n) OVER q AS w0, sum(n * level) OVER q AS s0, sum(n) OVER (PARTITION BY image) AS w, sum(n * level) OVER (PARTITION BY image) AS s FROM (SELECT image, level::BIGINT AS level, count(*) AS n FROM {pixels_} GROUP BY ALL) WINDOW q AS (PARTITION BY image ORDER BY level))
QUALIFY row_number() OVER (PARTITION BY image ORDER BY round((s0 * w - s * w0)::DOUBLE * (s0 * w - s * w0) / nullif(w0::DOUBLE * (w - w0), 0), 6) DESC NULLS LAST, level) = 1)"""


@query(f"""{CORE_SQL}, px AS MATERIALIZED (SELECT p.* FROM {PIXELS_SQL} AS p JOIN inside USING (image, y, x)),
parted AS (SELECT image, count(*) AS n, any_value(t) AS t, avg(grey) FILTER (grey <= t) AS d, avg(grey) FILTER (grey > t) AS l, avg(grey) - stddev_pop(grey) AS low FROM px JOIN {_otsu('(SELECT image, grey AS level FROM px)')} USING (image) GROUP BY image),
cut AS MATERIALIZED (SELECT image, n, low, CASE WHEN coalesce(l - d >= 8, false) THEN t ELSE -1 END AS t FROM parted WHERE n >= 10),
dark AS MATERIALIZED (SELECT image, y, x FROM px JOIN cut USING (image) WHERE grey <= t),
square AS (SELECT image, y - dy AS y, x - dx AS x FROM dark, range(2) AS r(dy), range(2) AS t(dx) GROUP BY ALL HAVING count(*) = 4),
spot AS MATERIALIZED (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM square, range(2) AS r(dy), range(2) AS t(dx)),
near AS MATERIALIZED (SELECT a.image, a.y * 64 + a.x AS a, b.y * 64 + b.x AS b FROM spot AS a, range(-1, 2) AS r(dy), range(-1, 2) AS t(dx) JOIN spot AS b ON a.image = b.image AND b.y = a.y + dy AND b.x = a.x + dx),
way(image, id, reached) AS (SELECT image, y * 64 + x, y * 64 + x FROM spot UNION SELECT way.image, way.id, near.b FROM way JOIN near ON way.image = near.image AND way.reached = near.a),
size AS (SELECT image, root, count(*) AS area FROM (SELECT image, id, min(reached) AS root FROM way GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 3),
sums AS (SELECT image, count(area) AS c, coalesce(sum(area), 0) AS total, max(area) AS most, coalesce(sum(area), 0) > 90e-2 * any_value(n) AS shade, any_value(n) AS n FROM cut LEFT JOIN size USING (image) GROUP BY image),
tones AS (SELECT image, avg(l) FILTER (s) AS ls, avg(l) FILTER (NOT s) AS lb, avg(a_) FILTER (s) AS sa, avg(a_) FILTER (NOT s) AS ba, avg(b_) FILTER (s) AS sb, avg(b_) FILTER (NOT s) AS bb, count(*) FILTER (s) >= 5 AND count(*) FILTER (NOT s) >= 5 AS enough, avg((grey < low)::INT) AS dark_fraction
  FROM (SELECT px.*, low, spot.image IS NOT NULL AND NOT shade AS s FROM px JOIN cut USING (image) JOIN sums USING (image) LEFT JOIN spot ON spot.image = px.image AND spot.y = px.y AND spot.x = px.x) GROUP BY image),
light AS (SELECT image, avg(l) AS mean_l FROM {PIXELS_SQL} JOIN core USING (image, y, x) GROUP BY image),
made AS (SELECT image, CASE WHEN shade THEN 0 ELSE c END::INT AS spot_count, CASE WHEN shade THEN 0e0 ELSE total / n END AS spot_coverage, CASE WHEN shade THEN 0e0 ELSE coalesce(most / n, 0) END AS largest_spot, CASE WHEN shade OR c = 0 THEN 0e0 ELSE total / c END AS mean_spot_px,
  CASE WHEN enough THEN sqrt((ls - lb) * (ls - lb) + (sa - ba) * (sa - ba) + (sb - bb) * (sb - bb)) ELSE 0 END AS spot_contrast_dE, dark_fraction, mean_l FROM sums JOIN tones USING (image) JOIN light USING (image))
SELECT image, spot_count, {r('spot_coverage AS spot_coverage; largest_spot AS largest_spot; mean_spot_px AS mean_spot_px; spot_contrast_dE AS spot_contrast_dE; dark_fraction AS dark_fraction')},
CASE WHEN mean_l < 35 THEN 'black' WHEN largest_spot > 15e-2 THEN 'marbled' WHEN spot_count = 0 OR spot_coverage < 2e-2 THEN 'plain' WHEN spot_count >= 12 THEN 'dotted' ELSE 'spotted' END AS pattern_class FROM made""")
def object_coats(spark, d):
    """Spots of the object in each photograph, and the pattern that they make."""
    clean, _ = masks.cleaned(mask(spark, d, FEW), KEYS)
    return rounded(pixels.coat(adapter.coloured(spark, d), clean, KEYS))


def _convolved(table: str, weights: str, place: str) -> str:
    """Rows of image, y, x, level summed with ``weights`` (o, w) along one axis; ``place`` says where an index beyond the edge lies."""
    for axis, size in (("x", "64"), ("y", "height")):
        other = "y" if axis == "x" else "x"
        table = f"(SELECT a.image, a.y, a.x, any_value(a.height) AS height, sum(w.w * b.level) AS level FROM {table} AS a JOIN {weights} AS w ON true JOIN {table} AS b ON b.image = a.image AND b.{other} = a.{other} AND b.{axis} = {place.format(i=f'(a.{axis} + w.o)', n='64' if axis == 'x' else 'a.height')} GROUP BY a.image, a.y, a.x)"
    return table


def _turned(cells: str) -> str:
    """Where most of a picture's edge is set, the others."""
    lit = f"(SELECT image, sum(set::INT * ((y = 0)::INT + (y = height - 1)::INT + (x = 0)::INT + (x = 63)::INT)) > height + 64 AS lit FROM {cells} GROUP BY image, height)"
    return f"(SELECT image, y, x, set <> lit AS set FROM {cells} JOIN {lit} USING (image))"


_HIGH = f"(SELECT image, y, x, max(y) OVER (PARTITION BY image) + 1 AS height, grey AS level FROM {PIXELS_SQL})"
_SOFT = f"(SELECT image, y, x, height, floor(level + 5e-1) AS level FROM {_convolved('g', '(VALUES (-2, 625e-4), (-1, 25e-2), (0, 375e-3), (1, 25e-2), (2, 625e-4)) AS v(o, w)', 'abs((({i} + {n} - 1) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2) - {n} + 1)').replace(') AS v(o, w) AS w', ') AS w(o, w)')})"
_LINES = "SELECT image, y::INT AS y, string_agg(set::INT::VARCHAR, '' ORDER BY x) AS line FROM {} GROUP BY image, y"


@query(f"WITH g AS MATERIALIZED {_HIGH}, soft AS MATERIALIZED {_SOFT}, cells AS MATERIALIZED (SELECT image, y, x, height, level <= t AS set FROM soft JOIN {_otsu('soft')} USING (image)) {_LINES.format(_turned('cells'))}")
def otsu_masks(spark, d):
    """Each photograph's mask by its own threshold on blurred grey."""
    return shown(pixels.otsu_mask(pixels.channel(adapter.coloured(spark, d), KEYS, "grey"), KEYS))


#: A window of 23 pixels (a share of 64, made odd), and the deviation that goes with it; edges are held.
_BELL = "(SELECT o, exp(-o * o / (2 * 38e-1 * 38e-1)) / sum(exp(-o * o / (2 * 38e-1 * 38e-1))) OVER () AS w FROM range(-11, 12) AS t(o))"


@query(f"WITH g AS MATERIALIZED {_HIGH}, soft AS MATERIALIZED {_SOFT}, bell AS MATERIALIZED {_BELL}, mean AS MATERIALIZED {_convolved('soft', 'bell', 'least(greatest({i}, 0), {n} - 1)')}, cells AS MATERIALIZED (SELECT image, y, x, soft.height, soft.level - floor(mean.level + 5e-1) <= -4 AS set FROM soft JOIN mean USING (image, y, x)) {_LINES.format(_turned('cells'))}")
def adaptive_masks(spark, d):
    """Each photograph's mask of pixels darker than what is around them."""
    return shown(pixels.adaptive_mask(pixels.channel(adapter.coloured(spark, d), KEYS, "grey"), KEYS))


@query()
def objects_segmented(spark, d):
    """The object cut out of each photograph, and by which threshold. Four methods in turn: tested on drawn pictures instead of by SQL."""
    _, told = pixels.segmented(adapter.coloured(spark, d), KEYS)
    return rounded(told.select("image", "method", "area", "fragments", "fill", "border_touch", "plausible"))
