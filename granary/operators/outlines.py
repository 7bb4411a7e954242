"""Measures of closed outlines: convex hull, rectangles, diameters, ellipse, circle, fewer vertices.

Each is one expression over the outline's array of points, so a row stays where it lies and nothing is shuffled. Loops
are aggregates over steps with a small state; parts that are used again are bound by ``let``, since a column could be
written out anew wherever the optimizer moves it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import Segment
from granary.functions.exprs import let

POINTS = "array<struct<x:double,y:double>>"


def _finite(contour: str) -> str:
    """Points as doubles; those with a null or non-finite coordinate are left out."""
    ok = "p.x is not null and p.y is not null and abs(p.x) < double('inf') and abs(p.y) < double('inf')"
    return f"filter(transform(`{contour}`, p -> struct(cast(p.x as double) as x, cast(p.y as double) as y)), p -> {ok})"


def _cross(o: str, p: str, q: str) -> str:
    return f"(({p}.x - {o}.x) * ({q}.y - {o}.y) - ({p}.y - {o}.y) * ({q}.x - {o}.x))"


def _gap(p: str, q: str) -> str:
    return f"sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"


def hull_points(contour: str = "contour") -> Column:
    """Corners of the convex hull, counter-clockwise from the leftmost (then lowest) point; none on a straight side.

    A monotone chain: points in order are pushed onto a chain, from which a step first takes a corner that the next point
    would turn right at. Pushes and takes together are at most twice the points.
    """
    half = lambda u: (
        f"aggregate(sequence(1, 2 * size({u})), struct(cast(array() as {POINTS}) as s, 0 as i), (a, k) -> case when a.i >= size({u}) then a "
        f"when size(a.s) >= 2 and {_cross('element_at(a.s, -2)', 'element_at(a.s, -1)', f'{u}[a.i]')} <= 0 then struct(slice(a.s, 1, size(a.s) - 1) as s, a.i as i) "
        f"else struct(array_append(a.s, {u}[a.i]) as s, a.i + 1 as i) end).s"
    )
    both = let("low", half("u"), let("v", "reverse(u)", let("up", half("v"), "concat(slice(low, 1, size(low) - 1), slice(up, 1, size(up) - 1))")))
    return F.expr(let("u", f"array_sort(array_distinct({_finite(contour)}))", f"if(size(u) <= 1, u, {both})"))


#: What a turn of the calipers gives.
CALIPERS = ("hull_area", "hull_perimeter", "length_px", "width_px", "rect_angle", "feret_max_px", "breadth_min_px")


def _calipers(h: str) -> str:
    """A struct of CALIPERS from hull corners ``h``, by rotating calipers.

    For each side, three pointers run on to the corners farthest along it, across it and back along it; as none ever turns
    back, there are at most four steps a side. The pointers give the side's rectangle and its opposite corners.
    """
    n, at = f"size({h})", lambda i: f"{h}[({i}) % size({h})]"
    p, q = at("a.e"), at("a.e + 1")
    along = lambda i, j: f"(({q}.x - {p}.x) * ({at(j)}.x - {at(i)}.x) + ({q}.y - {p}.y) * ({at(j)}.y - {at(i)}.y))"
    across = lambda i, j: f"(({q}.x - {p}.x) * ({at(j)}.y - {at(i)}.y) - ({q}.y - {p}.y) * ({at(j)}.x - {at(i)}.x))"
    state = lambda **new: "struct(" + ", ".join(f"{new.get(f, f'a.{f}')} as {f}" for f in ("e", "r", "t", "l", "best", "far", "thin", "area", "way")) + ")"
    side = _gap(p, q)
    least = f"struct(round(b.w * b.h, 9) as area, -greatest(b.w, b.h) as less, least(b.w, b.h) as width, 90 - pmod(90 - degrees(atan2({q}.y - {p}.y, {q}.x - {p}.x)), 90D) as angle)"
    measured = let(
        "b", f"struct({along('a.l', 'a.r')} / {side} as w, {across('a.e', 'a.t')} / {side} as h)",
        state(
            e="a.e + 1", r="greatest(a.r, a.e + 2)", t="greatest(a.t, a.e + 2)", l="greatest(a.l, a.e + 2)", best=f"least(a.best, {least})", thin="least(a.thin, b.h)", way=f"a.way + {side}", area=f"a.area + {p}.x * {q}.y - {q}.x * {p}.y",
            far="greatest(a.far, " + ", ".join(_gap(c, at(t)) for c in (p, q) for t in ("a.t", "a.t + 1")) + ")",
        ),
    )
    step = (
        f"case when a.e >= {n} then a when {along('a.r', 'a.r + 1')} > 0 then {state(r='a.r + 1')} when a.t < a.r then {state(t='a.r')} when {across('a.t', 'a.t + 1')} > 0 then {state(t='a.t + 1')} "
        f"when a.l < a.t then {state(l='a.t')} when {along('a.l', 'a.l + 1')} < 0 then {state(l='a.l + 1')} else {measured} end"
    )
    begin = "struct(0 as e, 1 as r, 1 as t, 1 as l, struct(double('inf') as area, 0D as less, 0D as width, 0D as angle) as best, 0D as far, double('inf') as thin, 0D as area, 0D as way)"
    turned = f"aggregate(sequence(1, 8 * {n}), {begin}, (a, k) -> {step})"
    out = "z.area / 2, z.way, -z.best.less, z.best.width, z.best.angle, z.far, z.thin".split(", ")
    named = lambda values: "struct(" + ", ".join(f"{v} as {c}" for v, c in zip(values, CALIPERS)) + ")"
    return f"case when {n} = 1 then {named(['0D', '0D', '0D', '0D', 'cast(null as double)', '0D', '0D'])} when {n} > 1 then {let('z', turned, named(out))} end"


def measured(df: DataFrame, contour: str = "contour") -> DataFrame:
    """Adds the hull's area and perimeter, length and width (sides of the rectangle of least area around the outline), its
    angle, greatest Feret diameter, the rectangle's width as least one, and breadth_min_px, the least over all directions.

    rect_angle: degrees in (0, 90] of a side against the x axis. Of rectangles of one area (to nine places, as all three on a
    triangle are), the longest counts. All null for an outline without a finite point; zero, but
    for the angle, for a single point. Repeated points count once.
    """
    out = df.withColumn("_hull", hull_points(contour)).withColumn("_turn", F.expr(_calipers("_hull")))
    return out.withColumns({c: F.col(f"_turn.{c}") for c in CALIPERS} | {"feret_min_px": F.col("_turn.width_px")}).drop("_hull", "_turn")


def _far(points: str, origin: str) -> str:
    """The place of the point farthest from the one at ``origin``, the first of several."""
    return f"-array_max(transform({points}, (p, i) -> struct((p.x - {points}[{origin}].x) * (p.x - {points}[{origin}].x) + (p.y - {points}[{origin}].y) * (p.y - {points}[{origin}].y) as d, -i as i))).i"


def simplified(df: DataFrame, contour: str = "contour", cfg: Segment = Segment()) -> DataFrame:
    """Replaces the closed outline by fewer of its points, none farther than smooth_epsilon of its length from the new sides.

    Split rounds: the ring is cut at two points far apart (going thrice to the farthest point); then, in each round, every
    side whose farthest point lies too far from it is split there, all sides at once. Outlines of at most ``smooth_from``
    points stay, as do those that would be left with fewer than ``least_points``. Ties go to the first point on the way.
    """
    ring = "concat(slice(c, f + 1, size(c)), slice(c, 1, f + 1))"  # begins and ends at the cut
    off = "abs((r[k[j + 1]].x - r[k[j]].x) * (r[i].y - r[k[j]].y) - (r[k[j + 1]].y - r[k[j]].y) * (r[i].x - r[k[j]].x))"
    side = _gap("r[k[j + 1]]", "r[k[j]]")
    distance = f"if({side} = 0, {_gap('r[i]', 'r[k[j]]')}, {off} / {side})"
    farthest = f"array_max(transform(sequence(k[j] + 1, k[j + 1] - 1), i -> struct({distance} as d, -i as i)))"
    split = f"if(k[j + 1] - k[j] < 2, array(k[j]), {let('w', farthest, 'if(w.d > eps, array(k[j], -w.i), array(k[j]))')})"
    once = f"concat(flatten(transform(sequence(0, size(k) - 2), j -> {split})), array(element_at(k, -1)))"
    rounds = f"aggregate(sequence(1, size(r)), struct(array(0, g, size(r) - 1) as k, false as done), (a, n) -> if(a.done, a, {let('k', 'a.k', let('m', once, 'struct(m as k, size(m) = size(k) as done)'))})).k"
    way = f"aggregate(transform(c, (p, i) -> {_gap('p', 'c[(i + 1) % size(c)]')}), 0D, (s, v) -> s + v)"
    cut = let("o", _far("c", "0"), let("f", _far("c", "o"), let("r", ring, let("g", _far("r", "0"), let("eps", f"{cfg.smooth_epsilon}D * {way}", let("kept", rounds, "transform(slice(kept, 1, size(kept) - 1), i -> r[i])"))))))
    fewer = let("c", _finite(contour), f"if(size(c) <= {cfg.smooth_from}, c, {let('few', cut, f'if(size(few) >= {cfg.least_points}, few, c)')})") if cfg.smooth_epsilon > 0 else _finite(contour)
    return df.withColumn(contour, F.expr(fewer))


def _solved(matrix: str, n: int) -> str:
    """Solution of the ``n`` symmetric equations given as rows of n + 1 numbers, by elimination without a change of rows."""
    step = "transform(m, (row, i) -> if(i = p, transform(row, v -> try_divide(v, m[p][p])), zip_with(row, m[p], (v, u) -> v - u * try_divide(row[p], m[p][p]))))"
    return f"transform(aggregate(sequence(0, {n - 1}), {matrix}, (m, p) -> {step}), row -> element_at(row, -1))"


def _least_squares(points: str, terms: Sequence[str]) -> str:
    """Coefficients that bring the sum of coefficient times term (of point ``p``) nearest to 1 over all points."""
    sums = [[f"aggregate(transform({points}, p -> ({a}) * ({b})), 0D, (s, v) -> s + v)" for b in [*terms, "1D"]] for a in terms]
    return _solved("array(" + ", ".join("array(" + ", ".join(row) + ")" for row in sums) + ")", len(terms))


def ellipse(df: DataFrame, contour: str = "contour") -> DataFrame:
    """Adds ellipse_major_px, ellipse_minor_px, ellipse_angle: full axes of the conic that fits the points best, and the
    degrees in [0, 180) of the minor axis against the x axis, as a rectangle that stands upright has it.

    Two sums of squares: a conic through all five terms, around the points' mean, gives the centre; the three quadratic terms
    around it give the axes. Null below five points, for points on a line, and where the best conic is no ellipse.
    """
    mean = lambda c: f"aggregate(c, 0D, (s, p) -> s + p.{c}) / size(c)"
    centred = let("x0", mean("x"), let("y0", mean("y"), "transform(c, p -> struct(p.x - x0 as x, p.y - y0 as y))"))
    scale = "sqrt(aggregate(q, 0D, (s, p) -> s + p.x * p.x + p.y * p.y) / size(q))"
    unit = "transform(q, p -> struct(p.x / z as x, p.y / z as y))"
    # the conic's centre solves 2ax + cy = -d, cx + 2by = -e
    bottom = "(4 * k[0] * k[1] - k[2] * k[2])"
    centre = f"struct((k[2] * k[4] - 2 * k[1] * k[3]) / {bottom} as x, (k[2] * k[3] - 2 * k[0] * k[4]) / {bottom} as y)"
    around = "transform(u, p -> struct(p.x - o.x as x, p.y - o.y as y))"
    # eigenvalues of the quadratic form are the inverse squares of the half axes
    root = "sqrt((g[0] - g[1]) * (g[0] - g[1]) + g[2] * g[2])"
    axes = "struct(2 * z * sqrt(2 / (g[0] + g[1] - w)) as major, 2 * z * sqrt(2 / (g[0] + g[1] + w)) as minor, pmod(degrees(atan2(g[2], g[0] - g[1])) / 2, 180D) as angle)"
    drawn = let("g", _least_squares("a", ("p.x * p.x", "p.y * p.y", "p.x * p.y")), let("w", root, f"if(g[0] + g[1] > w, {axes}, null)"))
    fitted = let("u", unit, let("k", _least_squares("u", ("p.x * p.x", "p.y * p.y", "p.x * p.y", "p.x", "p.y")), f"if({bottom} > 0, {let('o', centre, let('a', around, drawn))}, null)"))
    whole = let("c", _finite(contour), f"if(size(c) >= 5, {let('q', centred, let('z', scale, f'if(z > 0, {fitted}, null)'))}, null)")
    out = df.withColumn("_ellipse", F.expr(whole))
    names = {"ellipse_major_px": "major", "ellipse_minor_px": "minor", "ellipse_angle": "angle"}
    return out.withColumns({c: F.col(f"_ellipse.{p}") for c, p in names.items()}).drop("_ellipse")


def circle(df: DataFrame, contour: str = "contour") -> DataFrame:
    """Adds radius_px of the least circle around the outline; null without a finite point, 0 for a single one.

    On the hull's corners: a side of the hull is taken, then in each step the corner that sees it under the smallest angle.
    If that is a right angle or more, the side is the circle's diameter; if the triangle has no larger angle, its corners lie on
    the circle; else the side opposite to its large angle is looked at next. Radii fall at each step.
    """
    seen = "transform(h, q -> struct((h[a.i].x - q.x) * (h[a.j].x - q.x) + (h[a.i].y - q.y) * (h[a.j].y - q.y) as dot, abs((h[a.i].x - q.x) * (h[a.j].y - q.y) - (h[a.i].y - q.y) * (h[a.j].x - q.x)) as cross))"
    angle = "if(i = a.i or i = a.j, double('inf'), atan2(s.cross, s.dot))"
    least = f"array_min(transform({seen}, (s, i) -> struct({angle} as angle, i as i)))"
    corner = lambda i, j, k: f"((h[{j}].x - h[{i}].x) * (h[{k}].x - h[{i}].x) + (h[{j}].y - h[{i}].y) * (h[{k}].y - h[{i}].y))"
    state = lambda i, j, r: f"struct({i} as i, {j} as j, {r} as r)"
    chord = _gap("h[a.i]", "h[a.j]")
    step = let("t", least, (
        f"case when t.angle >= pi() / 2 then {state('a.i', 'a.j', f'{chord} / 2')} when {corner('a.i', 'a.j', 't.i')} < 0 then {state('a.j', 't.i', 'a.r')} when {corner('a.j', 'a.i', 't.i')} < 0 then {state('a.i', 't.i', 'a.r')} "
        f"else {state('a.i', 'a.j', f'{chord} / (2 * sin(t.angle))')} end"
    ))
    found = f"aggregate(sequence(1, size(h)), {state('0', '1', 'cast(null as double)')}, (a, n) -> if(a.r is not null, a, {step})).r"
    radius = f"case size(h) when 0 then null when 1 then 0D when 2 then {_gap('h[0]', 'h[1]')} / 2 else {found} end"
    return df.withColumn("_hull", hull_points(contour)).withColumn("radius_px", F.expr(let("h", "_hull", radius))).drop("_hull")
