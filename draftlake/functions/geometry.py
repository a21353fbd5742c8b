"""Geometry as column expressions: points and boxes are structs, transforms arrays of sixteen doubles in rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
#: Below 1/64 in both x and y a normal counts as upright.
UPRIGHT = 1.0 / 64.0


def point(x, y, z=0.0) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(z).alias("z"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _each(f, *points: Column) -> Column:
    return point(*[f(*[p[k] for p in points]) for k in "xyz"])


def add(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p + q, a, b)


def sub(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p - q, a, b)


def scale(a: Column, k) -> Column:
    return _each(lambda p: p * k, a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def distance_2d(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def lerp(a: Column, b: Column, t) -> Column:
    return _each(lambda p, q: p + (q - p) * t, a, b)


def normalize(a: Column, eps: float = 1e-12) -> Column:
    """Unit vector, or the zero vector for one shorter than eps."""
    return let(a, lambda v: let(length(v), lambda n: _each(lambda p: F.when(n < eps, 0.0).otherwise(p / n), v)))


def matrix(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def translation(p: Column) -> Column:
    return matrix(1, 0, 0, p["x"], 0, 1, 0, p["y"], 0, 0, 1, p["z"], 0, 0, 0, 1)


def scaling(p: Column) -> Column:
    return matrix(p["x"], 0, 0, 0, 0, p["y"], 0, 0, 0, 0, p["z"], 0, 0, 0, 0, 1)


def rotation_z(angle: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return matrix(c, -s, 0, 0, s, c, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def compose(a: Column, b: Column) -> Column:
    """a after b."""
    product = lambda p, q: F.array(*[sum((p[4 * i + k] * q[4 * k + j] for k in range(1, 4)), p[4 * i] * q[j]) for i in range(4) for j in range(4)])
    return let(a, lambda p: let(b, lambda q: product(p, q)))


def compose_chain(chain: Column) -> Column:
    """All transforms of an array composed from left to right; the identity for an empty one."""
    return F.aggregate(chain, matrix(*IDENTITY), compose)


def transform_point(m: Column, p: Column) -> Column:
    row = lambda m, p, i: m[4 * i] * p["x"] + m[4 * i + 1] * p["y"] + m[4 * i + 2] * p["z"] + m[4 * i + 3]
    return let(p, lambda q: point(row(m, q, 0), row(m, q, 1), row(m, q, 2)))


def transform_vector(m: Column, p: Column) -> Column:
    row = lambda i: m[4 * i] * p["x"] + m[4 * i + 1] * p["y"] + m[4 * i + 2] * p["z"]
    return point(row(0), row(1), row(2))


def axes_matrix(origin: Column, x: Column, y: Column, z: Column) -> Column:
    rows = [v for k in "xyz" for v in (x[k], y[k], z[k], origin[k])]
    return matrix(*rows, 0, 0, 0, 1)


def axes(normal: Column) -> Column:
    """struct(x, y, z): the axes of the plane of an extrusion; the y axis is the pivot for upright normals, else the z axis."""

    def of(z: Column) -> Column:
        upright = (F.abs(z["x"]) < UPRIGHT) & (F.abs(z["y"]) < UPRIGHT)
        pivot = point(F.lit(0.0), F.when(upright, 1.0).otherwise(0.0), F.when(upright, 0.0).otherwise(1.0))
        return let(normalize(cross(pivot, z)), lambda x: F.struct(x.alias("x"), normalize(cross(z, x)).alias("y"), z.alias("z")))

    return let(normalize(normal), of)


def arbitrary_axis(normal: Column) -> tuple[Column, Column, Column]:
    a = axes(normal)
    return a["x"], a["y"], a["z"]


def invert_orthonormal(m: Column) -> Column:
    """Inverse of a rotation with a translation; scaled transforms are no case for it."""

    def inverse(m: Column) -> Column:
        t = [m[3], m[7], m[11]]
        rows = []
        for i in range(3):
            col = [m[i], m[4 + i], m[8 + i]]
            rows += [*col, -(col[0] * t[0] + col[1] * t[1] + col[2] * t[2])]
        return matrix(*rows, 0, 0, 0, 1)

    return let(m, inverse)


def insert_transform(insertion: Column, scale_: Column, rotation: Column, extrusion: Column) -> Column:
    """Block to drawing: translation, plane of the extrusion, rotation, scale."""
    plane = let(axes(extrusion), lambda a: axes_matrix(point(0.0, 0.0, 0.0), a["x"], a["y"], a["z"]))
    return compose(compose(compose(translation(insertion), plane), rotation_z(rotation)), scaling(scale_))


# Boxes: min and max point; an empty one runs from +infinity to -infinity.


def box(low: Column, high: Column) -> Column:
    return F.struct(low.alias("min"), high.alias("max"))


def empty_box() -> Column:
    inf = float("inf")
    return box(point(inf, inf, inf), point(-inf, -inf, -inf))


def is_empty(b: Column) -> Column:
    return (b["min"]["x"] > b["max"]["x"]) | (b["min"]["y"] > b["max"]["y"]) | (b["min"]["z"] > b["max"]["z"])


def _low(*cs: Column) -> Column:
    return F.least(*cs)


def _high(*cs: Column) -> Column:
    # greatest takes NaN for the largest number; here it is none
    return F.greatest(*[F.nanvl(c, F.lit(float("-inf"))) for c in cs])


def union(a: Column, b: Column) -> Column:
    return box(_each(lambda p, q: _low(p, q), a["min"], b["min"]), _each(lambda p, q: _high(p, q), a["max"], b["max"]))


def expand(b: Column, p: Column) -> Column:
    return union(b, box(p, p))


def contains(b: Column, p: Column) -> Column:
    return ~is_empty(b) & p["x"].between(b["min"]["x"], b["max"]["x"]) & p["y"].between(b["min"]["y"], b["max"]["y"]) & p["z"].between(b["min"]["z"], b["max"]["z"])


def size(b: Column) -> Column:
    return _each(lambda lo, hi: hi - lo, b["min"], b["max"])


def center(b: Column) -> Column:
    return _each(lambda lo, hi: (lo + hi) / 2, b["min"], b["max"])


def bounds_agg(p: Column) -> Column:
    """Aggregate: the box of a group's points, empty for a group without any."""
    inf = float("inf")
    low = [F.coalesce(F.min(p[k]), F.lit(inf)) for k in "xyz"]
    high = [F.coalesce(F.max(F.nanvl(p[k], F.lit(-inf))), F.lit(-inf)) for k in "xyz"]
    return box(point(*low), point(*high))


def bounds_of(points: Column) -> Column:
    """The box of an array of points."""
    return F.aggregate(points, empty_box(), expand)


# Curves: a struct with kind and the members of that kind.


def curve(kind: str, **members: Column) -> Column:
    names = {"a": "point", "b": "point", "center": "point", "major": "point", "radius": "double", "ratio": "double", "start_angle": "double", "end_angle": "double"}
    p3 = "struct<x:double,y:double,z:double>"
    cols = [F.lit(kind).alias("kind")]
    for n, t in names.items():
        cols.append((members[n] if n in members else F.lit(None).cast(p3 if t == "point" else t)).alias(n))
    return F.struct(*cols)


def curve_bounds(c: Column) -> Column:
    """Conservative box: the cube of the radius for round curves, the segment's box for others."""
    r = F.coalesce(c["radius"], length(c["major"]), F.lit(0.0))
    round_ = c["kind"].isin("circle", "arc", "ellipse")
    lo = _each(lambda p: p - r, c["center"])
    hi = _each(lambda p: p + r, c["center"])
    seg = union(box(c["a"], c["a"]), box(c["b"], c["b"]))
    return F.when(round_, box(lo, hi)).otherwise(seg)


def line_curve(e: Column) -> Column:
    return curve("line", a=e["start"], b=e["end"])


def circle_curve(e: Column) -> Column:
    return curve("circle", center=e["center"], radius=e["radius"])


def arc_curve(e: Column) -> Column:
    return curve("arc", center=e["center"], radius=e["radius"], start_angle=e["start_angle"], end_angle=e["end_angle"])


def ellipse_curve(e: Column) -> Column:
    return curve("ellipse", center=e["center"], major=e["major_axis"], ratio=e["axis_ratio"], start_angle=e["start_param"], end_angle=e["end_param"])


def point_curve(e: Column) -> Column:
    return curve("line", a=e["position"], b=e["position"])


def polyline_path(vertices: Column, closed: Column) -> Column:
    """Segments (a, b) of a list of vertices: one less than vertices, or as many for a closed one."""
    n = F.size(vertices)
    count = F.when(closed, n).otherwise(n - 1)
    steps = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.struct(F.element_at(vertices, i).alias("a"), F.element_at(vertices, i % n + 1).alias("b")))


def face_triangles(corners: Column) -> Column:
    """Indexed triangles of a face: one where the last two corners are the same, else two."""
    one = F.array(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return F.when(corners[2] == corners[3], one).otherwise(F.concat(one, F.array(F.array(F.lit(0), F.lit(2), F.lit(3)))))


def bulge_arc(ax: Column, ay: Column, bx: Column, by: Column, bulge: Column) -> Column:
    """Arc (cx, cy, radius, start, end, ccw) over a chord; null for a bulge of 0, one that isn't finite, or a chord without length.

    bulge is the tangent of a quarter of the angle, positive for counter-clockwise,
    so the centre of a quarter circle to the right of its chord's direction has
    the sign that makes the arc sweep by that angle.
    """
    dx, dy = bx - ax, by - ay
    chord = F.sqrt(dx * dx + dy * dy)
    # distance of the centre from the chord along its left normal
    h = (1 - bulge * bulge) / (4 * bulge)
    cx, cy = (ax + bx) / 2 - dy * h, (ay + by) / 2 + dx * h
    radius = chord * (1 + bulge * bulge) / (4 * F.abs(bulge))
    ok = (bulge != 0) & ~F.isnan(bulge) & (F.abs(bulge) < float("inf")) & (chord > 0)
    return F.when(
        ok,
        F.struct(cx.alias("cx"), cy.alias("cy"), radius.alias("radius"), F.atan2(ay - cy, ax - cx).alias("start"), F.atan2(by - cy, bx - cx).alias("end"), (bulge > 0).alias("ccw")),
    )


def spline_form(degree: Column, weights: Column) -> Column:
    """(degree, weights) to draw with: the degree within 1 to 15, 3 where it isn't finite; equal weights dropped."""
    d = F.when(F.isnan(degree) | (F.abs(degree) == float("inf")), 3.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(15.0), degree)))
    equal = F.size(F.array_distinct(weights)) <= 1
    return F.struct(d.cast("int").alias("degree"), F.when(~equal, weights).alias("weights"))


def segments_of_sweep(start: Column, end: Column, full: int = 64) -> Column:
    """(sweep, segments) of an arc: a sweep of 0 or less goes round once more."""
    sweep = F.when(end - start <= 0, end - start + 2 * math.pi).otherwise(end - start)
    return F.struct(sweep.alias("sweep"), F.ceil(sweep * full / (2 * math.pi)).cast("int").alias("segments"))


def tessellate_circle(cx: Column, cy: Column, radius: Column, full: int = 64) -> Column:
    """Points of a circle, in order, without the last that equals the first."""
    return F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda i: point(cx + radius * F.cos(i * (2 * math.pi / full)), cy + radius * F.sin(i * (2 * math.pi / full)), 0.0))


def _around(center: Column, major: Column, minor: Column, start: Column, sweep: Column, segments: Column) -> Column:
    """Points at center + major cos t + minor sin t, from start on, one more than segments."""
    at = lambda i: start + sweep * i / segments
    return F.transform(F.sequence(F.lit(0), segments), lambda i: _each(lambda c, a, b: c + a * F.cos(at(i)) + b * F.sin(at(i)), center, major, minor))


def entity_points(kind: Column, rec: dict[str, Column]) -> Column:
    """Points of the line that an entity is drawn by, null for kinds that aren't lines. rec has a struct column per kind.

    A circle is closed, arcs and ellipses have segments by their sweep, a point
    is a line without length, and a polyline lies at its elevation.
    """
    zero = F.lit(0.0)

    def turned(e: Column, start: Column, end: Column) -> Column:
        s = segments_of_sweep(start, end)
        return _around(e["center"], point(e["radius"], 0.0, 0.0), point(zero, e["radius"], zero), start, s["sweep"], s["segments"])

    def ellipse(e: Column) -> Column:
        s = segments_of_sweep(e["start_param"], e["end_param"])
        minor = scale(cross(normalize(e["extrusion"]), e["major_axis"]), e["axis_ratio"])
        return _around(e["center"], e["major_axis"], minor, e["start_param"], s["sweep"], s["segments"])

    def polyline(e: Column) -> Column:
        pts = F.transform(e["vertices"], lambda v: point(v["x"], v["y"], F.coalesce(e["elevation"], zero)))
        return F.when(e["closed"] & (F.size(pts) > 1), F.concat(pts, F.slice(pts, 1, 1))).otherwise(pts)

    forms = {
        "LINE": lambda e: F.array(e["start"], e["end"]), "POINT": lambda e: F.array(e["position"], e["position"]), "CIRCLE": lambda e: turned(e, zero, F.lit(2 * math.pi)),
        "ARC": lambda e: turned(e, e["start_angle"], e["end_angle"]), "ELLIPSE": ellipse, "LWPOLYLINE": polyline,
    }
    return F.coalesce(*[F.when(kind == k, forms[k](e)) for k, e in rec.items() if k in forms])


def text_baseline(rec: Column) -> Column:
    """struct(origin, direction, height) of a text: from its insertion point at its elevation, along its rotation."""
    p = point(rec["insertion_point"]["x"], rec["insertion_point"]["y"], rec["elevation"])
    return F.struct(p.alias("origin"), point(F.cos(rec["rotation_angle"]), F.sin(rec["rotation_angle"]), F.lit(0.0)).alias("direction"), rec["height"].alias("height"))


def box_mesh(b: Column) -> Column:
    """struct(points, triangles): the eight corners and twelve triangles of a box."""
    lo, hi = b["min"], b["max"]
    corners = F.array(*[point(x["x"], y["y"], z["z"]) for z in (lo, hi) for x, y in ((lo, lo), (hi, lo), (hi, hi), (lo, hi))])
    quads = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))
    triangles = [F.array(*[F.lit(i) for i in t]) for q in quads for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    return F.struct(corners.alias("points"), F.array(*triangles).alias("triangles"))


def empty_mesh() -> Column:
    """struct(points, triangles) of a solid whose shape isn't computed."""
    return F.struct(F.array().cast("array<struct<x:double,y:double,z:double>>").alias("points"), F.array().cast("array<array<int>>").alias("triangles"))


def model_to_paper(p: Column, target: Column, twist: Column, scale_: Column, paper_center: Column) -> Column:
    """Viewport: move the target to the origin, turn by the twist, scale, move to the centre on paper."""
    dx, dy = p["x"] - target["x"], p["y"] - target["y"]
    c, s = F.cos(twist), F.sin(twist)
    return F.struct((paper_center["x"] + (dx * c - dy * s) * scale_).alias("x"), (paper_center["y"] + (dx * s + dy * c) * scale_).alias("y"))


def polygon_area(points: Column) -> Column:
    """Area of an array of points by the shoelace rule; 0 for fewer than three."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2)


def polyline_length(points: Column) -> Column:
    n = F.size(points)
    ahead = F.slice(points, 2, F.greatest(n - 1, F.lit(0)))
    behind = F.slice(points, 1, F.greatest(n - 1, F.lit(0)))
    return F.aggregate(F.zip_with(behind, ahead, lambda a, b: distance_2d(a, b)), F.lit(0.0), lambda s, d: s + d)


def fit_view(b: Column, width: float, height: float, margin: float) -> Column:
    """(zoom, x, y) that shows a box in a viewport; the margin is a part within 0 and 0.45."""
    m = min(max(margin, 0.0), 0.45)
    w, h = (F.greatest(b["max"][k] - b["min"][k], F.lit(1e-9)) for k in "xy")
    zoom = F.least(F.lit(max(width, 1.0) * (1 - 2 * m)) / w, F.lit(max(height, 1.0) * (1 - 2 * m)) / h)
    return F.struct(zoom.alias("zoom"), ((b["min"]["x"] + b["max"]["x"]) / 2).alias("x"), ((b["min"]["y"] + b["max"]["y"]) / 2).alias("y"))


# Outlines of dimensions and hatches


def _segment(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def arrow(tip: Column, tail: Column) -> Column:
    """Triangle at the tip of a line: 3 % of its length long, at least 0.001, half as wide; null for a line without length."""
    d = sub(tail, tip)
    n = length(d)
    size_ = F.greatest(n * 0.03, F.lit(1e-3))
    along = _each(lambda t, v: t + v / n * size_, tip, d)
    side = point(-d["y"] / n * size_ * 0.25, d["x"] / n * size_ * 0.25, 0.0)
    return F.when(n > 0, F.array(tip, add(along, side), sub(along, side)))


def dimension_segments(kind: Column, rec: Column) -> Column:
    """Line segments of a dimension by its kind; rec has the definition points def_point_10, 13, 14, 15 and, for ordinates, feature and leader.

    Linear and aligned ones have two extension lines and the line between them,
    at the height of point 10; angular ones straight legs.
    """
    p10, p13, p14, p15 = (rec[f"def_point_{k}"] for k in (10, 13, 14, 15))
    d = sub(p14, p13)
    n2 = d["x"] * d["x"] + d["y"] * d["y"]
    k = F.when(n2 > 0, ((p10["x"] - p13["x"]) * -d["y"] + (p10["y"] - p13["y"]) * d["x"]) / n2).otherwise(0.0)
    off = point(-d["y"] * k, d["x"] * k, 0.0)
    a, b = add(p13, off), add(p14, off)
    straight = F.array(_segment(p13, a), _segment(p14, b), _segment(a, b))
    return (
        F.when(kind.isin("DIMENSION_LINEAR", "DIMENSION_ALIGNED"), straight)
        .when(kind == "DIMENSION_ORDINATE", F.array(_segment(rec["feature_location_13"], rec["leader_endpoint_14"])))
        .when(kind == "DIMENSION_ANG3PT", F.array(_segment(p15, p13), _segment(p15, p14), _segment(p10, p15)))
        .when(kind == "DIMENSION_ANG2LN", F.array(_segment(p13, p14), _segment(p15, p10)))
        .when(kind == "DIMENSION_RADIUS", F.array(_segment(p10, p15)))
        .when(kind == "DIMENSION_DIAMETER", F.array(_segment(p15, p10)))
    )


def hatch_curves(path: Column, elevation: Column) -> Column:
    """Curves of a hatch path (see the record's layout): its polyline's edges, or one curve per line, arc, ellipse and spline edge."""
    at = lambda p: point(p["x"], p["y"], elevation)
    line = lambda a, b: curve("line", a=at(a), b=at(b))
    poly = F.transform(polyline_path(F.transform(path["vertices"], lambda v: v["point"]), F.coalesce(path["closed"], F.lit(False))), lambda s: line(s["a"], s["b"]))
    edge = lambda e: (
        F.when(e["kind"] == 1, line(e["line_start"], e["line_end"]))
        .when(e["kind"] == 2, curve("arc", center=at(e["center"]), radius=e["radius"], start_angle=e["start_angle"], end_angle=e["end_angle"]))
        .when(e["kind"] == 3, curve("ellipse", center=at(e["center"]), major=at(e["major"]), ratio=e["ratio"], start_angle=e["start_angle"], end_angle=e["end_angle"]))
        .otherwise(curve("spline"))
    )
    return F.when(path["vertices"].isNotNull(), poly).otherwise(F.transform(path["edges"], edge))
