"""Geometry as Column expressions: points are struct<x,y>, lines arrays of points, polygons arrays of closed rings (the first is the
exterior). Everything here stays inside the JVM; what needs a planar graph lives in loamgrid.kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"
MULTIPOLYGON = f"array<{POLYGON}>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points)


def rect_polygon(xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
    """Axis-aligned rectangle, counter-clockwise from its lower left corner."""
    a, b, c, d = (_c(v) for v in (xmin, ymin, xmax, ymax))
    return F.array(F.array(point(a, b), point(c, b), point(c, d), point(a, d), point(a, b)))


def segments(path) -> Column:
    """Consecutive vertex pairs of a line or ring: array of struct<x1,y1,x2,y2>."""
    p = _c(path)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    return F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def signed_ring_area(ring) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def polygon_area(polygon) -> Column:
    """Exterior less holes; null for null, 0 for no ring."""
    p = _c(polygon)
    rings = F.transform(p, lambda r, i: F.abs(signed_ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0))
    return F.aggregate(rings, F.lit(0.0), lambda s, a: s + a)


def line_length(path) -> Column:
    return F.aggregate(segments(path), F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def ring_centroid(ring) -> Column:
    """Area-weighted centroid of a ring; the mean of its vertices if it has no area."""
    r = _c(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s, e):
        w = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((s["a"] + w).alias("a"), (s["x"] + (e["x1"] + e["x2"]) * w).alias("x"), (s["y"] + (e["y1"] + e["y2"]) * w).alias("y"))

    t = F.aggregate(segments(r), zero, add)
    mean = lambda k: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[k]) / F.size(r)
    return F.when(t["a"] != 0, point(t["x"] / (3 * t["a"]), t["y"] / (3 * t["a"]))).otherwise(point(mean("x"), mean("y")))


def polygon_centroid(polygon) -> Column:
    """Area-weighted centroid of a polygon, less its holes; the mean of the exterior's vertices if it has no area. Sums run from the
    first vertex, so that large coordinates lose no digits."""
    p = _c(polygon)
    o = p[0][0]
    local = F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] - o["x"]).alias("x"), (v["y"] - o["y"]).alias("y"))))
    weights = F.transform(local, lambda r, i: F.struct((F.abs(signed_ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)).alias("a"), ring_centroid(r).alias("c")))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w["a"])
    mean = lambda k: F.aggregate(weights, F.lit(0.0), lambda s, w: s + w["a"] * w["c"][k]) / F.when(total != 0, total)
    plain = ring_centroid(local[0])
    return point(o["x"] + F.coalesce(mean("x"), plain["x"]), o["y"] + F.coalesce(mean("y"), plain["y"]))


def bounds(path, prefix: str = "") -> list[Column]:
    """xmin, ymin, xmax, ymax of a line or ring."""
    p = _c(path)
    take = lambda f, k: f(F.transform(p, lambda v: v[k]))
    return [take(F.array_min, "x").alias(prefix + "xmin"), take(F.array_min, "y").alias(prefix + "ymin"), take(F.array_max, "x").alias(prefix + "xmax"), take(F.array_max, "y").alias(prefix + "ymax")]


def undirected_angle(dx, dy) -> Column:
    """Angle of an edge to the x axis in 0..180; level and downward edges are mirrored, so that a level edge to the right has 180."""
    x, y = _c(dx), _c(dy)
    a = F.degrees(F.acos(x / F.sqrt(x * x + y * y)))
    return F.when(y <= 0, 180.0 - a).otherwise(a)


def azimuth(dx, dy) -> Column:
    """Angle of a direction in 0..360, counter-clockwise from the x axis."""
    a = F.degrees(F.atan2(_c(dy), _c(dx)))
    return F.when(a < 0, a + 360.0).otherwise(a)


def project_on_line(px, py, x1, y1, x2, y2) -> Column:
    """struct<distance,x,y>: foot of the perpendicular on the infinite line, and how far it is."""
    px, py, x1, y1, x2, y2 = (_c(v) for v in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    n = F.sqrt(dx * dx + dy * dy)
    along = (dx * (px - x1) + dy * (py - y1)) / n
    return F.struct((F.abs(dx * (y1 - py) - (x1 - px) * dy) / n).alias("distance"), (x1 + dx / n * along).alias("x"), (y1 + dy / n * along).alias("y"))


def nearest_on_segment(px, py, x1, y1, x2, y2) -> Column:
    """struct<distance,x,y>: the segment's nearest point."""
    px, py, x1, y1, x2, y2 = (_c(v) for v in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)))
    fx, fy = x1 + t * dx, y1 + t * dy
    return F.struct(F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)).alias("distance"), fx.alias("x"), fy.alias("y"))


def rect_point_distance(px, py, xmin, ymin, xmax, ymax) -> Column:
    px, py, a, b, c, d = (_c(v) for v in (px, py, xmin, ymin, xmax, ymax))
    dx, dy = F.greatest(a - px, F.lit(0.0), px - c), F.greatest(b - py, F.lit(0.0), py - d)
    return F.sqrt(dx * dx + dy * dy)


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_intersect(a: tuple, b: tuple) -> Column:
    """Whether closed segments (x1, y1, x2, y2) share a point; their boxes are part of the test, which settles collinear ones."""
    ax, ay, bx, by = (_c(v) for v in a)
    cx, cy, dx, dy = (_c(v) for v in b)
    boxes = (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    return boxes & (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0)


def crossing(a: tuple, b: tuple) -> Column:
    """The common point of two segments that aren't parallel; null if there is none."""
    ax, ay, bx, by = (_c(v) for v in a)
    cx, cy, dx, dy = (_c(v) for v in b)
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.when(det != 0, det)
    return F.when(segments_intersect(a, b) & (det != 0), point(ax + t * (bx - ax), ay + t * (by - ay)))


def extend(x1, y1, x2, y2, by: float) -> Column:
    """A segment lengthened by `by` at both ends."""
    x1, y1, x2, y2 = (_c(v) for v in (x1, y1, x2, y2))
    n = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    ux, uy = (x2 - x1) / n * by, (y2 - y1) / n * by
    return line(point(x1 - ux, y1 - uy), point(x2 + ux, y2 + uy))


def delete_holes(polygon, below: float = 0.0, inclusive: bool = False) -> Column:
    """Without holes smaller than `below` (up to it if inclusive); 0 removes all holes."""
    p = _c(polygon)
    if below <= 0 and not inclusive:
        return F.slice(p, 1, 1)
    small = (lambda a: a <= below) if inclusive else (lambda a: a < below)
    return F.filter(p, lambda r, i: (i == 0) | ~small(F.abs(signed_ring_area(r))))


def buffer_distance(area, least: float = 10.0, most: float = 100.0) -> Column:
    return F.least(F.greatest(F.sqrt(_c(area)), F.lit(least)), F.lit(most))
