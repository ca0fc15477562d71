"""Kernel operations as Arrow-batched column functions, and conversion between columns and arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loamgrid.kernel import convex, planar

#: Types as objects: workers that import this module have no session to parse type strings with.
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGON = T.ArrayType(T.ArrayType(POINT))
MULTIPOLYGON = T.ArrayType(POLYGON)


def to_polygon(geom) -> planar.Polygon:
    """Nested rows (rings of points) to arrays; null to an empty polygon."""
    return [] if geom is None else [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in geom]


def to_lines(paths) -> np.ndarray:
    """An array of lines to segments (n, 4)."""
    parts = [planar.path_segments(np.array([(p["x"], p["y"]) for p in path], float).reshape(-1, 2)) for path in (paths if paths is not None else []) if path is not None and len(path) > 1]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def from_ring(ring: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def from_polygon(polygon: planar.Polygon) -> list[list[dict]]:
    return [from_ring(r) for r in polygon]


def _ordered(polygons: list[planar.Polygon]) -> list[planar.Polygon]:
    """From west to east, then south to north, so that results don't depend on how they were found."""
    return sorted(polygons, key=lambda p: (*p[0].min(0), *p[0].max(0)))


def _array(values: list, kind: T.DataType) -> pa.Array:
    return pa.array(values, to_arrow_type(kind))


def _multipolygons(rows: np.ndarray, n: int, rings: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """n multipolygons of pieces with one ring each: the row of each piece, and (points, which of them count) of their rings."""
    size = np.concatenate([m.sum(1) for _, m in rings])
    points = np.concatenate([p[m] for p, m in rings])
    box = np.concatenate([np.concatenate([np.where(m[..., None], p, np.inf).min(1), np.where(m[..., None], p, -np.inf).max(1)], 1) for p, m in rings]) if len(rows) else np.zeros((0, 4))
    order = np.lexsort((box[:, 3], box[:, 2], box[:, 1], box[:, 0], rows))
    begin, size = (np.cumsum(size) - size)[order], size[order]
    ends = np.cumsum(size)
    points = points[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]
    kind = to_arrow_type(MULTIPOLYGON)
    struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], fields=list(kind.value_type.value_type.value_type))
    offsets = lambda x: pa.array(x.astype(np.int32))
    ring = pa.ListArray.from_arrays(offsets(np.r_[0, ends]), struct, type=kind.value_type.value_type)
    piece = pa.ListArray.from_arrays(offsets(np.arange(len(rows) + 1)), ring, type=kind.value_type)
    return pa.ListArray.from_arrays(offsets(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))]), piece, type=kind)


def _pieces(geom: pa.Array, cuts: pa.Array) -> pa.Array:
    shape, cut = convex.Single(geom), convex.Single(cuts, closed=False)
    known, found = convex.halves(shape, cut, planar.GRID)
    fast = _multipolygons(np.concatenate([r for r, _, _ in found]), len(geom), [(p, m) for _, p, m in found])
    if known.all():
        return fast
    rest = np.flatnonzero(~known)
    take = pa.array(rest)
    slow = [[from_polygon(p) for p in _ordered(planar.split(to_polygon(g), to_lines(c)))] if g is not None else [] for g, c in zip(geom.take(take).to_pylist(), cuts.take(take).to_pylist(), strict=True)]
    at = np.arange(len(geom))
    at[rest] = len(geom) + np.arange(len(rest))
    return pa.concat_arrays([fast, _array(slow, MULTIPOLYGON)]).take(pa.array(at))


@F.arrow_udf(MULTIPOLYGON)
def split_by_lines(geom: pa.Array, cuts: pa.Array) -> pa.Array:
    """Pieces of polygons between lines; without a cut the polygon itself; null gives no piece. Convex polygons with one segment have a
    closed form, others go through the kernel."""
    return _pieces(geom, cuts)


@F.arrow_udf(MULTIPOLYGON)
def triangles(geom: pa.Array) -> pa.Array:
    """Triangles of polygons by ear clipping, each as a polygon."""
    return _array([[[from_ring(t)] for t in planar.triangulate(to_polygon(g))] for g in geom.to_pylist()], MULTIPOLYGON)


@F.arrow_udf(MULTIPOLYGON)
def make_valid(geom: pa.Array) -> pa.Array:
    return _array([[from_polygon(p) for p in planar.make_valid(to_polygon(g))] for g in geom.to_pylist()], MULTIPOLYGON)


@F.arrow_udf(T.BooleanType())
def is_valid(geom: pa.Array) -> pa.Array:
    return pa.array([planar.is_valid(to_polygon(g)) for g in geom.to_pylist()], pa.bool_())


def _reason(polygon: planar.Polygon) -> str | None:
    if not polygon:
        return "empty"
    if any(len(np.unique(r, axis=0)) < 3 for r in polygon):
        return "too few points"
    if any((r[0] != r[-1]).any() for r in polygon):
        return "ring not closed"
    return None if planar.is_valid(polygon) else "self-intersection"


@F.arrow_udf(T.StringType())
def invalid_reason(geom: pa.Array) -> pa.Array:
    """Why a polygon isn't valid; null if it is, and for null."""
    return pa.array([None if g is None else _reason(to_polygon(g)) for g in geom.to_pylist()], pa.string())


def _decide(a: pa.Array, b: pa.Array, rules, work, kind: pa.DataType) -> pa.Array:
    """What rules(comparison, a, b) say of pairs (which are decided, and the values); the others one by one by work(polygon, polygon).
    Null for null."""
    n = len(a)
    out, known = np.zeros(n, kind.to_pandas_dtype()), np.zeros(n, bool)
    null = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    for i in range(0, n, STEP):
        x, y = convex.Single(a.slice(i, STEP)), convex.Single(b.slice(i, STEP))
        known[i : i + STEP], out[i : i + STEP] = rules(convex.compare(x, y), x, y)
    rest = np.flatnonzero(~known & ~null)
    take = pa.array(rest)
    for k, x, y in zip(rest, convex.polygons(a.take(take)), convex.polygons(b.take(take)), strict=True):
        out[k] = work(x, y)
    return pa.array(out, kind, mask=null)


def _shared(x: planar.Polygon, y: planar.Polygon) -> float:
    return float(sum(planar.area(p) for p in planar.intersection([x], [y])))


#: Pairs that are compared at once.
STEP = 4096
#: Areas that differ by less (m2, against the grid that overlays snap to) are equal.
SLIVER = 1e-3


def _meeting(r, x, y):
    return r["apart"] | r["convex"], ~r["apart"]


def _sharing(r, x, y):
    return r["a_in_b"] | r["b_in_a"] | r["flush"], np.where(r["flush"], 0.0, np.where(r["a_in_b"], x.area, y.area))


def _holding(r, x, y):
    return (r["a_in_b"] | r["flush"]) & (x.area > SLIVER), ~r["flush"]


@F.arrow_udf(T.BooleanType())
def intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two polygons share a point: an exact test for pairs that a grid join has found."""
    return pc.fill_null(_decide(a, b, _meeting, lambda x, y: bool(len(planar.meet([x], [y]))), pa.bool_()), False)


@F.arrow_udf(T.DoubleType())
def shared_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area that two polygons have in common; null for null."""
    return _decide(a, b, _sharing, _shared, pa.float64())


def _relation(test, rules=lambda r, x, y: (np.zeros(len(x.ok), bool), np.zeros(len(x.ok), bool))):
    """A Boolean function of two polygons; null for null."""

    @F.arrow_udf(T.BooleanType())
    def related(a: pa.Array, b: pa.Array) -> pa.Array:
        return _decide(a, b, rules, lambda x, y: bool(test(x, y)), pa.bool_())

    return related


#: Whether the first polygon lies in the second; whether they share border points only; whether they cover the same points.
within = _relation(lambda x, y: abs(planar.area(x) - _shared(x, y)) <= SLIVER, _holding)
touches = _relation(lambda x, y: len(planar.meet([x], [y])) and _shared(x, y) <= SLIVER)
equals = _relation(lambda x, y: abs(planar.area(x) - planar.area(y)) <= SLIVER and abs(planar.area(x) - _shared(x, y)) <= SLIVER)


@F.arrow_udf(POLYGON)
def min_rectangle(geom: pa.Array) -> pa.Array:
    """Oriented rectangle of least area around each polygon; null for null."""
    return _array([[from_ring(planar.min_area_rectangle(to_polygon(g)[0]))] if g else None for g in geom.to_pylist()], POLYGON)


def _centre(polygon: planar.Polygon) -> np.ndarray | None:
    total, moment = 0.0, np.zeros(2)
    if not polygon or not len(polygon[0]):
        return None
    first = polygon[0][0]
    for i, ring in enumerate(polygon):
        x, y = (ring - first).T
        w = x[:-1] * y[1:] - x[1:] * y[:-1]
        sign = (1 if i == 0 else -1) * (1 if w.sum() >= 0 else -1)
        total += sign * w.sum() / 2
        moment += sign * np.array([((x[:-1] + x[1:]) * w).sum(), ((y[:-1] + y[1:]) * w).sum()]) / 6
    return first + (moment / total if total else (polygon[0][:-1] - first).mean(0))


@F.arrow_udf(POINT)
def centroid(geom: pa.Array) -> pa.Array:
    """Area-weighted centroid of each polygon, less its holes; the mean of the exterior's vertices if it has no area; null for null."""
    return _array([None if c is None else {"x": float(c[0]), "y": float(c[1])} for c in map(_centre, convex.polygons(geom))], POINT)


@F.arrow_udf(POINT)
def point_on_surface(geom: pa.Array) -> pa.Array:
    """A point inside each polygon; null for null."""
    return _array([dict(zip("xy", map(float, planar.inner_point(to_polygon(g))), strict=True)) if g else None for g in geom.to_pylist()], POINT)
