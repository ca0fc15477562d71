"""Exact answers for many pairs of polygons at once where one is convex; what isn't decided here is left to the planar kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rings of more points are left to the kernel; distance (m) to a line within which a cut is, against the grid that the kernel snaps to.
MOST, CLOSE = 32, 1e-4


def flat(geom: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of rings of each geometry and of points of each ring, and the points; null counts as none."""
    rings = geom.flatten()
    x, y = rings.flatten().flatten()
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y)], 1)
    return size(geom), size(rings), points


def polygons(geom: pa.Array) -> list[list[np.ndarray]]:
    """Polygons of a column as lists of rings."""
    count, size, points = flat(geom)
    ends = np.cumsum(size).tolist()
    rings = [points[e - n : e] for e, n in zip(ends, size.tolist(), strict=True)]
    last = np.cumsum(count).tolist()
    return [rings[e - n : e] for e, n in zip(last, count.tolist(), strict=True)]


class Single:
    """Geometries of one ring, padded with their last points: p (n, k, 2). ok: closed, finite, of no more than MOST points; others are
    not to be used."""

    def __init__(self, geom: pa.Array, closed: bool = True) -> None:
        count, size, points = flat(geom)
        ring = np.cumsum(count) - count
        one = count == 1
        n = np.zeros(len(count), np.int64)
        n[one] = size[ring[one]]
        self.ok = one & (n >= (4 if closed else 2)) & (n <= MOST)
        self.size = np.where(self.ok, n, 0)
        k = int(self.size.max(initial=2))
        begin = np.zeros(len(count), np.int64)
        begin[one] = (np.cumsum(size) - size)[ring[one]]
        at = begin[:, None] + np.minimum(np.arange(k), np.maximum(self.size, 1)[:, None] - 1)
        self.p = points[np.where(self.ok[:, None], at, 0)] if len(points) else np.zeros((len(count), k, 2))
        self.ok &= np.isfinite(self.p).all((1, 2))
        self.p[~self.ok] = 0.0
        if closed:
            self.ok &= (self.p[:, 0] == self.p[:, -1]).all(1)
            q = self.p - self.p[:, :1]
            signed = (q[:, :-1, 0] * q[:, 1:, 1] - q[:, 1:, 0] * q[:, :-1, 1]).sum(1) / 2
            self.p[signed < 0] = self.p[signed < 0, ::-1]  # counter-clockwise
            self.area = np.abs(signed)
        self.low, self.high = self.p.min(1), self.p.max(1)

    def convex(self) -> np.ndarray:
        """Which rings are convex, have area and pass no point twice."""
        z = np.sort(self.p[:, :, 0] + 1j * self.p[:, :, 1], 1)
        different = 1 + (z[:, 1:] != z[:, :-1]).sum(1)
        return self.ok & (self.area > 0) & (different == self.size - 1) & (sides(self.p, self.p).min((1, 2)) >= 0)


def sides(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(n, edge, point): positive where a row's point lies to the left of its ring's edge, zero on its line."""
    a, d = ring[:, :-1, None], (ring[:, 1:] - ring[:, :-1])[:, :, None]
    v = points[:, None] - a
    return d[..., 0] * v[..., 1] - d[..., 1] * v[..., 0]


def compare(a: Single, b: Single) -> dict[str, np.ndarray]:
    """Of pairs: whether a lies in b (b convex) and b in a (a convex), whether an edge of a convex one has the other wholly outside
    (apart: without a common point; flush: without common area), whether both are convex."""
    ok = a.ok & b.ok
    ca, cb = a.convex(), b.convex()
    of_b, of_a = sides(b.p, a.p), sides(a.p, b.p)
    real = lambda s: ((s.p[:, 1:] != s.p[:, :-1]).any(2))[:, :]  # noqa: E731  edges of some length
    far_b, far_a = np.where(real(b), of_b.max(2), np.inf), np.where(real(a), of_a.max(2), np.inf)
    boxes = ((a.low > b.high) | (b.low > a.high)).any(1)
    flush = ((a.low >= b.high) | (b.low >= a.high)).any(1)
    return {
        "a_in_b": ok & cb & (of_b.min((1, 2)) >= 0),
        "b_in_a": ok & ca & (of_a.min((1, 2)) >= 0),
        "apart": ok & (boxes | cb & (far_b.min(1) < 0) | ca & (far_a.min(1) < 0)),
        "flush": ok & (flush | cb & (far_b.min(1) <= 0) | ca & (far_a.min(1) <= 0)),
        "convex": ca & cb,
    }


def halves(shape: Single, cut: Single, grid: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Convex shapes between one segment each. Which rows are decided, and for each side (rows, points of a ring, which points count); a
    shape that its segment doesn't cut is given once."""
    p, c = np.rint(shape.p / grid) * grid, np.rint(cut.p[:, :2] / grid) * grid
    d = c[:, 1] - c[:, 0]
    length = np.hypot(d[:, 0], d[:, 1])
    ok = shape.convex() & cut.ok & (cut.size == 2) & (length > CLOSE)
    v = p - c[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (d[:, None, 0] * v[..., 1] - d[:, None, 1] * v[..., 0]) / length[:, None]  # signed distance to the segment's line
        along = (d[:, None, 0] * v[..., 0] + d[:, None, 1] * v[..., 1]) / length[:, None]
        t = s[:, :-1] / (s[:, :-1] - s[:, 1:])
    ok &= (np.nan_to_num(s) == 0).all(1) | ~((np.abs(s) < CLOSE) & (s != 0)).any(1)
    crosses = s[:, :-1] * s[:, 1:] < 0
    x = np.where(crosses, along[:, :-1] + np.where(crosses, t, 0) * (along[:, 1:] - along[:, :-1]), np.nan)
    on = np.where(s == 0, along, np.nan)
    reach = np.concatenate([x, on], 1)
    both = (s.max(1) > 0) & (s.min(1) < 0)
    begin, end = np.full(len(p), np.nan), np.full(len(p), np.nan)
    begin[both], end[both] = np.nanmin(reach[both], 1), np.nanmax(reach[both], 1)
    spans = both & (begin >= CLOSE) & (end <= length - CLOSE)
    beside = ~both | (begin > length + CLOSE) | (end < -CLOSE)
    ok &= spans | beside
    point = p[:, :-1] + np.where(crosses, t, 0)[..., None] * (p[:, 1:] - p[:, :-1])
    point = np.rint(point / grid) * grid
    some = (p[:, 1:] != p[:, :-1]).any(2)
    out = []
    for sign, rows in ((1, np.flatnonzero(ok)), (-1, np.flatnonzero(ok & spans))):
        mine = some[rows] & ((sign * s[rows, :-1] >= 0) | beside[rows, None])
        mask = np.stack([mine, crosses[rows] & ~beside[rows, None]], 2).reshape(len(rows), -1)
        ring = np.stack([p[rows, :-1], point[rows]], 2).reshape(len(rows), -1, 2)
        first = ring[np.arange(len(rows)), mask.argmax(1)] if len(rows) else np.zeros((0, 2))
        out.append((rows, np.concatenate([ring, first[:, None]], 1), np.concatenate([mask, np.ones((len(rows), 1), bool)], 1)))
    return ok, out
