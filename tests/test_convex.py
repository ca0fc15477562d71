"""Closed forms for pairs with a convex polygon: what they decide is what the planar kernel finds, and they decide what queries ask."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

from loamgrid.kernel import columns, convex, planar

SHAPES = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)], [(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)], [(0, 0), (1, 0), (0, 1)]]


def shapes(random, n):
    """Triangles, rectangles, diamonds and Ls on a grid of whole numbers, either way round, so that many touch."""
    out = []
    for _ in range(n):
        r = np.array([*(s := SHAPES[random.integers(4)]), s[0]]) * random.integers(1, 8, 2) + random.integers(0, 12, 2)
        out.append([r if random.random() < 0.5 else r[::-1]])
    return out


def column(polygons):
    return pa.array([columns.from_polygon(p) for p in polygons], to_arrow_type(columns.POLYGON))


@pytest.mark.parametrize(
    ("rules", "work", "kind"),
    [
        (columns._meeting, lambda x, y: bool(len(planar.meet([x], [y]))), pa.bool_()),
        (columns._sharing, columns._shared, pa.float64()),
        (columns._holding, lambda x, y: bool(abs(planar.area(x) - columns._shared(x, y)) <= columns.SLIVER), pa.bool_()),
    ],
)
def test_relations_are_the_kernels(rules, work, kind):
    random = np.random.default_rng(3)
    a, b = shapes(random, 500), shapes(random, 500)
    asked = []
    got = columns._decide(column(a), column(b), rules, lambda x, y: asked.append(1) or work(x, y), kind).to_pylist()
    assert np.allclose(np.array(got, float), [float(work(x, y)) for x, y in zip(a, b, strict=True)], atol=1e-6)
    assert len(asked) < 150  # the kernel is left with Ls, and clips of partly covered shapes


def test_nulls_and_polygons_with_holes():
    square = lambda a, b: np.array([(a, a), (b, a), (b, b), (a, b), (a, a)], float)
    ring = [square(0, 10), square(2, 8)[::-1]]
    a = pa.array([None, columns.from_polygon(ring), columns.from_polygon([square(3, 7)])], to_arrow_type(columns.POLYGON))
    b = column([ring, [square(3, 7)], ring])
    assert columns._decide(a, b, columns._sharing, columns._shared, pa.float64()).to_pylist() == [None, 0.0, 0.0]


def test_halves_are_the_kernels_pieces():
    random = np.random.default_rng(4)
    a = shapes(random, 500)
    ends = random.integers(-3, 20, (500, 2, 2)).astype(float)
    cuts = pa.array([[columns.from_ring(e)] for e in ends], to_arrow_type(columns.MULTIPOLYGON).value_type)
    known, _ = convex.halves(convex.Single(column(a)), convex.Single(cuts, closed=False), planar.GRID)
    assert known.sum() > 300
    for got, p, e in zip(columns._pieces(column(a), cuts).to_pylist(), a, ends, strict=True):
        want = columns._ordered(planar.split(p, e.reshape(1, 4)))
        assert np.allclose([planar.ring_area(columns.to_polygon(g)[0]) for g in got], [planar.area(w) for w in want], atol=1e-3)


def test_outline_of_crowded_rings_takes_little(monkeypatch):
    """Lines inside a crowd of grown buildings go before pairs are made, which were millions; the outline is the same without that."""
    random = np.random.default_rng(5)
    corner = random.integers(0, 40, (600, 2)) * 25.0 + 2
    squares = [[np.array([(0, 0), (s, 0), (s, s), (0, s), (0, 0)]) + c] for c, s in zip(corner, random.integers(5, 21, 600), strict=True)]
    rings = [p[0] for p in planar.buffer(squares, 100.0, dissolve=False)]
    rings += [np.roll(rings[0][:-1], 3, 0)[[*range(24), 0]], rings[1].copy()]
    made = []
    plain = planar.box_pairs
    monkeypatch.setattr(planar, "box_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    length = lambda o: np.hypot(*(o[:, 2:] - o[:, :2]).T).sum()
    found = planar.convex_outline(rings)
    few = sum(map(len, made))
    monkeypatch.setattr(planar, "_covered", lambda lines, *_: np.zeros(len(lines), bool))
    every = planar.convex_outline(rings)
    assert np.isclose(length(found), length(every)) and length(found) > 4000
    assert few < 0.2 * (sum(map(len, made)) - few)


def test_density_by_whole_buildings(spark):
    face = [np.array([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], float)]
    inner, across = ([np.array([(x, 5), (x + 10, 5), (x + 10, 15), (x, 15), (x, 5)], float)] for x in (90, 95))
    assert planar.holds(face, [inner, across]).tolist() == [True, False]
    assert planar.holds([face[0], inner[0][::-1]], [inner]).tolist() == [False]  # a hole: left to the kernel


def test_centroids_by_batches(spark):
    from pyspark.sql import functions as F

    from loamgrid.functions import geometry as G

    hole = [np.array([(0, 0), (9, 0), (9, 6), (0, 6), (0, 0)], float), np.array([(1, 1), (1, 4), (3, 4), (3, 1), (1, 1)], float)]
    found = shapes(np.random.default_rng(6), 20) + [hole, hole[::-1][:1]]
    rows = [(i, columns.from_polygon(p)) for i, p in enumerate(found)] + [(99, None)]
    df = spark.createDataFrame(rows, "i long, geom array<array<struct<x:double,y:double>>>")
    for r in df.select("i", columns.centroid("geom").alias("a"), G.polygon_centroid("geom").alias("b")).collect():
        assert (r.a is None) == (r.i == 99) and (r.a is None or np.allclose(tuple(r.a), tuple(r.b)))
