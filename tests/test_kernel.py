import math

import numpy as np
import pytest

from loamgrid.kernel import graph, planar, stages
from loamgrid.kernel.planar import area


def sq(x, y, s, t=None):
    t = s if t is None else t
    return [np.array([(x, y), (x + s, y), (x + s, y + t), (x, y + t), (x, y)], float)]


def hole(outer, inner):
    return [outer[0], inner[0][::-1]]


def total(polygons):
    return sum(map(area, polygons))


# --- overlays ----------------------------------------------------------------------------------------------------------------


def test_overlays_of_two_squares():
    a, b = [sq(0, 0, 10)], [sq(5, 5, 10)]
    assert total(planar.union(a, b)) == pytest.approx(175) and total(planar.intersection(a, b)) == pytest.approx(25)
    assert total(planar.difference(a, b)) == pytest.approx(75) and total(planar.symmetric_difference(a, b)) == pytest.approx(150)
    assert len(planar.self_overlay(a + b)) == 3


def test_overlays_of_random_rectangles_against_a_raster():
    rng = np.random.default_rng(1)
    for _ in range(5):
        layers = []
        for _ in range(2):
            layers.append([sq(*rng.integers(0, 80, 2), *rng.integers(2, 20, 2)) for _ in range(25)])
        grid = np.zeros((2, 110, 110), bool)
        for k, layer in enumerate(layers):
            for p in layer:
                (x, y), (x2, y2) = p[0].min(0).astype(int), p[0].max(0).astype(int)
                grid[k, x:x2, y:y2] = True
        a, b = grid
        assert total(planar.union(*layers)) == pytest.approx((a | b).sum())
        assert total(planar.intersection(*layers)) == pytest.approx((a & b).sum())
        assert total(planar.difference(*layers)) == pytest.approx((a & ~b).sum())
        assert total(planar.symmetric_difference(*layers)) == pytest.approx((a ^ b).sum())
        one = planar.union(*layers)
        assert total(planar.union(one)) == pytest.approx(total(one)) and len(planar.union(one)) == len(one)
        assert all(planar.is_valid(p) for p in one)


def test_rotated_overlay_conserves_area():
    turn = np.array([[math.cos(0.3), -math.sin(0.3)], [math.sin(0.3), math.cos(0.3)]])
    a, b = [sq(0, 0, 40)], [[sq(3, -9, 33)[0] @ turn.T]]
    assert total(planar.intersection(a, b)) + total(planar.difference(a, b)) == pytest.approx(1600, abs=1e-2)


def test_holes_and_touching_squares():
    ring = hole(sq(0, 0, 100), sq(40, 40, 20))
    assert area(ring) == 9600
    assert [len(p) for p in planar.union([ring])] == [2]
    assert [(area(p), len(p)) for p in planar.difference([sq(0, 0, 100)], [sq(40, 40, 20)])] == [(pytest.approx(9600), 2)]
    assert len(planar.union([sq(0, 0, 10), sq(10, 10, 10)])) == 2 and len(planar.union([sq(0, 0, 10), sq(10, 0, 10)])) == 1


def test_polygonize_lattice_with_dead_ends():
    lines = [(i * 10, 0, i * 10, 40) for i in range(5)] + [(0, i * 10, 40, i * 10) for i in range(5)] + [(5, 10, 6, 14), (100, 100, 120, 100)]
    faces = planar.polygonize(np.array(lines, float))
    assert len(faces) == 16 and all(area(p) == pytest.approx(100) for p in faces)
    assert planar.polygonize(np.zeros((0, 4))) == []


def test_polygonize_nests_an_island():
    s = planar.segments([sq(0, 0, 100), sq(40, 40, 20)])
    assert sorted(area(p) for p in planar.polygonize(s)) == [pytest.approx(400), pytest.approx(9600)]


def test_split_and_clip():
    assert sorted(map(area, planar.split(sq(0, 0, 10), np.array([[4, -1, 4, 11.0]])))) == [pytest.approx(40), pytest.approx(60)]
    assert [area(p) for p in planar.split(sq(0, 0, 10), np.zeros((0, 4)))] == [pytest.approx(100)]
    clip = planar.clip_lines(np.array([[-5, 5, 15, 5], [0, 0, 10, 0], [20, 0, 30, 0.0]]), [sq(0, 0, 10)])
    assert np.hypot(clip[:, 2] - clip[:, 0], clip[:, 3] - clip[:, 1]).sum() == pytest.approx(20)


def test_buffers():
    disc = 20 * 0.5 * math.sin(2 * math.pi / 20)  # area of a 20-gon of radius 1
    assert total(planar.buffer([sq(0, 0, 10)], 5)) == pytest.approx(100 + 200 + 25 * disc, abs=1e-2)
    assert total(planar.buffer([hole(sq(0, 0, 100), sq(40, 40, 20))], 5)) == pytest.approx(10_000 - 100 + 2000 + 25 * disc, abs=0.1)
    assert len(planar.buffer([sq(0, 0, 10), sq(15, 0, 10)], 3)) == 1 and len(planar.buffer([sq(0, 0, 10), sq(15, 0, 10)], 2)) == 2
    assert total(planar.buffer_lines(np.array([[0, 0, 10, 0.0]]), 1, flat=True)) == pytest.approx(20)
    assert total(planar.buffer_lines(np.array([[0, 0, 10, 0.0]]), 1)) == pytest.approx(20 + disc, abs=1e-3)


def test_union_by_neighbourhoods_is_that_of_all_at_once():
    rng = np.random.default_rng(9)
    for grid in (1e-5, 1e-3):
        path = np.cumsum(rng.normal(size=(151, 2)) * 15, 0)
        strips = [[planar.capsule(np.r_[a, b], 8.0)] for a, b in zip(path, path[1:])]
        got, whole = planar.union(strips, grid=grid), planar.overlay(strips, [], lambda a, b: a, grid)
        assert total(got) == pytest.approx(total(whole), rel=1e-4) and len(got) == len(whole)
        points = path.min(0) - 20 + rng.random((4000, 2)) * (np.ptp(path, 0) + 40)
        assert (planar.inside_any(got, points) != planar.inside_any(strips, points)).sum() <= 2


def test_outline_of_convex_shapes():
    """Every piece lies on a border and inside no shape, and together they are as long as the union's boundary."""
    rng = np.random.default_rng(8)
    shapes = [planar.capsule(rng.random(4) * 60, 6.0) for _ in range(12)]
    out = planar.convex_outline(shapes)
    boundary = planar.segments(planar.union([[s] for s in shapes]))
    length = lambda s: np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]).sum()
    assert length(out) == pytest.approx(length(boundary), rel=1e-4)


def test_validity():
    bow = [np.array([(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], float)]
    assert planar.is_valid(sq(0, 0, 1)) and planar.is_valid(hole(sq(0, 0, 10), sq(2, 2, 3))) and not planar.is_valid(bow)
    assert sorted(map(area, planar.make_valid(bow))) == [pytest.approx(25), pytest.approx(25)]
    assert not planar.is_valid([]) and planar.make_valid([]) == []


def test_triangles_cover_the_polygon():
    for p in (sq(0, 0, 10), hole(sq(0, 0, 100), sq(40, 40, 20)), [np.array([(0, 0), (10, 0), (10, 10), (5, 3), (0, 10), (0, 0)], float)]):
        t = planar.triangulate(p)
        assert sum(abs(planar.ring_area(x)) for x in t) == pytest.approx(area(p))


def test_rectangles_and_inner_points():
    box = planar.min_area_rectangle(np.array([(0, 0), (10, 10), (5, 15), (-5, 5), (2, 6)], float))
    assert abs(planar.ring_area(box)) == pytest.approx(math.hypot(10, 10) * math.hypot(5, 5))
    u = [np.array([(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0)], float)]
    assert planar.inside(u, planar.inner_point(u)[None])[0]


def test_meet_counts_touching():
    assert planar.meet([sq(0, 0, 10)], [sq(10, 0, 5), sq(11, 0, 5), sq(2, 2, 3)]).tolist() == [[0, 0], [0, 2]]


# --- graphs ------------------------------------------------------------------------------------------------------------------


def test_delaunay_circles_are_empty():
    rng = np.random.default_rng(3)
    for n in (3, 10, 200):
        p = rng.random((n, 2)) * 100
        t = graph.delaunay(p)
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        d = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
        b2, c2 = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
        centre = a + np.stack([(c - a)[:, 1] * b2 - (b - a)[:, 1] * c2, (b - a)[:, 0] * c2 - (c - a)[:, 0] * b2], 1) / d[:, None]
        radius = np.hypot(*(centre - a).T)
        gap = np.hypot(*(p[None] - centre[:, None]).transpose(2, 0, 1)) - radius[:, None]
        assert (gap > -1e-6 * radius[:, None]).all()
        assert abs(np.abs(d).sum() / 4 - abs(planar.ring_area(planar.hull(p)))) < 1e-2 * abs(planar.ring_area(planar.hull(p)))


@pytest.mark.parametrize("points", [[], [(0, 0)], [(0, 0), (1, 1)], [(i, 2 * i) for i in range(5)], [(1, 1)] * 4])
def test_delaunay_degenerate(points):
    assert len(graph.delaunay(np.array(points, float).reshape(-1, 2))) == 0


def grid_buildings():
    return [sq(0, 0, 10), sq(20, 0, 10), sq(0, 20, 10), sq(20, 20, 10)]


def test_spanning_tree_of_four():
    b = grid_buildings()
    centres = np.array([p[0][:-1].mean(0) for p in b])
    tree = graph.spanning_forest([1, 2, 3, 4], b, centres, np.zeros((0, 4)))
    assert len(tree) == 3 and all(w == pytest.approx(10) for *_, w in tree)
    cut = graph.spanning_forest([1, 2, 3, 4], b, centres, np.array([[15, -50, 15, 80.0]]))
    assert sorted((u, v) for u, v, _ in cut) == [(1, 3), (2, 4)]


def test_forest_against_brute_force():
    rng = np.random.default_rng(4)
    edges = np.array([(i, j) for i in range(12) for j in range(i + 1, 12)])
    weights = rng.random(len(edges))
    kept = graph.kruskal(12, edges, weights)
    inside, left, want = {0}, set(range(1, 12)), 0.0
    while left:  # Prim
        w, j = min((weights[k], b if a in inside else a) for k, (a, b) in enumerate(edges.tolist()) if (a in inside) != (b in inside))
        want, inside, left = want + w, inside | {j}, left - {j}
    assert weights[kept].sum() == pytest.approx(want) and len(kept) == 11


def test_dominant_angle_cases():
    pick = lambda pairs: graph.dominant_angle(np.array([a for a, _ in pairs], float), np.array([w for _, w in pairs], float))
    assert pick([(45, 10)]) == 45 and pick([(10, 5), (80, 50)]) == 80 and pick([(30, 1), (30, 2), (30, 3)]) == 30
    assert pick([(0, 1), (0, 1), (5, 9), (5, 9)]) == 0  # the last run doesn't count


def test_cluster_of_two_squares():
    """50 x 50 at a distance of 50: 5000 of 7500 m2 is over 18 percent."""
    b = {1: sq(0, 0, 50), 2: sq(100, 0, 50)}
    edges = {k: graph.outline_edges(p) for k, p in b.items()}
    areas = {k: area(p) for k, p in b.items()}
    assert graph.clusters(edges, areas, [(1, 2, 50.0)]) == [[2, 1]]
    box, size = graph.oriented_rectangle(np.concatenate(list(edges.values())))
    assert size == pytest.approx(7500) and abs(planar.ring_area(box)) == pytest.approx(7500)
    assert graph.clusters(edges, areas, [(1, 2, 50.0)], ratio=70) == []
    assert graph.oriented_rectangle(edges[1]) == (None, 0.0)  # four points are too few


def test_failed_extension_tries_the_pair():
    b = {1: sq(0, 0, 10), 2: sq(12, 0, 10), 3: sq(200, 0, 10)}
    edges, areas = {k: graph.outline_edges(p) for k, p in b.items()}, {k: 100.0 for k in b}
    assert graph.clusters(edges, areas, [(1, 2, 2.0), (2, 3, 178.0)], 18) == [[2, 1]]


def test_chains_and_rays():
    paths = graph.chains(np.array([[0, 0, 10, 0], [10, 0, 20, 0], [20, 0, 20, 10], [20, 0, 30, 0], [0, 0, 10, 0.0]]))
    assert sorted(len(p) for p in paths) == [2, 2, 3]
    ring = graph.chains(planar.segments([sq(0, 0, 5)]))
    assert len(ring) == 1 and (ring[0][0] == ring[0][-1]).all()
    (ray,) = graph.shortest_lines(np.array([[5, 3.0]]), [np.array([[0, 0], [10, 0.0]])])
    assert (ray["x2"], ray["y2"], ray["distance"], ray["angle"]) == (5, 0, 3, 270)


# --- stages ------------------------------------------------------------------------------------------------------------------


def test_city_blocks_of_a_lattice():
    roads = [(x, -20, x, 180) for x in (75, 150, 225)] + [(-20, y, 320, y) for y in (50, 100)]
    buildings = [sq(15 * (i % 20), 15 * (i // 20), 10) for i in range(200)]
    part = [np.array([(-5, -5), (305, -5), (305, 155), (-5, 155), (-5, -5)], float)]
    assert len(stages.city_blocks(part, np.array(roads, float), buildings)) == 12


def test_edge_catch_draws_groups_to_the_road():
    groups, buildings = [sq(0, 0, 80), sq(200, 0, 80)], [sq(10, 10, 20), sq(210, 10, 20)]
    block = [sq(-50, -50, 450)]
    assert stages.edge_catch(groups, buildings, np.zeros((0, 4)), block) == groups
    caught = stages.edge_catch(groups, buildings, np.array([[90, -40, 90, 300.0]]), block)
    assert all(planar.is_valid(p) for p in caught) and total(planar.union(caught)) > 2 * 6400 - 1


def test_erode_cases():
    whole = [sq(0, 0, 200)]
    assert total(stages.erode(whole, [sq(90, 90, 20)])) == pytest.approx(40_000, rel=0.05)
    assert total(stages.erode(whole, [sq(5, 5, 10)], below=100)) < 40_000
    assert total(stages.erode(whole, [])) == pytest.approx(40_000)


def test_gap_cases():
    two = [sq(0, 0, 200), sq(215, 0, 200)]
    closed = stages.close_gaps(two, [sq(-50, -50, 500)], 10_000, 50_000, 15)
    assert total(closed) >= 80_000 and all(planar.is_valid(p) for p in closed)
    assert total(stages.close_gaps([hole(sq(0, 0, 100), sq(40, 40, 20))], [sq(-50, -50, 300)], 1000, 4900, 15)) > 9_600
    assert stages.close_gaps([], [sq(0, 0, 10)]) == []


def test_gap_in_holes():
    assert total(stages.close_hole_gaps([hole(sq(0, 0, 100), sq(35, 35, 30))], 15)) > 9_100
    assert total(stages.close_hole_gaps([hole(sq(0, 0, 100), sq(42, 42, 15))], 15)) == pytest.approx(9_775, rel=0.1)


@pytest.mark.parametrize(("size", "most", "want"), [(20, 500, 10_000), (40, 500, 8_400), (0, 500, 10_000), (20, 0, 9_600)])
def test_hole_close(size, most, want):
    layer = [hole(sq(0, 0, 100), sq(30, 30, size)) if size else sq(0, 0, 100)]
    assert total(stages.close_holes(layer, most)) == pytest.approx(want)


def test_stacked_shapes_cost_as_much_as_the_outermost(monkeypatch):
    """What lies in a rectangle of the same corner changes no union, no blocks and no zones, and doesn't get to the overlays."""
    square = lambda x, y, s: [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]
    at = [(40.0 * i, 40.0 * j) for i in range(12) for j in range(12)]
    stack = [square(x, y, s) for x, y in at for s in (20.0, *range(5, 20), 20.0)]
    notch = [np.array([(0, 0), (30, 0), (30, 9), (9, 9), (9, 30), (0, 30), (0, 0)], float)]  # wider than the rectangles, and not full
    every = [*stack, notch, []]
    left = planar.outermost(every)
    assert len(left) == len(at) + 1 and planar.outermost([]) == []
    assert sum(map(planar.area, planar.union(left))) == pytest.approx(sum(map(planar.area, planar.union(every[:40], every[-2:], [p for p in stack if p[0][2, 0] - p[0][0, 0] == 20]))))
    assert planar.areas([*every, [square(0, 0, 9)[0], square(2, 2, 3)[0][::-1]]]).tolist() == [*map(planar.area, every), 72.0]
    roads = np.array([s for k in range(7) for s in ((80.0 * k - 5, -5, 80.0 * k - 5, 475), (-5, 80.0 * k - 5, 475, 80.0 * k - 5))])
    seen, outline = [], planar.convex_outline
    monkeypatch.setattr(planar, "convex_outline", lambda shapes: seen.append(len(shapes)) or outline(shapes))
    found = [stages.inner_blocks(roads, shapes, 30.0) for shapes in (stack, [p for p in stack if planar.area(p) == 400][::2])]
    assert seen == [len(at), len(at)] and len(found[0]) > 0
    assert all(len(a) == len(b) and all((p == q).all() for p, q in zip(a, b, strict=True)) for a, b in zip(*found, strict=True))


def test_meet_in_parts(monkeypatch):
    square = lambda x, y, s: [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]
    a, b = [square(7.0 * i, 3.0 * (i % 5), 8) for i in range(20)], [square(5.0 * i, 2.0 * (i % 7), 1 + i % 9) for i in range(30)]
    want = planar.meet(a, b)
    monkeypatch.setattr(planar, "MET", 4)
    assert len(want) > 20 and planar.meet(a, b).tolist() == want.tolist()
    assert planar.meet(a, b[:3]).tolist() == want[want[:, 1] < 3].tolist() and planar.meet(a, []).shape == (0, 2)
