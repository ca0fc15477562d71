"""The geometry stages of the delineation, on the layers of one partition as numpy geometries."""

from __future__ import annotations

import numpy as np

from loamgrid.kernel import graph, planar
from loamgrid.kernel.planar import Polygon, area, buffer, buffer_lines, contains, delete_holes, difference, meet, polygonize, segments, union  # noqa: F401

#: Grid that overlays of gaps and voids snap to; metres.
SNAP = 1e-3
PIECE, BORDER = 10.0, 0.5
EDGE_ZONE, SNAP_BUFFER = 0.3, 0.1


def pieces(lines: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut every `step`, and the segment that each piece is of."""
    n = np.hypot(lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1])
    k = np.maximum(np.ceil(n / step - 1e-9), 1).astype(int)
    who = np.repeat(np.arange(len(lines)), k)
    i = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.nan_to_num(i * step / n[who]), np.minimum(np.nan_to_num((i + 1) * step / n[who], nan=1.0), 1)
    d = lines[who, 2:] - lines[who, :2]
    return np.concatenate([lines[who, :2] + a[:, None] * d, lines[who, :2] + b[:, None] * d], 1), who


def path_pieces(ring: np.ndarray, step: float) -> np.ndarray:
    """A ring cut at multiples of `step` along its whole length, as segments (pieces keep their corners)."""
    s = planar.path_segments(ring)
    n = np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1])
    at = np.r_[0, np.cumsum(n)]
    marks = np.unique(np.r_[at, np.arange(0, at[-1], step)])
    x, y = np.interp(marks, at, ring[:, 0]), np.interp(marks, at, ring[:, 1])
    return np.c_[x[:-1], y[:-1], x[1:], y[1:], marks[:-1] // step]


# --- blocks and density ------------------------------------------------------------------------------------------------------


def city_blocks(part: Polygon, roads: np.ndarray, buildings: list[Polygon]) -> list[Polygon]:
    """Faces between the partition's outline and the roads in it that a building touches."""
    faces = polygonize(np.concatenate([planar.clip_lines(roads, [part]), segments([part])]))
    return [faces[i] for i in np.unique(meet(faces, planar.outermost(buildings))[:, 0])]


def inner_blocks(roads: np.ndarray, buildings: list[Polygon], distance: float = 100.0) -> list[Polygon]:
    """Faces of the roads that the outline of the buildings, grown by a distance, doesn't touch."""
    faces = polygonize(roads)
    if not faces or not buildings:
        return faces
    buildings = planar.outermost(buildings)
    outline = planar.convex_outline([g[0] for g in buffer(buildings, distance, dissolve=False)]) if all(map(planar.is_convex, buildings)) else segments(buffer(buildings, distance))
    hit = np.unique(meet(faces, [outline])[:, 0]) if len(outline) else []
    return [f for i, f in enumerate(faces) if i not in set(hit)]


# --- edge catch --------------------------------------------------------------------------------------------------------------


def roads_near(roads: np.ndarray, buildings: list[Polygon], step: float = 20.0, distance: float = 25.0) -> np.ndarray:
    """Pieces of roads within a distance of a building (measured, where the original method asks 20-gons around the pieces)."""
    cut, _ = pieces(roads, step)
    buildings = planar.outermost(buildings)
    border = segments(buildings)
    if not len(cut) or not len(border):
        return np.zeros((0, 4))
    low, high = np.minimum(cut[:, :2], cut[:, 2:]) - distance, np.maximum(cut[:, :2], cut[:, 2:]) + distance
    pair = planar.box_pairs(low, high, np.minimum(border[:, :2], border[:, 2:]), np.maximum(border[:, :2], border[:, 2:]))
    near = np.zeros(len(cut), bool)
    near[pair[segment_distance(cut[pair[:, 0]], border[pair[:, 1]]) <= distance, 0]] = True
    return cut[near | planar.inside_any(buildings, cut[:, :2])]


def boxes(shapes: list[np.ndarray]) -> np.ndarray:
    """(n, 4): xmin, ymin, xmax, ymax of point arrays."""
    return np.array([(*s.min(0), *s.max(0)) for s in shapes]).reshape(-1, 4)


def overlapping(box: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which boxes touch a box."""
    return np.flatnonzero((of[:, 0] <= box[2]) & (of[:, 2] >= box[0]) & (of[:, 1] <= box[3]) & (of[:, 3] >= box[1]))


def catch_feature(feature: Polygon, roads: np.ndarray, blocks: list[Polygon], factor: float = 2.0) -> list[Polygon]:
    """A group's outline drawn out to the roads around it, cut to its blocks: pieces of less than factor times its area.

    roads and blocks: those whose boxes touch the feature's are enough, and the roads of those blocks.
    """
    size = area(feature)
    if not size:
        return []
    corners = feature[0][1:]
    touched = meet(blocks, [np.concatenate([p, p])[None] for p in corners])[:, 0] if blocks else []
    near = [blocks[i] for i in np.unique(touched)]
    if near and len(roads):
        border = segments(near)
        hit = graph.crossing(roads, border)
        mine = roads[hit | planar.inside_any(near, roads[:, :2])]
    else:
        mine = np.zeros((0, 4))
    paths = graph.chains(mine)
    rays = graph.keep_lines(graph.shortest_lines(corners, paths))
    lines = [extend(p) for p in paths] + [extend(np.array([[r["x1"], r["y1"]], [r["x2"], r["y2"]]])) for r in rays if r["distance"] > 0]
    lines += [extend(s.reshape(2, 2)) for s in segments([feature])]
    faces = polygonize(np.concatenate([planar.path_segments(p) for p in lines]))
    faces = [faces[i] for i in np.unique(meet(faces, [feature])[:, 0])] if faces else []
    cut = [p for i, j in meet(faces, near) for p in planar.intersection([faces[i]], [near[j]])] if faces and near else []
    return [p for p in cut if area(p) < factor * size]


def extend(path: np.ndarray, by: float = 1.0) -> np.ndarray:
    """A path whose first and last segments are longer by `by`."""
    a, b = path[0] - path[1], path[-1] - path[-2]
    first, last = path[0] + a / (np.hypot(*a) or 1) * by, path[-1] + b / (np.hypot(*b) or 1) * by
    return np.concatenate([first[None], path[1:-1], last[None]])


def edge_catch(grouped: list[Polygon], buildings: list[Polygon], roads: np.ndarray, blocks: list[Polygon]) -> list[Polygon]:
    """All groups drawn out to the roads near buildings; the groups themselves if there is no such road or nothing comes of it."""
    near = roads_near(roads, buildings)
    if not len(near):
        return grouped
    of_blocks = boxes([b[0] for b in blocks])
    of_roads = np.c_[np.minimum(near[:, :2], near[:, 2:]), np.maximum(near[:, :2], near[:, 2:])]
    out = []
    for g in grouped:
        mine = overlapping(boxes([g[0]])[0], of_blocks)
        if len(mine):
            wide = np.r_[of_blocks[mine, :2].min(0), of_blocks[mine, 2:].max(0)]
            out += catch_feature(g, near[overlapping(wide, of_roads)], [blocks[i] for i in mine])
    return out or grouped


# --- contact of borders ------------------------------------------------------------------------------------------------------


def contact(polygons: list[Polygon], border: np.ndarray, reach: float = BORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """Percent of each polygon's boundary whose 10 m pieces come within `reach` of a border (whole pieces count), and those pieces."""
    share, touching = np.zeros(len(polygons)), []
    for i, p in enumerate(polygons):
        found, total, hit_length = [], 0.0, 0.0
        for ring in p:
            s = path_pieces(ring, PIECE)
            n = np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1])
            hit = np.zeros(len(s), bool)
            if len(border):
                low, high = np.minimum(s[:, :2], s[:, 2:4]) - reach, np.maximum(s[:, :2], s[:, 2:4]) + reach
                pair = planar.box_pairs(low, high, np.minimum(border[:, :2], border[:, 2:]), np.maximum(border[:, :2], border[:, 2:]))
                near = segment_distance(s[pair[:, 0], :4], border[pair[:, 1]]) <= reach
                hit[pair[near, 0]] = True
            piece = s[:, 4].astype(int)
            hit = np.isin(piece, np.unique(piece[hit]))
            total, hit_length = total + n.sum(), hit_length + n[hit].sum()
            found.append(s[hit, :4])
        share[i] = 100 * hit_length / total if total else 0.0
        touching.append(np.concatenate(found) if found else np.zeros((0, 4)))
    return share, touching


def segment_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros(0)
    d = np.min([planar.point_segment(a[:, :2], b)[0], planar.point_segment(a[:, 2:], b)[0], planar.point_segment(b[:, :2], a)[0], planar.point_segment(b[:, 2:], a)[0]], 0)
    return np.where(planar.segments_meet(a, b), 0.0, d)


# --- erode -------------------------------------------------------------------------------------------------------------------


def erode(settlement: list[Polygon], buildings: list[Polygon], least: float = 500.0, low: float = 10.0, high: float = 100.0, below: float = 20.0) -> list[Polygon]:
    """Settlement without voids of at least `least` that hang on the rest by some, but less than `below` percent of their boundary.

    A void is what no building's zone covers (the building grown by the root of its area, between low and high). A void without
    contact to the outline of the rest isn't removed.
    """
    whole = union(settlement, grid=SNAP)
    buildings = planar.outermost(buildings)  # a building within another has a smaller zone, within the other's
    near = [buildings[i] for i in np.unique(meet(whole, buildings)[:, 1])] if whole else []
    if not near:
        return whole
    zones = buffer(near, [float(min(max(np.sqrt(area(b)), low), high)) for b in near], grid=SNAP)
    voids = [v for v in difference(whole, zones, grid=SNAP) if area(v) >= least]
    if not voids:
        return whole
    rest = difference([delete_holes(p) for p in whole], voids, grid=SNAP)
    share, _ = contact(voids, segments(rest))
    gone = [v for v, s in zip(voids, share, strict=True) if 0 < s < below]
    return difference(whole, buffer(gone, BORDER, grid=SNAP), grid=SNAP) if gone else whole


# --- gaps --------------------------------------------------------------------------------------------------------------------


def select_gaps(settlement: list[Polygon], gaps: list[Polygon], percent: float) -> list[Polygon]:
    """Gaps of whose boundary more than `percent` lies along the settlement's, and those that touch such a boundary piece."""
    share, touching = contact(gaps, segments(settlement))
    lines = [t for s, t in zip(share, touching, strict=True) if s > percent and len(t)]
    return [gaps[i] for i in np.unique(meet(gaps, lines)[:, 0])] if lines else []


def without_holes(polygons: list[Polygon], below: float) -> list[Polygon]:
    return [delete_holes(p, below) for p in polygons]


def close_hole_gaps(settlement: list[Polygon], distance: float = 15.0, most: float = 10_000.0, least: float = 500.0) -> list[Polygon]:
    """Narrow parts of holes are filled: what two sides, grown by a distance, cover together."""
    grown = union(buffer(settlement, SNAP_BUFFER, grid=SNAP), grid=SNAP)
    closed = without_holes(grown, most)
    rings = [p for p in closed if len(p) > 1]
    if not rings:
        return closed
    holes = [[r[::-1]] for p in rings for r in p[1:]]
    strip = planar.intersection(buffer(rings, distance, grid=SNAP), holes, grid=SNAP)
    outer = segments(buffer(rings, distance, grid=SNAP))
    core = difference(strip, buffer_lines(outer, distance + EDGE_ZONE, grid=SNAP), grid=SNAP)
    fill = [p for p in buffer(core, EDGE_ZONE + SNAP_BUFFER, grid=SNAP) if area(p) > least] if core else []
    return union(closed, fill, grid=SNAP)


def close_block_gaps(settlement: list[Polygon], blocks: list[Polygon], most_hole: float, most_gap: float) -> list[Polygon]:
    closed = without_holes(settlement, most_hole)
    parts = [p for p in planar.symmetric_difference(blocks, closed, grid=SNAP) if area(p) < most_gap]
    merged = union(select_gaps(closed, parts, 70.0), closed, grid=SNAP)
    return without_holes(close_hole_gaps(merged), most_hole)


def close_border_gaps(closed: list[Polygon], original: list[Polygon], most_hole: float, most_gap: float, distance: float) -> list[Polygon]:
    grown = buffer(closed, distance, grid=SNAP)
    core = difference(grown, buffer_lines(segments(grown), distance + EDGE_ZONE, grid=SNAP), grid=SNAP)
    gaps = difference(core, original, grid=SNAP)
    gaps = [p for g in gaps for p in buffer([g], EDGE_ZONE, grid=SNAP) if area(p) > 200 * distance / 15]
    loose, strict = select_gaps(closed, gaps, 70.0), select_gaps(closed, gaps, 90.0)
    small, large = [p for p in loose if area(p) < most_gap], [p for p in loose if area(p) >= most_gap]
    if strict:
        hit = set(meet(large, strict)[:, 0].tolist())
        large = [p for i, p in enumerate(large) if i not in hit]
    narrow = []
    for p in large:
        dense = [np.concatenate([path_pieces(r, PIECE)[:, :2], r[:1]]) for r in p]
        narrow += [[t] for t in planar.triangulate(dense) if np.hypot(*np.diff(t, axis=0).T).max() < 70.0]
    merged = without_holes(union(small, strict, narrow, closed, grid=SNAP), most_hole)
    return buffer(merged, SNAP_BUFFER, grid=SNAP)


def close_gaps(layer: list[Polygon], blocks: list[Polygon], most_hole: float = 10_000.0, most_gap: float = 4_900.0, distance: float = 30.0) -> list[Polygon]:
    """Gaps to block borders, in holes and between parts closed; an empty layer stays as it is."""
    whole = union(layer, grid=SNAP)
    if not whole:
        return layer
    return close_border_gaps(close_block_gaps(whole, blocks, most_hole, most_gap), layer, most_hole, most_gap, distance)


def close_holes(layer: list[Polygon], most: float) -> list[Polygon]:
    """Union of a layer without holes of up to `most`."""
    return [delete_holes(p, most, inclusive=True) if most > 0 else p for p in union(layer)]
