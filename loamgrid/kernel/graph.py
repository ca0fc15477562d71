"""Triangulations, spanning forests, clusters of buildings and chains of road segments."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from loamgrid.kernel.planar import Polygon, contains, point_segment, segments, segments_meet  # noqa: F401  (contains, segments: for callers)

FAR = 10_000.0  # distance of the reference axis from the points
ANGLE_GAP, SHORT_SHARE = 10.0, 0.20
NO_AREA = 1e12


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of the Delaunay triangulation, by inserting points one after another (Bowyer-Watson with a walk).

    Fewer than three points, or points on one line, have none; of repeated points the first is used. Ties of points on one circle go
    to the triangle that is there already, so that the order of the points decides them.
    """
    first = {tuple(p): i for i, p in reversed(list(enumerate(points.tolist())))}
    use = sorted(first.values())
    if len(use) < 3:
        return np.zeros((0, 3), np.int64)
    p = points - points[use].mean(0).round()
    d = p[use] - p[use[0]]
    far = d[np.abs(d).sum(1).argmax()]
    if np.all(np.abs(d[:, 0] * far[1] - d[:, 1] * far[0]) == 0):
        return np.zeros((0, 3), np.int64)
    n = len(points)
    span = float(np.abs(p[use]).max() + 1) * 1e5
    x = [*p[:, 0].tolist(), -span, span, 0.0]
    y = [*p[:, 1].tolist(), -span, -span, span]
    corner: list = [(n, n + 1, n + 2)]  # counter-clockwise
    across: list = [(-1, -1, -1)]  # neighbour opposite each corner
    alive = [True]

    def turn(a: int, b: int, q: int) -> float:
        return (x[b] - x[a]) * (y[q] - y[a]) - (y[b] - y[a]) * (x[q] - x[a])

    def in_circle(t: int, q: int) -> bool:
        a, b, c = corner[t]
        ax, ay, bx, by, cx, cy = x[a] - x[q], y[a] - y[q], x[b] - x[q], y[b] - y[q], x[c] - x[q], y[c] - y[q]
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    # Neighbours in space follow each other, so that walks are short.
    cell = max(1.0, float(np.abs(p[use]).max()) / math.sqrt(len(use)))
    order = sorted(use, key=lambda i: (int(x[i] // cell), y[i] if int(x[i] // cell) % 2 else -y[i], i))
    last = 0
    for q in order:
        t = last
        while True:  # walk to the triangle that holds q
            a, b, c = corner[t]
            if turn(a, b, q) < 0:
                t = across[t][2]
            elif turn(b, c, q) < 0:
                t = across[t][0]
            elif turn(c, a, q) < 0:
                t = across[t][1]
            else:
                break
        hole, todo, border = {t}, [t], []
        while todo:
            s = todo.pop()
            for k in range(3):
                o = across[s][k]
                if o not in hole:
                    if o >= 0 and in_circle(o, q):
                        hole.add(o)
                        todo.append(o)
                    else:
                        border.append((corner[s][(k + 1) % 3], corner[s][(k + 2) % 3], o, s))
        start, end = {}, {}
        for a, b, o, s in border:
            if o in hole:
                continue
            new = len(corner)
            corner.append((q, a, b))
            across.append([o, -1, -1])
            alive.append(True)
            if o >= 0:
                mine = list(across[o])
                mine[mine.index(s)] = new
                across[o] = mine
            start[a], end[b] = new, new
        for a, new in start.items():
            across[new][2] = end[a]  # opposite b: the edge q-a
        for b, new in end.items():
            across[new][1] = start[b]
        for s in hole:
            alive[s] = False
        last = len(corner) - 1
    return np.array([c for c, a in zip(corner, alive, strict=True) if a and max(c) < n], np.int64).reshape(-1, 3)


def triangle_edges(triangles: np.ndarray) -> np.ndarray:
    """Distinct edges (u < v) of triangles."""
    e = np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]])
    return np.unique(np.sort(e, 1), axis=0) if len(e) else np.zeros((0, 2), np.int64)


def kruskal(n: int, edges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a minimum spanning forest; of equal weights the earlier edge comes first."""
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for k in np.argsort(weights, kind="stable").tolist():
        a, b = top(int(edges[k, 0])), top(int(edges[k, 1]))
        if a != b:
            parent[b] = a
            out.append(k)
    return np.array(out, np.int64)


def vertex_distance(a: Polygon, b: Polygon) -> float:
    p, q = np.concatenate(a), np.concatenate(b)
    return float(np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min())


def spanning_forest(fids: list[int], polygons: list[Polygon], centres: np.ndarray, streets: np.ndarray) -> list[tuple[int, int, float]]:
    """(u, v, weight): minimum spanning forest of buildings over Delaunay edges between their centroids that cross no street."""
    edges = triangle_edges(delaunay(centres))
    if len(edges) and len(streets):
        lines = np.concatenate([centres[edges[:, 0]], centres[edges[:, 1]]], 1)
        edges = edges[~crossing(lines, streets)]
    weights = np.array([vertex_distance(polygons[u], polygons[v]) for u, v in edges])
    return [(fids[edges[k, 0]], fids[edges[k, 1]], float(weights[k])) for k in kruskal(len(fids), edges, weights)]


def crossing(lines: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which segments meet any of the others."""
    from loamgrid.kernel.planar import box_pairs

    low, high = np.minimum(lines[:, :2], lines[:, 2:]), np.maximum(lines[:, :2], lines[:, 2:])
    pair = box_pairs(low, high, np.minimum(others[:, :2], others[:, 2:]), np.maximum(others[:, :2], others[:, 2:]))
    out = np.zeros(len(lines), bool)
    out[pair[segments_meet(lines[pair[:, 0]], others[pair[:, 1]]), 0]] = True
    return out


# --- oriented rectangles and clusters ----------------------------------------------------------------------------------------


def outline_edges(polygon: Polygon, share: float = SHORT_SHARE) -> np.ndarray:
    """Edges (n, 5: x1, y1, x2, y2, length) of a building of at least `share` of its longest; all if fewer than two would be left."""
    s = segments([polygon])
    e = np.c_[s, np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1])]
    e = e[e[:, 4] > 0]
    kept = e[e[:, 4] >= e[:, 4].max() * share] if len(e) else e
    return kept if len(kept) >= 2 else e


def angles(edges: np.ndarray) -> np.ndarray:
    """Undirected angles to the x axis in 0..180, mirrored for level and downward edges, to one place."""
    d = edges[:, 2:4] - edges[:, :2]
    a = np.degrees(np.arccos(np.clip(d[:, 0] / np.hypot(d[:, 0], d[:, 1]), -1, 1)))
    return np.round(np.where(d[:, 1] <= 0, 180 - a, a), 1)


def dominant_angle(angle: np.ndarray, length: np.ndarray, gap: float = ANGLE_GAP) -> float:
    """Of the heaviest group of neighbouring angles the entry whose place is the number of the heaviest run of equal angles; the last
    run counts only if it is the only one (both as in the original method)."""
    order = np.argsort(angle, kind="stable")
    a, w = angle[order], length[order]
    begin = np.r_[0, np.flatnonzero(np.diff(a) >= gap) + 1]
    best = int(np.add.reduceat(w, begin).argmax())
    end = np.r_[begin[1:], len(a)]
    a, w = a[begin[best] : end[best]], w[begin[best] : end[best]]
    runs = np.add.reduceat(w, np.r_[0, np.flatnonzero(np.diff(a) != 0) + 1])
    return float(a[int((runs[:-1] if len(runs) > 1 else runs).argmax())])


def oriented_rectangle(edges: np.ndarray) -> tuple[np.ndarray | None, float]:
    """Rectangle (closed ring) along the dominant angle of edges, and its area; none for four points or fewer, and none where a foot
    lies at distance zero of the axis. An area of 0 counts as NO_AREA."""
    if len(edges) <= 4:
        return None, 0.0
    p = edges[:, :2]
    angle = math.radians(dominant_angle(angles(edges), edges[:, 4]))
    u = np.array([math.cos(angle), math.sin(angle)])
    start = np.array([p[:, 0].max() + FAR if angle > math.pi / 2 else p[:, 0].min() - FAR, p[:, 1].min()])
    end = start + FAR * u
    axis = (end - start) / np.hypot(*(end - start))
    along = (p - start) @ axis
    foot = start + along[:, None] * axis
    side = axis[0] * (p[:, 1] - start[1]) - axis[1] * (p[:, 0] - start[0])
    distance = np.abs(side)
    near, far = distance.min(), distance.max()
    low, high = int(foot[:, 1].argmin()), int(foot[:, 1].argmax())
    if distance[low] == 0 or distance[high] == 0:
        return None, 0.0
    to_low, to_high = (p[low] - foot[low]) / distance[low], (p[high] - foot[high]) / distance[high]
    c1, c2, d1, d2 = foot[low] + to_low * near, foot[low] + to_low * far, foot[high] + to_high * near, foot[high] + to_high * far
    area = float(np.hypot(*(c1 - c2)) * np.hypot(*(d2 - c2)))
    return np.array([c1, c2, d2, d1, c1]), area or NO_AREA


def clusters(edges: dict[int, np.ndarray], areas: dict[int, float], tree: list[tuple[int, int, float]], ratio: float = 18.0) -> list[list[int]]:
    """Members of groups of buildings: tree edges in order of weight extend a group, or found one, if the members' area is over
    `ratio` percent of their oriented rectangle.

    As in the original method: of two grouped buildings the later one's group is tried; a failed extension is followed by a try of
    the pair alone, which moves both to a new group while the old one keeps its list; a building may be listed twice.
    """
    group_of: dict[int, int] = {}
    groups: list[list[int]] = []

    def fits(members: list[int]) -> bool:
        _, area = oriented_rectangle(np.concatenate([edges[m] for m in members]))
        return bool(area) and sum(areas[m] for m in members) / area * 100 > ratio

    for u, v, _ in sorted(tree, key=lambda e: e[2]):
        if u not in edges or v not in edges:
            continue
        if v in group_of or u in group_of:
            old, new = (v, u) if v in group_of else (u, v)
            wider = [*groups[group_of[old]], new]
            if fits(wider):
                groups[group_of[old]] = wider
                group_of[new] = group_of[old]
                continue
        if fits([v, u]):
            group_of[v] = group_of[u] = len(groups)
            groups.append([v, u])
    return groups


# --- chains and shortest lines -----------------------------------------------------------------------------------------------


def chains(lines: np.ndarray, places: int = 8) -> list[np.ndarray]:
    """Distinct segments joined to paths between nodes of degree other than two; rings come last."""
    around: dict[tuple, list[tuple]] = defaultdict(list)
    left: dict[tuple, None] = {}
    for x1, y1, x2, y2 in np.round(lines, places).tolist():
        a, b = (x1, y1), (x2, y2)
        key = (a, b) if a < b else (b, a)
        if a != b and key not in left:
            left[key] = None
            around[a].append(b)
            around[b].append(a)
    out = []

    def follow(a: tuple, b: tuple) -> None:
        path = [a, b]
        left.pop((a, b) if a < b else (b, a))
        while len(around[b]) == 2:
            c = around[b][0] if around[b][0] != a else around[b][1]
            key = (b, c) if b < c else (c, b)
            if key not in left:
                break
            left.pop(key)
            path.append(c)
            a, b = b, c
        out.append(np.array(path))

    for a in list(around):
        if len(around[a]) != 2:
            for b in around[a]:
                if ((a, b) if a < b else (b, a)) in left:
                    follow(a, b)
    while left:
        follow(*next(iter(left)))
    return out


def shortest_lines(points: np.ndarray, paths: list[np.ndarray]) -> list[dict]:
    """For each point the line to the nearest path (of equal ones the first): x1, y1, x2, y2, angle (0..360), distance."""
    if not paths:
        return []
    s = np.concatenate([np.concatenate([p[:-1], p[1:]], 1) for p in paths])
    out = []
    for p in points:
        distance, foot = point_segment(np.repeat(p[None], len(s), 0), s)
        k = int(distance.argmin())
        d = foot[k] - p
        angle = math.degrees(math.atan2(d[1], d[0]))
        out.append({"x1": p[0], "y1": p[1], "x2": foot[k, 0], "y2": foot[k, 1], "angle": angle + 360 if angle < 0 else angle, "distance": float(distance[k]), "seq": len(out)})
    return out


def keep_lines(lines: list[dict], keep: int = 2) -> list[dict]:
    """The filter rules (see operators.rules) for lines in groups of four."""
    return [x for i in range(0, len(lines), 4) for x in _filter(lines[i : i + 4], keep)]


def _filter(lines: list[dict], keep: int) -> list[dict]:
    from loamgrid.operators.rules import ALL_PARALLEL, CLOSE, MOST, OUTLIER, SIMILAR, TOLERANCE

    if len(lines) <= keep:
        return lines
    lines = [x for x in lines if x["distance"] < MOST]
    if len(lines) <= keep:
        return lines
    xs, ys = [x["x1"] for x in lines], [x["y1"] for x in lines]
    inside = [min(xs) - TOLERANCE <= x["x2"] <= max(xs) + TOLERANCE and min(ys) - TOLERANCE <= x["y2"] <= max(ys) + TOLERANCE for x in lines]
    out = [x for x, i in zip(lines, inside, strict=True) if not i]
    if len(out) < keep:
        out += sorted((x for x, i in zip(lines, inside, strict=True) if i), key=lambda x: x["distance"])[: keep - len(out)]
    if len(out) <= keep:
        return out
    gone = set()
    for i, a in enumerate(out):
        for j in range(i + 1, len(out)):
            b = out[j]
            d = abs(a["angle"] - b["angle"])
            if min(360 - d if d > 180 else d, abs(d - 180)) <= SIMILAR and math.hypot(a["x2"] - b["x2"], a["y2"] - b["y2"]) <= CLOSE:
                gone.add(i if a["distance"] > b["distance"] else j)
    if len(out) - len(gone) >= keep:
        out = [x for i, x in enumerate(out) if i not in gone]
    if len(out) <= keep:
        return out
    half = [x["angle"] % 180 for x in out]
    if len(out) == 4 and max(half) - min(half) <= ALL_PARALLEL:
        return sorted(out, key=lambda x: x["distance"])[:2]
    groups: list[list[dict]] = []
    for x in sorted(out, key=lambda x: x["angle"]):
        if groups and x["angle"] - groups[-1][-1]["angle"] <= SIMILAR:
            groups[-1].append(x)
        else:
            groups.append([x])
    ranked = sorted(groups, key=lambda g: -sum(x["distance"] for x in g) / len(g))
    mean = [sum(x["distance"] for x in g) / len(g) for g in ranked]
    if len(groups) >= 3 and len(out) - len(ranked[0]) >= keep and mean[0] > OUTLIER * mean[1]:
        return [x for g in ranked[1:] for x in g]
    return out
