"""Kernel stages as grouped DataFrame operators: the layers of one partition meet in one group, and geometries come back as rows.

Layers are sent as one tagged table (pid, layer, fid, value, text, geom) and grouped by partition; a partition is the user's unit of
work and bounded by advice (10 000 buildings). A stage is a function from a dict of layers to rows (layer, fid, value, geom).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamgrid.kernel import graph, planar, stages
from loamgrid.kernel.columns import POLYGON, from_polygon
from loamgrid.kernel.convex import polygons as polygons_of

TAGGED = "pid long, layer string, fid long, value double, text string, geom array<array<struct<x:double,y:double>>>"
OUT = "pid long, layer string, fid long, value double, geom array<array<struct<x:double,y:double>>>"
ARROW = (pa.int64(), pa.string(), pa.int64(), pa.float64(), to_arrow_type(POLYGON))
Layers = dict[str, list[tuple[int, float, planar.Polygon]]]
Rows = Iterable[tuple[str, int, float | None, planar.Polygon]]


def tag(df: DataFrame, layer: str, fid: str = "fid", value: str | None = None, line: bool = False) -> DataFrame:
    """A layer's rows for run(): pid and geom are taken as they are; a line is sent as its only ring."""
    geom = F.array("geom") if line else F.col("geom")
    return df.select(F.col("pid").cast("long").alias("pid"), F.lit(layer).alias("layer"), F.col(fid).cast("long").alias("fid"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"), F.lit(None).cast("string").alias("text"), geom.alias("geom"))


def robust(stage: Callable[[Layers], Rows]) -> Callable[[Layers], list]:
    """A stage that is tried again with repaired polygons if it fails, and fails only then."""

    def run(layers: Layers) -> list:
        try:
            return list(stage(layers))
        except (ValueError, IndexError, FloatingPointError, ZeroDivisionError):
            mend = lambda p: planar.make_valid(p) if p and (p[0][0] == p[0][-1]).all() else [p]
            return list(stage({k: [(f, v, q) for f, v, p in rows for q in mend(p)] for k, rows in layers.items()}))

    return run


def run(layers: list[DataFrame], stage: Callable[[Layers], Rows]) -> DataFrame:
    """pid, layer, fid, value, geom: what the stage gives for each partition. Rows without a geometry are left out."""
    safe = robust(stage)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        mine: Layers = {}
        geoms = (p for chunk in table.column("geom").chunks for p in polygons_of(chunk))
        for layer, fid, value, geom in zip(*(table.column(c).to_pylist() for c in ("layer", "fid", "value")), geoms, strict=True):
            polygon = [r for r in geom if len(r) > 1]
            if polygon:
                mine.setdefault(layer, []).append((fid, value, polygon))
        for rows in mine.values():
            rows.sort(key=lambda r: r[0])  # the order of groups' rows is not fixed
        pid = key[0].as_py()
        out = [(pid, layer, int(fid), None if value is None else float(value), from_polygon(p)) for layer, fid, value, p in safe(mine)]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, ARROW, strict=True)], names=["pid", "layer", "fid", "value", "geom"])

    sent = reduce(DataFrame.union, layers)
    n = 4 * int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few partitions a task, so that tasks are alike
    return sent.repartition(n, "pid").groupBy("pid").applyInArrow(work, OUT)  # small in bytes, long in time: not to be coalesced


def polygons(layers: Layers, name: str) -> list[planar.Polygon]:
    return [p for _, _, p in layers.get(name, [])]


def lines(layers: Layers, *names: str) -> np.ndarray:
    found = [planar.path_segments(r) for n in names for _, _, p in layers.get(n, []) for r in p]
    return np.concatenate(found) if found else np.zeros((0, 4))


def centroid(polygon: planar.Polygon) -> tuple[float, float]:
    r = polygon[0] - polygon[0][0]
    w = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
    if not w.sum():
        return tuple(polygon[0][:-1].mean(0))
    c = ((r[:-1] + r[1:]) * w[:, None]).sum(0) / (3 * w.sum())
    return float(polygon[0][0, 0] + c[0]), float(polygon[0][0, 1] + c[1])


def numbered(layer: str, found: list[planar.Polygon], values: list | None = None) -> Rows:
    order = sorted(range(len(found)), key=lambda i: (*found[i][0].min(0), *found[i][0].max(0)))
    return [(layer, n, values[i] if values is not None else planar.area(found[i]), found[i]) for n, i in enumerate(order)]


# --- stages ------------------------------------------------------------------------------------------------------------------


def street_faces(layers: Layers) -> Rows:
    return numbered("block", planar.polygonize(lines(layers, "roads")))


def city_blocks(layers: Layers) -> Rows:
    part = polygons(layers, "part")
    return numbered("block", stages.city_blocks(part[0], lines(layers, "roads", "barriers"), polygons(layers, "buildings"))) if part else []


def inner_faces(layers: Layers) -> Rows:
    return numbered("block", stages.inner_blocks(lines(layers, "roads"), polygons(layers, "buildings")))


def block_density(least: int = 20) -> Callable[[Layers], Rows]:
    """Inner blocks that more than `least` buildings touch; value: percent of the block that buildings, clipped to it, cover (0 if they
    share its border only)."""

    def stage(layers: Layers) -> Rows:
        faces, buildings = stages.inner_blocks(lines(layers, "roads"), polygons(layers, "buildings")), polygons(layers, "buildings")
        pair = planar.meet(faces, buildings)
        out, values = [], []
        size = planar.areas(buildings)
        for i in np.unique(pair[:, 0]):
            mine = pair[pair[:, 0] == i, 1]
            if len(mine) > least:
                whole = planar.holds(faces[i], [buildings[j] for j in mine])
                covered = size[mine[whole]].sum() + sum(planar.area(p) for j in mine[~whole] for p in planar.intersection([buildings[j]], [faces[i]]))
                out.append(faces[i])
                values.append(100 * covered / planar.area(faces[i]))
        return numbered("block", out, values)

    return stage


def spanning_tree(layers: Layers) -> Rows:
    """A line for each edge; fid is the smaller building's, value the weight; the line runs from it to the other."""
    rows = layers.get("buildings", [])
    centres = np.array([centroid(p) for _, _, p in rows]).reshape(-1, 2)
    at = {f: i for i, (f, _, _) in enumerate(rows)}
    for u, v, w in graph.spanning_forest([r[0] for r in rows], [r[2] for r in rows], centres, lines(layers, "streets")):
        a, b = sorted((u, v))
        yield "edge", a, w, [np.array([centres[at[a]], centres[at[b]]])]


def forest(buildings: list[tuple[int, float, planar.Polygon]], streets: np.ndarray) -> list[tuple[int, int, float]]:
    """The spanning forest's edges: smaller id, larger id, weight."""
    centres = np.array([centroid(p) for _, _, p in buildings]).reshape(-1, 2)
    return [(min(u, v), max(u, v), w) for u, v, w in graph.spanning_forest([f for f, _, _ in buildings], [p for _, _, p in buildings], centres, streets)]


def cluster(buildings: list[tuple[int, float, planar.Polygon]], tree: list[tuple[int, int, float]], ratio: float) -> list[planar.Polygon]:
    """Oriented rectangles of the clusters of buildings along their spanning forest."""
    edges = {f: graph.outline_edges(p) for f, _, p in buildings}
    found = graph.clusters(edges, {f: planar.area(p) for f, _, p in buildings}, tree, ratio)
    boxes = [graph.oriented_rectangle(np.concatenate([edges[m] for m in members]))[0] for members in found]
    return [p for b in boxes if b is not None and (p := planar.oriented([b]))]


def clusters(ratio: float = 18.0) -> Callable[[Layers], Rows]:
    def stage(layers: Layers) -> Rows:
        mine = layers.get("buildings", [])
        return numbered("cluster", cluster(mine, forest(mine, lines(layers, "streets")), ratio))

    return stage


def singles(buildings: list[planar.Polygon], groups: list[planar.Polygon], least: float = 300.0) -> list[planar.Polygon]:
    """Rectangles of least area around buildings over `least` whose inner point lies in no group."""
    points = np.array([planar.inner_point(b) for b in buildings]).reshape(-1, 2)
    alone = ~planar.inside_any(groups, points)
    seeds = [np.concatenate([p, p])[None] for p in points[alone]]
    near = [buildings[i] for i in np.unique(planar.meet(buildings, seeds)[:, 0])] if seeds else []
    return [[planar.min_area_rectangle(b[0])] for b in near if planar.area(b) > least]


def settlement(least_cover: float = 18.0, most_hole: float = 10_000.0, most_gap: float = 4_900.0) -> Callable[[Layers], Rows]:
    """From a partition's outline (value: its coverage), buildings that roads have cut (split), the filtered of these (buildings), roads,
    barriers and streets to its settlement polygons.

    Blocks hold a split building each; dense ones leave the path; the filtered buildings outside them are clustered at the partition's
    coverage, large single ones added, groups drawn out to roads; with the dense blocks they are eroded and their gaps closed.
    Without a spanning tree there is nothing. value: area.
    """

    def stage(layers: Layers) -> Rows:
        part, every = layers.get("part", []), polygons(layers, "split")
        if not part or not every:
            return []
        _, coverage, outline = part[0]
        kept = layers.get("buildings", [])
        shapes = [p for _, _, p in kept]
        blocks = stages.city_blocks(outline, lines(layers, "roads", "barriers"), every)
        dense = dense_of(blocks, shapes, least_cover)
        inside = set(planar.meet(shapes, dense)[:, 0].tolist()) if dense and shapes else set()
        outside = [c for i, c in enumerate(kept) if i not in inside]
        tree = forest(outside, lines(layers, "streets")) if len(outside) > 1 else []
        if not tree:
            return []
        groups = cluster(outside, tree, coverage)
        alone = [p for _, _, p in outside]
        groups = groups + singles(alone, groups)
        merged = (stages.edge_catch(groups, alone, lines(layers, "roads"), blocks) if groups else []) + dense
        return numbered("settlement", stages.close_gaps(stages.erode(merged, every), blocks, most_hole, most_gap)) if merged else []

    return stage


def dense_of(blocks: list[planar.Polygon], shapes: list[planar.Polygon], least_cover: float) -> list[planar.Polygon]:
    """Blocks of which the whole areas of the shapes that touch them are at least a percentage."""
    if not blocks or not shapes:
        return []
    pair, size = planar.meet(blocks, shapes), planar.areas(shapes)
    cover = 100 * np.bincount(pair[:, 0], size[pair[:, 1]], len(blocks)) / np.array([planar.area(b) for b in blocks])
    return [b for b, c, n in zip(blocks, cover, np.bincount(pair[:, 0], minlength=len(blocks)), strict=True) if n and c >= least_cover]


def caught(layers: Layers) -> Rows:
    """Groups drawn out to the roads near buildings, within their blocks."""
    return numbered("caught", stages.edge_catch(polygons(layers, "groups"), polygons(layers, "buildings"), lines(layers, "roads"), polygons(layers, "blocks")))


def eroded(layers: Layers) -> Rows:
    return numbered("settlement", stages.erode(polygons(layers, "settlement"), polygons(layers, "buildings")))


def gaps_closed(layers: Layers) -> Rows:
    return numbered("settlement", stages.close_gaps(polygons(layers, "settlement"), polygons(layers, "blocks")))


def dissolved(layers: Layers) -> Rows:
    return numbered("settlement", planar.union(polygons(layers, "settlement")))


def holes_closed(most: float) -> Callable[[Layers], Rows]:
    """The settlement's union without holes of up to `most`."""
    return lambda layers: numbered("settlement", stages.close_holes(polygons(layers, "settlement"), most))
