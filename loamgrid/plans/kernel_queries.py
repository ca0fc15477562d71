"""Queries whose geometry the kernel works out for each partition. Where the fixture has a closed form, SQL checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.kernel.columns import min_rectangle, point_on_surface
from loamgrid.operators import density, filters, lines, parts
from loamgrid.operators.spatial import anti
from loamgrid.plans import pipeline
from loamgrid.plans.layers_sql import LAYERS
from loamgrid.plans.relational import DENSE, HIT
from loamgrid.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = LAYERS + more + sql
        return f

    return add


def _boxes(found: DataFrame) -> DataFrame:
    """pid, box rounded, area of polygons that a stage gave."""
    r = lambda c: F.round(c, 3).alias(c)
    return pipeline.with_box(found).select("pid", r("xmin"), r("ymin"), r("xmax"), r("ymax"), F.round(G.polygon_area("geom"), 2).alias("area"))


@query("SELECT pid, xmin, ymin, xmax, ymax, CAST(40000 AS DOUBLE) AS area FROM bl")
def street_blocks(spark, sf):
    """Faces of the street network: the lattice, as dead ends bound nothing."""
    return _boxes(parts.run([parts.tag(X.roads(spark, sf), "roads", line=True)], parts.street_faces))


CELLS = ", ys AS (SELECT pid, py + 200 * i + CASE WHEN k = 1 THEN 50 ELSE 0 END AS y0, CASE WHEN i = 8 AND k = 0 THEN py + 1650 ELSE py + 200 * i + 200 END AS y1 FROM (SELECT *, CAST((pid % 5) * 3200 AS DOUBLE) AS px, CAST((pid // 5) * 3200 AS DOUBLE) AS py FROM q), range(0, 16) t(i), range(0, 2) u(k) WHERE k = 0 OR i = 8), cb AS (SELECT ys.pid, xmin, y0 AS ymin, xmax, y1 AS ymax FROM ys JOIN (SELECT DISTINCT pid, xmin, xmax FROM bl) bx ON ys.pid = bx.pid)"


@query("SELECT pid, xmin, ymin, xmax, ymax, (xmax - xmin) * (ymax - ymin) AS area FROM cb WHERE EXISTS (SELECT 1 FROM b WHERE b.pid = cb.pid AND " + HIT.format(o="cb") + ")", CELLS)
def city_blocks(spark, sf):
    """Blocks between outline, streets and the railway that a building touches."""
    sent = [parts.tag(X.partitions(spark, sf), "part", "pid"), parts.tag(X.buildings(spark, sf), "buildings"), parts.tag(X.roads(spark, sf), "roads", line=True), parts.tag(X.barriers(spark, sf), "barriers", line=True)]
    return _boxes(parts.run(sent, parts.city_blocks))


@query()
def inner_blocks(spark, sf):
    """Blocks that the outline of the buildings, grown by 100 m, doesn't touch."""
    return _boxes(parts.run([parts.tag(X.buildings(spark, sf), "buildings"), parts.tag(X.roads(spark, sf), "roads", line=True)], parts.inner_faces))


@query()
def local_density(spark, sf):
    return pipeline.local_density(X.buildings(spark, sf), X.roads(spark, sf))


@query()
def global_density(spark, sf):
    return pipeline.global_density(X.buildings(spark, sf), X.roads(spark, sf))


def _apart(spark, sf) -> DataFrame:
    """Buildings with positions off the lattice, so that no four centres lie on a circle by construction; 40 m apart."""
    b = X.buildings(spark, sf)
    i = F.row_number().over(Window.partitionBy("pid").orderBy("fid")) - 1
    b = b.select("fid", "pid", "part", "fkt", (F.col("xmax") - F.col("xmin")).alias("side"), i.alias("i"))
    x = F.col("pid") % 5 * 3200 + F.col("i") % 79 * 40 + 10 + F.col("fid") * 17 % 7
    y = F.floor(F.col("pid") / 5) * 3200 + F.floor(F.col("i") / 79) * 40 + 10 + F.col("fid") * 29 % 5
    b = b.withColumns({"xmin": x.cast("double"), "ymin": y.cast("double")}).withColumns({"xmax": F.col("xmin") + F.col("side"), "ymax": F.col("ymin") + F.col("side")})
    return b.drop("side", "i").withColumn("geom", G.rect_polygon())


def _tree(spark, sf) -> DataFrame:
    streets = lines.without_dead_ends(X.roads(spark, sf))
    return parts.run([parts.tag(_apart(spark, sf), "buildings"), parts.tag(streets, "streets", line=True)], parts.spanning_tree)


@query()
def mst_edges(spark, sf):
    """The spanning forest's edges: ends' building and weight."""
    t = _tree(spark, sf)
    at = lambda i, k: F.round(F.col("geom")[0][i][k], 3)
    return t.select("pid", F.col("fid").alias("u"), F.round("value", 6).alias("weight"), at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(1, "x").alias("x2"), at(1, "y").alias("y2"))


@query()
def mst_summary(spark, sf):
    """Per partition: nodes that have an edge, edges, total weight."""
    t = _tree(spark, sf)
    ends = t.select("pid", F.explode(F.col("geom")[0]).alias("p")).groupBy("pid").agg(F.count_distinct("p").alias("n_nodes"))
    return ends.join(t.groupBy("pid").agg(F.count("*").alias("n_edges"), F.round(F.sum("value"), 4).alias("weight")), "pid")


@query()
def mst_pairs(spark, sf):
    """Building pairs of tree edges in order of weight, per partition."""
    t = _tree(spark, sf)
    b = _apart(spark, sf).select("pid", F.col("fid").alias("v"), F.round((F.col("xmin") + F.col("xmax")) / 2, 3).alias("x"), F.round((F.col("ymin") + F.col("ymax")) / 2, 3).alias("y"))
    ends = t.select("pid", F.col("fid").alias("u"), "value", F.round(F.col("geom")[0][1]["x"], 3).alias("x"), F.round(F.col("geom")[0][1]["y"], 3).alias("y"))
    joined = ends.join(b, ["pid", "x", "y"])
    return joined.select("pid", "u", "v", F.row_number().over(Window.partitionBy("pid").orderBy("value", "u", "v")).alias("rank"))


@query()
def mst_clusters(spark, sf):
    """Oriented rectangles of the clusters of buildings."""
    streets = lines.without_dead_ends(X.roads(spark, sf))
    return _boxes(parts.run([parts.tag(_apart(spark, sf), "buildings"), parts.tag(streets, "streets", line=True)], parts.clusters()))


@query("SELECT fid, area FROM b WHERE area > 300 AND NOT EXISTS (SELECT 1 FROM d WHERE d.s / 40000 * 100 >= 18 AND d.pid = b.pid AND (b.xmin + b.xmax) / 2 BETWEEN d.xmin AND d.xmax AND (b.ymin + b.ymax) / 2 BETWEEN d.ymin AND d.ymax)", DENSE)
def large_isolated_buildings(spark, sf):
    """Buildings over 300 m2 whose inner point lies in no dense block, as rectangles of least area."""
    b = X.buildings(spark, sf)
    p = b.withColumn("p", point_on_surface("geom")).withColumns({"xmin": F.col("p.x"), "ymin": F.col("p.y"), "xmax": F.col("p.x"), "ymax": F.col("p.y")})
    alone = anti(p, density.dense_blocks(X.blocks(spark, sf), b), ["fid"], 200.0, on=("pid",))
    out = alone.where(G.polygon_area("geom") > 300).select("fid", min_rectangle("geom").alias("g"))
    return out.select("fid", F.round(G.polygon_area("g"), 6).alias("area"))


@query("SELECT a.fid AS u, round((greatest(a.xmax, z.xmax) - least(a.xmin, z.xmin)) * (greatest(a.ymax, z.ymax) - least(a.ymin, z.ymin)), 4) AS area FROM b a JOIN b z ON a.pid = z.pid AND z.fid = a.fid + 25")
def oriented_rects(spark, sf):
    """Oriented rectangles of pairs of neighbours: their dominant angle is 90, so that the rectangle is their common box."""
    b = X.buildings(spark, sf).select("fid", "pid", "geom")
    pair = b.select(F.col("fid").alias("u"), "pid", F.col("geom").alias("g"), (F.col("fid") + 25).alias("v")).join(b.select(F.col("fid").alias("v"), F.col("geom").alias("h")), "v")
    both = pair.select(F.col("u").alias("fid"), "pid", F.explode(F.array("g", "h")).alias("geom"))
    sent = parts.tag(both, "buildings")
    return parts.run([sent], _rectangles).select(F.col("fid").alias("u"), F.round("value", 4).alias("area"))


def _rectangles(layers):
    import numpy as np

    from loamgrid.kernel import graph

    mine: dict = {}
    for f, _, p in layers.get("buildings", []):
        mine.setdefault(f, []).append(graph.outline_edges(p))
    for f, e in mine.items():
        box, size = graph.oriented_rectangle(np.concatenate(e))
        if box is not None:
            yield "rect", f, size, [box]


def _dense(spark, sf) -> DataFrame:
    return density.dense_blocks(X.blocks(spark, sf), X.buildings(spark, sf))


@query("SELECT pid, sum(40000.0::DOUBLE) AS area FROM d WHERE s / 40000 * 100 >= 18 GROUP BY pid", DENSE)
def dissolve_blocks(spark, sf):
    """Union of the dense blocks of each partition: its area."""
    out = parts.run([parts.tag(_dense(spark, sf), "settlement", "block_id")], parts.dissolved)
    return out.groupBy("pid").agg(F.round(F.sum("value"), 2).alias("area"))


@query("SELECT pid, CAST(sum(40000 - CASE WHEN 5 * (block_id % 30 + 1) > 77 THEN 5 * (block_id % 30 + 1) ELSE 0 END) AS DOUBLE) AS area FROM bl GROUP BY pid")
def hole_close(spark, sf):
    """Union of all blocks, each with a hole of 5 to 150 m2, without holes of up to 77 m2: its area."""
    w = (F.col("block_id") % 30 + 1).cast("double")
    hole = F.array(*(G.point(F.col("xmin") + 10 + dx, F.col("ymin") + 10 + dy) for dx, dy in ((0, 0), (0, 5), (w, 5), (w, 0), (0, 0))))
    b = X.blocks(spark, sf).select("block_id", "pid", F.concat("geom", F.array(hole)).alias("geom"))
    out = parts.run([parts.tag(b, "settlement", "block_id")], parts.holes_closed(77.0))
    return out.groupBy("pid").agg(F.round(F.sum("value"), 1).alias("area"))


@query()
def erode_empty_areas(spark, sf):
    """Dense blocks without voids that hang on the rest by a narrow contact."""
    return _boxes(parts.run([parts.tag(_dense(spark, sf), "settlement", "block_id"), parts.tag(X.buildings(spark, sf), "buildings")], parts.eroded))


@query()
def gap_close(spark, sf):
    """Every dense block shrunk by 6 m, with the gaps between them closed."""
    d = _dense(spark, sf)
    shrunk = d.select("block_id", "pid", G.rect_polygon(F.col("xmin") + 6, F.col("ymin") + 6, F.col("xmax") - 6, F.col("ymax") - 6).alias("geom"))
    return _boxes(parts.run([parts.tag(shrunk, "settlement", "block_id"), parts.tag(X.blocks(spark, sf), "blocks", "block_id")], parts.gaps_closed))


@query()
def edge_catch(spark, sf):
    """The middles of dense blocks, drawn out to the streets around them."""
    d = _dense(spark, sf)
    middle = d.select("block_id", "pid", G.rect_polygon(F.col("xmin") + 30, F.col("ymin") + 30, F.col("xmax") - 30, F.col("ymax") - 30).alias("geom"))
    roads, blocks = X.roads(spark, sf), X.blocks(spark, sf)
    sent = [parts.tag(middle, "groups", "block_id"), parts.tag(X.buildings(spark, sf), "buildings"), parts.tag(roads, "roads", line=True), parts.tag(blocks, "blocks", "block_id")]
    return _boxes(parts.run(sent, parts.caught))


@query()
def delineate(spark, sf):
    """The whole delineation: patches of all partitions."""
    layers = {"partitions": X.partitions(spark, sf), "buildings": X.buildings(spark, sf), "roads": X.roads(spark, sf), "barriers": X.barriers(spark, sf)}
    codes = filters.filter_codes(filters.text_lines(spark, X.FILTER_TEXT))
    out = pipeline.delineate(layers, codes)
    return out.select("pid", "patch_id", F.round("area", 2).alias("area"), "join_count", "kept_as")
