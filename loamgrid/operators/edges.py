"""Edges of buildings: angles, groups of angles, the dominant angle, oriented rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.geometry import segments, undirected_angle

#: Edges shorter than this share of a building's longest are left out; angles this close (degrees) are one group.
SHORT_SHARE, GROUP_GAP = 0.20, 10.0


def building_edges(buildings: DataFrame, key: str = "fid", on=("pid",)) -> DataFrame:
    """key, edge_no (from 0 along all rings), x1, y1, x2, y2, length."""
    rings = buildings.select(key, *on, F.posexplode("geom").alias("ring_no", "_r"))
    out = rings.select(key, *on, "ring_no", F.posexplode(segments("_r")).alias("edge_no", "_s")).select(key, *on, "ring_no", "edge_no", "_s.x1", "_s.y1", "_s.x2", "_s.y2")
    return out.withColumn("length", F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))))


def long_edges(edges: DataFrame, key: str = "fid", share: float = SHORT_SHARE) -> DataFrame:
    """Edges of at least `share` of their building's longest; all of them if fewer than two would be left."""
    w = Window.partitionBy(key)
    e = edges.withColumn("_long", F.col("length") >= F.max("length").over(w) * share)
    return e.withColumn("_n", F.count_if("_long").over(w)).where(F.col("_long") | (F.col("_n") < 2)).drop("_long", "_n")


def edge_angles(edges: DataFrame, places: int | None = None) -> DataFrame:
    """Adds angle (0..180)."""
    a = undirected_angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return edges.withColumn("angle", F.bround(a, places) if places is not None else a)


def angle_groups(df: DataFrame, by: list[str], gap: float = GROUP_GAP, inclusive: bool = False, order: list[str] | None = None) -> DataFrame:
    """Adds group_no: in order of angle, a new group begins where the step from the angle before is `gap` or more (more, if inclusive)."""
    w = Window.partitionBy(*by).orderBy("angle", *(order or []))
    step = F.col("angle") - F.lag("angle").over(w)
    starts = (step > gap) if inclusive else (step >= gap)
    return df.withColumn("_s", F.coalesce(starts.cast("int"), F.lit(0))).withColumn("group_no", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def dominant_angles(edges: DataFrame, by: list[str], gap: float = GROUP_GAP) -> DataFrame:
    """by, angle: of the group of angles with the greatest total length, the entry that the original method picks.

    Its sums of runs of equal angles leave out the last run unless it is the only one, and the number of the longest run is used as
    the number of an entry.
    """
    g = angle_groups(edges, by, gap, order=["edge_no"] if "edge_no" in edges.columns else None)
    sums = g.groupBy(*by, "group_no").agg(F.sum("length").alias("_sum"))
    top = sums.groupBy(*by).agg(F.max(F.struct("_sum", (-F.col("group_no")).alias("_g"))).alias("_t")).select(*by, (-F.col("_t._g")).alias("group_no"))
    mine = g.join(top, [*by, "group_no"])
    runs = mine.groupBy(*by, "angle").agg(F.sum("length").alias("_sum"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("angle")
    runs = runs.withColumn("_run", F.row_number().over(w) - 1).withColumn("_runs", F.count("*").over(Window.partitionBy(*by)))
    runs = runs.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    usable = runs.where((F.col("_run") < F.col("_runs") - 1) | (F.col("_runs") == 1))
    pick = usable.groupBy(*by).agg(F.max(F.struct("_sum", (-F.col("_run")).alias("_r"))).alias("_t")).select(*by, (-F.col("_t._r")).alias("_pick"))
    return runs.join(pick, by).where(F.col("_upto") > F.col("_pick")).groupBy(*by).agg(F.min("angle").alias("angle"))


def edge_keys(edges: DataFrame, keep: list[str], places: int = 1) -> DataFrame:
    """Order-independent edges: distinct pairs of rounded ends (half to even), the smaller first: ax, ay, bx, by."""
    r = lambda c: F.bround(c, places)
    a, b = F.struct(r("x1").alias("x"), r("y1").alias("y")), F.struct(r("x2").alias("x"), r("y2").alias("y"))
    k = edges.select(*keep, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return k.select(*keep, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def vertex_distance(a: Column | str, b: Column | str) -> Column:
    """Smallest distance between vertices of two polygons."""
    va, vb = F.flatten(a), F.flatten(b)
    d = F.flatten(F.transform(va, lambda p: F.transform(vb, lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))))
    return F.array_min(d)
