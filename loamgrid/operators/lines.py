"""Operators on straight street segments (x1, y1, x2, y2 with a box) and on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.geometry import crossing, line, nearest_on_segment, point, segments
from loamgrid.operators.spatial import anti, pairs, semi

ENDS = ("x1", "y1", "x2", "y2")


def with_box(df: DataFrame) -> DataFrame:
    return df.withColumns({"xmin": F.least("x1", "x2"), "ymin": F.least("y1", "y2"), "xmax": F.greatest("x1", "x2"), "ymax": F.greatest("y1", "y2")})


def length(df: DataFrame, name: str = "length") -> DataFrame:
    return df.withColumn(name, F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))))


def explode_lines(df: DataFrame, geom: str = "geom") -> DataFrame:
    """A row for each two-vertex segment of a line: seg_no (from 0), x1, y1, x2, y2."""
    keep = [c for c in df.columns if c not in (geom, *ENDS, "seg_no", "xmin", "ymin", "xmax", "ymax")]
    return with_box(df.select(*keep, F.posexplode(segments(geom)).alias("seg_no", "_s")).select(*keep, "seg_no", *(F.col(f"_s.{c}").alias(c) for c in ENDS)))


def split_by_length(df: DataFrame, step: float) -> DataFrame:
    """Segments cut at multiples of `step` along them: piece_no (from 0); a segment without length stays whole."""
    d = length(df, "_n")
    n = F.greatest(F.ceil(F.col("_n") / step), F.lit(1))
    d = d.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    a = F.when(F.col("_n") > 0, F.col("piece_no") * step / F.col("_n")).otherwise(0.0)
    b = F.when(F.col("_n") > 0, F.least((F.col("piece_no") + 1) * step / F.col("_n"), F.lit(1.0))).otherwise(1.0)
    at = lambda t, c: F.col(c + "1") + t * (F.col(c + "2") - F.col(c + "1"))
    out = d.withColumn("_a", a).withColumn("_b", b).withColumns({"_x1": at(F.col("_a"), "x"), "_y1": at(F.col("_a"), "y"), "_x2": at(F.col("_b"), "x"), "_y2": at(F.col("_b"), "y")})
    out = out.withColumns({c: F.col("_" + c) for c in ENDS}).drop("_n", "_a", "_b", *("_" + c for c in ENDS))
    return with_box(out.drop("geom")) if "geom" in out.columns else with_box(out)


def densify(df: DataFrame, step: float) -> DataFrame:
    """Vertices at equal distances of at most `step` along each segment: vertex_no (from 0), x, y; both ends are among them."""
    d = length(df, "_n").withColumn("_k", F.greatest(F.ceil(F.col("_n") / step), F.lit(1)))
    d = d.withColumn("vertex_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k"))))
    t = F.col("vertex_no") / F.col("_k")
    return d.withColumn("x", F.col("x1") + t * (F.col("x2") - F.col("x1"))).withColumn("y", F.col("y1") + t * (F.col("y2") - F.col("y1"))).drop("_n", "_k")


def intersections(streets: DataFrame, key: str = "fid", on=("pid",), size: float = 200.0) -> DataFrame:
    """l_fid < r_fid, x, y: the crossing points of a layer's segments with each other (parallel ones have none)."""
    met = pairs(streets.select(key, *ENDS, *on, "xmin", "ymin", "xmax", "ymax"), streets.select(key, *ENDS, *on, "xmin", "ymin", "xmax", "ymax"), size, on=on).where(F.col("l_" + key) < F.col("r_" + key))
    hit = crossing(tuple("l_" + c for c in ENDS), tuple("r_" + c for c in ENDS))
    return met.withColumn("_p", hit).where("_p is not null").select("l_" + key, "r_" + key, *(F.col("l_" + c).alias(c) for c in on), "_p.x", "_p.y")


def end_nodes(streets: DataFrame, on=("pid",)) -> DataFrame:
    """x, node_count, and the nodes themselves (y): first and last vertices, counted by x alone, as the original method counts them."""
    ends = streets.select(*on, F.explode(F.array(point("x1", "y1"), point("x2", "y2"))).alias("p")).select(*on, "p.x", "p.y")
    return ends.join(ends.groupBy(*on, "x").agg(F.count("*").alias("node_count")), [*on, "x"])


def lone_nodes(streets: DataFrame, on=("pid",)) -> DataFrame:
    """End nodes whose x no other end of the layer has."""
    return end_nodes(streets, on).where("node_count = 1").drop("node_count")


def dead_ends(streets: DataFrame, key: str = "fid", on=("pid",), clear: float = 5.0, most: float = 50.0) -> DataFrame:
    """Streets shorter than `most` with a lone end node that is more than `clear` from every crossing."""
    box = lambda df: df.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})
    crossings = box(intersections(streets, key, on).select(*on, "x", "y").distinct())
    apart = lambda: (F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x")) + (F.col("l_y") - F.col("r_y")) * (F.col("l_y") - F.col("r_y")) <= clear * clear
    free = anti(box(lone_nodes(streets, on)), crossings, [*on, "x", "y"], 50.0, on=on, within=clear, refine=apart)
    touch = lambda: nearest_on_segment("r_x", "r_y", *("l_" + c for c in ENDS))["distance"] == 0
    return semi(length(streets), free, [key, *on], 200.0, on=on, refine=touch).where(F.col("length") < most)


def without_dead_ends(streets: DataFrame, key: str = "fid", on=("pid",)) -> DataFrame:
    return streets.join(dead_ends(streets, key, on).select(key, *on), [key, *on], "left_anti")


def node_degrees(segments_: DataFrame, on=("pid",), places: int = 8) -> DataFrame:
    """x, y, degree: distinct neighbours of each vertex of two-vertex segments; repeated segments and loops don't count."""
    r = lambda c: F.round(c, places)
    a, b = F.struct(r("x1").alias("x"), r("y1").alias("y")), F.struct(r("x2").alias("x"), r("y2").alias("y"))
    edges = segments_.select(*on, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
    ends = edges.select(*on, F.explode(F.array("a", "b")).alias("p"))
    return ends.groupBy(*on, "p").agg(F.count("*").alias("degree")).select(*on, "p.x", "p.y", "degree")


def extended(df: DataFrame, by: float = 1.0) -> DataFrame:
    """Segments lengthened by `by` at both ends."""
    n = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    d = df.withColumn("_u", (F.col("x2") - F.col("x1")) / n * by).withColumn("_v", (F.col("y2") - F.col("y1")) / n * by)
    d = d.withColumns({"_x1": F.col("x1") - F.col("_u"), "_y1": F.col("y1") - F.col("_v"), "_x2": F.col("x2") + F.col("_u"), "_y2": F.col("y2") + F.col("_v")})
    d = with_box(d.withColumns({c: F.col("_" + c) for c in ENDS}).drop("_u", "_v", *("_" + c for c in ENDS)))
    return d.withColumn("geom", line(point("x1", "y1"), point("x2", "y2"))) if "geom" in df.columns else d
