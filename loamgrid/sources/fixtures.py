"""Synthetic layers projected from the star-schema test tables; all coordinates are whole metres, so any engine agrees on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions.geometry import line, point, rect_polygon

#: Side of a partition and of a lattice block; the extra barrier's height in each partition.
SIDE, STREET, BARRIER = 3200, 200, 1650
#: Building cells of all partitions: the building of key k stands in the cell of the one of key k - CELLS.
CELLS = 25 * 128 * 128
#: Sections of the function-code filter file: buildings that make a neighbourhood residential, and those that are left out.
FILTER_TEXT = """#Filter positive
31001_1000, Wohngeb
31001_1010, Wohnhaus

31001_2000, Gewerbe
#Filter negative
# a remark
31001_2721, Scheune
31001_2723, Schuppen
"""

X, Y = f"CAST((pid % 5) * {SIDE} AS DOUBLE)", f"CAST((pid div 5) * {SIDE} AS DOUBLE)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, part (NAME), box, geom: 25 squares."""
    n = _read(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS pid", "concat('PART_', n_nationkey) AS part")
    return n.selectExpr("pid", "part", f"{X} AS xmin", f"{Y} AS ymin", f"{X} + {SIDE} AS xmax", f"{Y} + {SIDE} AS ymax").withColumn("geom", rect_polygon())


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, pid, part, fkt (function code), box, geom: rectangles in 25 m cells in Morton order, thinned block by block."""
    bits = lambda shift: " + ".join(f"((s >> {2 * i + shift}) & 1) * {1 << i}" for i in range(7))
    o = _read(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS fid", "CAST(o_orderkey % 25 AS BIGINT) AS pid", "CAST(o_orderkey div 25 AS BIGINT) AS s", "o_orderpriority AS priority")
    o = o.selectExpr("*", f"{bits(0)} AS cx", f"{bits(1)} AS cy", "CASE WHEN fid % 11 = 0 THEN 5 ELSE 8 + (fid * 7) % 13 END AS side")
    o = o.where("(fid * 31) % 100 >= 10 + 15 * ((pid + 3 * (cx div 8) + 5 * (cy div 8)) % 5)")
    code = "CASE left(priority, 1) WHEN '1' THEN '31001_1000' WHEN '2' THEN '31001_1010' WHEN '3' THEN '31001_2000' WHEN '4' THEN '31001_2721' ELSE '0' END AS fkt"
    o = o.selectExpr("fid", "pid", "concat('PART_', pid) AS part", code, f"{X} + cx * 25 + 2 AS xmin", f"{Y} + cy * 25 + 2 AS ymin", "side")
    return o.selectExpr("fid", "pid", "part", "fkt", "xmin", "ymin", "xmin + side AS xmax", "ymin + side AS ymax").withColumn("geom", rect_polygon())


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, pid, part, box, geom: the lattice's faces in closed form."""
    n = SIDE // STREET
    b = partitions(spark, sf_dir).select("pid", "part", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("i"))
    b = b.selectExpr(f"pid * {n * n} + i AS block_id", "pid", "part", f"{X} + (i div {n}) * {STREET} AS xmin", f"{Y} + (i % {n}) * {STREET} AS ymin")
    return b.selectExpr("block_id", "pid", "part", "xmin", "ymin", f"xmin + {STREET} AS xmax", f"ymin + {STREET} AS ymax").withColumn("geom", rect_polygon())


def _lines(df: DataFrame) -> DataFrame:
    df = df.selectExpr("*", "least(x1, x2) AS xmin", "least(y1, y2) AS ymin", "greatest(x1, x2) AS xmax", "greatest(y1, y2) AS ymax")
    return df.withColumn("geom", line(point("x1", "y1"), point("x2", "y2")))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, pid, part, x1, y1, x2, y2, box, geom: a lattice of streets in each partition, and eight short dead ends."""
    p = partitions(spark, sf_dir).select("pid", "part")
    i = p.select("pid", "part", F.explode(F.sequence(F.lit(0), F.lit(SIDE // STREET))).alias("i"))
    down = i.selectExpr("pid * 100 + i AS fid", "pid", "part", f"{X} + i * {STREET} AS x1", f"{Y} AS y1", f"{X} + i * {STREET} AS x2", f"{Y} + {SIDE} AS y2")
    along = i.selectExpr("pid * 100 + 20 + i AS fid", "pid", "part", f"{X} AS x1", f"{Y} + i * {STREET} AS y1", f"{X} + {SIDE} AS x2", f"{Y} + i * {STREET} AS y2")
    stub = i.where("i % 2 = 1 AND i < 16").selectExpr("pid * 100 + 40 + i AS fid", "pid", "part", f"{X} + i * {STREET} + 100 AS x1", f"{Y} + i * {STREET} AS y1", f"{X} + i * {STREET} + 107 AS x2", f"{Y} + i * {STREET} + 30 AS y2")
    return _lines(down.union(along).union(stub))


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The auxiliary layer: a railway across each partition."""
    p = partitions(spark, sf_dir)
    return _lines(p.selectExpr("pid * 100 + 90 AS fid", "pid", "part", f"{X} AS x1", f"{Y} + {BARRIER} AS y1", f"{X} + {SIDE} AS x2", f"{Y} + {BARRIER} AS y2"))
