"""Building coverage of blocks: counts, dense blocks, clipped density, kernel density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.geometry import polygon_area, rect_point_distance
from loamgrid.kernel.columns import shared_area
from loamgrid.operators.spatial import pairs, semi, summary

CELL = 200.0


def area(df: DataFrame, name: str = "area") -> DataFrame:
    """Adds the area of `geom` where a layer has none; of the box only where there is no geometry."""
    if name in df.columns:
        return df
    return df.withColumn(name, polygon_area("geom") if "geom" in df.columns else (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))


def building_counts(blocks: DataFrame, buildings: DataFrame, key: list[str] | None = None, on=("pid",), refine=None) -> DataFrame:
    """blocks with building_count: buildings that touch a block count in it; blocks without any have 0."""
    out = summary(blocks, buildings.select("xmin", "ymin", "xmax", "ymax", *on, *(["geom"] if refine else [])), key or ["block_id"], [F.count("*").alias("building_count")], CELL, on=on, refine=refine)
    return out.withColumn("building_count", F.coalesce("building_count", F.lit(0)).cast("long"))


def dense_blocks(blocks: DataFrame, buildings: DataFrame, threshold: float = 18.0, key: list[str] | None = None, on=("pid",), refine=None) -> DataFrame:
    """Blocks covered by at least `threshold` percent. Each block is charged the full area of every building that touches it.

    Adds shape_area, footprint_area_sum, overlap; blocks that no building touches are left out, as are blocks without area.
    """
    b = area(blocks, "shape_area")
    inner = area(buildings).select("area", "xmin", "ymin", "xmax", "ymax", *on, *(["geom"] if refine else []))
    out = summary(b, inner, key or ["block_id"], [F.sum("r_area").alias("footprint_area_sum")], CELL, discard=True, on=on, refine=refine)
    out = out.withColumn("overlap", F.col("footprint_area_sum") / F.when(F.col("shape_area") != 0, F.col("shape_area")) * 100)
    return out.where(F.col("overlap") >= threshold)


def clip_pairs(blocks: DataFrame, buildings: DataFrame, on=("pid",)) -> DataFrame:
    """Pairs of blocks and buildings with the area that they share (touching pairs have 0). Pairs whose geometries fill their boxes have a
    closed form; the kernel works out the others."""
    w = F.least("l_xmax", "r_xmax") - F.greatest("l_xmin", "r_xmin")
    h = F.least("l_ymax", "r_ymax") - F.greatest("l_ymin", "r_ymin")
    if "geom" not in blocks.columns or "geom" not in buildings.columns:
        return pairs(buildings, blocks, CELL, on=on).withColumn("clip_area", w * h)
    full = polygon_area("geom") == (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    met = pairs(buildings.withColumn("_full", full), blocks.withColumn("_full", full), CELL, on=on)
    other = ~F.coalesce(F.col("l__full") & F.col("r__full"), F.lit(False))
    only = lambda c: F.when(other, F.col(c))  # noqa: E731  the kernel gets null for pairs that have a closed form
    return met.withColumn("clip_area", F.when(other, shared_area(only("l_geom"), only("r_geom"))).otherwise(w * h)).drop("l__full", "r__full")


def footprint_density(blocks: DataFrame, buildings: DataFrame, on=("pid",)) -> DataFrame:
    """block_id, sum_area_intersect, overlap: buildings clipped to their blocks; blocks that share no area with one are left out."""
    shared = clip_pairs(blocks, buildings, on).where("clip_area > 0")
    sums = shared.groupBy(F.col("r_block_id").alias("block_id")).agg(F.sum("clip_area").alias("sum_area_intersect"))
    a = area(blocks, "shape_area").select("block_id", *on, "shape_area")
    return a.join(sums, "block_id").select("block_id", *on, "sum_area_intersect", F.when(F.col("shape_area") > 0, F.col("sum_area_intersect") / F.col("shape_area") * 100).otherwise(0.0).alias("overlap"))


def mean_density(density: DataFrame, by: list[str], threshold: float = 18.0, least: int = 5, blocks: DataFrame | None = None) -> DataFrame:
    """Mean overlap for each group if it has more than `least` blocks, else the threshold. blocks: all of the groups' blocks, which
    count with 0 if density has no row of theirs."""
    out = density.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.avg("overlap").alias("_mean"))
    if blocks is not None:
        every = blocks.groupBy(*by).agg(F.count("*").alias("_all"))
        out = every.join(out, by, "left").select(*by, F.col("_all").alias("n_blocks"), (F.coalesce(F.col("_mean") * F.col("n_blocks"), F.lit(0.0)) / F.col("_all")).alias("_mean"))
    return out.withColumn("density", F.when(F.col("n_blocks") > least, F.col("_mean")).otherwise(threshold)).drop("_mean")


def kernel_density(points: DataFrame, cell: float = 50.0, radius: float = 200.0, on=("pid",)) -> DataFrame:
    """ix, iy, x, y (cell centre), value: quartic kernel (1 - (d/r)^2)^2 summed over the points (x, y) closer than `radius`."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / cell).cast("long"), F.floor((F.col(c) + radius) / cell).cast("long")))
    near = points.select(*on, "x", "y").withColumn("ix", span("x")).withColumn("iy", span("y"))
    dx, dy = F.col("x") - (F.col("ix") + 0.5) * cell, F.col("y") - (F.col("iy") + 0.5) * cell
    near = near.withColumn("q", (dx * dx + dy * dy) / (radius * radius)).where("q < 1")
    out = near.groupBy(*on, "ix", "iy").agg(F.sum((1 - F.col("q")) * (1 - F.col("q"))).alias("value"))
    return out.select(*on, "ix", "iy", ((F.col("ix") + 0.5) * cell).alias("x"), ((F.col("iy") + 0.5) * cell).alias("y"), "value")


def zone_buildings(buildings: DataFrame, density: DataFrame, least: float = 4.0, cell: float = 50.0, key: str = "fid", on=("pid",)) -> DataFrame:
    """Buildings that a residential zone touches: discs of radius cell / 1.5 around cells of at least `least`.

    The discs are exact circles here, not 20-gons (whose radius is up to 1.3 % smaller between vertices).
    """
    r = cell / 1.5
    cells = density.where(F.col("value") >= least).select(*on, "x", "y", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    close = lambda: rect_point_distance("r_x", "r_y", "l_xmin", "l_ymin", "l_xmax", "l_ymax") <= r
    return semi(buildings, cells, [key], 2 * cell, on=on, within=r, refine=close)
