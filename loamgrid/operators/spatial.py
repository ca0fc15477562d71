"""Spatial joins as equi-joins on grid cells.

Each side's boxes are dealt to the cells of a grid that they touch; rows meet in cells by an equi-join, so Catalyst plans a hash or
sort-merge join (and splits skewed cells) instead of a nested loop. A pair that meets in several cells is kept only in the cell of its
boxes' common lower left corner, so no distinct is needed. Boxes are closed: touching counts.

Layers carry xmin, ymin, xmax, ymax. `refine` is an exact test on the pair's columns; without it the boxes decide, which is exact for
axis-aligned rectangles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.geometry import nearest_on_segment
from loamgrid.runtime import cut_lineage

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_cells(df: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """A row for each grid cell that a row's box (grown by `grow`) touches: cx, cy. Rows without a box are in no cell."""

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(low) - grow) / size), F.floor((F.col(high) + grow) / size)))

    return df.where(F.col("xmin").isNotNull() & F.col("ymin").isNotNull()).withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))


def pairs(left: DataFrame, right: DataFrame, size: float, on: tuple[str, ...] = (), refine: Callable[[], Column] | None = None, within: float = 0.0) -> DataFrame:
    """Pairs whose boxes come within `within` of each other (0: touch). Columns are prefixed l_ and r_.

    on: columns (a partition, say) that must also be equal. size should be about twice the right side's usual extent.
    """
    a = with_cells(left, size, within)
    b = with_cells(right, size)
    a = a.select(*(F.col(c).alias("l_" + c) for c in left.columns), *(F.col(c).alias("k_" + c) for c in on), "cx", "cy")
    b = b.select(*(F.col(c).alias("r_" + c) for c in right.columns), *(F.col(c).alias("k_" + c) for c in on), "cx", "cy")
    met = a.join(b, [*("k_" + c for c in on), "cx", "cy"])
    near = (F.col("l_xmin") - within <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax") + within) & (F.col("l_ymin") - within <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax") + within)
    here = (F.floor(F.greatest(F.col("l_xmin") - within, F.col("r_xmin")) / size) == F.col("cx")) & (F.floor(F.greatest(F.col("l_ymin") - within, F.col("r_ymin")) / size) == F.col("cy"))
    met = met.where(near & here).drop("cx", "cy", *("k_" + c for c in on))
    return met.where(refine()) if refine else met


def semi(left: DataFrame, right: DataFrame, key: list[str], size: float, **how) -> DataFrame:
    """Rows of left that meet a row of right. key names left's rows."""
    hits = pairs(left, right, size, **how).select(*(F.col("l_" + k).alias(k) for k in key)).distinct()
    return left.join(hits, key, "left_semi")


def anti(left: DataFrame, right: DataFrame, key: list[str], size: float, **how) -> DataFrame:
    """Rows of left that meet no row of right."""
    hits = pairs(left, right, size, **how).select(*(F.col("l_" + k).alias(k) for k in key)).distinct()
    return left.join(hits, key, "left_anti")


def summary(left: DataFrame, right: DataFrame, key: list[str], aggregates: list[Column], size: float, discard: bool = False, **how) -> DataFrame:
    """left's rows with aggregates over the right rows (columns r_...) that they meet; rows that meet none only if not discard."""
    found = pairs(left, right, size, **how).groupBy(*(F.col("l_" + k).alias(k) for k in key)).agg(*aggregates)
    return left.join(found, key, "inner" if discard else "left")


def nearest(points: DataFrame, segments: DataFrame, key: list[str], order: str, size: float, most: float | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """For each point (columns x, y, and a box) the nearest segment (x1, y1, x2, y2); ties go to the smallest `order`.

    Columns: key, distance, fx, fy (the nearest point) and the segment's `order`. With `most` only segments within that distance
    count. Without, the reach doubles for the points that have found none, until it is the size of the layers; only points without any
    segment (of equal `on`) are left out.
    """
    if most is not None:
        return _nearest_within(points, segments, key, order, size, most, on)
    out, left, reach = None, points, size / 2
    span = lambda df: df.agg(F.min("xmin").alias("a"), F.min("ymin").alias("b"), F.max("xmax").alias("c"), F.max("ymax").alias("d"))
    a, b, c, d = span(points.select("xmin", "ymin", "xmax", "ymax").union(segments.select("xmin", "ymin", "xmax", "ymax"))).first()
    whole = 0.0 if a is None else ((c - a) ** 2 + (d - b) ** 2) ** 0.5
    while True:
        found = cut_lineage(_nearest_within(left, segments, key, order, max(size, reach), reach, on))
        out = found if out is None else out.union(found)
        left = cut_lineage(left.join(found.select(*key), key, "left_anti"))
        if reach >= whole or left.isEmpty():
            return out
        reach *= 2


def _nearest_within(points: DataFrame, segments: DataFrame, key: list[str], order: str, size: float, most: float, on: tuple[str, ...]) -> DataFrame:
    met = pairs(points, segments, size, on=on, within=most)
    foot = nearest_on_segment("l_x", "l_y", "r_x1", "r_y1", "r_x2", "r_y2")
    best = met.withColumn("_f", foot).where(F.col("_f.distance") <= most).groupBy(*("l_" + k for k in key)).agg(F.min(F.struct(F.col("_f.distance").alias("distance"), F.col("r_" + order).alias(order), F.col("_f.x").alias("fx"), F.col("_f.y").alias("fy"))).alias("m"))
    return best.select(*(F.col("l_" + k).alias(k) for k in key), "m.distance", "m.fx", "m.fy", "m." + order)
