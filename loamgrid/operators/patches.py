"""Layers as wholes: parts, merges, touching groups, building filter, patches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.geometry import point, polygon_area, segments
from loamgrid.kernel.columns import centroid, intersects
from loamgrid.operators.components import connected_components
from loamgrid.operators.density import area, building_counts, dense_blocks, kernel_density, zone_buildings
from loamgrid.operators.filters import like_any
from loamgrid.operators.spatial import BOX, anti, pairs, semi
from loamgrid.runtime import cut_lineage


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Union of all rows by name; columns that a layer lacks are null, and nothing is deduplicated."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def single_parts(df: DataFrame, parts: str = "parts", geom: str = "geom") -> DataFrame:
    """A row for each part of a multi-geometry: part_no (from 0), geom; attributes are copied."""
    keep = [c for c in df.columns if c not in (parts, geom, "part_no")]
    return df.select(*keep, F.posexplode(parts).alias("part_no", geom))


def _corners(layer: DataFrame, key: str, on, exact: bool) -> DataFrame:
    """layer with _of: of a row whose box lies in a full rectangle of the same lower left corner that rectangle's key, else its own."""
    corner = [*on, "xmin", "ymin"]
    full = (polygon_area("geom") == (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))) & (F.size("geom") == 1) if exact else F.lit(True)
    reach = F.struct("xmax", "ymax", F.col(key).alias("key"))
    heads = layer.groupBy(*corner).agg(F.max(F.when(full, reach)).alias("_head"), F.count("*").alias("_n")).where("_n > 1 AND _head IS NOT NULL").drop("_n")
    within = (F.col("xmax") <= F.col("_head.xmax")) & (F.col("ymax") <= F.col("_head.ymax"))
    marked = layer.join(heads, corner, "left").withColumn("_of", F.when(F.coalesce(within, F.lit(False)), F.col("_head.key")).otherwise(F.col(key)))
    return marked.select(*layer.columns, "_of")


def outermost(layer: DataFrame, key: str = "fid", on=("pid",)) -> DataFrame:
    """The rows that planar.outermost() keeps: for steps that only ask which points a layer covers."""
    return _corners(layer, key, on, True).where(F.col("_of") == F.col(key)).drop("_of")


def touching_groups(layer: DataFrame, key: str = "fid", on=("pid",), size: float = 50.0, refine: Callable[[], Column] | None = None) -> DataFrame:
    """layer with group_id, the smallest key among all that touch each other directly or through others.

    Rows whose box lies in a full rectangle of the same lower left corner touch it, and whatever touches them touches it: they take its
    group and make no pairs, so that buildings on top of each other cost no more than one.
    """
    marked = cut_lineage(_corners(layer, key, on, refine is not None))  # read several times from here on
    alone = marked.where(F.col("_of") == F.col(key)).select(key, *on, *BOX, *(["geom"] if refine else []))
    met = pairs(alone, alone, size, on=on, refine=refine).where(F.col("l_" + key) < F.col("r_" + key))
    groups = connected_components(met.select(F.col("l_" + key).alias("a"), F.col("r_" + key).alias("b")))
    least = marked.groupBy("_of").agg(F.min(key).alias("_least")).join(groups.select(F.col("node").alias("_of"), F.col("component").alias("_group")), "_of", "left")
    least = least.select("_of", F.coalesce("_group", "_of").alias("_group"), "_least")
    named = least.join(least.groupBy("_group").agg(F.min("_least").alias("group_id")), "_group").select("_of", "group_id")
    return marked.join(named, "_of").drop("_of")


def residential_filter(buildings: DataFrame, codes: DataFrame, min_area: float = 57.0, single_area: float = 35.0, cell: float = 50.0, radius: float = 200.0, on=("pid",), touch_on=None) -> DataFrame:
    """Buildings that pass the import filter, with group_id. Where there are geometries, they decide what touches; else boxes do.

    Per partition with more than min_area rows: buildings with a negative code outside the residential zone go, with every building
    that touches one; of the rest, groups of touching buildings must cover more than min_area, and a building more than single_area.
    Other partitions, and those without a positive code, pass whole. touch_on: columns that are equal where buildings can touch, if these
    are others than `on` (a storey besides the partition, say).
    """
    touch = touch_on or on
    total = buildings.groupBy(*on).agg(F.count("*").alias("_n"))
    positive = like_any(buildings, codes.where("section = 'positive'"))
    some = positive.select(*on).distinct().withColumn("_pos", F.lit(True))
    tagged = buildings.join(total, [*on]).join(some, [*on], "left")
    full = F.coalesce(F.col("_pos"), F.lit(False)) & (F.col("_n") > min_area)
    tagged = cut_lineage(tagged.withColumn("_full", full).drop("_n", "_pos"))  # read several times from here on
    work, whole = tagged.where("_full").drop("_full"), tagged.where("NOT _full").drop("_full")
    exact = (lambda: intersects("l_geom", "r_geom")) if "geom" in buildings.columns else None
    c = centroid("geom") if exact else F.struct(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    centres = cut_lineage(positive.select(*on, c.alias("c")).select(*on, "c.x", "c.y"))  # else worked out again for each cell around
    zone = zone_buildings(work, kernel_density(centres, cell, radius, on), cell=cell, on=on)
    outside = cut_lineage(like_any(work, codes.where("section = 'negative'")).join(zone.select("fid", *on), ["fid", *on], "left_anti"))
    left = cut_lineage(anti(work, outside, ["fid", *on], 50.0, on=touch, refine=exact))  # groups read their layer several times
    grouped = cut_lineage(touching_groups(area(left), on=touch, refine=exact))
    big = grouped.groupBy("group_id").agg(F.sum("area").alias("_sum")).where(F.col("_sum") > min_area).select("group_id")
    kept = grouped.join(big, "group_id", "left_semi").where(F.col("area") > single_area).drop("group_id", "area")
    return touching_groups(cut_lineage(merge_layers(kept, whole)), on=touch, refine=exact)


def distinct_geometries(layer: DataFrame, key: str = "fid", on=("pid",)) -> DataFrame:
    """Of rows with equal geometries the one with the smallest key: the same rings, whatever vertex they begin at and way round they
    run. Null geometries stay."""
    ends = lambda e: (point(e["x1"], e["y1"]), point(e["x2"], e["y2"]))
    edges = F.flatten(F.transform("geom", lambda r: F.transform(segments(r), lambda e: F.struct(F.least(*ends(e)).alias("a"), F.greatest(*ends(e)).alias("b")))))
    marked = layer.withColumn("_form", F.when(F.col("geom").isNotNull(), F.sha2(F.to_json(F.struct(F.sort_array(edges).alias("e"))), 256)))
    first = marked.where("_form IS NOT NULL").groupBy(*on, "_form").agg(F.min(key).alias(key)).drop("_form")
    return marked.where("_form IS NULL").drop("_form").unionByName(layer.join(first, [*on, key], "left_semi"))


def patch_remove(patches: DataFrame, buildings: DataFrame, key: str = "patch_id", min_patch: float = 10_000.0, min_buildings: int = 20, footprint_sum: float = 6_000.0, density: float = 18.0, on=("pid",), refine=None) -> DataFrame:
    """Patches larger than min_patch with more than min_buildings, then those dense enough with a size of min_patch or a footprint sum
    of footprint_sum; a patch that is both appears twice, as in the original method. Adds area, join_count."""
    p = area(patches)
    counted = building_counts(p, buildings, [key, *on] if key not in on else list(on), on, refine).withColumnRenamed("building_count", "join_count")
    large = counted.where((F.col("area") > min_patch) & (F.col("join_count") > min_buildings))
    dense = dense_blocks(counted.withColumn("shape_area", F.col("area")), buildings, density, [key, *on] if key not in on else list(on), on, refine)
    dense = dense.where((F.col("shape_area") >= min_patch) | (F.col("footprint_area_sum") >= footprint_sum)).drop("shape_area", "footprint_area_sum", "overlap")
    return merge_layers(large.withColumn("kept_as", F.lit("large")), dense.withColumn("kept_as", F.lit("dense")))


def touching(layer: DataFrame, other: DataFrame, key: list[str], size: float, on=("pid",)) -> DataFrame:
    return semi(layer, other, key, size, on=on)
