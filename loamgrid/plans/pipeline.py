"""The delineation from input layers to settlement patches, all partitions at once, and its resumable form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.kernel.columns import intersects, split_by_lines
from loamgrid.operators import density, lines, parts, patches
from loamgrid.operators.spatial import pairs
from loamgrid.operators.validation import Params
from loamgrid.runtime import cut_lineage, snapshot

LEAST_BUILDINGS = 10


def assign(layer: DataFrame, partitions: DataFrame, size: float = 3200.0) -> DataFrame:
    """A layer's rows with the pid and part of each partition that they touch: a row on a border comes once for each."""
    hit = pairs(layer.drop("pid", "part"), partitions.select("pid", "part", "xmin", "ymin", "xmax", "ymax"), size)
    keep = [c for c in layer.columns if c not in ("pid", "part")]
    return hit.select(*(F.col("l_" + c).alias(c) for c in keep), F.col("r_pid").alias("pid"), F.col("r_part").alias("part"))


def _inner_density(buildings: DataFrame, roads: DataFrame, least: int) -> DataFrame:
    return parts.run([parts.tag(buildings, "buildings"), parts.tag(roads, "roads", line=True)], parts.block_density(least))


def _local(found: DataFrame, buildings: DataFrame, threshold: float) -> DataFrame:
    mean = density.mean_density(found.withColumnRenamed("value", "overlap"), ["pid"], threshold)
    every = buildings.select("pid").distinct()
    return every.join(mean, "pid", "left").select("pid", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("density", F.lit(threshold)).alias("density"))


def _global(found: DataFrame, threshold: float) -> DataFrame:
    out = found.agg(F.count("*").alias("n_blocks"), F.avg("value").alias("_m"))
    return out.select("n_blocks", F.when(F.col("n_blocks") > 5, F.col("_m")).otherwise(threshold).alias("density"))


def local_density(buildings: DataFrame, roads: DataFrame, threshold: float = 18.0, least: int = 20) -> DataFrame:
    """pid, n_blocks, density: mean clipped density of inner blocks with more than `least` buildings; the threshold for five or fewer."""
    return _local(_inner_density(buildings, roads, least), buildings, threshold)


def global_density(buildings: DataFrame, roads: DataFrame, threshold: float = 18.0, least: int = 20) -> DataFrame:
    """n_blocks, density: as local_density(), over the blocks of all partitions together (one row)."""
    return _global(_inner_density(buildings, roads, least), threshold)


def overall_density(layers: dict[str, DataFrame], params: Params) -> float:
    """The coverage that stands in for partitions of few inner blocks: the parameter, or if that is 0 the one of all partitions."""
    if params.global_footprint_density:
        return params.global_footprint_density
    buildings, roads = (assign(layers[x], layers["partitions"]) for x in ("buildings", "roads"))
    return global_density(buildings, roads, 0.0, params.min_bdg_count).first().density


#: Numbers of pieces that a building's id leaves room for.
PIECES = 4096


def split_by_roads(buildings: DataFrame, roads: DataFrame, size: float = 200.0) -> DataFrame:
    """buildings cut where roads cross them: every piece has its building's columns, its own box, and as fid the building's times
    PIECES and its number from the west. Only buildings whose box a road's box touches go through the kernel."""
    b = buildings.drop("area")
    met = pairs(b.select("pid", "fid", "xmin", "ymin", "xmax", "ymax"), roads.select("pid", "geom", "xmin", "ymin", "xmax", "ymax"), size, on=("pid",))
    cuts = met.groupBy(F.col("l_pid").alias("pid"), F.col("l_fid").alias("fid")).agg(F.collect_list("r_geom").alias("_cuts"))
    both = b.join(cuts, ["pid", "fid"], "left")
    rest = [c for c in b.columns if c not in ("fid", "geom")]
    whole = both.where("_cuts IS NULL").select((F.col("fid") * PIECES).alias("fid"), *rest, "geom")
    cut = both.where("_cuts IS NOT NULL").select("fid", *rest, F.posexplode(split_by_lines("geom", "_cuts")).alias("_no", "geom"))
    return whole.unionByName(with_box(cut.withColumn("fid", F.col("fid") * PIECES + F.col("_no")).drop("_no")))


def delineate(layers: dict[str, DataFrame], codes: DataFrame, params: Params | None = None, finished: DataFrame | None = None, debug: str | None = None, overall: float | None = None) -> DataFrame:
    """pid, patch_id, area, join_count, kept_as, geom: the patches of all partitions.

    layers: partitions, buildings, roads, barriers. finished: (pid) of partitions that are done and are left out. Partitions with
    fewer than ten buildings give nothing, nor do those without a spanning tree. A patch that is large and dense comes twice, as in the
    original method. debug: a folder for snapshots of the steps, which change no result. overall: what overall_density() gives.

    Four layers of buildings take part: all of them (coverage of the partition, at which buildings are clustered), all after roads
    have cut them (blocks, erosion, patches), of these the filtered ones (dense blocks), and of these those outside dense blocks
    (spanning tree, clusters, edges drawn out to roads).
    """
    params = params or Params()
    wrong = [m for s, m in params.validate() if s == "error"]
    if wrong:
        raise ValueError("; ".join(wrong))
    every = layers["partitions"]
    partitions = every if finished is None else every.join(finished.select("pid").distinct(), "pid", "left_anti")
    overall = params.global_footprint_density or None if overall is None else overall
    around = every if overall is None else partitions  # the coverage of all partitions takes them all
    buildings, roads = (cut_lineage(assign(layers[x], around)) for x in ("buildings", "roads"))
    inner = cut_lineage(_inner_density(buildings, roads, params.min_bdg_count).drop("geom"))
    overall = _global(inner, 0.0).first().density if overall is None else overall
    if around is not partitions:
        buildings = buildings.join(partitions.select("pid"), "pid", "left_semi")
    enough = buildings.groupBy("pid").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_BUILDINGS).select("pid")
    enough = F.broadcast(cut_lineage(enough))  # a number for each partition
    buildings, roads = (x.join(enough, "pid", "left_semi") for x in (buildings, roads))
    barriers = assign(layers["barriers"], partitions).join(enough, "pid", "left_semi")
    coverage = _local(inner, buildings, overall)
    split = snapshot(cut_lineage(split_by_roads(buildings, roads)), debug, 1, "split_buildings")
    kept = snapshot(cut_lineage(patches.residential_filter(split, codes, params.min_area)), debug, 2, "filtered_buildings")
    streets = snapshot(lines.without_dead_ends(roads), debug, 3, "streets")
    outlines = partitions.join(coverage, "pid").withColumnRenamed("density", "_coverage")
    # Of the split buildings the settlement asks the points that they cover, so that those within others needn't be sent.
    stage = parts.settlement(params.min_overlap_blocks, params.max_hole_size, params.max_gap_size)
    sent = [parts.tag(outlines, "part", "pid", "_coverage"), parts.tag(patches.outermost(split), "split"), parts.tag(kept, "buildings"), parts.tag(roads, "roads", line=True), parts.tag(barriers, "barriers", line=True), parts.tag(streets, "streets", line=True)]
    found = parts.run(sent, stage).select("pid", F.col("fid").alias("patch_id"), F.col("value").alias("area"), "geom")
    found = snapshot(with_box(cut_lineage(found)), debug, 4, "settlement")  # it is read several times from here on
    exact = lambda: intersects("l_geom", "r_geom")
    return patches.patch_remove(found, split.select("pid", "fid", "geom", "xmin", "ymin", "xmax", "ymax"), "patch_id", params.min_patch_size, params.min_bdg_count, on=("pid",), refine=exact)


def with_box(df: DataFrame) -> DataFrame:
    """Adds the box of polygons."""
    ring = F.col("geom")[0]
    side = lambda k: F.transform(ring, lambda p: p[k])
    return df.withColumns({"xmin": F.array_min(side("x")), "ymin": F.array_min(side("y")), "xmax": F.array_max(side("x")), "ymax": F.array_max(side("y"))})


def run_resumable(spark: SparkSession, layers: dict[str, DataFrame], codes: DataFrame, path: str, params: Params | None = None) -> DataFrame:
    """Runs what no earlier run has finished, writes it to the Parquet table at `path` by partition, notes the finished partitions
    beside it, and returns all results.

    A partition's folder is replaced as a whole, so that a run that stops between the two writes leaves nothing twice: the next run
    does these partitions again and puts their rows in the place of the old ones.
    """
    done_path = path.rstrip("/") + "_finished"
    done = read_or_none(spark, done_path)
    found = delineate(layers, codes, params, done)
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pid").parquet(path)
    todo = layers["partitions"].select("pid")
    (todo.join(done, "pid", "left_anti") if done is not None else todo).write.mode("append").parquet(done_path)
    return spark.read.schema(found.schema).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or none where there is no such path, whatever the file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None
