"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line with seconds for each and in total."""

from __future__ import annotations

import json
import os
import sys
import time

from loamgrid.plans import queries as plans
from loamgrid.runtime import local_session

#: Relational queries run over the whole layers; the text operators are timed too if they are there.
RELATIONAL = (
    "dense_blocks", "buildings_per_block", "footprint_density", "block_density", "buildings_outside_dense_blocks", "points_in_polygon", "nearest_road", "roads_near_buildings",
    "street_intersections", "filtered_streets", "building_edges", "dominant_angle", "ortho_line_rules", "density_grid", "residential_zone_buildings", "touching_groups", "filtered_buildings",
    "patch_remove", "street_blocks", "city_blocks", "mst_edges", "mst_clusters", "validate_buildings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16, os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    found = {n: plans.QUERIES[n] for n in RELATIONAL}
    try:
        from loamgrid.llm.queries import QUERIES as text
    except ModuleNotFoundError as gone:
        if not (gone.name or "").startswith("loamgrid.llm"):
            raise
        text = {}
    found |= text
    names = sys.argv[1:] or list(found)
    found["layer_extent"] = plans.QUERIES["layer_extent"]
    found["layer_extent"](spark, sf_dir).collect()  # starts workers and compiles
    seconds = {}
    for n in names:
        begin = time.perf_counter()
        found[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[n] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
