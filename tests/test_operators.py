"""Edge cases that the fixture layers don't have."""

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.operators import density, edges, filters, lines, parts, patches, rules, spatial, validation
from loamgrid.operators.validation import Params
from loamgrid.plans import pipeline
from loamgrid.sources import fixtures as X

BOX = "fid long, pid long, xmin double, ymin double, xmax double, ymax double"


def boxes(spark, *rows, key="fid"):
    df = spark.createDataFrame([(i, 0, float(a), float(b), float(c), float(d)) if a is not None else (i, 0, None, None, None, None) for i, (a, b, c, d) in enumerate(rows)], BOX)
    return df.withColumn("geom", G.rect_polygon()).withColumnRenamed("fid", key)


def ids(df, key="fid"):
    return sorted(r[key] for r in df.collect())


def test_joins_count_touching_and_cross_cells(spark):
    a = boxes(spark, (0, 0, 10, 10), (500, 500, 510, 510), (None,) * 4, (-3, -3, 900, 900))
    b = boxes(spark, (10, 10, 20, 20), (1000, 0, 1001, 1))
    got = spatial.pairs(a, b, 50.0, on=("pid",)).select("l_fid", "r_fid").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (3, 0)]
    assert ids(spatial.semi(a, b, ["fid"], 50.0)) == [0, 3] and ids(spatial.anti(a, b, ["fid"], 50.0)) == [1, 2]
    assert spatial.pairs(a, b.limit(0), 50.0).count() == 0
    assert ids(spatial.semi(boxes(spark, (0, 0, 1, 1)), boxes(spark, (5, 0, 6, 1)), ["fid"], 3.0, within=4.0)) == [0]


def test_join_brute_force(spark):
    import random

    random.seed(1)
    rect = lambda: (lambda x, y: (x, y, x + random.randint(0, 60), y + random.randint(0, 60)))(random.randint(-200, 200), random.randint(-200, 200))
    a, b = [rect() for _ in range(80)], [rect() for _ in range(80)]
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    assert sorted(map(tuple, spatial.pairs(boxes(spark, *a), boxes(spark, *b), 37.0).select("l_fid", "r_fid").collect())) == want


def test_no_nested_loop_join(spark, sf):
    plan = density.dense_blocks(X.blocks(spark, sf), X.buildings(spark, sf))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_block_on_a_line_is_charged_twice(spark):
    blocks = boxes(spark, (0, 0, 200, 200), (200, 0, 400, 200), (600, 0, 800, 200), key="block_id")
    got = {r.block_id: r.footprint_area_sum for r in density.dense_blocks(blocks, boxes(spark, (150, 0, 200, 200)), 18.0).collect()}
    assert got == {0: 10_000.0, 1: 10_000.0}
    assert {r.block_id: r.overlap for r in density.footprint_density(blocks, boxes(spark, (150, 0, 250, 200))).collect()} == {0: 25.0, 1: 25.0}
    assert {r.block_id: r.building_count for r in density.building_counts(blocks, boxes(spark, (150, 0, 200, 200))).collect()} == {0: 1, 1: 1, 2: 0}


def test_geometry_columns(spark):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    ring = F.array(p(0.0, 0.0), p(10.0, 0.0), p(10.0, 10.0), p(0.0, 10.0), p(0.0, 0.0))
    hole = F.array(p(2.0, 2.0), p(2.0, 4.0), p(4.0, 4.0), p(4.0, 2.0), p(2.0, 2.0))
    r = spark.range(1).select(
        G.polygon_area(F.array(ring, hole)).alias("area"), G.polygon_area(F.lit(None).cast(G.POLYGON)).alias("none"), G.line_length(ring).alias("length"), G.ring_centroid(ring).alias("c"),
        G.delete_holes(F.array(ring, hole), 4.0).alias("kept"), G.delete_holes(F.array(ring, hole), 4.0, True).alias("closed"), G.delete_holes(F.array(ring, hole)).alias("all"),
        G.undirected_angle(F.lit(1.0), F.lit(0.0)).alias("a1"), G.undirected_angle(F.lit(-1.0), F.lit(-1.0)).alias("a2"), G.azimuth(F.lit(0.0), F.lit(-1.0)).alias("az"),
        G.project_on_line(F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("foot"),
    ).first()
    assert (r.area, r.none, r.length, (r.c.x, r.c.y)) == (96.0, None, 40.0, (5.0, 5.0))
    assert (len(r.kept), len(r.closed), len(r.all)) == (2, 1, 1)
    assert (round(r.a1, 6), round(r.a2, 6), r.az) == (180.0, 45.0, 270.0) and (r.foot.distance, r.foot.x, r.foot.y) == (3.0, 5.0, 0.0)


def test_like_filter(spark):
    df = spark.createDataFrame([(1, "31001_1000"), (2, "31001x1000"), (3, "31001_10001"), (4, None)], "fid long, funktion string")
    codes = spark.createDataFrame([("31001_1000",)], "code string")
    assert ids(filters.like_any(df, codes)) == [1, 2]  # _ stands for any character, and there is no %
    with pytest.raises(ValueError):
        filters.like_any(spark.range(1), codes)


def test_partition_lists(spark, sf):
    p = X.partitions(spark, sf)
    names = lambda *a: sorted(r.part for r in filters.partition_list(p, *a).collect())
    assert len(names(["#"])) == 25 and names(["#"], 0, 2) == ["PART_0", "PART_1"] and names(["PART_3\n", "x"]) == ["PART_3"]


def line(i, distance, angle, x1, y1, x2, y2):
    return (0, i, float(x1), float(y1), float(x2), float(y2), float(angle), float(distance))


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([line(0, 99, 0, 0, 0, 99, 0), line(1, 99, 90, 0, 0, 0, 99)], [0, 1]),  # two lines pass untouched
        ([line(0, 99, 0, 0, 0, 99, 0), line(1, 10, 90, 0, 0, 0, 10), line(2, 11, 90, 1, 0, 1, 50)], [1, 2]),  # rule 1
        ([line(0, 5, 0, 0, 0, 5, 5), line(1, 6, 90, 10, 0, 10, -6), line(2, 7, 180, 10, 10, 17, 10), line(3, 8, 270, 0, 10, 0, 18)], [1, 2, 3]),  # rule 2
        ([line(0, 5, 0, 0, 0, -5, 0), line(1, 9, 1, 0, 4, -5, 4), line(2, 7, 90, 10, 10, 10, 17)], [0, 2]),  # rule 3a
        ([line(i, 10 + i, 2 * i % 4, 0, 20 * i, -10 - i, 20 * i) for i in range(4)], [0, 1]),  # rule 3b
        ([line(0, 60, 10, 0, 0, -60, 0), line(1, 5, 100, 10, 0, 10, -5), line(2, 6, 200, 10, 10, 16, 10)], [1, 2]),  # rule 4
    ],
)
def test_line_rules(spark, rows, kept):
    from loamgrid.kernel import graph

    df = spark.createDataFrame(rows, "fid long, seq long, x1 double, y1 double, x2 double, y2 double, angle double, distance double")
    got = rules.apply_rules(rules.groups_of_four(df, ["fid"], ["seq"])).select(F.explode("lines").alias("l")).select("l.seq")
    assert ids(got, "seq") == kept
    plain = graph.keep_lines([dict(zip(("seq", "x1", "y1", "x2", "y2", "angle", "distance"), r[1:])) for r in rows])
    assert sorted(x["seq"] for x in plain) == kept


def test_angle_groups_and_dominant_angle(spark):
    rows = [(0, i, a, w) for i, (a, w) in enumerate([(0.0, 1.0), (0.0, 1.0), (5.0, 9.0), (5.0, 9.0), (40.0, 3.0)])] + [(1, 0, 30.0, 2.0)]
    df = spark.createDataFrame(rows, "fid long, edge_no long, angle double, length double")
    assert {r.fid: r.angle for r in edges.dominant_angles(df, ["fid"]).collect()} == {0: 0.0, 1: 30.0}


def test_lines_edge_cases(spark):
    df = lines.with_box(spark.createDataFrame([(1, 0, 0.0, 0.0, 25.0, 0.0), (2, 0, 7.0, 7.0, 7.0, 7.0)], "fid long, pid long, x1 double, y1 double, x2 double, y2 double"))
    got = lines.split_by_length(df, 10.0).orderBy("fid", "piece_no").collect()
    assert [(r.fid, r.piece_no, r.x1, r.x2) for r in got] == [(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 20.0, 25.0), (2, 0, 7.0, 7.0)]
    assert {(r.x, r.degree) for r in lines.node_degrees(df).collect()} == {(0.0, 1), (25.0, 1)}


def test_merge_and_parts(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,), (3,)], "x int")
    assert sorted(map(tuple, patches.merge_layers(a, b).collect()), key=str) == [(1, 2), (3, None), (3, None)]


def test_patch_counts(spark):
    big, small = (0, 0, 200, 200), (500, 500, 550, 550)
    buildings = boxes(spark, *[(15 * (i % 10), 15 * (i // 10), 15 * (i % 10) + 8, 15 * (i // 10) + 8) for i in range(25)])
    got = patches.patch_remove(boxes(spark, big, small, key="patch_id"), buildings, min_patch=5000).collect()
    assert [(r.patch_id, r.join_count, r.kept_as) for r in got] == [(0, 25, "large")]


def test_validation_parameters():
    assert Params().validate() == [] and len(Params(min_area=5, part_start=3, part_end=2).validate()) == 2
    assert Params.of({"min_area": "60", "other": 1}).min_area == 60.0
    assert validation.validate_crs({"a": "EPSG:25833", "b": "EPSG:4326"})[0][0] == "error"


def test_filter_file_faults(spark):
    text = "31001_1\n#Filter negative\nx\n"
    got = {r.check: r.n for r in validation.validate_filter_file(filters.text_lines(spark, text)).collect()}
    assert got["no positive section"] == 1 and got["entries outside sections"] == 1 and got["codes of a wrong form"] == 1 and got["negative section is empty"] == 0


def test_kernel_stage_repairs_and_retries(spark):
    calls = []

    def stage(layers):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("broken input")
        return [("x", 0, 1.0, layers["a"][0][2])]

    import numpy as np

    ring = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    assert len(parts.robust(stage)({"a": [(1, None, [ring])]})) == 1 and len(calls) == 2


def test_touching_groups_of_stacked_buildings(spark, monkeypatch):
    """Buildings on top of each other make no pairs, whatever geometry they have, and take part in groups as all others."""
    stack = [(x, 0, x + s, s) for x in (0, 20, 60) for s in (20, *range(1, 20), 20)]
    diamond = (100, 0, 110, 10), (100, 0, 104, 4), (98, 7, 102, 12)  # the small square lies in the diamond's box, and meets the third only
    df = boxes(spark, *stack, *diamond, (100, 1, 101, 9)).withColumn("geom", G.rect_polygon())
    points = F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((105, 0), (110, 5), (105, 10), (100, 5), (105, 0))))
    first = len(stack)
    df = df.withColumn("geom", F.when(F.col("fid") == first, F.array(points)).otherwise(F.col("geom")))
    df = df.withColumn("fid", 500 - F.col("fid"))
    seen, components = [], patches.connected_components
    monkeypatch.setattr(patches, "connected_components", lambda e: seen.append(e.count()) or components(e))
    from loamgrid.kernel.columns import intersects

    got = {500 - r.fid: 500 - r.group_id for r in patches.touching_groups(df, on=(), refine=lambda: intersects("l_geom", "r_geom")).collect()}
    n = len(stack) // 3
    assert seen[0] < 10
    assert [got[i] for i in range(first)] == [2 * n - 1] * 2 * n + [first - 1] * n
    assert [got[first + i] for i in range(4)] == [first + 3, first + 3, first + 3, first + 3]
    plain = {500 - r.fid: 500 - r.group_id for r in patches.touching_groups(df.drop("geom"), on=()).collect()}
    assert [plain[i] for i in range(first)] == [got[i] for i in range(first)]
    assert sorted(500 - i for i in ids(patches.outermost(df))) == [0, n, 2 * n, *range(first, first + 4)]  # of equal ones that of the largest key; pid is 0 for all


def test_inner_density_is_worked_out_once(spark, sf, monkeypatch):
    seen, inner = [], pipeline._inner_density
    monkeypatch.setattr(pipeline, "_inner_density", lambda *a: seen.append(1) or inner(*a))
    monkeypatch.setattr(parts, "settlement", lambda *_: lambda layers: [])
    pipeline.delineate(small_layers(spark, sf), filters.filter_codes(filters.text_lines(spark, X.FILTER_TEXT)), Params())
    assert len(seen) == 1


def small_layers(spark, sf):
    """Two partitions of the fixture."""
    two = lambda df: df.where("pid < 2")
    return {"partitions": two(X.partitions(spark, sf)), "buildings": two(X.buildings(spark, sf)), "roads": two(X.roads(spark, sf)), "barriers": two(X.barriers(spark, sf))}


def test_delineation_and_resuming(spark, sf, tmp_path):
    codes = filters.filter_codes(filters.text_lines(spark, X.FILTER_TEXT))
    layers = small_layers(spark, sf)
    params = Params(min_patch_size=100, min_bdg_count=1, min_overlap_blocks=60, global_footprint_density=18)  # no dense block, so that there are trees
    first = pipeline.run_resumable(spark, {**layers, "partitions": layers["partitions"].where("pid = 0")}, codes, str(tmp_path / "out"), params)
    n = first.count()
    assert n > 0 and {r.pid for r in first.collect()} == {0}
    both = pipeline.run_resumable(spark, layers, codes, str(tmp_path / "out"), params)
    assert both.where("pid = 0").count() == n and both.where("pid = 1").count() > 0
    assert pipeline.run_resumable(spark, layers, codes, str(tmp_path / "out"), params).count() == both.count()
    with pytest.raises(ValueError):
        pipeline.delineate(layers, codes, Params(min_area=1))
    seen = pipeline.delineate(layers, codes, params, debug=str(tmp_path / "steps"))
    assert seen.count() == both.count() and spark.read.parquet(str(tmp_path / "steps" / "004_settlement")).count() > 0


def test_stage_gets_the_right_buildings(monkeypatch):
    """Each step of a partition gets the layer that the original method gives it, at the partition's own coverage."""
    import numpy as np

    from loamgrid.kernel import stages

    box = lambda x, y, s: [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]
    seen = {}
    monkeypatch.setattr(stages, "city_blocks", lambda part, roads, shapes: seen.update(blocks=(len(roads), len(shapes))) or [box(0, 0, 100), box(100, 0, 100)])
    monkeypatch.setattr(parts, "cluster", lambda buildings, tree, ratio: seen.update(cluster=(sorted(f for f, _, _ in buildings), ratio)) or [box(110, 10, 40)])
    monkeypatch.setattr(stages, "edge_catch", lambda groups, shapes, roads, blocks: seen.update(catch=(len(shapes), len(roads))) or groups)
    monkeypatch.setattr(stages, "erode", lambda merged, shapes: seen.update(erode=(len(merged), len(shapes))) or merged)
    monkeypatch.setattr(stages, "close_gaps", lambda layer, *_: layer)
    split = [(i, None, box(*p, 20)) for i, p in enumerate([(5, 5), (30, 5), (55, 5), (5, 30), (110, 10), (140, 10), (170, 60), (130, 70)])]
    road, barrier = [np.array([(100.0, 0), (100, 100)])], [np.array([(0.0, 50), (200, 50)])]
    layers = {"part": [(0, 31.5, box(0, 0, 200))], "split": split, "buildings": split[:7], "roads": [(0, None, road)], "barriers": [(0, None, barrier)], "streets": [(0, None, road)]}
    out = list(parts.settlement(least_cover=16.0)(layers))
    assert seen["blocks"] == (2, 8)  # roads and barriers; all split buildings
    assert seen["cluster"] == ([4, 5, 6], 31.5)  # filtered buildings outside dense blocks; the partition's coverage
    assert seen["catch"] == (3, 1)  # these buildings; roads only
    assert seen["erode"][1] == 8 and len(out) == 4  # all split buildings; the dense block, the group and two large buildings outside it
    layers["buildings"] = split[:4]
    assert list(parts.settlement(least_cover=16.0)(layers)) == []  # no spanning tree


def test_split_by_roads(spark):
    from loamgrid.operators import lines

    b = boxes(spark, (0, 0, 10, 10), (20, 0, 30, 10), (100, 100, 110, 110)).withColumn("geom", G.rect_polygon()).withColumn("fkt", F.lit("x"))
    r = lines.with_box(spark.createDataFrame([(0, 4.0, -5.0, 4.0, 50.0), (0, -5.0, 6.0, 60.0, 6.0)], "pid long, x1 double, y1 double, x2 double, y2 double")).withColumn("geom", G.line(G.point("x1", "y1"), G.point("x2", "y2")))
    b = b.withColumn("pid", F.lit(0).cast("long"))
    got = pipeline.split_by_roads(b, r)
    sizes = {}
    for row in got.select("fid", "xmin", "xmax", G.polygon_area("geom").alias("a"), "fkt").collect():
        assert row.fkt == "x" and row.xmin < row.xmax
        sizes.setdefault(row.fid // pipeline.PIECES, []).append(round(row.a, 6))
    assert {k: sorted(v) for k, v in sizes.items()} == {0: [16.0, 24.0, 24.0, 36.0], 1: [40.0, 60.0], 2: [100.0]}


def test_nearest_has_no_limit(spark):
    from loamgrid.operators import lines
    from loamgrid.operators.spatial import nearest

    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 3.0), (3, 90.0, 0.0)], "id long, x double, y double").withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})
    segs = lines.with_box(spark.createDataFrame([(7, 100.0, -1.0, 100.0, 1.0), (8, 0.0, 9000.0, 1.0, 9000.0)], "sid long, x1 double, y1 double, x2 double, y2 double"))
    got = {r.id: (r.sid, round(r.distance, 3)) for r in nearest(pts, segs, ["id"], "sid", 10.0).collect()}
    assert got == {1: (7, 100.0), 2: (7, 4900.0), 3: (7, 10.0)}
    assert nearest(pts, segs.limit(0), ["id"], "sid", 10.0).count() == 0


def test_output_paths():
    assert validation.validate_output("/d/x.gpkg", "/w") == []
    assert len(validation.validate_output("x.shp", " ")) == 3 and len(validation.validate_output("", "/w")) == 1


def test_runs_without_the_text_operators(tmp_path):
    """The entry module, with the text operators and the corpus pipeline taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "loamgrid", tmp_path / "loamgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) >= 70
