import struct

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import filters
from loamgrid.operators.validation import Params
from loamgrid.sources import config, fixtures, vector
from loamgrid.streaming.partition_feed import feed

SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]  # clockwise: an exterior in a shapefile
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]


@pytest.mark.parametrize(("kind", "parts"), [("point", [[[(1.0, 2.0)]]]), ("line", [[[(0.0, 0.0), (1.0, 1.0)]]]), ("line", [[[(0.0, 0.0), (1.0, 1.0)]], [[(5.0, 0.0), (1.0, 1.0)]]]), ("polygon", [[SQUARE, HOLE]]), ("polygon", [[SQUARE], [HOLE]])])
def test_wkb_round_trip(kind, parts):
    data = vector.write_wkb(kind, parts)
    assert vector.read_wkb(data) == (kind, parts, len(data))


def shapefile(records):
    """A polygon shapefile's bytes from lists of rings; None is a null shape."""
    out = bytes(100)
    for i, rings in enumerate(records, 1):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            flat, starts = [v for r in rings for xy in r for v in xy], [sum(map(len, rings[:k])) for k in range(len(rings))]
            body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(flat) // 2) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)
        out += struct.pack(">2I", i, len(body) // 2) + body
    return out


def dbf(names, rows):
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([12]) + bytes(15) for n in names)
    head = 32 + len(fields) + 1
    body = b"".join(b" " + b"".join(v.encode().ljust(12) for v in r) for r in rows)
    return bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(rows), head, 1 + 12 * len(names)) + bytes(20) + fields + b"\r" + body


def test_shapefile(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shapefile([[SQUARE, HOLE], None, [SQUARE, [(x + 50, y) for x, y in SQUARE]]]))
    (tmp_path / "a.dbf").write_bytes(dbf(["FKT", "oid"], [("31001_1000", "x"), ("NULL", ""), ("0", "ü")]))
    rows = vector.read_layer(spark, str(tmp_path / "a.shp")).orderBy("fid").collect()
    assert [(r.fid, r.kind, [len(p) for p in r.parts], r.attributes["FKT"]) for r in rows] == [(1, "polygon", [2], "31001_1000"), (2, "null", [], None), (3, "polygon", [1, 1], "0")]
    flat = vector.attribute_layer(vector.read_layer(spark, str(tmp_path / "a.shp")), "fkt").orderBy("fid").collect()
    assert (flat[0].fkt, flat[0].xmax, flat[1].xmin) == ("31001_1000", 10.0, None)
    with pytest.raises(ValueError):
        vector.read_layer(spark, "x.tif")


def test_geopackage(spark, sf, tmp_path):
    blocks = fixtures.blocks(spark, sf).where("block_id < 5").select("block_id", F.array("geom").alias("parts"))
    path = str(tmp_path / "out.gpkg")
    assert vector.write_gpkg(blocks, path, "blocks") == 5
    got = vector.attribute_layer(vector.read_layer(spark, path, "blocks"), "block_id").collect()
    assert sorted(r.block_id for r in got) == ["0", "1", "2", "3", "4"] and all(r.xmax - r.xmin == 200 for r in got)
    assert len(vector.checksum(spark, path)) == 32


def test_split_by_attribute(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "name string, n int")
    vector.split_by_attribute(df, "name", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "name=a")).count() == 2


def test_config(tmp_path):
    p = Params(min_area=60.0, min_bdg_count=7)
    config.save(p, str(tmp_path / "c.ini"))
    assert config.load(str(tmp_path / "c.ini")) == p and config.load(str(tmp_path / "none.ini")) == Params()


def test_stream_of_partitions(spark, sf, tmp_path):
    layers = {"partitions": fixtures.partitions(spark, sf), "buildings": fixtures.buildings(spark, sf), "roads": fixtures.roads(spark, sf), "barriers": fixtures.barriers(spark, sf)}
    layers["partitions"].where("pid = 1").write.parquet(str(tmp_path / "in"))
    codes = filters.filter_codes(filters.text_lines(spark, fixtures.FILTER_TEXT))
    feed(spark, str(tmp_path / "in"), layers, codes, str(tmp_path / "out"), str(tmp_path / "check"), Params(min_patch_size=100, min_bdg_count=1)).awaitTermination()
    assert {r.pid for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}
