"""Vector files as layers: shapefiles and GeoPackages in, GeoPackages and Parquet out.

Files are read by Spark's binaryFile source, so that any file system works, and parsed on the executors, one file a row; for large
layers keep Parquet and read that. A layer's rows are fid, attributes (by name, as text), kind (point, line, polygon) and parts: for
polygons each a list of closed rings, for lines and points each a list of one path.
"""

from __future__ import annotations

import hashlib
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PARTS = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
LAYER = T.StructType([T.StructField("file", T.StringType()), T.StructField("fid", T.LongType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("kind", T.StringType()), T.StructField("parts", PARTS)])
Path = list[tuple[float, float]]


# --- well-known binary -------------------------------------------------------------------------------------------------------


def read_wkb(data: bytes, at: int = 0) -> tuple[str, list[list[Path]], int]:
    """kind, parts and where the geometry ends. Heights and measures are left out."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    kind, wide = code % 1000, 2 + (1 if code // 1000 % 10 in (1, 2) else 2 if code // 1000 % 10 == 3 else 0)
    at += 5

    def points(n: int, at: int) -> tuple[Path, int]:
        v = struct.unpack_from(f"{order}{n * wide}d", data, at)
        return [(v[i * wide], v[i * wide + 1]) for i in range(n)], at + 8 * n * wide

    if kind == 1:
        p, at = points(1, at)
        return "point", [[p]], at
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 2:
        p, at = points(n, at)
        return "line", [[p]], at
    if kind == 3:
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", data, at)
            p, at = points(m, at + 4)
            rings.append(p)
        return "polygon", [rings], at
    if kind in (4, 5, 6, 7):
        name, parts = {4: "point", 5: "line", 6: "polygon"}.get(kind, "point"), []
        for _ in range(n):
            name, one, at = read_wkb(data, at)
            parts += one
        return name, parts, at
    raise ValueError(f"geometry type {code} isn't supported")


def write_wkb(kind: str, parts: list[list[Path]]) -> bytes:
    """Little-endian well-known binary; several parts make a multi-geometry."""
    path = lambda p: struct.pack(f"<I{2 * len(p)}d", len(p), *(v for xy in p for v in xy))
    one = {
        "point": lambda p: struct.pack("<BI2d", 1, 1, *p[0][0]),
        "line": lambda p: struct.pack("<BI", 1, 2) + path(p[0]),
        "polygon": lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(map(path, p)),
    }[kind]
    code = {"point": 4, "line": 5, "polygon": 6}[kind]
    return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, code, len(parts)) + b"".join(map(one, parts))


# --- shapefiles --------------------------------------------------------------------------------------------------------------


def _signed(ring: Path) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _inside(p: tuple[float, float], ring: Path) -> bool:
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:])) % 2 == 1


def read_shp(data: bytes) -> Iterator[tuple[str, list[list[Path]]]]:
    """kind and parts of each record; null shapes have no part. Clockwise rings are exteriors, the others holes of the one around them."""
    at = 100
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at + 4)
        (code,) = struct.unpack_from("<i", data, at + 8)
        body, kind = at + 12, code % 10
        if kind == 1:
            yield "point", [[[struct.unpack_from("<2d", data, body)]]]
        elif kind in (3, 5):
            n, m = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{n}i", data, body + 40), m]
            v = struct.unpack_from(f"<{2 * m}d", data, body + 40 + 4 * n)
            paths = [[(v[2 * i], v[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
            if kind == 3:
                yield "line", [[p] for p in paths]
            else:
                outer = [[p] for p in paths if _signed(p) <= 0] or [[p] for p in paths[:1]]
                for hole in (p for p in paths if _signed(p) > 0 and [p] not in outer):
                    next((o for o in outer if _inside(hole[0], o[0])), outer[0]).append(hole)
                yield "polygon", outer
        else:
            yield "null", []
        at += 8 + 2 * size


def read_dbf(data: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """Attribute rows as text; deleted rows count, as shapes do; empty values and the text NULL are null."""
    n, head, wide = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        at, row = head + i * wide + 1, {}
        for name, size in fields:
            text = data[at : at + size].decode(encoding, "replace").strip(" \0")
            row[name] = None if text in ("", "NULL") else text
            at += size
        rows.append(row)
    return rows


# --- GeoPackages -------------------------------------------------------------------------------------------------------------


def read_gpkg(data: bytes, layer: str | None = None) -> Iterator[tuple[int, dict, str, list[list[Path]]]]:
    """fid, attributes, kind and parts of a feature table (the first one if none is named)."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    name, column = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE ?1 IS NULL OR table_name = ?1 ORDER BY table_name", (layer,)).fetchone()
    found = db.execute(f'SELECT rowid, * FROM "{name}" ORDER BY rowid')
    names = [d[0] for d in found.description]
    for row in found:
        values = dict(zip(names[1:], row[1:], strict=True))
        blob = values.pop(column)
        text = {k: None if v is None or v == "NULL" else str(v) for k, v in values.items()}
        if blob is None:
            yield row[0], text, "null", []
        else:
            envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
            kind, parts, _ = read_wkb(blob, 8 + envelope)
            yield row[0], text, kind, parts


def write_gpkg(df: DataFrame, path: str, layer: str, kind: str = "polygon", geom: str = "parts", srs: int = 25833) -> int:
    """Writes rows to a new feature table of a GeoPackage on the driver's disk, row by row as they come; returns their number.

    A GeoPackage is one file for desktop programs: for large layers write Parquet. Columns beside `geom` become text columns.
    """
    db = sqlite3.connect(path)
    names = [c for c in df.columns if c != geom]
    with db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        db.execute(f'DROP TABLE IF EXISTS "{layer}"')
        db.execute(f'CREATE TABLE "{layer}" (gpkg_fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{"".join(f", {chr(34)}{c}{chr(34)} TEXT" for c in names)})')
        db.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        db.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
        n = 0
        for row in df.toLocalIterator():
            parts = [[[(p["x"], p["y"]) for p in path] for path in part] for part in row[geom] or []]
            blob = b"GP\0\x01" + struct.pack("<i", srs) + write_wkb(kind, parts) if parts else None
            db.execute(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (2 + len(names)))})', (None, blob, *(None if row[c] is None else str(row[c]) for c in names)))
            n += 1
    db.close()
    return n


# --- layers ------------------------------------------------------------------------------------------------------------------


def read_layer(spark: SparkSession, path: str, layer: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """Rows of shapefiles (their .shp and .dbf side by side) or GeoPackages at a path or pattern; fid counts from 1 in a shapefile."""
    if not path.endswith((".shp", ".gpkg")):
        raise ValueError("only .shp and .gpkg files are read; Parquet needs spark.read.parquet")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if path.endswith(".shp"):
        tables = spark.read.format("binaryFile").load(path.removesuffix(".shp") + ".dbf").select("path", F.col("content").alias("table"))
        stem = F.regexp_replace("path", r"\.(shp|dbf)$", "")
        files = files.withColumn("stem", stem).join(tables.withColumn("stem", stem).drop("path"), "stem", "left").drop("stem")
    else:
        files = files.withColumn("table", F.lit(None).cast("binary"))
    dot_shp = path.endswith(".shp")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [to_arrow_type(f.dataType) for f in LAYER.fields]
        for batch in batches:
            for name, content, table in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "table")), strict=True):
                if dot_shp:
                    shapes = list(read_shp(content))
                    rows = read_dbf(table, encoding) if table is not None else [{}] * len(shapes)
                    found = ((i, a, k, p) for i, ((k, p), a) in enumerate(zip(shapes, rows, strict=True), 1))
                else:
                    found = read_gpkg(content, layer)
                out = [(name, i, list(a.items()), k, [[[{"x": x, "y": y} for x, y in path] for path in part] for part in parts]) for i, a, k, parts in found]
                for at in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + 5000], strict=True), kind, strict=True)], names=LAYER.names)

    return files.mapInArrow(parse, LAYER)


def attribute_layer(layer: DataFrame, *names: str) -> DataFrame:
    """A layer with attributes as columns (names match whatever their case, missing ones are null), geom (the first part) and its box."""
    low = F.map_from_entries(F.transform(F.map_entries("attributes"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    out = layer.withColumn("_a", low).select("fid", "parts", *(F.col("_a").getItem(n.lower()).alias(n) for n in names), F.get("parts", F.lit(0)).alias("geom"))
    ring = F.get("geom", F.lit(0))
    side = lambda k: F.transform(ring, lambda p: p[k])
    return out.withColumns({"xmin": F.array_min(side("x")), "ymin": F.array_min(side("y")), "xmax": F.array_max(side("x")), "ymax": F.array_max(side("y"))})


def split_by_attribute(df: DataFrame, name: str, path: str) -> None:
    """One Parquet folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(name).parquet(path)


def checksum(spark: SparkSession, path: str) -> str:
    """MD5 of the files at a path, in their order: the key of a kept validation result."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("m")).orderBy("path").collect()  # one short row a file
    return rows[0].m if len(rows) == 1 else hashlib.md5("".join(r.m for r in rows).encode()).hexdigest()
