"""Checks of input layers: one row for each check with its severity and how many rows fail it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.kernel.columns import invalid_reason
from loamgrid.operators.filters import NEGATIVE, POSITIVE, code_field, filter_sections

#: Patterns, least rows of a layer, most buildings a partition, columns that must be there.
CODE_PATTERN, NAME_PATTERN = r"^[0-9]{5}_[0-9]{4}", r"^PART_[0-9]+$"
LEAST_ROWS = {"buildings": 50, "roads": 30, "partitions": 1, "barriers": 10}
MOST_BUILDINGS = 10_000


def checks(layer: DataFrame, name: str, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """layer, check, severity, n: all tests in one pass; n counts the rows that fail."""
    counts = layer.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(f"c{i}") for i, (_, _, t) in enumerate(tests)))
    rows = F.array(*(F.struct(F.lit(name).alias("layer"), F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("n")) for i, (c, s, _) in enumerate(tests)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def geometry_tests(geom: str = "geom") -> list[tuple[str, str, Column]]:
    return [("geometry is null", "error", F.col(geom).isNull()), ("geometry is empty", "error", F.size(geom) == 0)]


def validate_buildings(buildings: DataFrame) -> DataFrame:
    """Null codes (also the text NULL) and codes of a wrong form; 0 stands for no code and is right."""
    code = F.col(code_field(buildings))
    none = code.isNull() | (F.trim(code) == "") | (F.upper(code) == "NULL")
    ring = F.get("geom", F.lit(0))
    return checks(
        buildings,
        "buildings",
        [*geometry_tests(), ("code is null", "error", none), ("code has a wrong form", "warning", ~none & (code != "0") & ~code.rlike(CODE_PATTERN)), ("ring isn't closed", "warning", (F.size(ring) < 4) | (F.get(ring, F.lit(0)) != F.get(ring, F.size(ring) - 1)))],
    )


def validate_partitions(partitions: DataFrame) -> DataFrame:
    name = F.col("part")
    return checks(partitions, "partitions", [*geometry_tests(), ("name is null", "error", name.isNull() | (name == "")), ("name has a wrong form", "error", name.isNotNull() & ~name.rlike(NAME_PATTERN))])


def validate_lines(lines: DataFrame, name: str) -> DataFrame:
    return checks(lines, name, [*geometry_tests(), ("line has several parts", "error", F.size(F.col("parts")) > 1)] if "parts" in lines.columns else geometry_tests())


def validate_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, n, least, severity: how many rows each layer has; error where there are too few."""
    out = None
    for name, df in layers.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n", F.lit(LEAST_ROWS[name]).cast("long").alias("least"))
        out = row if out is None else out.union(row)
    return out.withColumn("severity", F.when(F.col("n") < F.col("least"), "error").otherwise("ok"))


def validate_ratio(buildings: DataFrame, partitions: DataFrame) -> DataFrame:
    """n_buildings, n_partitions, severity: warning above MOST_BUILDINGS a partition."""
    both = buildings.agg(F.count("*").alias("n_buildings")).crossJoin(partitions.agg(F.count("*").alias("n_partitions")))  # one row by one row
    return both.withColumn("severity", F.when(F.col("n_buildings") > MOST_BUILDINGS * F.col("n_partitions"), "warning").otherwise("ok"))


def invalid_geometries(layer: DataFrame, key: str = "fid") -> DataFrame:
    """key, reason of each polygon that isn't valid: too few points, ring not closed, self-intersection, empty. Null geometries are
    not among them."""
    return layer.where(F.col("geom").isNotNull()).select(key, invalid_reason("geom").alias("reason")).where("reason IS NOT NULL")


def validate_geometries(layer: DataFrame, name: str, examples: int = 5, key: str = "fid") -> DataFrame:
    """layer, check, severity, n, examples (at most so many ids, the smallest): a row for null geometries and for each reason."""
    said = layer.select(key, F.when(F.col("geom").isNull(), "geometry is null").otherwise(invalid_reason("geom")).alias("check")).where("check IS NOT NULL")
    ranked = said.withColumn("_n", F.row_number().over(Window.partitionBy("check").orderBy(key)))
    found = ranked.groupBy("check").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_n") <= examples, F.col(key)))).alias("examples"))
    return found.select(F.lit(name).alias("layer"), "check", F.lit("error").alias("severity"), "n", "examples")


#: Kinds of geometry that the input layers must have.
KINDS = {"buildings": "Polygon", "partitions": "Polygon", "roads": "Line", "barriers": "Line"}


def validate_types(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, found, wanted, severity: the kind of geometry of each layer, by the type of its column geom."""
    spark = next(iter(layers.values())).sparkSession

    def kind(df: DataFrame) -> str:
        t, depth = df.schema["geom"].dataType, 0
        while isinstance(t, T.ArrayType):
            t, depth = t.elementType, depth + 1
        return ("Point", "Line", "Polygon", "MultiPolygon")[depth]

    rows = [(n, kind(df), KINDS[n]) for n, df in layers.items()]
    return spark.createDataFrame([(*r, "ok" if r[1] == r[2] else "error") for r in rows], "layer string, found string, wanted string, severity string")


def validate_output(output: str, workspace: str) -> list[tuple[str, str]]:
    """(severity, message): the output must be a .gpkg file in a directory, and there must be a workspace."""
    out = []
    if not (output or "").strip():
        out.append(("error", "no output file"))
    else:
        if not output.lower().endswith(".gpkg"):
            out.append(("error", f"the output file must be a .gpkg: {output}"))
        if not output.rpartition("/")[0]:
            out.append(("error", f"the output file must have a directory: {output}"))
    return out + ([] if (workspace or "").strip() else [("error", "no workspace directory")])


def validate_crs(crs: dict[str, str], geographic: tuple[str, ...] = ("EPSG:4326", "EPSG:4258")) -> list[tuple[str, str]]:
    """(severity, message): all layers must have one coordinate system; a geographic one is a warning."""
    out = []
    if len(set(crs.values())) > 1:
        out.append(("error", f"layers differ in their coordinate systems: {crs}"))
    return out + [("warning", f"{n} has a geographic coordinate system") for n, c in crs.items() if c in geographic]


def validate_filter_file(lines: DataFrame) -> DataFrame:
    """check, severity, n: headers, their order, empty sections, entries before a section, codes of a wrong form."""
    head = lines.agg(
        F.min(F.when(F.startswith(F.trim("line"), F.lit(POSITIVE)), F.col("line_no"))).alias("p"),
        F.min(F.when(F.startswith(F.trim("line"), F.lit(NEGATIVE)), F.col("line_no"))).alias("q"),
    )
    e = filter_sections(lines).agg(
        F.count_if(F.col("section") == "positive").alias("np"),
        F.count_if(F.col("section") == "negative").alias("nq"),
        F.count_if(F.col("section").isNull()).alias("orphans"),
        F.count_if(F.col("section").isNotNull() & ~F.col("entry").rlike(CODE_PATTERN)).alias("odd"),
    )
    one = head.crossJoin(e)  # one row by one row
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    tests = [
        ("no positive section", "error", flag(F.col("p").isNull())),
        ("no negative section", "error", flag(F.col("q").isNull())),
        ("sections in wrong order", "error", flag(F.col("p") > F.col("q"))),
        ("positive section is empty", "error", flag(F.col("p").isNotNull() & (F.col("np") == 0))),
        ("negative section is empty", "error", flag(F.col("q").isNotNull() & (F.col("nq") == 0))),
        ("entries outside sections", "warning", F.col("orphans")),
        ("codes of a wrong form", "warning", F.col("odd")),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), n.alias("n")) for c, s, n in tests))).alias("r")).select("r.*")


@dataclass(frozen=True)
class Params:
    """Parameters of a run with their defaults; validate() names those out of range."""

    min_overlap_blocks: float = 18.0
    global_footprint_density: float = 0.0
    min_area: float = 57.0
    min_bdg_count: int = 20
    min_patch_size: float = 10_000.0
    max_hole_size: float = 10_000.0
    max_gap_size: float = 4_900.0
    part_start: int = -1
    part_end: int = -1
    crs: str = "EPSG:25833"

    def validate(self) -> list[tuple[str, str]]:
        ranges = {"min_overlap_blocks": (0, 100), "global_footprint_density": (0, 100), "min_area": (10, 500), "min_bdg_count": (1, 100), "min_patch_size": (100, 100_000), "max_hole_size": (0, 100_000), "max_gap_size": (0, 100_000)}
        out = [("error", f"{n} must lie in {a}..{b}") for n, (a, b) in ranges.items() if not a <= getattr(self, n) <= b]
        if self.part_start != -1 and self.part_end != -1 and self.part_start >= self.part_end:
            out.append(("error", "part_start must be less than part_end"))
        return out

    @classmethod
    def of(cls, values: dict) -> Params:
        return cls(**{f.name: type(f.default)(values[f.name]) for f in fields(cls) if f.name in values})
