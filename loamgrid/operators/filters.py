"""Filter file, code filters, partition lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.runtime import require_columns

#: Section headers, length of a code in an entry, names that the code column may have (the first that is there counts).
POSITIVE, NEGATIVE = "#Filter positive", "#Filter negative"
CODE_LENGTH = 10
CODE_FIELDS = ("fkt", "gfkzshh", "funktion")


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    """line_no (from 1) and line of a small text, such as a filter file's content."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"), 1)], "line_no long, line string")


def filter_sections(lines: DataFrame) -> DataFrame:
    """line_no, section (positive, negative, null before both), entry (the line, trimmed) of the entries of a filter file.

    A section holds until the next header; remarks (#...) and empty lines are no entries. The file is bounded by its nature, so that
    one ordered window over it is in place.
    """
    header = F.when(F.startswith(F.col("entry"), F.lit(POSITIVE)), "positive").when(F.startswith(F.col("entry"), F.lit(NEGATIVE)), "negative")
    t = lines.select("line_no", F.trim("line").alias("entry")).withColumn("header", header)
    t = t.withColumn("section", F.last("header", ignorenulls=True).over(Window.orderBy("line_no")))
    return t.where(~F.startswith(F.col("entry"), F.lit("#")) & (F.col("entry") != "")).select("line_no", "section", "entry")


def filter_codes(lines: DataFrame) -> DataFrame:
    """section, code: entries cut to the length of a code; entries outside both sections don't count."""
    return filter_sections(lines).where("section is not null").select("section", F.left("entry", F.lit(CODE_LENGTH)).alias("code")).distinct()


def code_field(layer: DataFrame) -> str:
    for name in CODE_FIELDS:
        if name in {c.lower() for c in layer.columns}:
            return name
    raise ValueError(f"none of the columns {', '.join(CODE_FIELDS)}")


def like_any(layer: DataFrame, codes: DataFrame, field: str | None = None) -> DataFrame:
    """Rows whose code is LIKE one of the codes: _ stands for any one character, there is no %, and null never matches."""
    field = field or code_field(layer)
    return layer.join(F.broadcast(codes.select(F.col("code").alias("_code")).distinct()), F.expr(f"{field} LIKE _code"), "left_semi")  # codes of one file


def partition_list(partitions: DataFrame, names: list[str], start: int = -1, end: int = -1, order: str = "pid") -> DataFrame:
    """Names of partitions to run: all (first name begins with #), a slice [start, end) of all in their order, or those named."""
    require_columns(partitions, "part", order)
    if not names or not names[0].startswith("#"):
        wanted = [n.replace("\n", "") for n in names]
        return partitions.where(F.col("part").isin(wanted)).select("part")
    if start == -1 or end == -1:
        return partitions.select("part")
    numbered = partitions.withColumn("_n", F.row_number().over(Window.orderBy(order)) - 1)  # a list of partitions is short
    return numbered.where((F.col("_n") >= start) & (F.col("_n") < end)).select("part")
