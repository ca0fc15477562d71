"""Filter rules for the shortest lines from a building's corners to the roads, as expressions on arrays of at most four lines.

A line is struct<x1,y1,x2,y2,angle,distance,seq>: from a corner to its foot on a road, angle 0..360.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres, degrees.
MOST, TOLERANCE, SIMILAR, CLOSE, ALL_PARALLEL, OUTLIER = 70.0, 0.001, 2.0, 5.0, 5.0, 2.0
KEEP = 2
FIELDS = ("x1", "y1", "x2", "y2", "angle", "distance", "seq")


def by_distance(lines: Column) -> Column:
    """In order of distance; of equal distances the earlier line first."""
    return F.array_sort(lines, lambda a, b: F.when(a["distance"] < b["distance"], -1).when(a["distance"] > b["distance"], 1).otherwise((a["seq"] - b["seq"]).cast("int")))


def near_enough(lines: Column) -> Column:
    """Rule 1: shorter than MOST."""
    return F.filter(lines, lambda x: x["distance"] < MOST)


def not_into_start_box(lines: Column, keep: int = KEEP) -> Column:
    """Rule 2: without lines that end inside the box of all starts, unless fewer than `keep` were left; then the shortest of them stay."""
    low = lambda k: (F.array_min(F.transform(lines, lambda x: x[k])) - TOLERANCE).alias("low_" + k)
    high = lambda k: (F.array_max(F.transform(lines, lambda x: x[k])) + TOLERANCE).alias("high_" + k)

    def split(box):
        inside = lambda x: (x["x2"] >= box["low_x1"]) & (x["x2"] <= box["high_x1"]) & (x["y2"] >= box["low_y1"]) & (x["y2"] <= box["high_y1"])
        refill = lambda out: F.concat(out, F.slice(by_distance(F.filter(lines, inside)), F.lit(1), F.greatest(F.lit(keep) - F.size(out), F.lit(0))))
        return let(F.filter(lines, lambda x: ~inside(x)), refill)

    return let(F.struct(low("x1"), low("y1"), high("x1"), high("y1")), split)


def parallel(a: Column, b: Column) -> Column:
    """Whether two directions differ by at most SIMILAR, either way round."""
    d = F.abs(a - b)
    one = F.when(d > 180, 360 - d).otherwise(d)
    other = F.abs(d - 180)
    return F.least(one, other) <= SIMILAR


def no_parallel_twins(lines: Column, keep: int = KEEP) -> Column:
    """Rule 3a: of parallel lines whose ends are close, without the longer (of equal ones the later), if at least `keep` are left."""
    close = lambda a, b: parallel(a["angle"], b["angle"]) & (F.hypot(a["x2"] - b["x2"], a["y2"] - b["y2"]) <= CLOSE)
    n = F.size(lines)

    def gone(x, i):
        after = F.exists(F.slice(lines, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: close(x, y) & (x["distance"] > y["distance"]))
        before = F.exists(F.slice(lines, F.lit(1), i), lambda y: close(y, x) & (y["distance"] <= x["distance"]))
        return after | before

    left = F.filter(lines, lambda x, i: ~gone(x, i))
    return F.when(F.size(left) >= keep, left).otherwise(lines)


def all_parallel(lines: Column) -> Column:
    """Rule 3b's condition: four lines whose angles modulo 180 spread over at most ALL_PARALLEL (0 and 180 are far apart here)."""
    a = F.transform(lines, lambda x: F.pmod(x["angle"], F.lit(180.0)))
    return (F.size(lines) == 4) & (F.array_max(a) - F.array_min(a) <= ALL_PARALLEL)


def angle_groups(lines: Column) -> Column:
    """The lines in order of angle with their group's number: array<struct<group,angle,distance,seq>>; steps up to SIMILAR join."""
    order = F.array_sort(lines, lambda a, b: F.when(a["angle"] < b["angle"], -1).when(a["angle"] > b["angle"], 1).otherwise((a["seq"] - b["seq"]).cast("int")))
    kind = "array<struct<group:int,angle:double,distance:double,seq:bigint>>"

    def number(done, x):
        last = F.element_at(done, -1)
        group = F.when(F.size(done) == 0, 0).when(x["angle"] - last["angle"] <= SIMILAR, last["group"]).otherwise(last["group"] + 1)
        return F.concat(done, F.array(F.struct(group.cast("int").alias("group"), x["angle"].cast("double").alias("angle"), x["distance"].cast("double").alias("distance"), x["seq"].cast("bigint").alias("seq"))))

    return F.aggregate(order, F.array().cast(kind), number)


def group_means(grouped: Column) -> Column:
    """array<struct<m,g,n>>: each group's mean distance (negative, so that the largest comes first), number and size, sorted."""

    def one(g):
        mine = F.filter(grouped, lambda x: x["group"] == g)
        return F.struct((-F.aggregate(mine, F.lit(0.0), lambda s, x: s + x["distance"]) / F.size(mine)).alias("m"), g.alias("g"), F.size(mine).alias("n"))

    return F.array_sort(F.transform(F.array_distinct(F.transform(grouped, lambda x: x["group"])), one))


def no_angle_outlier(lines: Column, grouped: Column, means: Column, keep: int = KEEP) -> Column:
    """Rule 4: of three or more groups of angles, without that of the largest mean distance, if it is over OUTLIER times the second."""
    worst, second = F.get(means, F.lit(0)), F.get(means, F.lit(1))
    drop = (F.size(lines) > 2) & (F.size(means) >= 3) & (F.size(lines) - worst["n"] >= keep) & (-worst["m"] > OUTLIER * -second["m"])
    bad = F.transform(F.filter(grouped, lambda x: x["group"] == worst["g"]), lambda x: x["seq"])
    return F.when(drop, F.filter(lines, lambda x: ~F.array_contains(bad, x["seq"]))).otherwise(lines)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once: in a chain of columns the optimizer would copy it wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filtered(lines: Column, keep: int = KEEP) -> Column:
    """Rules in order, each only while more than `keep` lines are left; at most `keep` lines pass untouched."""

    def while_more(rule, then):
        return lambda x: let(F.when(F.size(x) > keep, rule(x)).otherwise(x), then)

    def outliers(x):
        return let(angle_groups(x), lambda g: let(group_means(g), lambda m: no_angle_outlier(x, g, m, keep)))

    last = lambda x: F.when(F.size(x) <= keep, x).when(all_parallel(x), F.slice(by_distance(x), 1, 2)).otherwise(outliers(x))
    third = while_more(lambda x: no_parallel_twins(x, keep), last)
    second = while_more(lambda x: not_into_start_box(x, keep), third)
    return let(lines, while_more(near_enough, second))


def apply_rules(groups: DataFrame, name: str = "lines", keep: int = KEEP) -> DataFrame:
    """The filter rules on a column of groups of lines."""
    return groups.withColumn(name, filtered(F.col(name), keep))


def groups_of_four(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, group_no, lines: consecutive lines in groups of four."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    numbered = lines.withColumn("group_no", F.floor((n - 1) / 4))
    packed = F.sort_array(F.collect_list(F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), *FIELDS)))  # at most four
    return numbered.groupBy(*by, "group_no").agg(packed.alias("lines")).withColumn("lines", F.transform("lines", lambda x: F.struct(*(x[f].alias(f) for f in FIELDS))))
