"""Queries over orders whose keys go beyond the fixture's cells, as in tables that repeat the orders with shifted keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgrid.plans import queries as plans
from loamgrid.sources import fixtures as X


@pytest.fixture(scope="module")
def shifted(spark, sf, tmp_path_factory):
    """Orders thrice: 11 and 13 layers on, some buildings are equal to the ones below them."""
    folder = tmp_path_factory.mktemp("shifted")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    for layer in (0, 11, 13):
        orders.withColumn("o_orderkey", F.col("o_orderkey") + layer * X.CELLS).write.mode("append").parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def test_distinct_geometries_where_buildings_coincide(spark, shifted):
    con = duckdb.connect()
    for name in ("orders", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{shifted}/{name}.parquet/*.parquet'")
    want = con.execute(plans.ORACLE_SQL["distinct_geometries"]).fetchall()
    got = plans.QUERIES["distinct_geometries"](spark, shifted).select("fid", "pid").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_filtered_buildings_where_buildings_coincide(spark, shifted):
    con = duckdb.connect()
    for name in ("orders", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{shifted}/{name}.parquet/*.parquet'")
    want = con.execute(plans.ORACLE_SQL["filtered_buildings"]).fetchall()
    got = plans.QUERIES["filtered_buildings"](spark, shifted).select("fid", "group_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
