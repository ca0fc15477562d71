"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.runtime import cut_lineage


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) together."""
    ends = [np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (apart := a != b).any():  # hook the larger label below the smaller one, then shorten all paths
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Alternating large-star and small-star contraction: each round is a few equi-joins on node ids with partial minima before
    each shuffle, so a hub's edges are never gathered in one row, and the number of rounds grows with the logarithm of the
    diameter. Nulls and loops are ignored; repeated edges count once. Nothing but two counters per round reaches the driver.
    Up to `few` edges between longs are joined by one task instead, as a round over many partitions costs more than such edges.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e, before = cut_lineage(e), None
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if few and e.count() <= few:
        return cut_lineage(e.coalesce(1).mapInArrow(_joined, "node long, component long"))
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", "m")).distinct()
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    members = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return members.union(members.select("component", "component").distinct())
