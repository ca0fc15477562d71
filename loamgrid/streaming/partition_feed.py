"""The delineation as a stream of partitions: each batch of newly arrived partitions is run like a batch job.

The original method has no streams; this is its resumable loop over partitions, with the checkpoint in place of a list of the finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loamgrid.operators.validation import Params
from loamgrid.plans.pipeline import delineate, overall_density


def feed(spark: SparkSession, arrivals: str, layers: dict[str, DataFrame], codes: DataFrame, out: str, checkpoint: str, params: Params | None = None) -> StreamingQuery:
    """Starts a stream over Parquet files of partitions (columns of layers["partitions"]) that appends patches to `out` and ends when all
    files that are there have been read. A batch that runs again after a failure overwrites its own folder."""
    schema = layers["partitions"].schema
    overall = overall_density(layers, params or Params())  # of all partitions, not of a batch's

    def batch(partitions: DataFrame, number: int) -> None:
        found = delineate({**layers, "partitions": partitions}, codes, params, overall=overall)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(arrivals).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
