"""What depends on the cluster: session defaults, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the session is the caller's."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loamgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/loamgrid-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs nothing that was computed before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def snapshot(df: DataFrame, folder: str | None, number: int, step: str) -> DataFrame:
    """df itself; where a folder is given, its rows are first written to NNN_step in it, for looking at a run step by step."""
    if folder:
        df.write.mode("overwrite").parquet(f"{folder}/{number:03d}_{step}")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
