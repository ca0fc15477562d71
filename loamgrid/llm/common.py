"""Helpers that the text operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % of


def others(df: DataFrame, *own: str) -> list[str]:
    """Names of df's columns that an operator's own columns don't take; where names clash, the operator's column stays."""
    taken = {x.lower() for x in own}
    return [c for c in df.columns if c.lower() not in taken]


_kept: dict[str, Callable[[], None]] = {}  # what a worker process keeps from task to task: by owner, how to drop it


def keep_only(owner: str, drop: Callable[[], None] | None = None) -> None:
    """For a task's start: what other owners' tasks have left in the worker process goes; `drop` does the same for this one's, later on."""
    others_kept = [o for o in _kept if o != owner]
    for o in others_kept:
        _kept.pop(o)()
    if others_kept:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if drop:
        _kept[owner] = drop


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField], keep: list[str], owner: str = "") -> DataFrame:
    """df's `keep` columns and new ones that start()'s function makes of each batch, row for row; start() runs once a task. What tasks
    of owners other than `owner` have left in a worker's memory is dropped first."""
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(owner)
        work = start()
        names = [*keep, *(f.name for f in fields)]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), *work(batch)], names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's strings; null counts as empty."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`, so that working arrays stay small; a larger row comes alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
