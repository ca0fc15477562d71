"""Exact deduplication by sorting content.

Rows are range-partitioned on (first 64 normalised bytes, hash of all of them, turn) by Spark's sampled splitters, sorted externally,
and compared in full with their neighbours. Before the shuffle each batch folds its equal texts to one row with the list of their
ids, so a text that a third of all rows share crosses the network once a batch, not once a row; the turn, the batch's number,
lets splitters fall between the copies of such a text, so that many tasks share them. Runs of neighbours that a splitter has cut in
two are joined by the texts' SHA-256. Ids never meet by text: they take their group's row where they are, by a broadcast of the few
groups of very many batches, whose number is bounded, and by a shuffle for all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import others
from loamgrid.runtime import cut_lineage

#: Normalised bytes that the range partitioning and the sort look at before the hash.
PREFIX = 64
#: Groups are hot, and broadcast, if they have over one of so many of all folded rows; so there are fewer than HOT of them.
HOT = 1000
FOLDED = [T.StructField("_ids", T.ArrayType(T.LongType())), T.StructField("_most", T.LongType()), T.StructField("_prefix", T.BinaryType()), T.StructField("_hash", T.LongType()), T.StructField("_turn", T.LongType())]
RUN = [T.StructField("row_no", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("first", T.BooleanType())]
OWN = (*(f.name for f in FOLDED + RUN), "_top")


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; bytes.lower() leaves all others alone."""
    return (text or "").encode().lower()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for number, batch in enumerate(batches):
        groups: dict[bytes, list[int]] = {}
        for i, text in enumerate(batch.column("text").to_pylist()):
            groups.setdefault(normalise(text), []).append(i)
        ids = batch.column("doc_id").to_pylist()
        rank = lambda i: (ids[i] is not None, ids[i] or 0, -i)  # noqa: E731  nulls are smallest; of a repeated id the first row counts
        members = [sorted(rows, key=rank, reverse=True) for rows in groups.values()]
        most = [ids[rows[0]] for rows in members]
        new = [
            pa.array([[ids[i] for i in rows] for rows in members], pa.list_(pa.int64())),
            pa.array(most, pa.int64()),
            pa.array([k[:PREFIX] for k in groups], pa.binary()),
            pa.array([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in groups], pa.int64()),
            pa.array([part << 32 | number] * len(groups), pa.int64()),
        ]
        own = batch.take(pa.array([rows[0] for rows in members], pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*own.schema.names, *(f.name for f in FOLDED)])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (prefix, hash, largest id first): a number of their own, their text's digest, whether they begin a run."""
    at, count, seen = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0, None
    known: dict[bytes, str] = {}  # of the present prefix and hash: one text, or several if hashes collide
    for batch in batches:
        digests, first = [], []
        for text, prefix, code in zip(*(batch.column(c).to_pylist() for c in ("text", "_prefix", "_hash")), strict=True):
            if (prefix, code) != seen:
                seen, known = (prefix, code), {}
            key = normalise(text)
            first.append(key not in known)
            if first[-1]:
                known[key] = hashlib.sha256(key).hexdigest()
            digests.append(known[key])
        new = [pa.array(np.arange(at + count, at + count + len(first))), pa.array(digests, pa.string()), pa.array(first, pa.bool_())]
        count += len(first)
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in RUN)])


def runs(docs: DataFrame) -> DataFrame:
    """A row for each batch's group of equal texts: docs' columns (of the row with the largest id), the group's ids, its place in a run."""
    docs = docs.select("doc_id", "text", *others(docs, "doc_id", "text", *OWN)).withColumn("doc_id", F.col("doc_id").cast("long"))
    folded = docs.mapInArrow(_fold, T.StructType([*docs.schema.fields, *FOLDED]))
    ordered = folded.repartitionByRange("_prefix", "_hash", "_turn").sortWithinPartitions(F.col("_prefix"), F.col("_hash"), F.col("_most").desc(), F.col("_turn"))
    return ordered.mapInArrow(_compare, T.StructType([*folded.schema.fields, *RUN]))


def top() -> Column:
    """Of rows of equal texts the one with the largest id, of those that repeat it the first."""
    return F.max(F.struct(F.col("_most").alias("keep_id"), (-F.col("row_no")).alias("row"))).alias("top")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text, more columns are ignored).

    Texts are equal when identical after lower-casing A-Z. Null texts count as empty and empty texts equal each other. The
    largest doc_id of a group stays (ids are cast to long); null ids are smaller than all others; of rows that repeat the id, one has
    kept = true. Texts of any length are compared whole. An empty table gives an empty result.
    """
    found = cut_lineage(runs(docs.select("doc_id", "text")).select("_ids", "_most", *(f.name for f in RUN)))  # without texts
    groups = cut_lineage(found.groupBy("text_sha256").agg(F.count("*").alias("n"), F.sum(F.size("_ids").cast("long")).alias("group_size"), top()))
    most = max(HOT, (groups.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot, cold = (groups.where(F.col("n") > most), groups.where(F.col("n") <= most))
    alike = found.join(F.broadcast(hot), "text_sha256")  # fewer than HOT groups
    rest = found.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(cold, "text_sha256")
    rows = alike.union(rest.select(alike.columns)).select(F.posexplode("_ids").alias("pos", "doc_id"), "row_no", "top", "group_size", "text_sha256")
    return rows.select("doc_id", F.col("top.keep_id").alias("keep_id"), "group_size", ((F.col("pos") == 0) & (F.col("row_no") == -F.col("top.row"))).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns; a column named like one of this operator's own (row_no, first, ...) goes. Rows
    that begin a run are kept in the shared folder; of a run that splitters have cut, the part with the largest id counts."""
    found = cut_lineage(runs(docs.drop("_top")).where("first").drop("_ids", "_prefix", "_hash", "_turn", "first"))
    cut = found.groupBy("text_sha256").agg(F.count("*").alias("n"), top()).where("n > 1").select("text_sha256", F.col("top.row").alias("_top"))
    joined = found.join(F.broadcast(cut), "text_sha256", "left")  # a splitter cuts one run at most, so there are fewer than partitions
    return joined.where("_top IS NULL OR row_no = -_top").select(*[c for c in docs.columns if c in ("doc_id", "text") or c in others(docs, *OWN)])
