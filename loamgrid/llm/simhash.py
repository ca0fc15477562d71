"""Near-duplicate detection: SimHash fingerprints and BK-trees.

Fingerprints within `RADIUS` bits of each other differ in at most two of eight bytes, so they agree on the other six. Each of the
28 choices of six bytes deals the distinct fingerprints into shards that agree there; a shard leaves 16 bits free, so it holds at
most 65,536 fingerprints whatever the input. In each shard a BK-tree is built, children keyed by their Hamming distance to the
parent, and searched along the edges within the radius. All trees of a batch of shards are built and searched together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import map_batches, others, texts
from loamgrid.operators.components import connected_components
from loamgrid.runtime import cut_lineage

RADIUS, SHINGLE, SEED = 2, 3, 42
MASKS = [~sum(0xFF << 8 * b for b in pair) & (1 << 64) - 1 for pair in combinations(range(8), RADIUS)]
#: Pairs of a query and a tree node that are held at once.
FRONT = 1 << 20


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text: bit by bit the majority of its shingles' hashes; 0 if there is no word."""
    words = (text or "").encode().lower().split()  # bytes.split() splits at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])  # noqa: B905
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - width + 1)))


def majority(codes: np.ndarray) -> int:
    """Unsigned fingerprint of hashes: a bit is 1 if it is set in over half of them; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 14):
        ones += np.unpackbits(codes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(codes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def start():
        return lambda batch: [pa.array(np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64))]

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), start, [T.StructField("fp", T.LongType())], ["doc_id"])


class Forest:
    """BK-trees over groups of distinct fingerprints: one tree a group, all as arrays."""

    def __init__(self, fps: np.ndarray, group: np.ndarray) -> None:
        """group: ascending group numbers, one for each fingerprint; the first of a group is the root of its tree."""
        n = len(fps)
        self.fps, first = fps, np.r_[True, group[1:] != group[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        self.child: dict[int, np.ndarray] = {}
        node, rest = self.root.copy(), np.flatnonzero(~first)
        while len(rest):  # each round hangs one fingerprint below every (node, distance) that has any; the others go down to it
            distance = np.bitwise_count(fps[rest] ^ fps[node[rest]]).astype(np.int64)
            _, at, back = np.unique(node[rest] * 65 + distance, return_index=True, return_inverse=True)
            for d in np.unique(distance[at]):
                self.child.setdefault(int(d), np.full(n, -1, np.int64))
            for d in np.unique(distance[at]):
                new = at[distance[at] == d]
                self.child[int(d)][node[rest[new]]] = rest[new]
            node[rest] = rest[at[back]]
            rest = rest[node[rest] != rest]

    def near(self, radius: int, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, for every fingerprint as query in its own tree."""
        stack = [(q, self.root[q]) for q in (np.arange(i, min(i + step, len(self.fps))) for i in range(0, len(self.fps), step))]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            hit = (distance <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            next_query, next_node = [], []
            for d, child in self.child.items():
                below = child[node]
                go = (below >= 0) & (np.abs(distance - d) <= radius)
                if go.any():
                    next_query.append(query[go])
                    next_node.append(below[go])
            if next_query:
                stack.append((np.concatenate(next_query), np.concatenate(next_node)))


def forest_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the position of the first one that it is linked with inside its group, itself included."""
    label = np.arange(len(fps))
    for query, node in Forest(fps, group).near(radius):
        a, b = label[query], label[node]
        while (apart := a != b).any():  # hook the larger label below the smaller one, then shorten all paths
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            a, b = label[a], label[b]
    return label


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints in shards; rows come sorted by shard, and a shard may go on in the next batch."""

    def linked(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        same = (mask[1:] == mask[:-1]) & (key[1:] == key[:-1])
        group = np.r_[0, np.cumsum(~same)]
        many = (np.bincount(group) > 1)[group]
        fp, group = fp[many], group[many]
        label = forest_links(fp.view(np.uint64), group) if len(fp) else np.zeros(0, np.int64)
        other = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[label[other]])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
        if not len(now[0]):
            continue
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        if len(last) and last[-1] + 1 >= 1 << 15:
            cut = last[-1] + 1
            yield linked(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None:
        yield linked(*held)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints `fp` that differ in at most RADIUS bits."""
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))
    shards = fps.select("fp", F.posexplode(keys).alias("mask", "key"))
    ordered = shards.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return ordered.mapInArrow(_shard_links, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text; other columns are ignored).

    Fingerprints within two bits are linked, and a component is all that links reach; component_id is its smallest doc_id. Texts
    without a word (null and empty too) have fingerprint zero, linked like any other. Rows that repeat count as often as they
    occur; a component of null ids only has a null component_id. Copies share a fingerprint and are never expanded to pairs.
    """
    prints = cut_lineage(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    grouped = distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.where(F.col("fp").isNotNull()).groupBy("component").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(ids, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Of each component the rows with the smallest doc_id, with docs' columns (but for one named _keep). doc_id names a document:
    rows that repeat one stay or go together. Rows with a null id count as one document, which stays if some component has no id."""
    kept = near_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    ids = docs.select(*others(docs, "_keep"))
    return ids.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")), "left_semi")
