"""Near copies: SimHash fingerprints of word shingles, BK-trees over shards, and an exact check by Jaccard similarity.

A text has the SimHash fingerprint of its set of shingles. Fingerprints within `RADIUS` bits are candidates: at a similarity of 0.8 about
ten of 64 bits differ, and a pair with more than `RADIUS` has a probability under 2e-6, whatever its sizes. No choice of bytes agrees at
such a radius, so shards aren't dealt as for two bits: a set has `BANDS` keys, each of `ROWS` minima under its own hash functions, and the
texts of a key are a shard. Two texts of similarity s share none with probability (1 - s^ROWS)^BANDS: 3e-6 at 0.8, 2e-8 at 0.85.

Each shard is a BK-tree. First the links to a shard's root are checked by the sets. Shards whose texts these links join are done; the trees of the others are built and
searched along the edges within the radius, and a pair that is found is checked by its sets where it stands, unless links that hold
already join the two or their sizes rule a link out. So no pair is ever a row, and a large group costs some comparisons a copy, and
one more for each pair of a copy and a text of its shard that is really apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import map_batches, others, texts
from loamgrid.llm.simhash import Forest, majority
from loamgrid.operators.components import connected_components
from loamgrid.runtime import cut_lineage

WIDTH, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
#: Differing bits of 64 up to which fingerprints are candidates.
RADIUS = 28
_random = np.random.default_rng(SEED)
TIMES, PLUS = (_random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
TIMES |= np.uint64(1)
MIX = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
#: Shingles that are hashed at once; candidates that may be broadcast (8 bytes each), more are joined by a shuffle.
AT_ONCE, BROADCAST_ROWS = 4096, 1_000_000
#: Pairs that a row of a shard has at least where the shard's texts are counted for a bound; bits of the table for it at most.
WORTH, TABLE = 4, 24
#: Links (16 bytes each) that one task may join; more are contracted by shuffles.
FEW = 1 << 20
#: Rows of shards that are searched at once (a larger shard comes alone); pairs between two looks at what is joined by now.
SHARDS, LOOK = 1 << 12, 1 << 12


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles; of all its words if they are fewer than `width`, none without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])  # noqa: B905
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64))


def node(codes: np.ndarray) -> int:
    """Hash of a set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes(), SEED)).view(np.int64))


def band_keys(codes: np.ndarray) -> np.ndarray:
    """A set's keys, signed."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(codes), AT_ONCE):
        least = np.minimum(least, (TIMES * codes[i : i + AT_ONCE] + PLUS).min(axis=1))
    return (MIX * (least.reshape(BANDS, ROWS) >> np.uint64(1) ^ least.reshape(BANDS, ROWS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node, size (distinct shingles), fp (fingerprint, signed), keys of every row."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingles(t, width) for t in texts(batch)]
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            return [pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]

        return work

    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), start, fields, ["doc_id"])


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, fp) of keys that several have, each with its key's first row (head, n, top); rows come sorted by key, and a key
    may go on in the next batch."""
    head, alone = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(c).to_numpy() for c in ("key", "node", "size", "fp")])
        if head is not None:
            rows = np.concatenate([head, rows])
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        run = np.cumsum(first) - 1
        start, many = np.flatnonzero(first), np.bincount(run) > 1
        out = many[run]
        out[0] &= head is None or alone  # else it has gone out with an earlier batch
        both = np.concatenate([rows, rows[start[run], 1:]], axis=1)[out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in both.T.copy()], names=["key", "node", "size", "fp", "head", "n", "top"])
        head, alone = rows[start[-1]][None], not many[-1]


def _shards(nodes: DataFrame) -> DataFrame:
    """key, node, size, fp, head, n, top: the nodes of keys that several share, and the least of each key's nodes with its size and fingerprint."""
    bands = nodes.select("node", "size", "fp", F.explode(F.array_distinct("keys")).alias("key"))
    ordered = bands.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(_headed, "key long, node long, size long, fp long, head long, n long, top long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, codes (bytes) of the wanted nodes."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingles(t, width) for t in texts(batch)]
            return [pa.array([node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

        return work

    found = map_batches(docs.select("text"), start, [T.StructField("node", T.LongType()), T.StructField("codes", T.BinaryType())], [])
    few = wanted.count() <= BROADCAST_ROWS
    return found.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").dropDuplicates(["node"])


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets have at least the Jaccard similarity."""
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, codes) have at least the similarity."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), similarity) for pair in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = sets.select("node", "codes")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, node, fp, component) of keys with several components; rows come sorted by key, and a key may go on in the next batch."""

    def mixed(rows: pa.Table) -> list[pa.RecordBatch]:
        key, component = rows.column("key").to_numpy(), rows.column("component").to_numpy()
        run = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        other = np.r_[False, (key[1:] == key[:-1]) & (component[1:] != component[:-1])]
        return rows.filter(pa.array((np.bincount(run, other) > 0)[run])).to_batches()

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        key = held.column("key").to_numpy()
        if cut := int(np.searchsorted(key, key[-1])):
            yield from mixed(held[:cut])
            held = held[cut:]
    if held is not None:
        yield from mixed(held)


def _searched(batches: Iterator[pa.RecordBatch], similarity: float, worth: float = WORTH) -> Iterator[pa.RecordBatch]:
    """Links found in shards; rows (key, node, component, fp, keys, codes) come sorted by key, and a shard may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= SHARDS:
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _shard_pairs(held[:cut], similarity, worth)
                held = held[cut:]
    if held is not None:
        yield _shard_pairs(held, similarity, worth)


def _shared(codes: list[np.ndarray]) -> np.ndarray:
    """For each set at least as many as it has of the codes that others of the sets have too: places of a table stand for codes."""
    total = sum(map(len, codes))
    place = np.uint64((1 << min(TABLE, (8 * total).bit_length())) - 1)
    once, again = np.zeros(int(place) + 1, bool), np.zeros(int(place) + 1, bool)
    for x in codes:
        at = x & place
        again[at] |= once[at]
        once[at] = True
    return np.array([np.count_nonzero(again[x & place]) for x in codes])


def _shard_pairs(rows: pa.Table, similarity: float, worth: float) -> pa.RecordBatch:
    """(a, b): links of at least the similarity in whole shards, but for those between what other links of these shards or components join.

    A pair that shares several keys is checked in the shard of the first. Texts within the radius are found by each shard's BK-tree. Where
    a shard's rows have more than `worth` pairs each, shingles that a text has alone there bound what it can share.
    """
    key, node, root, fp = (rows.column(c).to_numpy() for c in ("key", "node", "component", "fp"))
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    codes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("codes")]
    size = np.array([len(x) for x in codes])
    group = np.r_[0, np.cumsum(key[1:] != key[:-1])]
    common, ends = size.copy(), np.cumsum(np.bincount(group))
    for start, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        if end - start - 1 > 2 * worth:
            common[start:end] = _shared(codes[start:end])
    fit = np.flatnonzero(common >= similarity * size)  # others fit no text
    key, node, fp, keys, size, group, common = (x[fit] for x in (key, node, fp, keys, size, group, common))
    codes = [codes[i] for i in fit.tolist()]
    root = np.unique(root, return_inverse=True)[1][fit]
    above = list(range(len(rows)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    a, b = [], []
    for query, other in Forest(fp.view(np.uint64), group).near(RADIUS):
        once = (query > other) & (root[query] != root[other])
        query, other = query[once], other[once]
        least = np.minimum(common[query], common[other])
        fits = least >= similarity * (size[query] + size[other] - least)
        query, other = query[fits], other[fits]
        for k in range(0, len(query), LOOK):
            q, o = query[k : k + LOOK], other[k : k + LOOK]
            first = (keys[q] == keys[o]).argmax(1)
            here = keys[q, first] == key[q]
            for i, j in zip(q[here].tolist(), o[here].tolist(), strict=True):
                x, y = top(root[i]), top(root[j])
                if x != y and alike(codes[i], codes[j], similarity):
                    above[max(x, y)] = min(x, y)
                    a.append(node[j])
                    b.append(node[i])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(nodes: DataFrame, docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between nodes (node, size, fp, keys) that reach all that links between candidates of at least the similarity reach.

    The trees of the shards that the links to their first texts leave apart are all searched. Each step is a shuffle or few, whatever the data:
    files and log lines of many small steps over many partitions take more disk than the rows.
    """
    shards = cut_lineage(_shards(nodes))
    sets = cut_lineage(_sets(docs, shards.select("node").distinct(), width).join(nodes.select("node", "keys"), "node"))
    near = shards.where(f"node != head AND bit_count(fp ^ top) <= {RADIUS} AND least(size, n) >= {similarity}D * greatest(size, n)")
    found = cut_lineage(_verified(near.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), sets, similarity))
    groups = connected_components(found, few=FEW)
    placed = shards.join(groups, "node", "left").select("key", "node", "fp", F.coalesce("component", "node").alias("component"))
    placed = placed.repartition("key").sortWithinPartitions("key", "node")
    placed = cut_lineage(placed.mapInArrow(_apart, "key long, node long, fp long, component long"))
    ordered = placed.join(sets, "node").select("key", "node", "component", "fp", "keys", "codes").repartition("key").sortWithinPartitions("key", "node")
    worth = WORTH
    return found.union(cut_lineage(ordered.mapInArrow(lambda batches: _searched(batches, similarity, worth), "a long, b long")))


def similar_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id for every row of docs (doc_id, text; other columns are ignored).

    Texts are linked if their sets of shingles (A-Z lower-cased, `width` words) have at least the Jaccard similarity, and a component is
    all that links reach; component_id is its smallest doc_id. Texts without a word (null and empty too) are linked with each other
    only. A component of null ids only has a null component_id. Texts of equal sets are one node and never expanded to pairs.
    """
    rows = cut_lineage(_nodes(docs, width))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    groups = connected_components(links(nodes.select("node", "size", "fp", "keys"), docs, width, similarity), few=FEW)
    grouped = nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(grouped.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def similar_dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Of each component the rows with the smallest doc_id, with docs' columns (but for one named _keep). doc_id names a document:
    rows that repeat one stay or go together. Rows with a null id count as one document, which stays if some component has no id."""
    kept = similar_groups(docs, width, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    ids = docs.select(*others(docs, "_keep"))
    return ids.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")), "left_semi")
