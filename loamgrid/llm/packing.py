"""Packing documents into fixed windows of tokens by lexical retrieval.

Texts are encoded once and kept in the shared folder. How many documents hold each token id, and how long documents are, is counted over
all of them; the counts are as many as the tokenizer has tokens and go to every task. Documents are dealt to the shards of a BM25
index by content: by their leading term, the one of the greatest BM25 weight, so that those that share a rare term meet whatever
split of the input they come from. A term that leads very many is dealt to as many parts as its document count fills shards.

In a shard a seed document opens a window; the unused documents of the highest scores against all of its terms fill the window, and the
one that crosses its end is cut there and becomes the seed of the next. When no unused document shares a term with the seed, the
next unused one becomes the seed. What is left at the end of a shard goes into the task's next shard; what is left at the end of the
task is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.bpe import encoder
from loamgrid.llm.common import texts
from loamgrid.runtime import cut_lineage

WINDOW, END_ID = 2048, 1
#: A shard is closed at so many documents or tokens; one longer document makes a shard of its own.
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 21
#: Tokens that a task packs, about.
TASK_TOKENS = 1 << 24
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Terms that more than this share of a shard's items hold are scored for all seeds by one product of matrices.
COMMON = 1 / 8

ENCODED = "doc_id long, ids binary"
DEALT = "doc_id long, ids binary, lead long, part long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Statistics:
    """Of all documents: how many there are, their items' mean length, and how many hold each term."""

    docs: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Statistics:
        df = np.zeros(max((int(x.max()) + 1 for x in items if len(x)), default=1), np.int64)
        for x in items:
            df[np.unique(x)] += 1
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), df)

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """BM25 weights of terms that occur tf times in items of a size."""
        df = self.df[term]
        return np.log1p((self.docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(1.0, self.mean)))


class Index:
    """BM25 postings of a shard's items: arrays sorted by term, and for common terms the scores of all items for each as a seed."""

    def __init__(self, items: list[np.ndarray], statistics: Statistics | None = None) -> None:
        n, size = len(items), np.array([len(x) for x in items])
        statistics = statistics or Statistics.of(items)
        code, tf = np.unique(np.repeat(np.arange(n), size) << 32 | np.concatenate(items).astype(np.int64), return_counts=True)
        item, term = code >> 32, code & 0xFFFFFFFF
        self.n, self.first = n, np.searchsorted(item, np.arange(n + 1))
        weight = statistics.weights(term, tf, size[item])
        held, self.row, df = np.unique(term, return_inverse=True, return_counts=True)
        order = np.argsort(self.row, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.end = np.cumsum(df)
        self.begin = self.end - df
        often = df > max(1, n * COMMON)
        self.rare = ~often & (df > 1)  # a term of one item adds to no other's score
        column = np.cumsum(often) - 1
        at = often[self.row]
        common = np.zeros((n, int(often.sum())), np.float32)
        common[item[at], column[self.row[at]]] = weight[at]
        self.common = (common > 0).astype(np.float32) @ common.T

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each item for all terms of the seed (those that no other item holds count for the seed itself only, and are
        left out)."""
        row = self.row[self.first[seed] : self.first[seed + 1]]
        row = row[self.rare[row]]
        begin, size = self.begin[row], self.end[row] - self.begin[row]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
        return np.bincount(self.item[at], self.weight[at], self.n) + self.common[seed]


def order(items: list[np.ndarray], window: int, statistics: Statistics | None = None) -> Iterator[int]:
    """The order in which items follow each other: the seed's best unused neighbours until a window is full, and so on. Of equal
    scores the first item comes first."""
    index, unused, first = Index(items, statistics), np.ones(len(items), bool), 0
    filled = 0
    seed: int | None = None
    while True:
        if seed is None:
            while first < len(items) and not unused[first]:
                first += 1
            if first == len(items):
                return
            seed = first
            unused[seed] = False
            yield seed
            filled = (filled + len(items[seed])) % window
            if not filled:
                seed = None
                continue
        scores = np.where(unused, index.scores(seed), 0.0)
        near = np.flatnonzero(scores > 0)
        seed = None
        for i in near[np.argsort(-scores[near], kind="stable")]:
            unused[i] = False
            yield int(i)
            filled += len(items[i])
            if filled >= window:  # the one that crosses the end leads the next window
                filled %= window
                seed = int(i) if filled else None
                break


def narrow(path: str) -> np.dtype:
    """The type in which ids of a tokenizer are kept."""
    return np.dtype(np.uint16 if len(encoder(path).decoded.offset) <= 1 << 16 else np.uint32)


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids of every row, each text's ids followed by end_id; kept in the shared folder."""
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, kind = encoder(path), narrow(path)
        for batch in batches:
            ids = [np.frombuffer(e.encode(t) + end, np.uint32).astype(kind).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED))


def statistics(encoded: DataFrame, kind: np.dtype, window: int) -> tuple[Statistics, int]:
    """Statistics over all rows of encoded, and how many tokens they have. What reaches the driver is a row for each token of the
    tokenizer at most. A document's item is what its full windows leave."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, items, total = np.zeros(1 << 16, np.int64), 0, 0, 0
        for batch in batches:
            for x in batch.column("ids"):
                ids = np.unique(whole := np.frombuffer(x.as_buffer(), kind))
                if len(ids) and ids[-1] >= len(df):
                    df = np.r_[df, np.zeros(int(ids[-1]) + 1 - len(df), np.int64)]
                df[ids] += 1
                docs, items, total = docs + 1, items + len(whole) % window, total + len(whole)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.r_[-1, -2, -3, at], "n": np.r_[docs, items, total, df[at]]})

    found = {r.term: r.n for r in encoded.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, items, total = (found.pop(k, 0) for k in (-1, -2, -3))
    df = np.zeros(max(found, default=0) + 1, np.int64)
    for term, n in found.items():
        df[term] = n
    return Statistics(docs, items / max(1, docs), df), total


def deal(encoded: DataFrame, known: Statistics, kind: np.dtype, window: int, parts: int, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """encoded with its rows where their leading terms belong: rows of a leading term are adjacent, but for one that leads so many that
    they are dealt to several parts in turn."""
    shared = encoded.sparkSession.sparkContext.broadcast(known)  # as many numbers as the tokenizer has tokens

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Statistics = shared.value
        row = 0
        for batch in batches:
            leads, turns = [], []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), kind)
                term, tf = np.unique(ids[len(ids) // window * window :], return_counts=True)
                weight = np.where(s.df[term] > 1, s.weights(term, tf, len(ids) % window), 0.0)
                best = int(term[weight.argmax()]) if len(term) and weight.max() > 0 else -1
                leads.append(best)
                turns.append(row % -(-(int(s.df[best]) if best >= 0 else s.docs) // shard_docs))
                row += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leads, pa.int64()), pa.array(turns, pa.int64())], names=["doc_id", "ids", "lead", "part"])

    return encoded.mapInArrow(lead, DEALT).repartition(parts, "lead", "part").sortWithinPartitions("lead", "part", "doc_id", "ids")


def pack_documents(docs: Iterator[tuple[int | None, bytes]], window: int = WINDOW, base: int = 0, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, known: Statistics | None = None) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of documents (doc_id, ids as bytes).

    Each id lies in exactly one piece. Sequences have `window` ids, but for at most log2(window) at the end, whose sizes are
    distinct powers of two.
    """
    sequence, offset = base, 0

    def piece(item: tuple, begin: int, n: int) -> tuple:
        doc_id, ids, start, _ = item
        at = start + begin
        return doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4, sequence, offset

    def close(pool: list[tuple], last: bool) -> Iterator[tuple]:
        """Packs a pool; keeps in it what fills no window unless it is the last."""
        nonlocal sequence, offset
        held: list[tuple[tuple, int, int]] = []  # of the open window
        arrays = [np.frombuffer(ids, np.uint32)[start : start + n] for _, ids, start, n in pool]
        for i in order(arrays, window, known) if pool else ():
            begin, n = 0, pool[i][3]
            while offset + n >= window:
                part = window - offset
                for x in held:
                    yield (*piece(*x[:2], x[2])[:6], x[3])
                yield piece(pool[i], begin, part)
                held, begin, n, offset, sequence = [], begin + part, n - part, 0, sequence + 1
            if n:
                held.append((pool[i], begin, n, offset))
                offset += n
        pool[:] = [(x[0][0], x[0][1], x[0][2] + x[1], x[2]) for x in held]
        rest, offset = offset, 0
        if last:
            for item in pool:
                begin, n = 0, item[3]
                while n:
                    goal = 1 << (rest + offset).bit_length() - 1  # the open sequence's size
                    part = min(n, goal - offset)
                    yield piece(item, begin, part)
                    begin, n, rest, offset = begin + part, n - part, rest - part, offset + part
                    if offset == goal:
                        sequence, offset = sequence + 1, 0
            pool.clear()

    pool: list[tuple] = []
    tokens = 0
    for doc_id, ids in docs:
        n = len(ids) // 4
        whole = n // window * window
        for start in range(0, whole, window):  # full windows of long documents need no neighbour
            yield doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, sequence, 0
            sequence += 1
        if n > whole:
            pool.append((doc_id, ids, whole, n - whole))
            tokens += n
        if len(pool) >= shard_docs or tokens >= shard_tokens:
            yield from close(pool, False)
            tokens = sum(len(x[1]) // 4 for x in pool)
    yield from close(pool, True)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file at `path`, then end_id; null and empty texts are the end id alone. doc_id is cast to
    long. Rows that repeat an id are packed as often, columns beside doc_id and text are ignored, an empty table gives no piece. The full
    windows of a long text need no neighbours and stand alone; its rest is an item of the index. Equal scores go by the order of rows in
    the shard. A sequence never leaves its task: sequence_id is the partition's number times 2^32 and a count, and a task that runs again
    gives the same pieces.
    """
    kind = narrow(path)
    types = [pa.int64()] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    encoded = encode_documents(docs, path, end_id)
    known, total = statistics(encoded, kind, window)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        wide = lambda x: np.frombuffer(x, kind).astype(np.uint32).tobytes()
        rows = ((i, wide(x)) for batch in batches for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True))
        out: list[tuple] = []
        for p in pack_documents(rows, window, (context.partitionId() if context else 0) << 32, known=shared.value):
            out.append(p)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    return deal(encoded, known, kind, window, parts).select("doc_id", "ids").mapInArrow(run, SCHEMA)
