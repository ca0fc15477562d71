"""Scoring texts with an n-gram model kept as an Elias-Fano trie.

Level 1 has every word of the training texts: its 64-bit hashes as an Elias-Fano sequence, with exact counts; a word's number is its
place there. Levels 2 and 3 hold all n-grams that occur at least `least` times (with a `share`, only those of words that make up at
least this share of the training tokens): per context a monotone
pointer (Elias-Fano) to its children, the children's word numbers packed in as many bits as they need, and smoothed probabilities and
back-off weights quantised to 16 bits. A query finds a word among its context's children by successor search.

Counting is distributed: tasks send compressed runs of ascending counts to the ranges of contexts, where they are merged. Each level is
cut at contexts into segments that tasks write to the cluster's shared folder and that workers
map into memory, so the model is neither collected nor broadcast and grows with the corpus. Only the list of segments goes through
the driver.

Smoothing is interpolated absolute discounting over the add-one unigram model of the base score, so that the probabilities of all words
after a context sum to one (but for the rounding of 16 bits):
    p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) p(w),  g(v) = 1 - sum of the first terms.
"""

from __future__ import annotations

import ast
import functools
import os
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import fold, map_batches, pieces, texts
from loamgrid.llm.elias_fano import EliasFano, U, pack, search
from loamgrid.runtime import cut_lineage, scratch

#: The end of a text; no word holds a line feed.
END = b"\n"
ORDER, SHARE, LEAST, DISCOUNT = 3, 0.0, 2, 0.75
#: Quantisation: log10 from LOWEST to 0 in 2^16 - 1 steps.
LOWEST = -16.0
REMEMBERED, CHARS_AT_ONCE = 600_000, 1 << 21
#: Contexts of a segment whose pointers a worker keeps decoded (8 bytes each).
DECODED = 1 << 17
#: Bytes of segments that a worker keeps where they can't be mapped.
READ = 1 << 28
#: Training tokens for each segment of a higher level; keys that are merged at once.
RAW, MERGED = 1 << 22, 1 << 20


def quantise(log: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log - LOWEST, 0, -LOWEST) * (65535 / -LOWEST)).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return code * (-LOWEST / 65535) + LOWEST


def tokens(text: str) -> list[bytes]:
    """A-Z lower-cased, split at \\x20 and \\x09-\\x0D."""
    return text.encode().lower().split()


def code(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def signed(codes: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers in the same order, as Spark sorts them."""
    return (codes ^ U(1 << 63)).view(np.int64)


def unsigned(keys: np.ndarray) -> np.ndarray:
    return keys.view(U) ^ U(1 << 63)


# --- segments ----------------------------------------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    return path if "://" not in path and not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def save(folder: str, arrays: dict[str, np.ndarray]) -> tuple[str, list]:
    """Writes arrays to a new file in the shared folder: its path, and (name, type, length, offset) of each."""
    path, parts, at = f"{folder}/{uuid.uuid4().hex}", [], 0
    for name, a in arrays.items():
        parts.append((name, a.dtype.str, len(a), at))
        at += -(-a.nbytes // 8) * 8
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        out = open(local, "wb")  # noqa: SIM115
    else:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        out = fs.open_output_stream(inner)
    with out:
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    return path, parts


_read: OrderedDict[str, np.ndarray] = OrderedDict()  # segments that a worker has in memory, the last used at the end


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.memmap(path, np.uint8, "r")


def load(path: str) -> np.ndarray:
    """A segment's bytes, mapped into memory; read whole where the shared folder is no file system, of which a worker keeps READ bytes."""
    if (local := _local(path)) is not None:
        return _mapped(local)
    if path not in _read:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(inner) as f:
            _read[path] = np.frombuffer(f.read(), np.uint8)
        while len(_read) > 1 and sum(a.nbytes for a in _read.values()) > READ:
            _read.popitem(last=False)
    _read.move_to_end(path)
    return _read[path]


@functools.lru_cache(maxsize=64)
def decoded(path: str, n: int, segment: Segment) -> np.ndarray:
    """All pointers of a segment with few contexts."""
    return segment.sequence("pointer", n + 1).get(np.arange(n + 1)).astype(np.int64)


@dataclass(eq=False)
class Segment:
    first: int  # smallest hash or context
    base: int  # n-grams in the segments before
    n: int
    path: str
    parts: list
    size: dict[str, int]  # numbers that the arrays need: contexts, widths

    def array(self, name: str) -> np.ndarray:
        _, kind, n, at = next(p for p in self.parts if p[0] == name)
        return load(self.path)[at : at + n * np.dtype(kind).itemsize].view(kind)

    def range(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of contexts begin and end."""
        n = self.size["contexts"]
        if n <= DECODED:
            pointer = decoded(self.path, n, self)
            return pointer[context], pointer[context + 1]
        pointer = self.sequence("pointer", n + 1)
        return pointer.get(context).astype(np.int64), pointer.get(context + 1).astype(np.int64)

    def __hash__(self) -> int:
        return hash(self.path)

    def sequence(self, name: str, n: int) -> EliasFano:
        return EliasFano(n, self.size[name], *(self.array(f"{name}_{x}") for x in EliasFano.NAMES))


def _sequence_arrays(name: str, s: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}_{x}": getattr(s, x) for x in EliasFano.NAMES}


@dataclass
class Level:
    """Segments in ascending order of what they begin with."""

    segments: list[Segment] = field(default_factory=list)

    @functools.cached_property
    def firsts(self) -> np.ndarray:
        kind = np.int64 if all(s.first < 1 << 63 for s in self.segments) else U
        return np.array([s.first for s in self.segments], kind)

    @functools.cached_property
    def bases(self) -> np.ndarray:
        return np.array([s.base for s in self.segments], np.int64)

    def _deal(self, of: np.ndarray) -> Iterator[tuple[Segment, np.ndarray]]:
        """Segments that occur in `of`, and where, by one sort whatever their number."""
        order = np.argsort(of.astype(np.int16) if len(self.segments) < 1 << 15 else of, kind="stable")
        some, begin = np.unique(of[order], return_index=True)
        for i, a, b in zip(some.tolist(), begin.tolist(), [*begin[1:].tolist(), len(of)], strict=True):
            if i >= 0:
                yield self.segments[i], order[a:b]

    def split(self, keys: np.ndarray) -> Iterator[tuple[Segment, np.ndarray]]:
        """Each segment and which of the keys belong to it."""
        if self.segments and len(keys):
            yield from self._deal(np.searchsorted(self.firsts.astype(keys.dtype), keys, "right") - 1)

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level 1: numbers of words by their hashes, -1 where absent, and exact counts."""
        number, count = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        for s, at in self.split(codes):
            found = s.sequence("hash", s.n).find(codes[at])
            hit = found >= 0
            number[at[hit]] = found[hit] + s.base
            count[at[hit]] = s.array("count")[found[hit]]
        return number, count

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of n-grams, -1 where absent: in the range that the context's pointers give."""
        out = np.full(len(context), -1, np.int64)
        for s, at in self.split(context):
            own = context[at] - s.first
            inside = own < s.size["contexts"]
            at, own = at[inside], own[inside]
            begin, end = s.range(own)
            found = search(s.array("word"), s.size["word"], begin, end, word[at].astype(U))
            out[at] = np.where(found >= 0, found + s.base, -1)
        return out

    def take(self, name: str, number: np.ndarray) -> np.ndarray:
        """Values of n-grams by their numbers."""
        out = np.zeros(len(number), np.float64)
        if self.segments and len(number):
            for s, at in self._deal(np.searchsorted(self.bases, number, "right") - 1):
                out[at] = s.array(name)[number[at] - s.base]
        return out

    def weights(self, context: np.ndarray) -> np.ndarray:
        """log10 of the back-off weights of contexts; 0 for a context without children."""
        out = np.zeros(len(context), np.float64)
        for s, at in self.split(context):
            own = context[at] - s.first
            inside = own < s.size["contexts"]
            out[at[inside]] = restore(s.array("weight")[own[inside]])
        return out


@dataclass
class Model:
    total: int  # training tokens
    distinct: int
    docs: int
    floor: float  # words of fewer occurrences are in no n-gram and go without a number
    levels: list[Level]  # levels[0] has level 1
    known: dict[bytes, int] = field(default_factory=dict)  # places in `met` of words that have come up
    met: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # numbers and counts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "met": np.zeros((0, 2), np.int64)}

    @property
    def begin(self) -> int:
        """The number that begins texts, one more than those of words."""
        return self.distinct

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def _look_up(self, new: list[bytes]) -> None:
        """Remembers words that haven't come up."""
        codes = np.fromiter(map(code, new), U, len(new))
        order = np.argsort(codes)
        number, count = self.levels[0].words(codes[order]) if self.levels else (np.full(len(new), -1, np.int64), np.zeros(len(new), np.int64))
        number[count < self.floor] = -1
        self.known.update(zip([new[i] for i in order.tolist()], range(len(self.met), len(self.met) + len(new)), strict=True))
        self.met = np.concatenate([self.met, np.stack([number, count], axis=1)])

    def words(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: in no n-gram) and count of each word."""
        place = np.fromiter(map(self.known.get, some, repeat(-1)), np.int64, len(some))
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known) > REMEMBERED:
                self.known, self.met, new = {}, self.met[:0], np.arange(len(some))
            others = [some[i] for i in new.tolist()]
            self._look_up(list(set(others)))
            place[new] = np.fromiter(map(self.known.__getitem__, others), np.int64, len(new))
        return self.met[place, 0], self.met[place, 1]

    def read(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts' tokens in a row: number, count, and where each text begins."""
        parts = [tokens(t) for t in some]
        for p in parts:
            p.append(END)
        begins = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(np.int64)
        return (*self.words(list(chain.from_iterable(parts))), begins)

    def encode(self, some: list[str]) -> list[tuple[int, int, float, bytes]]:
        """(tokens, known tokens, base score, tokens' numbers) of each text."""
        number, count, begins = self.read(some)
        if not len(begins):
            return []
        ends = np.r_[begins[1:], len(number)]
        known, base = np.add.reduceat((count > 0).astype(np.int64), begins), np.add.reduceat(self.base_log(count), begins)
        small = number.astype(self.kind)
        return [(int(b - a), int(k), float(x), small[a:b].tobytes()) for a, b, k, x in zip(begins, ends, known, base, strict=True)]

    @property
    def kind(self) -> type:
        """Type of kept numbers."""
        return np.int32 if self.begin < 1 << 31 else np.int64

    def decode(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' numbers in a row, and where each begins."""
        number = np.frombuffer(b"".join(codes), self.kind).astype(np.int64)
        return number, np.r_[0, np.cumsum([len(c) // np.dtype(self.kind).itemsize for c in codes])[:-1]].astype(np.int64)

    def contexts(self, number: np.ndarray, begins: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the number of the n-gram of the order-1 tokens before it (-1: none), and of the one it ends of that order."""
        before = np.r_[-1, number[:-1]]
        before[begins] = self.begin
        here = number
        for n in range(2, order + 1):
            found = np.full(len(here), -1, np.int64)
            ok = (before >= 0) & (number >= 0)
            found[ok] = self.levels[n - 1].find(before[ok], number[ok]) if n <= len(self.levels) else -1
            if n == order:
                return before, found
            here = found
            before = np.r_[-1, here[:-1]]
            before[begins] = -1
        return before, here

    def score(self, codes: list[bytes], base: np.ndarray) -> np.ndarray:
        """Scores of texts from their tokens' numbers and base scores: what the levels change of the base score."""
        number, begins = self.decode(codes)
        if not len(begins):
            return np.zeros(0)
        own, some = np.zeros(len(number)), np.flatnonzero(number >= 0)
        own[some] = self.base_log(self.levels[0].take("count", number[some])) if len(some) else 0
        change = np.zeros(len(number))
        before = np.r_[-1, number[:-1]]
        before[begins] = self.begin
        for level in self.levels[1:]:
            ok = np.flatnonzero(before >= 0)
            found = np.full(len(number), -1, np.int64)
            fit = ok[number[ok] >= 0]
            found[fit] = level.find(before[fit], number[fit])
            hit = np.flatnonzero(found >= 0)
            miss = ok[found[ok] < 0]
            change[miss] += level.weights(before[miss])
            change[hit] = restore(level.take("log", found[hit])) - own[hit]
            before = np.r_[-1, found[:-1]]
            before[begins] = -1
        return base + np.add.reduceat(change, begins)


# --- counting and building ---------------------------------------------------------------------------------------------------


def squeeze(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending keys and their counts as bytes: differences, byte by byte, compressed."""
    wide = np.r_[np.diff(keys, prepend=0), times].view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(wide).tobytes(), 1)


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]
    return np.cumsum(wide[: len(wide) // 2]), wide[len(wide) // 2 :]


class Sums:
    """Counts by key that are merged whenever what is new outgrows what is there, so that memory is bounded by the different keys."""

    def __init__(self) -> None:
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.new.append((keys, times))
        self.size += len(keys)
        if self.size > max(MERGED, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
            times = np.concatenate([self.times, *(t for _, t in self.new)])
            order = np.argsort(keys, kind="stable")  # of ascending runs
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.times = keys[first], np.add.reduceat(times[order], first) if len(first) else times
            self.new, self.size = [], 0
        return self.keys, self.times

    def split(self, starts: np.ndarray) -> pa.RecordBatch:
        """(range, counts): what there is, cut at the ranges' first keys."""
        keys, times = self.merge()
        cut = np.r_[np.searchsorted(keys, starts), len(keys)]
        some = np.flatnonzero(cut[1:] > cut[:-1])
        blobs = [squeeze(keys[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "counts"])


COUNTS = "range long, counts binary"


SEGMENTS = "first string, n long, path string, parts string, size string"


def _saved(first: int, n: int, arrays: dict[str, np.ndarray], size: dict[str, int], folder: str) -> pa.RecordBatch:
    """The row of a segment that is written to the folder."""
    path, layout = save(folder, arrays)
    return pa.RecordBatch.from_pydict({"first": [str(first)], "n": [n], "path": [path], "parts": [repr(layout)], "size": [repr(size)]})


def _listed(rows: DataFrame) -> list[Segment]:
    """Segments in their order; one small row each reaches the driver."""
    out, base = [], 0
    for r in sorted(rows.collect(), key=lambda r: int(r.first)):
        out.append(Segment(int(r.first), base, r.n, r.path, ast.literal_eval(r.parts), ast.literal_eval(r.size)))
        base += r.n
    return out


def _merged(counts: DataFrame, ranges: int, build, folder: str) -> list[Segment]:
    """A segment for each range of counts that build() makes something of: (first, n, arrays, sizes) or nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at = Sums(), None

        def out() -> Iterator[pa.RecordBatch]:
            if len(sums.merge()[0]) and (made := build(sums.keys, sums.times)):
                yield _saved(*made, folder)

        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i != at:
                    yield from out()
                    sums, at = Sums(), i
                sums.add(*unsqueeze(blob.as_buffer()))
        yield from out()

    return _listed(counts.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(run, SEGMENTS))


def _build_words(keys: np.ndarray, n: np.ndarray):
    codes = unsigned(keys)
    s = EliasFano.of(codes, 1 << 64)
    kind = np.uint32 if n.max() < 1 << 32 else np.int64
    end = n[keys == signed(np.array([code(END)], U))]
    return int(codes[0]), len(codes), _sequence_arrays("hash", s) | {"count": n.astype(kind)}, {"hash": s.width, "tokens": int(n.sum()), "ends": int(end.sum())}


def train(docs: DataFrame, order: int = ORDER, share: float = SHARE, least: int = LEAST) -> Model:
    """A model of all rows of docs (text); see the module's notes. The segments lie in a new folder of the shared one."""
    model, folder = train_words(docs, share, least)
    return train_levels(encode(docs, model, []), model, folder, order, least)


def train_words(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> tuple[Model, str]:
    """The model with level 1, and the folder for the other levels."""
    spark: SparkSession = docs.sparkSession
    folder = scratch(spark, "ngram")
    docs = docs.select("text")
    ranges = max(1, docs.rdd.getNumPartitions())  # a range has about as many words as a split of the input
    starts = np.array([(i << 64) // ranges - (1 << 63) for i in range(ranges)], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = Sums(), Counter()

        def add() -> None:
            codes = signed(np.fromiter(map(code, counts), U, len(counts)))
            order = np.argsort(codes)
            sums.add(codes[order], np.fromiter(counts.values(), np.int64, len(counts))[order])
            counts.clear()

        for batch in batches:
            for t in texts(batch):
                counts.update(tokens(t))
            counts[END] += batch.num_rows
            if len(counts) > REMEMBERED:
                add()
                if len(sums.keys) > 2 * MERGED:
                    yield sums.split(starts)
                    sums = Sums()
        add()
        yield sums.split(starts)

    words = Level(_merged(docs.mapInArrow(count, COUNTS), ranges, _build_words, folder))
    total, ends = (sum(s.size[k] for s in words.segments) for k in ("tokens", "ends"))
    distinct = sum(s.n for s in words.segments)
    if not distinct:
        return Model(0, 0, 0, 0, []), folder
    return Model(total, distinct, ends, max(least, share * total), [words]), folder


ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("codes", T.BinaryType())]


def encode(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' `keep` columns with n_tokens, n_known, base_score and codes, kept in the shared folder: texts are looked up once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a list of segments

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            some = texts(batch)
            found = [x for a, b in pieces([len(t) for t in some], CHARS_AT_ONCE) for x in shared.value.encode(some[a:b])]
            return [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)]

        return work

    return cut_lineage(map_batches(docs.select(*dict.fromkeys([*keep, "text"])), start, ENCODED, keep))


def train_levels(encoded: DataFrame, model: Model, folder: str, order: int, least: int = LEAST) -> Model:
    """The model with the levels from 2 on, from encoded texts (codes)."""
    if model.levels:
        for n in range(2, order + 1):
            model.levels.append(_level(encoded.select("codes"), model, n, least, f"{folder}/{n}"))
    return model


def _level(encoded: DataFrame, model: Model, n: int, least: int, folder: str) -> Level:
    """Level n from encoded texts and the levels below; its n-grams' beginnings and ends are n-grams of the level below.

    Tasks count n-grams, and send their counts as compressed runs to the ranges of contexts that they belong to; a range is merged by
    one task and becomes a segment. There is a range for every RAW training tokens.
    """
    wide = model.begin + 1
    contexts = wide if n == 2 else sum(s.n for s in model.levels[n - 2].segments)
    ranges = max(1, -(-model.total // RAW))
    starts = np.array([-(-i * contexts // ranges) for i in range(ranges)], np.int64) * wide  # first key of each range
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # the lists of segments

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        sums = Sums()
        for batch in batches:
            codes = batch.column(0).to_pylist()
            for a, b in pieces([len(c) for c in codes], CHARS_AT_ONCE):
                number, begins = m.decode(codes[a:b])
                if n == 2:
                    before, ok = np.r_[-1, number[:-1]], number >= 0
                    before[begins] = m.begin
                else:
                    _, here = m.contexts(number, begins, n - 1)
                    before, ok = np.r_[-1, here[:-1]], here >= 0
                    before[begins] = -1
                ok &= before >= 0
                keys = np.sort(before[ok] * wide + number[ok])
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                sums.add(keys[first], np.diff(np.r_[first, len(keys)]))
                if len(sums.keys) > 2 * MERGED:
                    yield sums.split(starts)
                    sums = Sums()
        yield sums.split(starts)

    def build(keys: np.ndarray, times: np.ndarray):
        m: Model = shared.value
        keys, times = keys[times >= least], times[times >= least]
        if not len(keys):
            return None
        context, word = keys // wide, keys % wide
        first, number = int(context[0]), int(context[-1] - context[0] + 1)
        own = context - first
        if n == 2:
            ids = np.arange(first, first + number)
            whole = np.where(ids < m.begin, m.levels[0].take("count", np.minimum(ids, m.begin - 1)), m.docs)
            lower = m.base_log(m.levels[0].take("count", word))
            last = word.astype(np.int64)
        else:
            whole = m.levels[n - 2].take("count", np.arange(first, first + number))
            # The lower order's probability: of the n-gram without its first word.
            last = m.levels[n - 2].find(m.levels[n - 2].take("last", context).astype(np.int64), word)
            lower = restore(m.levels[n - 2].take("log", last))
        part = (times - DISCOUNT) / whole[own]
        left = np.clip(1 - np.bincount(own, part, number), 1e-12, 1)
        log = np.log10(part + left[own] * 10**lower)
        pointer = EliasFano.of(np.searchsorted(own, np.arange(number + 1)), len(keys) + 1)
        width = int(wide).bit_length()
        arrays = _sequence_arrays("pointer", pointer) | {"word": pack(word.astype(U), width), "log": quantise(log), "weight": quantise(np.log10(left)), "count": times.astype(np.int64), "last": last}
        return first, len(keys), arrays, {"contexts": number, "pointer": pointer.width, "word": width}

    return Level(_merged(encoded.mapInArrow(count, COUNTS), ranges, build, folder))


def score_encoded(encoded: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns, n_tokens, n_known, train_tokens, base_score, score of encoded texts."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            codes = batch.column("codes").to_pylist()
            base = batch.column("base_score").to_numpy()
            found = [shared.value.score(codes[a:b], base[a:b]) for a, b in pieces([len(c) for c in codes], CHARS_AT_ONCE)]
            return [pa.array([shared.value.total] * len(codes), pa.int64()), pa.array(np.concatenate(found))]

        return work

    held = [*keep, "n_tokens", "n_known", "base_score"]
    out = map_batches(encoded.select(*held, "codes"), start, [T.StructField("train_tokens", T.LongType()), T.StructField("score", T.DoubleType())], held)
    return out.select(*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' `keep` columns with n_tokens, n_known, train_tokens, base_score and score. A null text is an end alone."""
    return score_encoded(encode(docs, model, keep), model, keep)


def score_held_out(docs: DataFrame, folds: int = 7, out: int = 2, order: int = ORDER, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    The model learns from all rows whose fold (crc32 of the id as text, modulo folds; null counts as empty text) is not `out`. Null
    and empty texts are an end alone; rows that repeat are counted and scored as often; other columns are ignored. Without a training
    row every probability is 1 and every score 0. Words are told apart by 64-bit hashes.
    """
    flagged = docs.select("doc_id", "text", (fold("doc_id", folds) == out).alias("held_out"))
    model, folder = train_words(flagged.where("NOT held_out"), share, least)
    encoded = encode(flagged, model, ["doc_id", "held_out"])
    model = train_levels(encoded.where("NOT held_out"), model, folder, order, least)
    return score_encoded(encoded, model, ["doc_id", "held_out"])
