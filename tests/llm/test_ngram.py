import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import elias_fano, ngram

ODD = [(1001, None), (1002, ""), (1003, " \n"), (1003, " \n"), (None, "no id"), (1006, "new words only zzzyx"), (1007, "the " * 20_000)]


def test_sequences():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 5), (1, 1), (1, 1 << 64), (7, 9), (1000, 1001), (5000, 1 << 20), (3000, 1 << 64)):
        values = np.sort(rng.choice(universe, n, replace=False) if universe < 1 << 30 else np.unique(rng.integers(0, universe, n, dtype=np.uint64, endpoint=False)))
        s = elias_fano.EliasFano.of(values.astype(np.uint64), universe)
        assert (s.get(np.arange(len(values))) == values.astype(np.uint64)).all()
        if len(values):
            assert (s.find(values.astype(np.uint64)) == np.arange(len(values))).all()
            absent = np.setdiff1d(np.unique(rng.integers(0, universe, 500, dtype=np.uint64, endpoint=False)), values.astype(np.uint64))
            assert (s.find(absent) == -1).all()
    repeated = np.sort(rng.integers(0, 50, 300)).astype(np.uint64)
    assert (elias_fano.EliasFano.of(repeated, 51).get(np.arange(300)) == repeated).all()


@pytest.mark.parametrize("width", [1, 7, 31, 33, 63])
def test_packing(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 999, dtype=np.uint64)
    assert (elias_fano.unpack(elias_fano.pack(values, width), width, np.arange(999)) == values).all()


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]  # None is the end


class Slow:
    """The same model in dictionaries."""

    def __init__(self, some, order, share, least):
        self.c = Counter(w for t in some for w in split(t))
        self.n, self.v, self.order = sum(self.c.values()), len(self.c), order
        frequent = {w for w, n in self.c.items() if n >= max(least, share * self.n)}
        self.count = {(): None}
        kept = {(w,) for w in frequent} | {("<s>",)}
        total = {(w,): n for w, n in self.c.items()} | {("<s>",): len(some)}
        self.prob, self.back = [], []
        for n in range(2, order + 1):
            grams = Counter()
            for t in some:
                ws = ["<s>", *split(t)]
                for i in range(len(ws) - n + 1):
                    g = tuple(ws[i : i + n])
                    if g[:-1] in kept and g[1:] in kept:
                        grams[g] += 1
            grams = {g: k for g, k in grams.items() if k >= least}
            left = defaultdict(lambda: 1.0)
            for g, k in grams.items():
                left[g[:-1]] -= (k - ngram.DISCOUNT) / total[g[:-1]]
            self.prob.append({})
            self.back.append(left)
            self.prob[-1].update({g: (k - ngram.DISCOUNT) / total[g[:-1]] + left[g[:-1]] * self.p(g[1:-1], g[-1]) for g, k in grams.items()})
            kept, total = set(grams), grams

    def p(self, context, w):
        if not context:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        n = len(context) + 1
        if n - 2 < len(self.prob) and (*context, w) in self.prob[n - 2]:
            return self.prob[n - 2][(*context, w)]
        return (self.back[n - 2][context] if context in self.back[n - 2] else 1.0) * self.p(context[1:], w)

    def score(self, text):
        ws = ["<s>", *split(text)]
        return sum(math.log10(self.p(tuple(ws[max(0, i - self.order + 1) : i]), ws[i])) for i in range(1, len(ws)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_brute_force(spark, sf, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    got = ngram.score_held_out(df, order=order, share=1e-4).collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    slow = Slow(train, order, 1e-4, ngram.LEAST)
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        ws = split(t)
        want[str(i)].append((len(ws), sum(slow.c[w] > 0 for w in ws), sum(math.log10((slow.c[w] + 1) / (slow.n + slow.v + 1)) for w in ws), slow.score(t)))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 7 == 2) and r.train_tokens == slow.n
        n, known, base, score = want[str(r.doc_id)][0]
        assert (r.n_tokens, r.n_known) == (n, known) and abs(r.base_score - base) < 1e-6 * n
        assert abs(r.score - score) < 4e-4 * n  # rounding to 16 bits, once or a few times a token
    assert len({len(x) for x in want.values()}) == 2


def test_probabilities_sum_to_one():
    some = ["a b a b c", "b a c a b", "a b c", "c c b a"] * 3
    slow = Slow(some, 3, 0, 2)
    for context in ((), ("a",), ("a", "b"), ("<s>", "a"), ("zz",)):
        assert abs(sum(slow.p(context, w) for w in slow.c) + slow.p(context, "unseen") - 1) < 1e-9


def test_better_than_words_alone(spark):
    got = ngram.score_held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram.score_held_out(df).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = ngram.score_held_out(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score, only.score) == (3, 0, 0, 0.0, 0.0)


def test_rare_words_of_a_large_corpus_are_in_ngrams(spark):
    rows = [(i, "the of and to in " * 1000) for i in range(60)] + [(100 + i, "quorl vennit drasp") for i in range(20)]
    got = ngram.score_held_out(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("doc_id >= 100").collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    slow = Slow(train, ngram.ORDER, 0, ngram.LEAST)
    want = slow.score("quorl vennit drasp")
    assert slow.c["quorl"] < 2e-4 * slow.n and len(got) == 20
    assert all(abs(r.score - want) < 2e-3 and r.score > r.base_score + 5 for r in got)


def test_model_broadcasts_no_words(spark):
    import pickle

    sizes = [len(pickle.dumps(ngram.train(spark.createDataFrame([(" ".join(f"w{i % n}" for i in range(3 * n)),)], "text string")))) for n in (100, 20_000)]
    assert sizes[1] < 2 * sizes[0]


def test_many_segments_and_remote_folder(spark, monkeypatch):
    """A model of many small segments, read from a path that can't be mapped and kept within a bound, gives what one segment gives."""
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.score for r in ngram.score_held_out(docs).collect()}
    monkeypatch.setattr(ngram, "RAW", 100)
    model = ngram.train(docs)
    assert all(len(x.segments) > 3 for x in model.levels)
    texts = [t for _, t in rows]
    monkeypatch.setattr(ngram, "_local", lambda path: None)
    monkeypatch.setattr(ngram, "READ", 2000)
    for x in model.levels:
        for s in x.segments:
            s.path = "file://" + s.path.removeprefix("file://").removeprefix("file:")
    found = model.encode(texts)
    scores = model.score([c for *_, c in found], np.array([b for _, _, b, _ in found]))
    monkeypatch.undo()
    whole = ngram.train(docs)
    found = whole.encode(texts)
    assert np.allclose(scores, whole.score([c for *_, c in found], np.array([b for _, _, b, _ in found])))
    sizes = [a.nbytes for a in ngram._read.values()]
    assert len(want) == 200 and sum(sizes) <= max(2000, sizes[-1])


def test_rare_trigram_is_in_the_model(spark):
    """Words of two occurrences among many others take part in n-grams, whatever the corpus's size."""
    docs = spark.createDataFrame([(i, "common words here " * 300) for i in range(40)] + [(i, "zyx wvu tsr") for i in (100, 101)], "doc_id long, text string")
    model = ngram.train(docs)
    _, _, base, codes = model.encode(["zyx wvu tsr"])[0]
    assert model.score([codes], np.array([base]))[0] > base + 3
