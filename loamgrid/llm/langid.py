"""Language of every word, and so of every text, by a linear-chain conditional random field.

A word's emission is a sum of learned weights: its letter trigrams (with marks for the word's ends), its first and last three
letters, and the word itself (a hashed lexicon). Learned transitions tie neighbouring words, so that words which languages share take
the language around them, and a passage in another language is a run of its own. Forward-backward runs over whole texts: texts are
laid out in blocks of words, the blocks' transfer matrices give the messages at their borders exactly, and all blocks then run at once.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import fold, map_batches, pieces, texts

#: The fit takes at most so many labelled documents, the first by a hash of their ids, and none of more characters than FIT_CHARS.
FIT_DOCS, FIT_CHARS = 1200, 65_536
BITS = 16  # rows of a weight table: 2^BITS for trigrams, as many for affixes, as many for words
BLOCK = 64  # words
CHARS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 17
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def lowered(text: str) -> str:
    """Lower case, letter by letter, with every letter in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _mix(h: np.ndarray, part: int) -> np.ndarray:
    """Row of a weight table for 64-bit codes."""
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(part << BITS)


@dataclass
class Words:
    """The words of some texts: rows of the weight table that each one's features have."""

    doc: np.ndarray  # text that a word is in
    begin: np.ndarray  # its first letter in the text
    end: np.ndarray
    gram: np.ndarray  # rows of all letters' trigrams
    first: np.ndarray  # where each word's trigrams begin
    rest: np.ndarray  # (words, 4): end mark, first three letters, last three letters, word
    n_docs: int

    @classmethod
    def of(cls, some: list[str]) -> Words:
        codes = [np.frombuffer(lowered(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in some]
        ends = np.cumsum([len(c) + 1 for c in codes])
        code = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.uint32))]) if some else np.zeros(0, np.uint32)
        is_letter = letters()[code]
        at = np.flatnonzero(is_letter)
        z = np.where(is_letter, code, 0).astype(np.uint64)
        before = np.r_[np.zeros(3, np.uint64), z]
        z1 = before[at + 2]
        z2 = np.where(z1 > 0, before[at + 1], 0)
        k1, k2, k3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
        gram = _mix(z2 * k1 + z1 * k2 + z[at] * k3, 0)
        first = np.flatnonzero(z1 == 0)
        size = np.diff(np.r_[first, len(at)])
        begin = at[first]
        last = begin + size - 1
        after = np.r_[z, np.zeros(3, np.uint64)]
        second = after[begin + 1]
        third = np.where(size > 2, after[begin + 2], 0)
        power = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
        where = np.arange(len(at)) - np.repeat(first, size)
        whole = np.add.reduceat((z[at] + np.uint64(1)) * k1 * power[where & 63], first) if len(first) else np.zeros(0, np.uint64)
        whole ^= whole >> np.uint64(29)
        l1, l2 = np.where(size > 1, before[last + 2], 0), np.where(size > 2, before[last + 1], 0)
        rest = np.stack([_mix(l1 * k1 + z[last] * k2 + k3, 0), _mix(z[begin] * k1 + second * k2 + third * k3 + k1, 1), _mix(l2 * k1 + l1 * k2 + z[last] * k3 + k2, 1), _mix(whole, 2)], 1)
        doc = np.searchsorted(ends, begin, "right")
        start = np.r_[0, ends[:-1]][doc] if len(some) else begin
        return cls(doc, begin - start, last + 1 - start, gram, first, rest, len(some))

    @classmethod
    def of_many(cls, some: list[str]) -> Words:
        """As of(), piece by piece, so that only the rows of features are held for all texts."""
        parts = [(a, cls.of(some[a:b])) for a, b in pieces([len(t) for t in some], CHARS_AT_ONCE)]
        if not parts:
            return cls.of([])
        shift = np.cumsum([0, *(len(w.gram) for _, w in parts[:-1])])
        join = lambda name: np.concatenate([getattr(w, name) for _, w in parts])
        doc = np.concatenate([w.doc + a for a, w in parts])
        return cls(doc, join("begin"), join("end"), join("gram"), np.concatenate([w.first + n for (_, w), n in zip(parts, shift, strict=True)]), join("rest"), len(some))

    def runs(self) -> list[tuple[slice, slice]]:
        """Words and their trigrams, in runs of at most WORDS_AT_ONCE words."""
        ends = np.r_[self.first, len(self.gram)]
        n = len(self.first)
        return [(slice(a, b := min(n, a + WORDS_AT_ONCE)), slice(int(ends[a]), int(ends[b]))) for a in range(0, n, WORDS_AT_ONCE)]

    def emissions(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.first), weight.shape[1]), weight.dtype)
        for w, g in self.runs():
            out[w] = np.add.reduceat(weight[self.gram[g]], self.first[w] - g.start, axis=0) + weight[self.rest[w]].sum(1)
        return out

    def gradient(self, g: np.ndarray, rows: int) -> np.ndarray:
        """Sum over words of g for each row of the weight table."""
        size = np.diff(np.r_[self.first, len(self.gram)])
        out = np.zeros((rows, g.shape[1]))
        for w, t in self.runs():
            for k in range(g.shape[1]):
                out[:, k] += np.bincount(self.gram[t], np.repeat(g[w, k], size[w]), rows) + np.bincount(self.rest[w].ravel(), np.repeat(g[w, k], 4), rows)
        return out


def forward_backward(emission: np.ndarray, doc: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word's label and the expected number of each transition.

    emission: log potentials (words, labels); doc: ascending text number of each word; step: transition potentials with rows that
    sum to 1 (the chain begins as if after a word of each label alike).
    """
    n, k = emission.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    e = np.exp(emission - emission.max(1, keepdims=True)).astype(np.float64) + 1e-30
    opens = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[opens, n])
    place = np.arange(n) - np.repeat(opens, size)
    blocks = -(-size // BLOCK)
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    block, slot = np.repeat(first, size) + place // BLOCK, place % BLOCK
    b = int(blocks.sum())
    x = np.ones((BLOCK, b, k))  # slots beyond a text's end: potentials 1, which leave backward messages as they are
    x[slot, block] = e
    enter, leave = np.full((b, k), 1.0 / k), np.ones((b, k))
    longest = int(blocks.max())
    if longest > 1:
        through = np.broadcast_to(np.eye(k), (b, k, k))
        for s in range(BLOCK):
            through = (through.reshape(-1, k) @ step).reshape(b, k, k) * x[s][:, None, :]
            through = through / through.max((1, 2), keepdims=True)
        by_size = np.argsort(-blocks, kind="stable")
        count = np.array([np.searchsorted(-blocks[by_size], -i, "right") for i in range(longest + 1)])  # texts of at least i blocks
        for i in range(1, longest):
            at = first[by_size[: count[i + 1]]] + i
            v = np.einsum("bi,bij->bj", enter[at - 1], through[at - 1])
            enter[at] = v / v.sum(1, keepdims=True)
        for i in range(longest - 2, -1, -1):
            at = first[by_size[: count[i + 2]]] + i
            v = np.einsum("bij,bj->bi", through[at + 1], leave[at + 1])
            leave[at] = v / v.sum(1, keepdims=True)
    ahead = np.empty_like(x)
    a = enter
    for s in range(BLOCK):
        a = (a @ step) * x[s]
        a = a / a.sum(1, keepdims=True)
        ahead[s] = a
    back, pairs = leave, np.zeros((k, k))
    real = np.zeros((BLOCK, b), bool)
    real[slot, block] = True
    fresh = np.zeros(b, bool)
    fresh[first] = True
    for s in range(BLOCK - 1, -1, -1):
        here = x[s] * back
        prior = ahead[s - 1] if s else enter
        use = real[s] if s else real[s] & ~fresh
        norm = np.einsum("bi,ij,bj->b", prior[use], step, here[use])
        pairs += (prior[use] / norm[:, None]).T @ here[use] * step
        ahead[s] *= back
        back = here @ step.T
        back = back / back.sum(1, keepdims=True)
    out = ahead[slot, block]
    return out / out.sum(1, keepdims=True), pairs


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray
    step: np.ndarray

    def marginals(self, words: Words) -> np.ndarray:
        return forward_backward(words.emissions(self.weight), words.doc, self.step)[0]

    def predict(self, some: list[str]) -> list[tuple[str, float]]:
        """Language and score (its share of the words' posteriors) of each text."""
        words = Words.of(some)
        count = np.bincount(words.doc, minlength=len(some))
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(some)
        m = self.marginals(words)
        share = np.stack([np.bincount(words.doc, m[:, i], len(some)) for i in range(len(self.langs))], 1) / np.maximum(count, 1)[:, None]
        best = share.argmax(1)
        return [(self.langs[b], min(1.0, float(s[b]))) if n else (UNDETERMINED, 0.0) for b, s, n in zip(best, share, count, strict=True)]


def train(some: list[str], langs: list[str], rounds: int = 25, chain_rounds: int = 12, rate: float = 0.5) -> Model:
    """Texts and their languages to a model.

    First every word takes its text's language and the emissions alone are fitted. Then words are labelled anew by
    forward-backward with sticky transitions, which gives passages in another language their own labels, and emissions and
    transitions are fitted together by the field's gradient: observed less expected counts.
    """
    names = sorted(set(langs))
    k, rows = len(names), 3 << BITS
    if not k:
        return Model([], np.zeros((rows, 0), np.float32), np.zeros((0, 0)))
    words = Words.of_many(some)
    label = np.array([names.index(x) for x in langs])[words.doc] if len(words.doc) else np.zeros(0, np.int64)
    weight, seen = np.zeros((rows, k)), np.full((rows, k), 1e-3)

    def climb(truth: np.ndarray, guess: np.ndarray) -> None:
        g = words.gradient(truth - guess, rows) - 0.05 * weight
        np.add(seen, g * g, out=seen)
        np.add(weight, rate * g / np.sqrt(seen), out=weight)

    truth = np.eye(k)[label]
    for _ in range(rounds):
        e = words.emissions(weight)
        p = np.exp(e - e.max(1, keepdims=True)) if len(e) else e
        climb(truth, p / p.sum(1, keepdims=True) if len(p) else p)
    step = np.full((k, k), 0.05 / max(1, k - 1))
    np.fill_diagonal(step, 0.95 if k > 1 else 1.0)
    m, _ = forward_backward(words.emissions(weight), words.doc, step)
    hard = m.argmax(1) if len(m) else label
    truth = np.eye(k)[hard]
    same = words.doc[1:] == words.doc[:-1]
    observed = np.zeros((k, k))
    np.add.at(observed, (hard[:-1][same], hard[1:][same]), 1.0)
    potential, pull = np.log(step), np.full((k, k), 1e-3)
    for _ in range(chain_rounds):
        m, expected = forward_backward(words.emissions(weight), words.doc, step)
        climb(truth, m)
        g = observed - expected
        pull += g * g
        potential += rate * g / np.sqrt(pull)
        step = np.exp(potential - potential.max(1, keepdims=True))
        step = step / step.sum(1, keepdims=True) * 0.999 + 0.001 / k  # no transition is ruled out
    return Model(names, weight.astype(np.float32), step)


def fit(docs: DataFrame, folds: int = 5, fit_docs: int = FIT_DOCS) -> Model:
    """A model of at most fit_docs documents (doc_id, text, lang) that are not held out and have a text and a language."""
    usable = docs.where((fold("doc_id", folds) != 0) & F.col("lang").isNotNull() & (F.length("text") <= FIT_CHARS)).withColumn("_h", F.xxhash64("doc_id"))
    most = usable.select("_h").orderBy("_h").limit(fit_docs).agg(F.max("_h")).first()[0]
    rows = usable.where(F.col("_h") <= F.lit(most)).select("text", "lang").limit(fit_docs).collect() if most is not None else []
    return train([r.text for r in rows], [r.lang for r in rows])


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' `keep` columns with lang_pred and score. A null text and one without a letter are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: 3 * 2^BITS rows of weights

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            some = texts(batch)
            found = [x for a, b in pieces([len(t) for t in some], CHARS_AT_ONCE) for x in shared.value.predict(some[a:b])]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return work

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), start, PREDICTED, keep)


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, begin, end, lang, n_words: the runs of words of one language in each text, by characters. No words: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids, some = batch.column("doc_id").to_pylist(), texts(batch)
            for a, b in pieces([len(t) for t in some], CHARS_AT_ONCE):
                words = Words.of(some[a:b])
                if not len(words.doc) or not shared.value.langs:
                    continue
                best = shared.value.marginals(words).argmax(1)
                cut = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (words.doc[1:] != words.doc[:-1])])
                last = np.r_[cut[1:], len(best)] - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[a + i] for i in words.doc[cut]], pa.int64()), pa.array(words.begin[cut]), pa.array(words.end[last]), pa.array([shared.value.langs[i] for i in best[cut]]), pa.array(last - cut + 1)],
                    names=["doc_id", "begin", "end", "lang", "n_words"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, begin long, end long, lang string, n_words long")


def predict_held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang); other columns are ignored.

    The model learns from rows whose fold (crc32 of the id as text, modulo folds; null counts as empty text) is not 0. Rows that
    repeat are predicted as often. An empty table, or one without a label, gives `und` for every row that there is.
    """
    ready = docs.select("doc_id", "text", (fold("doc_id", folds) == 0).alias("held_out"))
    return identify(ready, fit(docs, folds), ["doc_id", "held_out"])
