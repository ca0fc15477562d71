"""Toxicity by a lexicon that is learned from labels, searched with spelling errors, and weighed by context.

Lexicon: words and stems whose share of toxic documents is far above the base rate, chosen greedily until each toxic document of the
fit has several. Search: the Levenshtein automata of all entries are intersected with the lexicon's trie, one automaton whose states
are sets of (trie node, errors so far); its transitions are worked out when first needed and kept. Context: hits inside quotation
marks and near words of reporting count as quotation in part, the rest as abuse; a logistic regression on the hits' masses gives the
score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import fold, map_batches, texts

#: The fit takes at most so many labelled documents, the first by a hash of their ids, and none of more characters than FIT_CHARS.
FIT_DOCS, FIT_CHARS = 6000, 65_536
STEM_SIZES = (4, 5, 6)  # characters of a stem entry
MIN_DOCS, COVER = 5, 3  # toxic documents that an entry needs; entries that a toxic document gets
REMEMBERED = 500_000
WINDOW = 8  # words to each side that a hit is judged by
DENSE_REACH = 200  # characters to each side within which hits are massed
#: Transitions of the automaton that a worker keeps; beyond, it begins anew, which changes no result.
KEPT_TRANSITIONS = 1_000_000

WORD = re.compile(r"\w+(?:[@$*!]+\w+)*")
#: Signs that stand for letters, marks of quotation, words of reporting in four languages.
SIGNS = str.maketrans("013457@$!", "oieastasi")
OPENING, CLOSING = "\"'“„«‹‘”", "\"'”“»›’"
REPORTING = frozenset(
    "said says say wrote writes called calls quote quoted quotes quoting reported reports report term word slur insult "
    "sagte sagt schrieb nannte zitat zitiert berichtet wort beleidigung "
    "dit écrit appelé cite citation rapporte mot insulte "
    "dijo dice escribió llamó cita citó informa palabra insulto".split()
)


def allowed(size: int) -> int:
    """Spelling errors that an entry of so many characters allows."""
    return 0 if size < 5 else 1 if size < 9 else 2


class Lexicon:
    """Trie of words and stems, and the lazily built automaton that finds them with errors."""

    def __init__(self, entries: list[str]) -> None:
        """An entry that ends with * is a stem: what follows it doesn't matter."""
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]  # errors that the entry ending here allows
        self.stem: list[int | None] = [None]  # errors that the stem ending here allows
        for entry in entries:
            node = 0
            for c in entry.rstrip("*"):
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(None)
                    self.stem.append(None)
            if entry.endswith("*"):
                self.stem[node] = allowed(len(entry) - 2)  # any ending goes, so that an error counts as in a word one shorter
            else:
                self.ends[node] = allowed(len(entry))
        self.most = max((e for e in self.ends + self.stem if e is not None), default=0)
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[bool, bool]] = []  # of each state: whether an entry ends here exactly, with errors
        self.stemmed: list[int] = []  # 2: a stem ends here exactly, 1: with errors
        self.transitions = 0
        self.start = self._state({(0, 0)})
        self.dead = self._state(set())

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # skipping a letter of the entry is an error that reads nothing
            node, errors = todo.pop()
            if errors <= self.most and errors < best.get(node, 99):
                best[node] = errors
                todo += [(child, errors + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.found.append((any(self.ends[n] is not None and e == 0 for n, e in key), any(self.ends[n] is not None and 0 < e <= self.ends[n] for n, e in key)))
            self.stemmed.append(max((2 if e == 0 else 1 for n, e in key if self.stem[n] is not None and e <= self.stem[n]), default=0))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        pairs = set()
        for node, errors in self.sets[state]:
            pairs.add((node, errors + 1))  # c is one too many
            for letter, child in self.children[node].items():
                pairs.add((child, errors + (letter != c)))
        self.next[state][c] = new = self._state(pairs)
        self.transitions += 1
        return new

    def match(self, word: str) -> int:
        """2 if the word is an entry or has its stem, 1 if it is one or begins with a stem but for allowed errors, else 0."""
        if self.transitions > KEPT_TRANSITIONS:
            self._begin()
        state, following, dead, stemmed = self.start, self.next, self.dead, 0
        for c in word:
            to = following[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == dead:
                return stemmed
            if self.stemmed[state] > stemmed:
                stemmed = self.stemmed[state]
                if stemmed == 2:
                    return 2
        exact, near = self.found[state]
        return 2 if exact else int(near or stemmed)


def densest(at: list[int], mass: list[float], reach: int = DENSE_REACH) -> float:
    """The largest mass of hits less than `reach` characters from one of them, by two ends that move along the ascending places."""
    best = total = 0.0
    first = last = 0
    for x in at:
        while last < len(at) and at[last] < x + reach:
            total += mass[last]
            last += 1
        while at[first] <= x - reach:
            total -= mass[first]
            first += 1
        best = max(best, total)
    return best


@dataclass
class Model:
    entries: list[str]
    weights: list[float] = field(default_factory=list)
    bias: float = -3.0
    lexicon: Lexicon | None = None
    known: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None, "known": {}}

    def kind(self, word: str) -> int:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.entries)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = self.lexicon.match(word)
        if found < 2 and not word.isalpha():
            found = max(found, min(1, self.lexicon.match(word.translate(SIGNS))))
        self.known[word] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, int, float]]:
        """(begin, end, kind, share of quotation) of each hit in a text."""
        low = text.lower()
        known, kind = self.known, self.kind
        words = WORD.findall(low)
        get = known.get
        if not any([get(w, 3) for w in words]):
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        out = []
        for i, w in enumerate(words):
            if found := (known[w] if w in known else kind(w)):
                begin, end = spans[i]
                first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
                left, right = low[max(0, spans[first][0] - 2) : begin], low[end : spans[last][1] + 2]
                marked = re.search(rf"[{OPENING}](?:[^{CLOSING}]*\s)?$", left) and re.search(rf"[{CLOSING}](?!\w)", right)
                told = any(x in REPORTING for x in words[first : last + 1])
                out.append((begin, end, found, (0.6 if marked else 0.0) + (0.3 if marked and told else 0.1 if told else 0.0)))
        return out

    def features(self, text: str) -> list[float]:
        """Masses of abuse: whether any, how many, of misspelt ones, the most in one window, a hundred words' worth."""
        hits = self.hits(text)
        if not hits:
            return [0.0] * 5
        abuse = [1 - q for *_, q in hits]
        exact = sum(a for a, h in zip(abuse, hits, strict=True) if h[2] == 2)
        near = sum(abuse) - exact
        dense = densest([h[0] for h in hits], abuse)
        return [float(exact >= 0.5), math.log1p(exact), math.log1p(near), math.log1p(dense), math.log1p(2000 * (exact + near) / (len(text) + 100))]

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[list[float], float]:
    """Logistic regression with non-negative weights, by Newton steps that put negative weights to zero."""
    n, k = x.shape
    used, w = np.ones(k, bool), np.zeros(k + 1)
    design = np.c_[x, np.ones(n)]
    while True:
        at = np.r_[used, True]
        a, v = design[:, at], np.zeros(at.sum())
        keep = np.full(len(v), ridge)
        keep[-1] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
            v = v + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * v)
        w[:] = 0
        w[at] = v
        if (w[:-1] >= 0).all():
            return [float(z) for z in w[:-1]], float(w[-1])
        used &= w[:-1] >= 0


def choose(counts: list[tuple[str, int, int]], members: dict[str, list[int]], toxic: int, clean: int) -> list[str]:
    """Entries: by toxic documents, those far above the base rate, until each toxic document of the fit has COVER of them."""
    base = toxic / max(1, toxic + clean)
    limit = math.log(max(2, len(counts))) + 5

    def surprise(p: int, n: int) -> float:  # exponent of the chance of such a share at the base rate
        share = p / (p + n)
        q = min(max(base, 1e-9), 1 - 1e-9)
        return (p + n) * (share * math.log(share / q) + (0 if share == 1 else (1 - share) * math.log((1 - share) / (1 - q)))) if share > q else 0.0

    good = [(t, p, n) for t, p, n in counts if p >= MIN_DOCS and p >= 4 * n and surprise(p, n) > limit]
    good.sort(key=lambda x: (-(x[1] - 2 * x[2]), x[0].endswith("*"), -len(x[0]), x[0]))
    covered: dict[int, int] = defaultdict(int)
    out: list[str] = []
    for t, _, _ in good:
        if any(t.startswith(e[:-1]) for e in out if e.endswith("*")) or (t.endswith("*") and any(e.startswith(t[:-1]) for e in out)):
            continue
        mine = members.get(t, [])
        if sum(covered[d] < COVER for d in mine) >= MIN_DOCS:
            out.append(t)
            for d in mine:
                covered[d] += 1
    return out


def labelled(docs: DataFrame, labels: DataFrame, folds: int, fit_docs: int) -> DataFrame:
    """doc_id, text, toxic of the documents to learn from. A document with several labels takes the largest; null labels don't count."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    most = known.select("_h").orderBy("_h").limit(fit_docs).agg(F.max("_h")).first()[0]
    some = known.where(F.col("_h") <= F.lit(most if most is not None else 0)).limit(fit_docs).drop("_h")
    return docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(some), "doc_id")  # at most fit_docs rows


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fit_docs: int = FIT_DOCS) -> Model:
    rows = labelled(docs, labels, folds, fit_docs).persist(StorageLevel.DISK_ONLY)
    try:
        totals = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic or not clean:
            return Model([], [], -3.0 if not toxic else 3.0)
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{4,})"), 1))
        stems = F.flatten(F.transform(words, lambda w: F.filter(F.array(*(F.when(F.length(w) > n, F.concat(F.left(w, F.lit(n)), F.lit("*"))) for n in STEM_SIZES)), lambda s: s.isNotNull())))
        entries = rows.select("doc_id", (F.col("toxic") > 0).alias("bad"), F.explode(F.array_distinct(F.concat(words, stems))).alias("entry"))
        counts = entries.groupBy("entry").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).where((F.col("p") >= MIN_DOCS) & (F.col("p") >= 4 * F.col("n")))
        # Of a bounded fit: at most its toxic documents' entries reach the driver.
        of = entries.where("bad").join(counts, "entry").groupBy("entry", "p", "n").agg(F.collect_list("doc_id").alias("docs")).collect()
        chosen = choose([(r.entry, r.p, r.n) for r in of], {r.entry: r.docs for r in of}, toxic, clean)
        model = Model(chosen)

        def start():
            return lambda batch: [pa.array([model.features(t) for t in texts(batch)], pa.list_(pa.float64()))]

        got = map_batches(rows, start, [T.StructField("x", T.ArrayType(T.DoubleType()))], ["toxic"]).collect()
        weights, bias = regression(np.array([r.x for r in got]), np.array([float(r.toxic > 0) for r in got]))
        return Model(chosen, weights, bias)
    finally:
        rows.unpersist()


SCORED = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' `keep` columns with score and predicted. Null and empty texts have the score of a text without a hit."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [model.score(t) for t in texts(batch)]
            return [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]

        return work

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), start, SCORED, keep)


def toxic_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, begin, end, exact, quotation: a row for each hit of the lexicon in the texts, by characters of the lower-cased text."""

    def run(batches):
        for batch in batches:
            out = [(i, b, e, k == 2, q) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True) for b, e, k, q in model.hits(t)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate((("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_()), ("quotation", pa.float64())))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, begin long, end long, exact boolean, quotation double")


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); other columns are ignored.

    Learns from labels (doc_id, toxic) of rows whose fold (crc32 of the id as text, modulo folds) is not 0. Without a label of
    either kind every text has the same score. Rows that repeat are scored as often; an empty table gives an empty result.
    """
    ready = docs.select("doc_id", "text", (fold("doc_id", folds) == 0).alias("held_out"))
    return score(ready, fit(docs, labels, folds), ["doc_id", "held_out"])
