from collections import Counter, defaultdict

import numpy as np

from loamgrid.llm import similar, stages
from tests.llm.test_dedup import EDGE, frame, lower


def slow_sets(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower(text)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_similar(rows):
    """Smallest reachable id of each row by all pairs that share a shingle."""
    ids, holds = defaultdict(list), defaultdict(list)
    for i, t in rows:
        ids[slow_sets(t)].append(i)
    sets = list(ids)
    for k, s in enumerate(sets):
        for x in s:
            holds[x].append(k)
    next_to = defaultdict(set)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holds[x] if j > k).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                next_to[k].add(j)
                next_to[j].add(k)
    out, left = {}, set(range(len(sets)))
    while left:
        group, todo = set(), {left.pop()}
        while todo:
            group |= todo
            todo = {j for k in todo for j in next_to[k]} - group
        left -= group
        least = min((i for k in group for i in ids[sets[k]] if i is not None), default=None)
        out |= {sets[k]: least for k in group}
    return [(i, out[slow_sets(t)]) for i, t in rows]


def test_similar_groups_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(i and i + 10_000, t) for i, t in EDGE]
    words = [f"w{i}" for i in range(200)]
    for n in range(12):  # a chain in which only neighbours are similar, so that components need the pairs beside the stars
        rows.append((20_000 + n, " ".join(words[7 * n : 7 * n + 100])))
    got = similar.similar_groups(frame(spark, rows, extra=True)).collect()
    want = slow_similar(rows)
    assert len({c for _, c in want}) < len({slow_sets(t) for _, t in rows}) - 15
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(i), c) for i, c in want)
    assert similar.similar_groups(frame(spark, rows).limit(0)).collect() == []


def test_turns_and_bounds_change_no_component(spark, monkeypatch):
    """A group of differently edited copies: some link, some share keys only; with turns for any number of pairs, and with none."""
    random = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in random.choice(60, random.integers(1, 4), replace=False):
            words[k] = f"edit{random.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    want = slow_similar(rows)
    assert 5 < len({c for _, c in want}) < 115
    for worth in (0, 1 << 40):
        monkeypatch.setattr(similar, "WORTH", worth)
        got = similar.similar_groups(frame(spark, rows)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted(want)


def test_stage_drops_edited_copies_and_keeps_different_texts(spark):
    words = [f"word{i}" for i in range(300)]
    edited = words[:120] + ["another"] + words[121:]
    other = [f"word{i}" for i in range(150, 450)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(other)), (4, " ".join(words[:3])), (5, " ".join(words[:4]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.near(spark, docs, "").collect()) == [1, 3, 4, 5]


def test_keys_reach_the_similarity():
    random = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        codes = random.integers(0, 1 << 64, 108, np.uint64)
        a, b = codes[:96], codes[12:]  # Jaccard similarity 84 / 108 = 0.78
        missed += not (similar.band_keys(a) == similar.band_keys(b)).any()
    assert missed <= 2
