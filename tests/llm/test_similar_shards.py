"""The near stage takes few shuffles whatever the data: over many partitions their files and log lines take more disk than the rows."""

import numpy as np
import pyarrow as pa

from loamgrid.llm import similar
from tests.llm.test_dedup import frame
from tests.llm.test_similar import slow_similar


def test_a_large_group_takes_few_shuffles(spark):
    random = np.random.default_rng(11)
    rows = []
    for i in range(150):  # differently edited copies: the links to a shard's first text leave many apart
        words = [f"b{k}" for k in range(60)]
        for k in random.choice(60, random.integers(1, 4), replace=False):
            words[k] = f"edit{random.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    count = spark.sparkContext._jsc.sc().newShuffleId
    before = count()
    got = similar.similar_groups(frame(spark, rows)).collect()
    assert count() - before - 1 <= 40
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(slow_similar(rows))


def cut(table, step):
    return iter(table.to_batches(max_chunksize=step))


def test_keys_with_their_first_rows_in_any_batches():
    random = np.random.default_rng(3)
    rows = sorted({(int(k), int(n)) for k, n in zip(random.integers(-20, 20, 90), random.integers(-500, 500, 90), strict=True)} | {(7, n) for n in range(1000, 1030)})
    table = pa.table({"key": [k for k, _ in rows], "node": [n for _, n in rows], "size": [n * 2 for _, n in rows], "fp": [n * 3 for _, n in rows]})
    first = {k: min(n for x, n in rows if x == k) for k, _ in rows}
    many = {k for k in first if sum(x == k for x, _ in rows) > 1}
    assert 0 < len(many) < len(first)
    want = [(k, n, 2 * n, 3 * n, first[k], 2 * first[k], 3 * first[k]) for k, n in rows if k in many]
    for step in (1, 2, 3, 7, len(rows)):
        assert [tuple(r.values()) for b in similar._headed(cut(table, step)) for r in b.to_pylist()] == want


def test_keys_of_several_components_in_any_batches():
    random = np.random.default_rng(4)
    key = np.sort(random.integers(0, 40, 120))
    component = np.where(key % 3 == 0, key, random.integers(0, 3, 120))
    table = pa.table({"key": key, "node": np.arange(120), "fp": np.arange(120), "component": component})
    want = [n for n in range(120) if len(set(component[key == key[n]])) > 1]
    assert 0 < len(want) < 120
    for step in (1, 2, 7, 120):
        assert [n for b in similar._apart(cut(table, step)) for n in b.column("node").to_pylist()] == want


def test_counted_shingles_bound_what_is_shared(monkeypatch):
    random = np.random.default_rng(5)
    pool = random.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.unique(random.choice(pool, 40)) for _ in range(9)] + [np.zeros(0, np.uint64), np.unique(random.integers(0, 1 << 64, 50, np.uint64))]
    true = [sum(any(c in o for j, o in enumerate(sets) if j != i) for c in x) for i, x in enumerate(sets)]
    for bits in (24, 6):  # with the smaller table places are shared by codes
        monkeypatch.setattr(similar, "TABLE", bits)
        assert all(got >= want for got, want in zip(similar._shared(sets), true, strict=True))
    monkeypatch.setattr(similar, "TABLE", 24)
    assert similar._shared(sets)[-1] < 10
