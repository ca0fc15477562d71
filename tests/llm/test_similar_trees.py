"""The near stage's candidates: SimHash fingerprints within a radius, found by the shards' BK-trees and checked where they stand."""

from math import comb

import numpy as np
import pyarrow as pa

from loamgrid.llm import similar, simhash


def differ(n, m, shared):
    """Probability that a bit of the fingerprints of two sets of random hashes differs."""
    over = lambda size, own, k: sum(comb(own, i) for i in range(own + 1) if 2 * (k + i) > size) / 2**own
    total = 0.0
    for k in range(shared + 1):
        p, q = over(n, n - shared, k), over(m, m - shared, k)
        total += comb(shared, k) / 2**shared * (p * (1 - q) + q * (1 - p))
    return total


def test_radius_reaches_the_similarity():
    worst = max(differ(n, m, s) for n in range(1, 41) for m in range(n, 51) for s in range(1, n + 1) if s < m and s >= similar.SIMILARITY * (n + m - s))
    lost = sum(comb(64, k) * worst**k * (1 - worst) ** (64 - k) for k in range(similar.RADIUS + 1, 65))
    assert lost < 2e-6
    random = np.random.default_rng(2)
    for n, m, shared in ((4, 5, 4), (9, 9, 8), (90, 90, 80), (400, 500, 400)):
        for _ in range(300):
            codes = random.integers(0, 1 << 64, n + m - shared, np.uint64)
            assert (simhash.majority(codes[:n]) ^ simhash.majority(codes[n - shared :])).bit_count() <= similar.RADIUS


def test_fingerprint_is_that_of_the_set():
    """Repeated shingles count once, as in the similarity: one set has one fingerprint."""
    words = [f"w{i}" for i in range(40)]
    once, again = similar.shingles(" ".join(words)), similar.shingles(" ".join(words + words[:20] + words[:20]))
    assert (simhash.majority(once) ^ simhash.majority(again)).bit_count() <= similar.RADIUS
    assert simhash.majority(np.zeros(0, np.uint64)) == 0


def test_shards_by_brute_force():
    """Two shards with texts of several similarities, some in both: components as by all pairs that share a key."""
    random = np.random.default_rng(7)
    sets = []
    for _ in range(12):
        base = random.integers(0, 1 << 64, 60, np.uint64)
        for _ in range(10):
            own = base.copy()
            own[random.choice(60, random.integers(0, 9), replace=False)] = random.integers(0, 1 << 64, 1, np.uint64)
            sets.append(np.unique(own))
    shard = [(0,) if i % 3 == 0 else (1,) if i % 3 == 1 else (0, 1) for i in range(len(sets))]
    rows = sorted((10 + b, i) for i, bs in enumerate(shard) for b in bs)
    node = np.array([i for _, i in rows])
    keys = [[10 if 0 in shard[i] else -1 - i, 11 if 1 in shard[i] else -1 - i] for i in node]
    table = pa.table(
        {
            "key": pa.array([k for k, _ in rows], pa.int64()), "node": pa.array(node), "common": pa.array([len(sets[i]) for i in node], pa.int64()), "component": pa.array(node),
            "fp": pa.array(np.array([simhash.majority(sets[i]) for i in node], np.uint64).view(np.int64)), "keys": pa.array(keys, pa.list_(pa.int64())), "codes": pa.array([sets[i].tobytes() for i in node], pa.binary()),
        }
    )

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    every = [(i, j) for i in range(len(sets)) for j in range(i) if set(shard[i]) & set(shard[j]) and similar.alike(sets[i], sets[j], 0.8)]
    for step in (7, len(rows)):  # shards that go on in the next batch, and all in one
        found = [p for out in similar._searched(iter(table.to_batches(max_chunksize=step)), 0.8) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
        assert groups(found) == groups(every)
        assert all(similar.alike(sets[a], sets[b], 0.8) for a, b in found) and len(found) < len(every)
