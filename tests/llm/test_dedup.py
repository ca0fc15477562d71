import hashlib
import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from loamgrid.llm import exact_dedup, simhash

EDGE = [
    (1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (5, " \n"), (None, "same text"), (7, "É"), (8, "é"), (9, "w " * 30000), (9, "W " * 30000),
    (10, "a b"), (11, "a b c"), (12, "a b c"), (None, None), (9, "other"),
]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("keep_id", F.lit("x")).withColumn("_hash", F.lit(1)).withColumn("fp", F.lit(0)) if extra else df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    codes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(c >> b & 1 for c in codes) * 2 > len(codes))


def slow_components(prints):
    """prints: (id, fingerprint) pairs; the smallest reachable id by breadth-first search over all pairs."""
    ids = defaultdict(list)
    for i, p in prints:
        ids[p].append(i)
    left, out = set(ids), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            p = todo.pop()
            group.append(p)
            near = {q for q in left if (p ^ q).bit_count() <= 2}
            left -= near
            todo += near
        named = [i for p in group for i in ids[p] if i is not None]
        out |= {p: min(named, default=None) for p in group}
    return out


def test_exact_groups_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(i and i + 10_000, t) for i, t in EDGE]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    got = exact_dedup.exact_groups(frame(spark, rows, extra=True)).collect()
    want = sorted((str(i), max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_text_is_split(spark, monkeypatch):
    """A third of all rows have one text: splitters fall between its copies, groups stay whole, and broadcast groups give the same."""
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        rows = [(i, "Hot text " * 20 if i % 5 else [f"own {i}", f"twice {i // 30}"][i % 2]) for i in range(3000)] + [(2999, "hot TEXT " * 20)]
        df = frame(spark, rows).repartition(8)
        groups = defaultdict(list)
        for i, t in rows:
            groups[lower(t)].append(i)
        got = exact_dedup.exact_groups(df).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((i, max(ids), len(ids)) for ids in groups.values() for i in ids)
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
        hot = exact_dedup.runs(df).where("text like 'Hot%'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(hot) >= 2  # the text's copies are in several tasks
        kept = exact_dedup.exact_dedup(df.withColumn("_top", F.lit(1)).withColumn("lang", F.lit("en")))
        assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "A", "en"), (2, "a", "de"), (2, "a", "de"), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == [(2, "a", "de"), (3, None, None)]
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def test_near_groups_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(i and i + 10_000, t) for i, t in EDGE]
    got = simhash.near_groups(frame(spark, rows, extra=True)).collect()
    prints = [(i, slow_print(t)) for i, t in rows]
    groups = slow_components(prints)
    want = sorted((str(i), f"{p:016x}", groups[p]) for i, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_groups(frame(spark, rows).limit(0)).collect() == []


def test_forest_links_reach_what_all_pairs_reach():
    import numpy as np

    random.seed(3)
    fps = [random.getrandbits(64) for _ in range(40)]
    for _ in range(600):  # chains of one to three changed bits, so that components have long paths
        f = random.choice(fps)
        for b in random.sample(range(64), random.randint(1, 3)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    label = simhash.forest_links(np.array(fps, np.uint64), np.zeros(len(fps), np.int64))
    want = slow_components(list(enumerate(fps)))
    assert [int(x) for x in label] == [want[f] for f in fps]


def test_near_dedup_keeps_one_of_each_component(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = simhash.near_groups(docs)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}


def test_chain_components(spark):
    from loamgrid.operators.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 7), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5}
