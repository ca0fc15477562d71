import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamgrid.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n", "<|endoftext|>a<|startoftext|>", "</w> x</w>", "ΑΣ ΑΣΑ", "é ẛ̣", "a\x1cb\x1dc \x1e\x85\xa0　d", "0１٣½ don't WE'VE", "日本語😀!!..", "a" * 4000, "W " * 5000, "\0\x7f﻿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_librarys(library, sf):
    import pyarrow.parquet as pq

    random.seed(1)
    pool = "abAB éÉßΣσςİıﬁ́̀ \t\n\x0b\x1c\x1f\x85\xa0  0१٣½'s't're've''ll<|endoftext|>!!..😀日本​\0</w>"
    samples = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() + ODD
    samples += ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    samples += ["".join(random.choice("abcdeinthersotan") for _ in range(random.randint(1, 40))) for _ in range(1500)]
    e = bpe.encoder(PATH)
    for text in samples:
        ids = library_ids(library, text)
        assert np.frombuffer(e.encode(text), np.uint32).tolist() == ids, text
        assert e.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def rows(spark):
    return spark.createDataFrame([*enumerate(ODD), (3, "again"), (None, "no id")], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("x"))


def test_token_digests(spark, library):
    want = []
    for i, t in [*enumerate(ODD), (3, "again"), (None, "no id")]:
        ids = library_ids(library, t)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(rows(spark), PATH).collect()) == sorted(want)
    assert bpe.token_digests(rows(spark).limit(0), PATH).collect() == []


def test_tables_round_trip(spark, library):
    encoded = bpe.encode_table(rows(spark).where("doc_id is not null"), PATH)
    got = sorted((r.doc_id, r.decoded) for r in bpe.decode_table(encoded, PATH).collect())
    assert got == sorted((i, library.decode(library_ids(library, t), skip_special_tokens=False)) for i, t in [*enumerate(ODD), (3, "again")])


def check_pieces(pieces, ids_of, window, partitions):
    """Each id in one piece; sequences gapless; sizes the window or, few times a partition, a power of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p[0]].append(p)
        sequences[p[5]].append(p)
    assert set(docs) == set(ids_of)
    for d, ps in docs.items():
        ps.sort(key=lambda p: p[1])
        ids = np.array(ids_of[d], np.uint32)
        assert [p[1] for p in ps] == [0, *np.cumsum([p[2] for p in ps])[:-1]] and sum(p[2] for p in ps) == len(ids)
        assert all(p[4] == len(ids) and p[2] > 0 and p[3] == zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) for p in ps)
    short = 0
    for ps in sequences.values():
        ps.sort(key=lambda p: p[6])
        assert [p[6] for p in ps] == [0, *np.cumsum([p[2] for p in ps])[:-1]]
        n = sum(p[2] for p in ps)
        assert n == window or n & (n - 1) == 0
        short += n < window
    assert short <= partitions * window.bit_length()


def test_pack_table(spark, library, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids_of = {r.doc_id: library_ids(library, r.text) + [1] for r in docs.collect()}
    got = [tuple(r) for r in packing.pack(docs.withColumn("start", F.lit("x")), PATH).collect()]
    check_pieces(got, ids_of, 2048, spark.sparkContext.defaultParallelism)
    odd = packing.pack(rows(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id != 3").coalesce(1), PATH).collect()
    check_pieces([tuple(r) for r in odd], {i: library_ids(library, t) + [1] for i, t in enumerate(ODD) if i != 3}, 2048, spark.sparkContext.defaultParallelism)
    assert packing.pack(rows(spark).limit(0), PATH).collect() == []
    assert {r.doc_id for r in packing.pack(rows(spark), PATH).collect()} == {None, *range(len(ODD))}


def test_pack_small_shards():
    random.seed(2)
    ids_of = {i: [random.randint(0, 30) for _ in range(random.choice([1, 3, 7, 8, 20, 64, 65]))] for i in range(300)}
    stream = ((i, np.array(x, np.uint32).tobytes()) for i, x in ids_of.items())
    check_pieces(list(packing.pack_documents(stream, window=16, base=5 << 32, shard_docs=40, shard_tokens=500)), ids_of, 16, 1)


def test_neighbours_share_terms():
    """Two topics, dealt alternately: what follows in a window of four documents has the topic of its seed."""
    random.seed(3)
    items = [np.array([random.randint(0, 40) + 1000 * (i % 2) for _ in range(50)], np.uint32) for i in range(60)]
    got = list(packing.order(items, 200))
    assert sorted(got) == list(range(60))
    assert sum(got[i] % 2 == got[i - i % 4] % 2 for i in range(60)) >= 58  # each topic has 30, so one window has both


def slow_scores(items, seed):
    """BM25 of each item for all terms of the seed that another item holds, by the formula."""
    mean, out = sum(map(len, items)) / len(items), []
    held = [Counter(x.tolist()) for x in items]
    df = Counter(t for x in held for t in x)
    for x, tfs in zip(items, held, strict=True):
        score = 0.0
        for t in held[seed]:
            if df[t] > 1 and tfs[t]:
                score += math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * tfs[t] * (packing.K1 + 1) / (tfs[t] + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        out.append(score)
    return out


@pytest.mark.parametrize(("terms", "longest"), [(10, 12), (300, 60), (4000, 900)])
def test_bm25_brute_force(terms, longest):
    """Seeds of a few and of over 500 different terms: each term counts."""
    rng = np.random.default_rng(4)
    items = [rng.zipf(1.3, rng.integers(1, longest)).clip(0, terms).astype(np.uint32) for _ in range(40)]
    if terms == 4000:
        items += [np.arange(600, dtype=np.uint32) * 3, np.arange(500, dtype=np.uint32) * 3 + 30]
    index = packing.Index(items)
    for q in range(len(items)):
        assert np.allclose(index.scores(q), slow_scores(items, q), rtol=1e-4)


def test_order_brute_force():
    """The greedy order, item by item, against scores worked out anew for each seed."""
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 200, rng.integers(1, 50)).astype(np.uint32) for _ in range(60)]
    window, want, unused, seed, filled = 100, [], list(range(60)), None, 0
    while unused:
        if seed is None:
            seed = unused.pop(0)
            want.append(seed)
            filled = (filled + len(items[seed])) % window
            if not filled:
                seed = None
                continue
        scores, at, seed = slow_scores(items, seed), seed, None
        for i in sorted((i for i in unused if scores[i] > 0), key=lambda i: (-round(scores[i], 5), i)):
            unused.remove(i)
            want.append(i)
            filled += len(items[i])
            if filled >= window:
                filled %= window
                seed = i if filled else None
                break
    assert list(packing.order(items, window)) == want


def test_statistics_and_dealing_cover_all(spark, library, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 50"))
    ids_of = [(r.doc_id, library_ids(library, r.text) + [1]) for r in docs.collect()]
    kind = packing.narrow(PATH)
    encoded = packing.encode_documents(docs, PATH, 1)
    known, total = packing.statistics(encoded, kind, 2048)
    df = Counter(t for _, x in ids_of for t in set(x))
    assert known.docs == len(ids_of) and total == sum(len(x) for _, x in ids_of) and np.isclose(known.mean * known.docs, sum(len(x) % 2048 for _, x in ids_of))
    assert {t: n for t, n in enumerate(known.df.tolist()) if n} == dict(df)
    dealt = packing.deal(encoded, known, kind, 2048, 5, shard_docs=16).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, kind).tolist()) for r in dealt) == sorted(ids_of)
    groups = defaultdict(set)
    for r in dealt:
        groups[r.lead, r.part].add(r.p)
    assert all(len(g) == 1 for g in groups.values())
    sizes = Counter((r.lead, r.part) for r in dealt)
    assert max(sizes.values()) <= 16 * encoded.rdd.getNumPartitions() + 16  # no term gathers more than some shards
