import numpy as np

from loamgrid.operators.components import connected_components


def test_few_edges_by_one_task_give_the_same(spark):
    random = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in random.integers(-200, 200, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3), (2, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(map(tuple, connected_components(edges).collect()))
    assert len({c for _, c in want}) > 10
    assert sorted(map(tuple, connected_components(edges, few=len(pairs)).collect())) == want
    assert sorted(map(tuple, connected_components(edges, few=3).collect())) == want
    assert connected_components(edges.limit(0), few=3).collect() == []
