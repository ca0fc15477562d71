"""Trees and clusters end at every street of the lattice."""

from loamgrid.plans import queries as plans
from loamgrid.sources import fixtures as X


def test_no_tree_edge_crosses_a_street(spark, sf):
    upright, level = {}, {}
    for r in X.roads(spark, sf).collect():
        if r.x1 == r.x2:
            upright.setdefault(r.pid, set()).add(r.x1)
        elif r.y1 == r.y2:
            level.setdefault(r.pid, set()).add(r.y1)
    edges = plans.QUERIES["mst_edges"](spark, sf).collect()
    assert edges and all(len(upright[e.pid]) == len(level[e.pid]) == 17 for e in edges)
    for e in edges:
        assert not any((e.x1 - x) * (e.x2 - x) < 0 for x in upright[e.pid])
        assert not any((e.y1 - y) * (e.y2 - y) < 0 for y in level[e.pid])
