import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.jobs.registry import ORACLES, QUERIES
from edgeloom.operators import compress as cm
from edgeloom.operators import edges as ed
from edgeloom.operators import gcn, normalize, report, similarity, tree
from edgeloom.operators import propagate as pr
from edgeloom.sources.graphs import batch_graphs, read_coordinate_text, read_edges, write_table

HAND = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 3), (3, 3)]


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "node long, x array<double>")


def dense(df):
    return np.array([r.x for r in df.orderBy("node").collect()])


@pytest.mark.parametrize("method", ["mst", "exact"])
@pytest.mark.parametrize("alpha,total", [(0, 5), (1, 7), (2, 7)])
def test_hand_graph(spark, alpha, total, method):
    e = graph(spark, HAND)
    c = cm.compress(e, 4, alpha, method=method)
    assert c.deltas.count() == total == c.tree.agg(F.sum("weight")).first()[0]
    assert cm.check_compressed(c, e)
    cand = {(r.parent, r.child) for r in similarity.candidate_edges(e, alpha).collect()}
    assert {(r.parent, r.row) for r in c.tree.collect()} <= cand and c.tree.count() == 4
    x = np.arange(8).reshape(4, 2)
    a = np.zeros((4, 4))
    a[tuple(zip(*HAND))] = 1
    assert np.allclose(dense(c.matmul(vectors(spark, x), 2)), a @ x)


def test_random_graph_compresses_and_multiplies(spark):
    rng = random.Random(0)
    pairs = [(i, j) for i in range(14) for j in range(14) if i != j and rng.random() < 0.5]
    e, a = graph(spark, pairs), np.zeros((15, 15))
    a[tuple(zip(*pairs))] = 1
    x = np.random.default_rng(0).integers(0, 10, (15, 3))
    d = a.sum(axis=1)
    s = np.where(d > 0, np.maximum(d, 1) ** -0.5, 0)
    c = cm.compress(e, 15, 3, normalized=True)
    assert np.allclose(dense(c.matmul(vectors(spark, x), 3)), s[:, None] * (a * s) @ x)
    for alpha in (0, 2):
        assert similarity.candidate_edges(e, alpha, pruned=True).exceptAll(similarity.candidate_edges(e, alpha, pruned=False)).count() == 0
        assert similarity.candidate_edges(e, alpha, pruned=False).exceptAll(similarity.candidate_edges(e, alpha, pruned=True)).count() == 0


def test_exact_beats_or_equals_mst_and_raises_beyond_its_size(spark):
    cand = similarity.candidate_edges(graph(spark, HAND), 0)
    with pytest.raises(ValueError, match="beyond"):
        tree.compression_tree(cand, 0, "exact", largest=2)
    with pytest.raises(ValueError, match="unknown"):
        tree.compression_tree(cand, 0, "other")


def test_least_arborescence_matches_brute_force():
    from itertools import product

    rng = random.Random(1)
    for _ in range(60):
        n = 5
        arcs = [(p, c, rng.randint(1, 6)) for p in range(n) for c in range(1, n) if p != c and (p == 0 or rng.random() < 0.6)]
        best = None
        for pick in product(*[[a for a in arcs if a[1] == c] for c in range(1, n)]):
            parent = {c: p for p, c, _ in pick}
            if all(any_root(parent, c) for c in parent):
                best = min(sum(a[2] for a in pick), best or 10**9)
        found = tree.least_arborescence(n, arcs)
        assert all(any_root(found, c) for c in found) and len(found) == n - 1
        assert sum(min(w for p, c, w in arcs if (p, c) == (found[v], v)) for v in found) == best


def any_root(parent, v):
    for _ in range(len(parent) + 1):
        if v == 0:
            return True
        v = parent[v]
    return False


def test_two_cycle_and_wide_features(spark):
    e = graph(spark, [(0, 1), (1, 0)])
    x = np.random.default_rng(2).random((2, 70))
    once = pr.propagate(e, vectors(spark, x), None, 70)
    assert np.allclose(dense(pr.propagate(e, once, 2, 70)), x)
    report.assert_close(pr.propagate(e, once, 2, 70), vectors(spark, x))
    with pytest.raises(AssertionError):
        report.assert_close(once, vectors(spark, x))


def test_isolated_nodes_and_empty_edges(spark):
    e = graph(spark, [(0, 2), (2, 2)])
    assert [r.deg for r in normalize.inv_sqrt_degree(e, 4).orderBy("node").collect()] == [0, 0, 2, 0]
    assert dense(pr.propagate(e, vectors(spark, [[1], [2], [3], [4]]), 5, 1)).ravel().tolist() == [0, 0, 4, 0, 0]
    none = graph(spark, [])
    assert ed.num_nodes(none) == 0 and pr.spmv(none, spark.createDataFrame([], "node long, v double"), 2).count() == 2
    assert ed.check_edges(none).first().contiguous


def test_check_edges(spark):
    assert all(ed.check_edges(graph(spark, [(0, 1), (1, 2)])).first())
    bad = ed.check_edges(graph(spark, [(1, 3), (1, 3), (None, 1)])).first()
    assert (bad.contiguous, bad.coalesced, bad.starts_at_zero, bad.no_nulls) == (False, False, False, False)
    with pytest.raises(ValueError, match="coalesced"):
        ed.check_edges(graph(spark, [(0, 1), (0, 1)]), raise_on_error=True)
    with pytest.raises(ValueError):
        ed.check_edges(spark.createDataFrame([("a", "b")], "src string, dst string"))


def test_gcn_gradients(spark):
    e = ed.add_self_loops(graph(spark, [(0, 1), (1, 2), (2, 0), (0, 2)]), 3)
    a = np.zeros((3, 3))
    a[tuple(zip(*[(r.src, r.dst) for r in e.collect()]))] = 1
    s = a.sum(axis=0) ** -0.5
    norm = s[:, None] * a * s
    x, w, g = np.arange(6.0).reshape(3, 2), np.array([[1.0, -2.0], [0.5, 3.0]]), np.arange(3.0)[:, None] * [1.0, 2.0]
    assert np.allclose(dense(gcn.gcn_layer(e, vectors(spark, x), w, 3)), norm.T @ x @ w.T)
    assert np.allclose(dense(gcn.gcn_model(e, vectors(spark, x), [w, w], 3)), norm.T @ np.maximum(norm.T @ x @ w.T, 0) @ w.T)
    got = gcn.weight_gradient(e, vectors(spark, x), vectors(spark, g), 3, 2, 2).orderBy("out", "in").collect()
    assert np.allclose([r.v for r in got], (g.T @ (norm.T @ x)).ravel())
    with pytest.raises(ValueError):
        gcn.gcn_model(e, vectors(spark, x), [w], 3)


def test_sources(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.5\n3 1 4\n3 3 3\n")
    got = sorted(tuple(r) for r in read_coordinate_text(spark, str(tmp_path / "m.mtx")).collect())
    assert got == [(0, 0, 2.5), (0, 2, 4.0), (2, 0, 4.0), (2, 2, 3.0)]
    write_table(graph(spark, HAND), str(tmp_path / "e"), "csv")
    assert read_edges(spark, str(tmp_path / "e"), "csv", "_c0", "_c1").count() == 10
    e = spark.createDataFrame([(7, 0, 1), (9, 1, 0), (8, 0, 0)], "graph_id long, src long, dst long")
    sizes = spark.createDataFrame([(7, 2), (8, 5), (9, 2)], "graph_id long, n long")
    assert sorted(tuple(r) for r in batch_graphs(e, sizes).collect()) == [(7, 0, 1), (8, 2, 2), (9, 8, 7)]


def test_compressed_form_round_trips_through_storage(spark, tmp_path):
    e = graph(spark, HAND)
    cm.compress(e, 4, 0).write(str(tmp_path / "c"))
    c = cm.Compressed.read(spark, str(tmp_path / "c"), 4)
    assert cm.check_compressed(c, e)
    assert cm.delta_layout(c).count() == 4 and cm.delta_layout(c, "edges").count() == 5
    with pytest.raises(ValueError):
        cm.delta_layout(c, "other")


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 45
