import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.jobs import fixtures as fx
from edgeloom.operators import compress as cm
from edgeloom.operators import edges as ed
from edgeloom.functions.storage import materialize
from edgeloom.operators import gcn, normalize
from edgeloom.operators import propagate as pr
from edgeloom.operators import report, similarity, tree
from edgeloom.sources.graphs import read_coordinate_text

from .test_graph import dense, graph, vectors

SMALL = "/root/testdata/sf0.001"


def pairs_of(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_a_normalised_form_gives_its_edges_back(spark):
    e = graph(spark, [(0, 2), (0, 3), (1, 1), (1, 2), (1, 3)])  # columns 2 and 3 have a scale of 0
    c = cm.compress(e, 4, 0, normalized=True)
    assert pairs_of(cm.decompress(c)) == pairs_of(e) and cm.check_compressed(c, e)
    assert not cm.check_compressed(c, e.where("dst <> 3"))


def test_equal_rows_hang_below_one_of_them(spark):
    e = graph(spark, [(r, c) for r in range(6) for c in (1, 2, 5)] + [(7, 1), (8, 1)])
    c = cm.compress(e, 9, 1)
    assert c.deltas.count() == 5  # 3 for one of the six; rows of one entry are no longer than alpha
    assert cm.check_compressed(c, e) and c.tree.count() == 8


@pytest.mark.parametrize("name,alpha,want", [("user_day", 0, 80), ("user_day", 2, 80), ("part_supp", 0, 36), ("part_supp", 8, 243), ("order_part", 0, 4580)])
def test_deltas_of_the_fixtures(spark, name, alpha, want):
    e = getattr(fx, name)(spark, SMALL)
    got = cm.compress(e, fx.sized(e), alpha).deltas.count()
    assert got == want if alpha == 0 else want <= got <= want + 6


def test_forests_and_trees_are_the_same_in_one_task_and_in_many(spark):
    rng = random.Random(3)
    links = [(a, b, rng.randint(1, 5)) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.3] + [(tree.ROOT, v, rng.randint(3, 7)) for v in range(40)]
    frame = spark.createDataFrame(links, "a long, b long, w long")
    one, many = (sorted(map(tuple, tree._boruvka(frame, few).collect())) for few in (10**6, 0))
    assert one == many and len(one) == 40
    forest = spark.createDataFrame(one, "a long, b long, w long")
    a, b = ({r.row: (r.parent, r.depth) for r in tree.orient_tree(forest, few).collect()} for few in (10**6, 0))
    assert a == b and len(a) == 40


def test_a_long_chain(spark):
    n = 5000
    links = spark.range(n).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))  # -1 is the root
    got = tree.orient_tree(links, few=0)
    assert got.agg(F.count(F.lit(1)), F.max("depth"), F.sum((F.coalesce("parent", F.lit(-1)) == F.col("row") - 1).cast("int"))).first()[:] == (n, n, n)
    deltas = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val")).union(spark.range(2, n).select("id", F.col("id") - 2, F.lit(-1.0)))
    back = cm.decompress(cm.Compressed(n, got, deltas))  # each row holds its own and the column before
    assert back.count() == 2 * n - 1 and back.where("src - dst not in (0, 1)").count() == 0


def test_a_deep_arborescence():
    n = 3000
    arcs = [(0, v, 10) for v in range(1, n)] + [(v, v + 1, 1) for v in range(1, n - 1)] + [(v + 1, v, 1) for v in range(1, n - 1)]
    found = tree.least_arborescence(n, arcs)
    assert len(found) == n - 1 and sum(p == 0 for p in found.values()) == 1


def test_sizes_hooks_and_strategies(spark):
    x = spark.createDataFrame([(k, [float(k), 1.0], float(10 * k)) for k in range(4)], "node long, x array<double>, age double")
    assert dense(pr.propagate(graph(spark, [(0, 0)]), x, None, 2)).tolist() == [[0.0, 1.0]]
    e = spark.createDataFrame([(0, 1, 2.0, 3.0), (2, 1, 1.0, 5.0), (1, 3, 1.0, 1.0)], "src long, dst long, weight double, far double")
    hook = lambda x_j, age_i, far, edge_weight: F.transform(x_j, lambda v: v * edge_weight + age_i * far)
    got = dense(pr.propagate(e, x, 4, 2, message=hook))
    assert got.tolist() == [[0, 0], [0 * 2 + 10 * 3 + 2 + 10 * 5, 2 + 30 + 1 + 50], [0, 0], [1 + 30, 1 + 30]]
    rng = random.Random(4)
    e = graph(spark, [(i, j) for i in range(12) for j in range(12) if rng.random() < 0.6])
    feats = vectors(spark, np.random.default_rng(1).integers(0, 9, (12, 3)))
    for flow in pr.ENDS:
        for normalize in (False, True):
            a, b = (pr.propagate(e, feats, 12, 3, flow, normalize=normalize, strategy=s) for s in ("direct", "compressed"))
            report.assert_close(a, b, 1e-9, 1e-9)
    with pytest.raises(ValueError):
        pr.propagate(e, feats, 12, 3, strategy="other")
    with pytest.raises(ValueError):
        pr.propagate(e, feats, 12, 3, strategy="compressed", aggregate=F.max)


def test_coordinate_files_of_several_kinds(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 1\n3 1 4\n")
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n% note\n\n2 2 2\n1 2\n2 2\n")
    got = sorted(tuple(r) for r in read_coordinate_text(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1.0), (0, 2, -4.0), (1, 1, 1.0), (2, 0, 4.0)]
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n4\n")
    with pytest.raises(ValueError, match="dense"):
        read_coordinate_text(spark, str(tmp_path))


def test_statistics_by_dataset(spark):
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("b", 4, 0), ("b", 4, 0)], "dataset string, src long, dst long")
    got = {r.dataset: tuple(r)[1:] for r in report.graph_stats(e, by="dataset").collect()}
    assert got == {"a": (2, 2, 1.5), "b": (5, 1, 1.2)}
    assert report.graph_stats(graph(spark, [(0, 1)]), 4).first()[:] == (4, 1, 1.25)
    assert ed.num_nodes(graph(spark, [])) == 0


def test_the_guard_lets_other_import_errors_through(tmp_path):
    here = Path(__file__).resolve().parent.parent
    for part in ("__spark_entry__.py", "edgeloom"):
        (tmp_path / part).symlink_to(here / part)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q)"
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # which may lead to the whole repository
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own, capture_output=True, text=True)
    assert run().stdout.split()[1:] == ["False"]  # no corpus_pipeline
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr


def test_tasks_of_copurchase_follow_the_lines(spark, monkeypatch):
    plain = pairs_of(fx.copurchase(spark, SMALL))
    monkeypatch.setattr(fx, "LINES_AT_ONCE", 200)  # some 6,000 lines, so 30 tasks; the session has 4
    many = fx.copurchase(spark, SMALL)
    assert pairs_of(many) == plain and len(many.inputFiles()) > 20


def test_a_layer_joins_its_edges_once(spark):
    rng = random.Random(5)
    e = materialize(graph(spark, [(i, j) for i in range(12) for j in range(12) if rng.random() < 0.3]), "plain")
    looped = ed.add_self_loops(e.where("src <> dst"), 12, repeats=False)
    x, w = vectors(spark, np.arange(24).reshape(12, 2)), np.array([[1.0, -2.0], [0.5, 3.0]])
    layer = gcn.gcn_layer(looped, x, w, 12)
    assert layer._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1  # edges and loops are read once
    report.assert_close(layer, pr.propagate(normalize.normalize_edges(ed.add_self_loops(e, 12)), gcn.linear(x, w), 12, 2), 1e-9, 1e-9)
    report.assert_close(gcn.gcn_layer(e, x, w, 12), pr.propagate(normalize.normalize_edges(e), gcn.linear(x, w), 12, 2), 1e-9, 1e-9)  # nodes without edges


def test_sizes_of_a_rooted_tree_take_no_tour(spark, monkeypatch):
    rng = random.Random(6)
    up = {v: None if rng.random() < 0.05 else rng.randrange(v) for v in range(1, 300)} | {0: None}
    frame = spark.createDataFrame(list(up.items()), "row long, parent long")
    size = dict.fromkeys(up, 1)
    for v in sorted(up, reverse=True):
        if up[v] is not None:
            size[up[v]] += size[v]
    whole = sorted(map(tuple, tree.heavy_paths(frame).collect()))
    monkeypatch.delattr(tree, "_toured")
    assert {r.row: r.size for r in tree._sized(frame).collect()} == size
    assert sorted(map(tuple, tree.heavy_paths(frame, few=0).collect())) == whole


def test_rows_without_links_are_not_searched(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2, 1)], "a long, b long, w long")
    rows = spark.createDataFrame([(v, 3) for v in range(1, 50)], "row long, nnz long")
    asked, search = [], tree._boruvka
    monkeypatch.setattr(tree, "_boruvka", lambda found: asked.append(found.count()) or search(found))
    got = sorted(map(tuple, tree.tree_of_links(links, rows, 1).collect()))
    assert asked == [3] and got == [(1, None, 3, 1), (2, 1, 1, 2)] + [(v, None, 3, 1) for v in range(3, 50)]


def dense_graph(spark, rows, columns, seed):
    rng = random.Random(seed)
    kinds = {frozenset(c for c in range(columns) if rng.random() < 0.8) for _ in range(rows)}
    sets = dict(enumerate(sorted(kinds - {frozenset()}, key=sorted)))
    return graph(spark, [(r, c) for r, held in sets.items() for c in held]), sets


def least_forest(sets):
    """a, b, w as a search by rising length finds it among all links and no root edges."""
    links = sorted((len(sets[a] ^ sets[b]), a, b) for a in sets for b in sets if a < b and len(sets[a] ^ sets[b]) < max(len(sets[a]), len(sets[b])))
    up, out = {v: v for v in sets}, []
    for w, a, b in links:
        p, q = up[a], up[b]
        if p != q:
            out.append((a, b, w))
            up = {v: q if t == p else t for v, t in up.items()}
    return sorted(out)


def test_near_bitmaps_are_looked_up(spark, monkeypatch):
    e, sets = dense_graph(spark, 400, 12, 7)
    ways = []
    look_up = similarity._turned_pairs
    monkeypatch.setattr(similarity, "_turned_pairs", lambda *a: ways.append(a) or look_up(*a))
    monkeypatch.setattr(similarity, "LOOK_UP", 1)
    monkeypatch.delattr(similarity, "bitmap_pairs")  # all pairs of rows
    got = sorted(map(tuple, similarity.rising_forest(e, growth=2)[0].collect()))
    assert ways and len(got) == len(sets) - 1 and got == least_forest(sets)


def test_all_ways_to_near_bitmaps_give_the_same(spark, monkeypatch):
    e, sets = dense_graph(spark, 300, 70, 8)  # two words
    few = {r: frozenset(sets[r % 40] ^ {r % 70} if r >= 40 else sets[r]) for r in range(200)}
    e = graph(spark, [(r, c) for r, held in few.items() for c in held])
    maps, words = similarity._dense(similarity._ranked(e, 0), 0)
    assert len(words) == 2 and similarity._all_columns(maps, words) == 70
    maps = maps.withColumn("component", F.when(F.col("row") < 150, 0).otherwise(F.col("row")).cast("long")).withColumn("reach", F.lit(9).cast("long"))
    part = lambda r: 0 if r < 150 else r
    want = {(a, b): len(few[a] ^ few[b]) for a in few for b in few if a < b and part(a) != part(b)}
    for look_up, rows, bound in ((0, 200, 2), (10**6, 10**6, 2), (10**6, 1, 2)):
        monkeypatch.setattr(similarity, "LOOK_UP", look_up)
        found = similarity._between_components(maps, words, rows, 70, 0, bound).select(F.least("u", "v"), F.greatest("u", "v"), "h").collect()
        near = [(a, b, h) for a, b, h in found if 0 < h <= bound]
        assert sorted(near) == sorted((*k, h) for k, h in want.items() if 0 < h <= bound) and len(near) > 5
    own = graph(spark, [(r, c) for r, held in few.items() for c in held] + [(3, 999)])  # a column of one row alone is in no bitmap
    maps, words = similarity._dense(similarity._ranked(own, 0), 0)
    assert similarity._all_columns(maps, words) == 0


def test_tasks_follow_the_pairs_that_meet(spark, monkeypatch):
    rng = random.Random(9)
    rows = {r: set(rng.sample(range(40), 8)) for r in range(200)}
    e = materialize(graph(spark, [(r, c) for r, held in rows.items() for c in held] + [(r, 99) for r in rows]), "plain")
    want = sorted((a, b, len(rows[a] & rows[b]) + 1) for a in rows for b in rows if a < b and 2 * (len(rows[a] & rows[b]) + 1) > 9)
    monkeypatch.setattr(similarity, "MADE_AT_ONCE", 1000)
    monkeypatch.setattr(similarity, "LOT", 30)  # the column of all rows is dealt to seven
    monkeypatch.setattr(similarity, "_heavy_columns", lambda *_: (None, False))
    met, made = similarity._met, []
    monkeypatch.setattr(similarity, "_met", lambda one, two, n: made.append((n, met(one, two, n))) or made[-1][1])
    for prefix in (True, False):
        found = similarity.row_distances(e, similarity.pruned_overlap(e, 0, prefix)).where("h < greatest(nnz_u, nnz_v)")
        assert sorted(tuple(r) for r in found.select("u", "v", "overlap").collect()) == want
    for n, joined in made:  # adaptive execution leaves the tasks as they are
        assert joined.count() == n and joined.rdd.getNumPartitions() == -(-n // 1000) > 20
    assert made[1][1].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000  # of 40,000 that meet in one column


def test_the_join_of_all_columns_counts_them(spark, monkeypatch):
    rng = random.Random(10)
    rows = {r: set(rng.sample(range(30), rng.randint(1, 5))) for r in range(120)}
    e = graph(spark, [(r, c) for r, held in rows.items() for c in held])
    for name in ("counted_overlap", "_with_light"):  # a second look at the pairs
        monkeypatch.delattr(similarity, name)
    for alpha in (0, 1):
        want = sorted((a, b, len(rows[a] & rows[b])) for a in rows for b in rows if a < b and 2 * len(rows[a] & rows[b]) > min(len(rows[a]), len(rows[b])) + alpha)
        found = similarity.row_distances(e, similarity.pruned_overlap(e, alpha, prefix=False)).where(f"h < greatest(nnz_u, nnz_v) - {alpha}")
        assert sorted(tuple(r) for r in found.select("u", "v", "overlap").collect()) == want


def test_digests_of_many_edges_do_not_overflow(spark):
    n = 20_000_000  # more than 2 ** 24: a sum of 40 bits for each is beyond 63
    e = spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    digest = cm.edge_digest(e)
    assert digest[0] == n and digest[3] == 0 and all(-(1 << 63) <= x < 1 << 63 for x in digest)
    other = e.withColumn("dst", F.when(F.col("src") == 7, 8).otherwise(F.col("dst")))
    assert cm.edge_digest(other) != digest and cm.edge_digest(e.repartition(5)) == digest
    few = graph(spark, [(0, 1), (2, 3), (None, 4)])
    one, two = F.xxhash64("src", "dst"), F.xxhash64("src", "dst", F.lit(1))
    plain = few.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum(F.pmod(two, F.lit(1 << 40))), F.lit(1).cast("long")).first()
    assert cm.edge_digest(few) == tuple(plain)  # as in forms written before


def test_pairs_of_copies_are_returned_and_not_sent(spark):
    from edgeloom.jobs.registry import QUERIES

    e = fx.user_day(spark, "/root/testdata/sf0.01")
    sizes = e.groupBy("src").count()
    pairs = similarity._light_overlap(e).join(sizes.toDF("u", "nnz_u"), "u").join(sizes.toDF("v", "nnz_v"), "v")
    want = sorted(map(tuple, pairs.select("u", "v", "nnz_u", "nnz_v", "overlap", (F.col("nnz_u") + F.col("nnz_v") - 2 * F.col("overlap"))).collect()))
    assert len(want) > sizes.count() * (sizes.count() - 1) // 2 - 10 and similarity.equal_rows(e).where("copies > 1").count() > 1
    whole = QUERIES["row_distances"](spark, "/root/testdata/sf0.01")
    assert whole.columns == ["u", "v", "nnz_u", "nnz_v", "overlap", "h"] and sorted(map(tuple, whole.collect())) == want
    overlaps = QUERIES["row_overlap"](spark, "/root/testdata/sf0.01")
    assert overlaps.columns == ["u", "v", "overlap"] and sorted(map(tuple, overlaps.collect())) == sorted((u, v, k) for u, v, _, _, k, _ in want)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Repartition") == 2 and "Aggregate" not in plan  # blocks of rows meet, and pairs go nowhere else


def test_blocks_grow_with_the_rows():
    sent = {n: n * (similarity._blocks(n) + 1) for n in (9_000, 90_000, 540_000)}
    assert sent[540_000] <= 10 * sent[90_000] and similarity._blocks(9_000) == 8 and similarity._blocks(90_000) == 44
    assert -(-3_000_000 // similarity._blocks(3_000_000)) <= 8 * similarity.BLOCK_ROWS


def test_dense_rows_have_few_candidates_of_a_least_tree(spark):
    e, sets = dense_graph(spark, 150, 14, 11)
    e = e.union(e.where("src < 20").select(F.col("src") + 1000, "dst"))
    n = len(sets) + 20
    for alpha in (0, 2):
        cand = materialize(similarity.kind_candidates(e, alpha), "candidates")
        assert cand.where("parent is null").count() == n and cand.count() <= 4 * n
        every = materialize(similarity.candidate_edges(e, alpha, pruned=False), "every")
        assert every.count() > 40 * n and cand.exceptAll(every).isEmpty()
        totals = [tree.compression_tree(c, alpha).agg(F.count(F.lit(1)), F.sum("weight")).first() for c in (cand, every)]
        assert totals[0] == totals[1] and totals[0][0] == n


def test_pairs_that_signatures_tell_apart_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_HEAVY", 6)  # the others are joined
    rng = random.Random(12)
    rows = {r: set(range(4)) | set(rng.sample(range(10, 400), 30)) for r in range(60)}
    rows.update({100 + r: set(list(rows[r])[:28]) | {500 + r} for r in range(20)})
    e = materialize(graph(spark, [(r, c) for r, held in rows.items() for c in held]), "plain")
    common = {(a, b): len(rows[a] & rows[b]) for a in rows for b in rows if a < b}
    pairs = materialize(spark.createDataFrame([(a, b, 12) for a, b in common], "u long, v long, least long"), "pairs")
    counted, with_light = [], similarity._with_light
    monkeypatch.setattr(similarity, "_with_light", lambda p, rest: counted.append(p.count()) or with_light(p, rest))
    for few in (0, 10**6):  # bitmaps are sent with the pairs, or to all executors
        monkeypatch.setattr(similarity, "FEW_WORDS", few)
        found = {(u, v): k for u, v, _, k in similarity.counted_overlap(pairs, e, needed=F.col("least")).collect()}
        assert all(common[p] == k for p, k in found.items()) and {p for p, k in common.items() if k >= 12} <= set(found)
        assert 20 <= counted[-1] < len(common) / 4
    every = {(u, v): k for u, v, _, k in similarity.counted_overlap(pairs, e).collect()}
    assert every == common and counted[-1] == len(common)
    monkeypatch.setattr(similarity, "_dense", lambda ranked, n: (None, []))
    sizes = e.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"))
    totals = [tree.tree_of_links(f, sizes, 2).agg(F.sum("weight")).first()[0] for f in (similarity.rising_forest(e, 2)[0], similarity.row_links(e, 2))]
    assert totals[0] == totals[1]
