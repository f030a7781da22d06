import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.jobs import fixtures as fx
from edgeloom.operators import aggregates, gcn, normalize, similarity, tree
from edgeloom.operators import compress as cm
from edgeloom.operators import edges as ed
from edgeloom.operators import propagate as pr
from edgeloom.operators import report

from .test_graph import HAND, dense, graph, vectors

SMALL = "/root/testdata/sf0.001"


def clustered(spark, seed, rows=60, columns=40):
    """Rows that are copies of a few with some columns changed, and columns that most rows have."""
    rng = random.Random(seed)
    bases = [{c for c in range(columns) if rng.random() < p} | {0, 1} for p in (0.1, 0.2, 0.3, 0.5)]
    pairs = []
    for r in range(rows):
        cols = set(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            cols ^= {rng.randrange(2, columns)}
        pairs += [(r, c) for c in cols]
    return graph(spark, pairs), max(rows, columns)


def tuples(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


# A form that is used again


def test_a_form_is_of_its_edges_alone(spark, tmp_path):
    e, n = clustered(spark, 0)
    x = vectors(spark, np.arange(2 * n).reshape(n, 2))
    form = cm.compress(ed.transpose(e), n, 2)
    form.write(str(tmp_path / "form"))
    again = cm.Compressed.read(spark, str(tmp_path / "form"))
    assert again.n == n and again.digest == form.digest
    report.assert_close(pr.propagate(e, x, n, 2, strategy="compressed", form=again), pr.propagate(e, x, n, 2))
    first = e.first()
    changed = e.where(~((F.col("src") == first.src) & (F.col("dst") == first.dst)))
    for other in (changed, changed.union(spark.createDataFrame([(first.src, 39)], e.schema)), e.union(e.limit(1)), ed.transpose(e)):
        with pytest.raises(ValueError, match="other edges"):
            pr.propagate(other, x, n, 2, strategy="compressed", form=again)
    with pytest.raises(ValueError, match="not normalised"):
        pr.propagate(e, x, n, 2, normalize=True, strategy="compressed", form=again)
    with pytest.raises(ValueError, match="rows"):
        cm.Compressed.read(spark, str(tmp_path / "form"), n + 1)
    with pytest.raises(ValueError, match="does not say"):
        cm.Compressed(n, form.tree, form.deltas).check_source(e)


def test_repeated_edges_and_null_ids_raise(spark):
    x = vectors(spark, [[2.0], [3.0]])
    for flow in pr.ENDS:
        twice = graph(spark, [(0, 1), (0, 1)])
        assert dense(pr.propagate(twice, x, 2, 1, flow)).ravel().tolist() == ([0, 4] if flow == "source_to_target" else [6, 0])
        with pytest.raises(ValueError, match="repeated"):
            pr.propagate(twice, x, 2, 1, flow, strategy="compressed")
    with pytest.raises(ValueError, match="null"):
        cm.compress(graph(spark, [(0, 1), (None, 1)]), 2)
    with pytest.raises(ValueError, match="null"):
        cm.alpha_sweep(graph(spark, [(0, 1), (1, None)]), 2, [0])


def test_a_compressed_model_builds_one_form(spark, monkeypatch):
    rng, n = random.Random(3), 14
    e = ed.add_self_loops(graph(spark, [(i, j) for i in range(n) for j in range(n) if rng.random() < 0.5]), n)
    e = spark.createDataFrame(e.collect(), e.schema)
    x, ws = vectors(spark, np.random.default_rng(0).normal(size=(n, 3))), [np.random.default_rng(k).normal(size=s) for k, s in enumerate([(4, 3), (4, 4), (2, 4)])]
    made = []
    monkeypatch.setattr(gcn, "compress", lambda *a, **k: made.append(cm.compress(*a, **k)) or made[-1])
    report.assert_close(gcn.gcn_model(e, x, ws, n), gcn.gcn_model(e, x, ws, n, strategy="compressed"), 1e-8, 1e-8)
    assert len(made) == 1
    report.assert_close(gcn.gcn_model(e, x, ws, n), gcn.gcn_model(e, x, ws, n, strategy="compressed", form=made[0]), 1e-8, 1e-8)
    assert len(made) == 1
    with pytest.raises(ValueError, match="other edges"):
        gcn.gcn_model(e.where("src <> 3"), x, ws, n, strategy="compressed", form=made[0])
    with pytest.raises(ValueError, match="unknown"):
        gcn.gcn_model(e, x, ws, n, strategy="other")


def test_normalising_keeps_weights_and_other_columns(spark):
    e = spark.createDataFrame([(0, 1, 2.0, 3.0), (2, 1, 1.0, 5.0), (1, 2, 4.0, 1.0)], "src long, dst long, weight double, far double")
    x = vectors(spark, [[1.0], [10.0], [100.0]])
    hook = lambda x_j, edge_weight, far: F.transform(x_j, lambda v: v * edge_weight + far)
    for flow, (source, target) in pr.ENDS.items():
        turned = e if flow == "source_to_target" else ed.transpose(e)
        w = {(r.src, r.dst): (r.weight, r.far) for r in normalize.normalize_adjacency(turned).collect()}
        want = np.zeros(3)
        for (s, t), (v, far) in w.items():
            want[t] += 10.0**s * v + far
        assert np.allclose(dense(pr.propagate(e, x, 3, 1, flow, hook, normalize=True)).ravel(), want)


# Trees


def test_a_sweep_gives_what_each_compression_gives(spark):
    e, n = clustered(spark, 1)
    copies = e.union(e.where("src < 9").select(F.col("src") + 100, "dst"))
    got = {r.alpha: r for r in cm.alpha_sweep(copies, 110, [0, 1, 3, 30]).collect()}
    kept = cm.similarity_forest(copies, 0)
    for alpha in (0, 3):
        c = cm.compress(copies, 110, alpha)
        assert got[alpha].deltas == c.deltas.count() == cm.compress(copies, 110, alpha, forest=kept).deltas.count()
        assert got[alpha].candidates == similarity.candidate_edges(copies, alpha, pruned=False).where("parent is not null").count()
        assert np.isclose(got[alpha].ratio, cm.compression_ratio(110, copies.count(), got[alpha].deltas))


@pytest.mark.parametrize("alpha,growth,few", [(0, 2, 10**6), (2, 4, 10**6), (1, 4, 0)])
def test_rising_distances_find_the_same_forest(spark, alpha, growth, few):
    e, n = clustered(spark, 2 + alpha, rows=60 if few else 20)
    forest, tiers = similarity.rising_forest(e, alpha, growth=growth, few=few)
    rows = e.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"))
    one, other = (tree.tree_of_links(x, rows, alpha) for x in (forest, similarity.row_links(e, alpha)))
    assert tuples(one, "row", F.coalesce("parent", F.lit(-1)), "weight") == tuples(other, "row", F.coalesce("parent", F.lit(-1)), "weight")
    assert [t["bound"] for t in tiers] == [growth**k for k in range(len(tiers))]


@pytest.mark.parametrize("name,alpha,want", [("user_day", 0, 80), ("part_supp", 0, 36)])
def test_rising_distances_on_the_fixtures(spark, name, alpha, want):
    e = getattr(fx, name)(spark, SMALL)
    c = cm.compress(e, fx.sized(e), alpha, search="rising")
    assert c.deltas.count() == want if alpha == 0 else want <= c.deltas.count() <= want + 6
    assert cm.check_compressed(c, e)


def test_words_that_all_documents_have_make_no_pairs(spark):
    e = fx.doc_word(spark, SMALL)
    rows = e.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"))
    assert rows.agg(F.sum("nnz")).first()[0] == 53_140
    forest, tiers = similarity.rising_forest(e, 0, first=4, growth=8)
    assert tree.tree_of_links(forest, rows).agg(F.sum("weight")).first()[0] == 46_528
    assert sum(t["verified"] for t in tiers) < 200 * 199 / 2 / 4


def test_loose_pairs_are_never_made(spark):
    # ten groups of near rows; all rows share forty columns, which the plain join would pair
    pairs = [(r, c) for r in range(200) for c in range(40)] + [(r, 1000 + 50 * (r % 10) + k) for r in range(200) for k in range(45)] + [(r, 2000 + r) for r in range(200)]
    e = graph(spark, pairs)
    forest, tiers = similarity.rising_forest(e, 0)
    made = sum(t["verified"] for t in tiers)
    assert forest.where("w = 2").count() == 190 and made < 200 * 199 / 2
    rows = e.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"))
    totals = [tree.tree_of_links(x, rows).agg(F.sum("weight")).first()[0] for x in (forest, similarity.row_links(e, 0))]
    assert totals[0] == totals[1]


def test_unknown_searches_raise(spark):
    with pytest.raises(ValueError, match="unknown search"):
        cm.compress(graph(spark, HAND), 4, search="other")


# Heavy columns


def test_heavy_columns_give_the_plain_overlaps(spark):
    for seed in (4, 5):
        e, _ = clustered(spark, seed, rows=90, columns=150)
        e = e.union(graph(spark, [(r, 500) for r in range(45)] + [(200, 500), (201, 501), (None, 500)]))
        want = tuples(similarity._light_overlap(e.where("src is not null")), "u", "v", "overlap")
        for share, least in ((0.0, 0), (0.3, 2), (0.5, 2), (2.0, 0)):
            assert tuples(similarity.row_overlap(e, share, least), "u", "v", "overlap") == want


def test_a_column_of_half_the_rows_is_spread(spark):
    blocks = 8
    e = spark.range(4000).select(F.col("id").alias("src"), F.lit(0).alias("bit"))
    pairs = similarity._heavy_overlap(e.where("src % 2 = 0"), 1, blocks)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    met = pairs.groupBy(F.least(block("u"), block("v")).alias("p"), F.greatest(block("u"), block("v")).alias("q")).count().select("count").collect()
    sizes = sorted(r[0] for r in met)
    assert len(sizes) == blocks * (blocks + 1) // 2 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and sum(sizes) == 2000 * 1999 // 2


# Paths and tours


def random_tree(seed, n, deep):
    rng = random.Random(seed)
    return {v: None if v == 0 or rng.random() < 0.02 else (v - 1 if deep and rng.random() < 0.9 else rng.randrange(v)) for v in range(n)}


@pytest.mark.parametrize("few,deep", [(10**6, False), (10**6, True), (0, True)])
def test_heavy_paths(spark, few, deep):
    up = random_tree(7, 300, deep)
    t = spark.createDataFrame(list(up.items()), "row long, parent long")
    paths = {r.row: r for r in tree.heavy_paths(t, few).collect()}
    assert set(paths) == set(up)
    for v, r in paths.items():
        p = up[v]
        if r.place:
            assert paths[p].head == r.head and paths[p].place == r.place - 1 and paths[p].level == r.level
        else:
            assert r.head == v and r.above == (tree.ROOT if p is None else p) and r.level == (0 if p is None else paths[p].level + 1)
    assert max(r.level for r in paths.values()) <= np.log2(len(up)) + 1
    for width in (3, 70):
        z = np.random.default_rng(1).integers(-9, 9, (305, width)).astype(float)
        want = z.copy()
        for v in range(300):
            want[v] += want[up[v]] if up[v] is not None else 0
        assert np.allclose(dense(tree.tree_update(t, vectors(spark, z), tree.heavy_paths(t, few), span=16)), want)


def test_a_chain_of_100_000_rows_is_one_pass(spark):
    n = 100_000
    t = spark.range(n).select(F.col("id").alias("row"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    paths = tree.heavy_paths(t)
    assert paths.agg(F.max("level"), F.max("place"), F.countDistinct("head")).first()[:] == (0, n - 1, 1)
    z = spark.range(n).select(F.col("id").alias("node"), F.array(F.lit(1.0)).alias("x"))
    got = tree.tree_update(t, z, paths)
    assert got.where("x[0] <> node + 1").isEmpty() and got.count() == n


def test_a_hub_is_walked_by_many_tasks(spark):
    n = 3_000
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(tree.ROOT, 0)], "a long, b long"))
    got = tree.orient_tree(links.withColumn("w", F.col("b") % 5), few=0)
    assert got.where("row > 0").agg(F.count(F.lit(1)), F.min("parent"), F.max("parent"), F.min("depth"), F.max("depth")).first()[:] == (n - 1, 0, 0, 2, 2)
    assert got.where("w <> row % 5").isEmpty()
    arcs = spark.range(n).select(F.col("id").alias("u"), F.lit(7).cast("long").alias("v"))
    after = tree._next_arcs(arcs)
    assert after.where("w = u + 1").count() == n - 1 and after.where("w is null").first().f == 0


# Rows, hubs and whole messages


def test_row_chunks(spark):
    rng = random.Random(8)
    pairs = sorted({(0, rng.randrange(500)) for _ in range(400)} | {(rng.randrange(1, 9), rng.randrange(50)) for _ in range(60)})
    weighed = spark.createDataFrame([(s, d, float(d % 7)) for s, d in pairs], "src long, dst long, weight double").repartition(3)
    chunks = ed.to_row_chunks(weighed, 32, n=12).collect()
    assert max(r.nnz for r in chunks) <= 32 and {r.row for r in chunks} == set(range(12))
    whole = {}
    for r in sorted(chunks, key=lambda r: (r.row, r.chunk)):
        assert r.nnz == len(r.entries)
        whole.setdefault(r.row, []).append((r.chunk, [(e.col, e.val) for e in r.entries]))
    for row, parts in whole.items():
        assert [k for k, _ in parts] == list(range(len(parts)))
        assert sum((p for _, p in parts), []) == [(d, float(d % 7)) for s, d in pairs if s == row]
    assert tuples(ed.to_edges(ed.to_row_chunks(weighed, 32)), "src", "dst", "weight") == [(s, d, float(d % 7)) for s, d in pairs]
    c = cm.compress(graph(spark, HAND), 5, 0)
    assert cm.delta_layout(c, "chunks").agg(F.sum("nnz"), F.countDistinct("row")).first()[:] == (5, 5)
    assert ed.to_row_chunks(graph(spark, [])).count() == 0


def test_hubs_are_joined_by_broadcast(spark):
    e = spark.range(1000).select(F.when(F.col("id") % 5 < 2, 3).otherwise(F.col("id") % 97).cast("long").alias("src"), (F.col("id") % 101).alias("dst"))
    x = spark.range(110).select(F.col("id").alias("node"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    assert tuples(pr.propagate(e, x, 110, 2, hubs=20), "node", "x") == tuples(pr.propagate(e, x, 110, 2), "node", "x")
    assert tuples(pr.gather(e, x, hubs=20), "src", "dst", "x_j") == tuples(pr.gather(e, x), "src", "dst", "x_j")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pr.gather(e, x, hubs=20)._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert "BroadcastHashJoin" not in pr.gather(e, x, hubs=2)._jdf.queryExecution().toString()  # none has half of the edges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_messages(spark):
    e = spark.createDataFrame([(0, 3, 1.0), (1, 3, 3.0), (2, 3, None), (1, 4, 0.0), (2, 5, 2.0)], "src long, dst long, far double")
    x = vectors(spark, [[3.0, 4.0], [-5.0, 0.0], [0.0, 1000.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]])
    pick = lambda how, **k: dense(pr.propagate(e, x, 6, 2, aggregate=how, **k))[3:].tolist()
    assert pick(aggregates.Largest()) == [[0, 1000], [-5, 0], [0, 1000]]
    assert dense(pr.propagate(e.where("src < 2"), x, 4, 2, aggregate=aggregates.Largest()))[3].tolist() == [3, 4]  # of equal norms
    assert pick(aggregates.WeightedMean("far"), message=lambda x_j: x_j) == [[-3, 1], [0, 0], [0, 1000]]
    soft = pick(aggregates.SoftMaximum())
    assert soft[0][1] == 1000 and np.isclose(soft[0][0], (3 + -5 * np.exp(-8) + 0) / (1 + np.exp(-8) + np.exp(-3)))
    with pytest.raises(NotImplementedError):
        pick(aggregates.WholeAggregate())


def test_merging_trees(spark):
    for seed, alpha in ((1, 2),):
        rng = random.Random(seed)
        e = graph(spark, [(r, c) for r in range(22) for c in range(14) if rng.random() < 0.25 + 0.03 * (r % 10)])
        cand = similarity.candidate_edges(e, alpha)
        legal = {(r.parent, r.child): r.weight for r in cand.collect()}
        totals = {}
        for method in ("mst", "merged", "exact"):
            t = {r.row: r for r in tree.compression_tree(cand, alpha, method).collect()}
            assert all(legal[r.parent, r.row] == r.weight for r in t.values()) and set(t) == {v for p, v in legal if p is None}
            assert all(r.depth == (1 if r.parent is None else t[r.parent].depth + 1) for r in t.values())
            totals[method] = sum(r.weight for r in t.values())
        assert totals["exact"] <= totals["merged"] <= totals["mst"]


def test_a_merge_turns_a_way_round(spark):
    # 0-1-2 hang together, 0 is their shortest row; 2 comes cheaper below 9 than 0 below the root
    tree_rows = spark.createDataFrame([(0, None, 5), (1, 0, 2), (2, 1, 2), (3, 1, 1), (9, None, 9)], "row long, parent long, weight long")
    arcs = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (1, 3, 1), (1, 0, 2), (2, 1, 2), (9, 2, 4)], "parent long, child long, weight long")
    got = {r.row: (r.parent, r.weight, r.depth) for r in tree.merged_tree(tree_rows, arcs).collect()}
    assert got == {9: (None, 9, 1), 2: (9, 4, 2), 1: (2, 2, 3), 0: (1, 2, 4), 3: (1, 1, 4)}
    same = tree.merged_tree(tree_rows, arcs.where("not (parent = 2 and child = 1)"))  # a way that may not be turned
    assert {(r.row, r.parent) for r in same.collect()} == {(0, None), (1, 0), (2, 1), (3, 1), (9, None)}


@pytest.mark.parametrize("sf,name,alpha,want", [("sf0.001", "user_day", 2, 80), ("sf0.01", "part_supp", 2, 47_952)])
def test_merged_trees_are_the_least_on_the_fixtures(spark, sf, name, alpha, want):
    e = getattr(fx, name)(spark, f"/root/testdata/{sf}")
    c = cm.compress(e, fx.sized(e), alpha, method="merged")
    assert c.deltas.count() == want and cm.check_compressed(c, e)


def test_dense_rows_are_compared_in_blocks(spark):
    rng = random.Random(9)
    pairs = [(r, c) for r in range(40) for c in range(12) if rng.random() < 0.7] + [(r, 100 + r) for r in range(40)] + [(60, 200), (61, 12)]
    e = graph(spark, pairs)
    for alpha in (0, 2):
        found = similarity.pruned_overlap(e, alpha)
        assert "dst" not in found.columns and "sequence" in found._jdf.queryExecution().toString()  # blocks
        one, other = (tuples(similarity.candidate_edges(e, alpha, pruned=p), F.coalesce("parent", F.lit(-1)), "child", "weight") for p in (True, False))
        assert one == other


def test_rows_that_meet_by_chance_are_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_HEAVY", 8)  # so that columns are joined
    rng = random.Random(11)
    rows = {r: rng.sample(range(60), 12) for r in range(200)}
    rows.update({200 + r: rows[r][1:] + [70 + r] for r in range(10)} | {300: [3], 301: [3, 4]})
    e = graph(spark, [(r, c) for r, cs in rows.items() for c in cs])
    for alpha in (2,):
        want = [(p, c, len(set(rows[p]) ^ set(rows[c]))) for p in rows for c in rows if p != c and len(set(rows[p]) ^ set(rows[c])) < len(rows[c]) - alpha]
        for prefix in (True, False):
            assert similarity.pruned_overlap(e, alpha, prefix).count() < 2_500  # of some 20,000 that share a column
            got = similarity.candidate_edges(e, alpha, pruned=prefix).where("parent is not null")
            assert tuples(got, "parent", "child", "weight") == sorted(want)


def test_copies_are_members_of_a_kind(spark, monkeypatch):
    rng = random.Random(12)
    e = graph(spark, [(r, c) for r in range(12) for c in rng.sample(range(14), 9)])
    copies = e.union(e.where("src < 6").select(F.col("src") + 20, "dst")).union(e.where("src < 6").select(F.col("src") + 40, "dst"))
    got = similarity.kind_distances(copies)
    assert got.where("not same").count() <= 12 * 11 // 2 and got.where("same").count() == 12
    kinds = got.where("same").select("u", "v").union(e.select("src", "src").distinct())
    pairs = got.where("not same").select(F.col("u").alias("a"), F.col("v").alias("b"), "overlap").union(e.groupBy("src").agg(F.count(F.lit(1)).alias("k")).select("src", "src", "k"))
    whole = pairs.join(kinds.toDF("a", "u"), "a").join(kinds.toDF("b", "v"), "b").where("u <> v").select(F.least("u", "v"), F.greatest("u", "v"), "overlap").distinct()
    assert sorted(map(tuple, whole.collect())) == tuples(similarity._light_overlap(copies), "u", "v", "overlap")
    monkeypatch.setattr(similarity, "row_links", None)  # dense rows write no list of all links
    rows = copies.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"))
    forest, tiers = similarity.rising_forest(copies, 2)
    assert sum(t["verified"] for t in tiers) <= 12 * 11 // 2 and similarity.spanning_links(copies, 2).count() == forest.count()
    every = similarity.candidate_edges(copies, 2, pruned=False).where("parent < child").select(F.col("parent").alias("a"), F.col("child").alias("b"), F.col("weight").alias("w"))
    other = similarity.candidate_edges(copies, 2, pruned=False).where("parent > child").select(F.col("child").alias("a"), F.col("parent").alias("b"), F.col("weight").alias("w"))
    one, two = (tree.tree_of_links(f, rows, 2).agg(F.sum("weight")).first()[0] for f in (forest, every.union(other).distinct()))
    assert one == two


def test_a_pair_is_met_one_way_round(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_dense", lambda ranked, rows: (None, []))
    e = graph(spark, [(0, c) for c in range(4)] + [(1, c) for c in range(5)])
    forest, tiers = similarity.rising_forest(e)
    assert tuples(forest, "a", "b", "w") == [(0, 1, 1)]
    assert (tiers[0]["joined"], tiers[0]["verified"]) == (1, 1)
