"""Spanning trees over row candidates, and prefix sums along tree paths.

Loops are driven from here, their state is in tables: each round is a few joins
and is written to the shared folder, which bounds the lineage.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.storage import materialize
from ..functions.vectors import BLOCK, add

ROOT = -1
#: Links up to this number (a few MB) are handled by one task; more are joined. Both give the same result.
FEW = 100_000


def _roots_of(pointers: DataFrame) -> DataFrame:
    """node, top: follow ``ptr`` to its end (ptr = node) by doubling."""
    now = materialize(pointers, "pointers")
    while True:
        up = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("top"))
        new = materialize(now.join(up, "ptr").select("node", F.col("ptr").alias("was"), "top"), "pointers")
        if new.where("was <> top").isEmpty():
            return new.select("node", "top")
        now = new.select("node", F.col("top").alias("ptr"))


def _spanning(frame):
    """The forest of a few links, cheapest first, with the components that each link joins."""
    import pandas as pd

    up: dict[int, int] = {}

    def top(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    out = []
    order = frame.assign(inner=frame["a"] != ROOT).sort_values(["w", "inner", "a", "b"])
    for a, b, w, ca, cb in zip(*[order[c].tolist() for c in ("a", "b", "w", "ca", "cb")], strict=True):
        p, q = top(ca), top(cb)
        if p != q:
            up[p] = q
            out.append((a, b, w, ca, cb))
    return pd.DataFrame(out, columns=["a", "b", "w", "ca", "cb"], dtype="int64")


def _kruskal(frame):
    return _spanning(frame)[["a", "b", "w"]]


def _filtered(batches, at_once: int = 200_000):
    """The links of a part of all that its own forest keeps (a, b, w, ca, cb)."""
    import pandas as pd

    held, size = [], 0
    for frame in batches:
        held.append(frame)
        size += len(frame)
        if size >= at_once:
            held = [_spanning(pd.concat(held))]
            size = len(held[0])
    if held:
        yield _spanning(pd.concat(held))


def _boruvka(links: DataFrame, few: int = FEW, most_rounds: int = 64) -> DataFrame:
    """a, b, w: minimum spanning forest of ``links`` (a < b, w). Ties go to edges
    of the root (the least id), then to the least (a, b): a total order, so the
    choice is repeatable and closes no cycle. While there are ``few`` components at
    most, each task first leaves out what a forest of its own links does without
    (links that no forest of all needs). Once ``few`` links at most are left
    between components, one task ends the search with the same choice."""
    live = materialize(links.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "links")
    chosen = links.limit(0).select("a", "b", "w")
    for _ in range(most_rounds):
        if live.limit(few + 1).count() > few and live.select(F.explode(F.array("ca", "cb")).alias("c")).distinct().limit(few + 1).count() <= few:
            live = materialize(live.mapInPandas(_filtered, live.schema), "links")
        if live.limit(few + 1).count() <= few:
            rest = live.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_kruskal, "a long, b long, w long")
            return materialize(chosen.union(rest), "forest")
        order = F.struct("w", (F.col("a") != ROOT).cast("int").alias("inner"), "a", "b")
        sides = live.select(F.col("ca").alias("c"), F.col("cb").alias("o"), order.alias("k")).union(live.select("cb", "ca", order))
        picks = materialize(sides.groupBy("c").agg(F.min(F.struct("k", "o")).alias("p")).select("c", "p.k", "p.o"), "picks")
        chosen = materialize(chosen.union(picks.select("k.a", "k.b", "k.w").distinct()), "forest")
        back = picks.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        pointers = picks.join(back, "o", "left").select(F.col("c").alias("node"), F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("ptr"))
        top = _roots_of(pointers)
        live = live.join(top.select(F.col("node").alias("ca"), F.col("top").alias("ta")), "ca").join(top.select(F.col("node").alias("cb"), F.col("top").alias("tb")), "cb")
        live = materialize(live.where("ta <> tb").select("a", "b", "w", F.col("ta").alias("ca"), F.col("tb").alias("cb")), "links")
    raise RuntimeError("the forest did not settle")


def _walked(frame):
    """row, parent, depth and weight of a few links, from the root on."""
    import pandas as pd

    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in zip(frame["a"].tolist(), frame["b"].tolist(), frame["w"].tolist(), strict=True):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    out, todo = {ROOT: (ROOT, 0, 0)}, [ROOT]
    for p in todo:
        depth = out[p][1] + 1
        for v, w in near.get(p, ()):
            if v not in out:
                out[v] = (p, depth, w)
                todo.append(v)
    del out[ROOT]
    return pd.DataFrame([(v, *x) for v, x in out.items()], columns=["row", "p", "depth", "w"], dtype="int64")


def _next_arcs(arcs: DataFrame) -> DataFrame:
    """u, v, w, f: the neighbour of v that follows u (null after the last), and for the last one v's first neighbour.

    Arcs are sorted over all tasks, and each is joined with the one behind it by
    its place, so a node of any degree is as many rows of as many tasks.
    """
    ordered = materialize(numbered(arcs, "v", "u"), "arcs")
    behind = ordered.select((F.col("at") - 1).alias("at"), F.col("v").alias("vb"), F.col("u").alias("ub"))
    after = ordered.join(behind, "at", "left").select("u", "v", F.when(F.col("vb") == F.col("v"), F.col("ub")).alias("w"))
    first = arcs.groupBy("v").agg(F.min("u").alias("f"))
    last = after.where("w is null").join(first, "v").select("u", "v", "w", "f")  # one for each node
    return after.where("w is not null").withColumn("f", F.lit(None).cast("long")).union(last)


def _toured(links: DataFrame) -> DataFrame:
    """row, p (its parent) and size (rows below and itself; null below the root) by an Euler tour of each tree below the root, ranked by pointer doubling.

    The arc into a row after the arc (u, v) is the one to v's next neighbour
    after u. An arc leads away from the root if its tour passes it before its
    reverse.
    """
    tops = links.where(F.col("a") == ROOT).select(F.col("b").alias("v"))
    inner = links.where(F.col("a") != ROOT)
    arcs = inner.select(F.col("a").alias("u"), F.col("b").alias("v")).union(inner.select("b", "a"))
    # a tour ends where it comes back to its top for the last time
    ended = _next_arcs(arcs).join(tops.withColumn("top", F.lit(True)), "v", "left").select("u", "v", F.coalesce("w", F.when(F.col("top").isNull(), F.col("f"))).alias("w"))
    now = materialize(ended.select("u", "v", F.when(F.col("w").isNotNull(), F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("nxt"), F.lit(1).cast("long").alias("rank")), "tour")
    while not now.where("nxt is not null").isEmpty():
        on = now.select(F.struct("u", "v").alias("nxt"), F.col("nxt").alias("further"), F.col("rank").alias("more"))
        now = materialize(now.join(on, "nxt", "left").select("u", "v", F.col("further").alias("nxt"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "tour")
    back = now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("rank").alias("back"))
    down = now.join(back, ["u", "v"]).where("rank > back").select(F.col("v").alias("row"), F.col("u").alias("p"), F.floor((F.col("rank") - F.col("back") + 1) / 2).alias("size"))
    return down.union(tops.select("v", F.lit(ROOT).cast("long"), F.lit(None).cast("long")))


def orient_tree(links: DataFrame, few: int = FEW) -> DataFrame:
    """row, parent, depth, w of an undirected tree (a, b, w if there is one) rooted at ``ROOT``; root
    children have a null parent and depth 1.

    ``few`` links at most are walked in one task; more take a number of joins
    that follows the logarithm of the rows, whatever the depth and the degrees.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w") if "w" in links.columns else F.lit(0).cast("long").alias("w")), "tree")
    parent = F.when(F.col("p") != ROOT, F.col("p")).alias("parent")
    if links.limit(few + 1).count() <= few:
        down = links.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_walked, "row long, p long, depth long, w long")
        return materialize(down.select("row", parent, F.col("depth").cast("int").alias("depth"), "w"), "oriented")
    down = _toured(links).withColumn("a", F.least("row", "p")).withColumn("b", F.greatest("row", "p")).join(links, ["a", "b"])
    return depths(materialize(down.select("row", parent, "w"), "oriented")).select("row", "parent", "depth", "w")


def depths(tree: DataFrame) -> DataFrame:
    """``tree`` (row, parent and others) with depth (1 below the root), by pointer doubling."""
    rest = [c for c in tree.columns if c != "depth"]
    now = tree.select(*rest, F.lit(1).cast("long").alias("depth"), F.col("parent").alias("ptr"))
    while not now.where("ptr is not null").isEmpty():
        up = now.select(F.col("row").alias("ptr"), F.col("depth").alias("_more"), F.col("ptr").alias("_further"))
        now = materialize(now.join(up, "ptr", "left").select(*rest, (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_further").alias("ptr")), "depths")
    return now.select(*rest, F.col("depth").cast("int").alias("depth"))


def components(links: DataFrame) -> DataFrame:
    """node, component (least id) of undirected links (a, b), by least labels and doubling."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    both = materialize(both, "both")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jumped = low.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        new = materialize(jumped.select("node", F.least("label", "far").alias("label"), "was"), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def _united(frame):
    """node and component (its least node) of a few links."""
    import pandas as pd

    up: dict[int, int] = {}

    def top(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return pd.DataFrame([(v, top(v)) for v in list(up)], columns=["node", "component"], dtype="int64")


def forest_components(forest: DataFrame, few: int = FEW) -> DataFrame:
    """The same for the links of a written forest: up to ``few`` in one task."""
    if forest.limit(few + 1).count() > few:
        return components(forest)
    return forest.select("a", "b").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_united, "node long, component long")


def least_arborescence(n: int, arcs: list[tuple[int, int, int]]) -> dict[int, int]:
    """child -> parent of the cheapest tree from node 0 over arcs (parent, child,
    weight), by contracting cycles. Every node must be reachable from 0.

    A contracted cycle is a new node. Arcs into a node are a heap, whose weights
    count from the node's own offset; of two heaps the smaller goes into the larger.
    """
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (_, c, w) in enumerate(arcs):
        heaps[c].append((w, k))
    for h in heaps:
        heapq.heapify(h)
    offset, up, same = [0] * n, [-1] * n, list(range(n))  # what all weights are more by; the cycle that holds it
    best: list[int] = [-1] * n

    def now(v: int) -> int:
        while same[v] != v:
            same[v] = same[same[v]]
            v = same[v]
        return v

    state = [0] * n  # 1: on the walk, 2: settled
    state[0] = 2
    for start in range(1, n):
        u, walk = now(start), []
        while state[u] != 2:
            if state[u] == 1:  # the walk has closed a cycle
                members = [walk.pop()]
                while members[-1] != u:
                    members.append(walk.pop())
                c = len(heaps)
                large = max(members, key=lambda v: len(heaps[v]))
                heap, base = heaps[large], offset[large]
                for v in members:
                    if v != large:
                        for w, k in heaps[v]:
                            heapq.heappush(heap, (w + offset[v] - base, k))
                        heaps[v] = []
                    up[v] = same[v] = c
                heaps[large] = []
                heaps.append(heap)
                offset.append(base)
                up.append(-1)
                same.append(c)
                best.append(-1)
                state.append(0)
                u = c
            while now(arcs[heaps[u][0][1]][0]) == u:
                heapq.heappop(heaps[u])
            w, k = heaps[u][0]
            best[u], state[u] = k, 1
            offset[u] -= w + offset[u]  # another arc into u saves this one
            walk.append(u)
            u = now(arcs[k][0])
        for v in walk:
            state[v] = 2
    for c in range(len(heaps) - 1, n - 1, -1):  # what enters a cycle enters one of its members
        x = arcs[best[c]][1]
        while up[x] != c:
            x = up[x]
        best[x] = best[c]
    return {v: arcs[best[v]][0] for v in range(1, n)}


def compression_tree(candidates: DataFrame, alpha: int = 0, method: str = "mst", largest: int = 5_000) -> DataFrame:
    """row, parent (null: root), weight, depth from ``candidate_edges``.

    ``mst`` is a distributed minimum spanning tree with root edges of
    nnz - alpha: the least total for alpha 0, a legal and nearly least one
    above. ``merged`` goes on from there (``merged_tree``). ``exact`` solves each
    connected group of candidates apart and raises beyond ``largest`` rows in a
    group.
    """
    cand = materialize(candidates, "candidates")
    if method == "exact":
        return _exact(cand, largest)
    if method not in ("mst", "merged"):
        raise ValueError(f"unknown method {method}")
    inner = cand.where("parent is not null").select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"), F.col("weight").alias("w")).distinct()
    tree = tree_of_links(inner, cand.where("parent is null").select(F.col("child").alias("row"), F.col("weight").alias("nnz")), alpha)
    return tree if method == "mst" else merged_tree(tree, cand.where("parent is not null"))


def merged_tree(tree: DataFrame, arcs: DataFrame, most_rounds: int = 64) -> DataFrame:
    """row, parent, weight, depth: ``tree`` with fewer differences, by hanging whole trees below rows of others.

    In a spanning tree with root edges of nnz - alpha no row has a cheaper legal
    parent outside of the rows below it. But a tree under the root may come
    cheaper as a whole: one of its rows, v, gets a legal parent u in another
    tree, and the way from v up to the tree's top is turned round. That is legal
    if each row of the way may hang below the one that hung below it, and gains
    if the difference of u and v is less than the top row's own length.
    ``arcs`` (parent, child, weight) are the legal ones.

    A round finds each tree's best merge and makes all that do not meet: one
    goes ahead unless the tree it goes to has a better merge of its own, so no
    cycle can close. The ways to the tops are read off the heavy paths, one
    join a level.
    """
    now = materialize(tree.select("row", "parent", "weight"), "tree")
    arcs = materialize(arcs.select(F.col("parent").alias("u"), F.col("child").alias("v"), F.col("weight").alias("h")), "arcs")
    for _ in range(most_rounds):
        paths = heavy_paths(now)
        turned = now.join(arcs.select(F.col("u").alias("row"), F.col("v").alias("parent"), F.lit(True).alias("turns")), ["row", "parent"], "left")
        marks = F.array(F.when(F.col("parent").isNull(), F.col("row")).otherwise(0).cast("double"), F.when(F.col("parent").isNull() | F.col("turns"), 0.0).otherwise(1.0))
        sums = tree_update(now, turned.select(F.col("row").alias("node"), marks.alias("x")), paths)
        labels = materialize(sums.select("node", F.col("x")[0].cast("long").alias("top"), (F.col("x")[1] == 0).alias("free")), "labels")
        tops = now.where("parent is null").select(F.col("row").alias("a"), F.col("weight").alias("saved"))
        found = arcs.join(labels.where("free").select(F.col("node").alias("v"), F.col("top").alias("a")), "v").join(tops, "a").where("h < saved").join(labels.select(F.col("node").alias("u"), F.col("top").alias("b")), "u").where("a <> b")
        best = found.groupBy("a").agg(F.min(F.struct((F.col("h") - F.col("saved")).alias("k"), F.col("v").alias("v"), F.col("u").alias("u"), F.col("h").alias("h"), F.col("b").alias("b"))).alias("m")).select("a", "m.*")
        best = materialize(best, "merges")
        other = best.select(F.col("a").alias("b"), F.col("k").alias("their"))
        kept = best.join(other, "b", "left").where("their is null or k < their or (k = their and a < b)").select("a", "v", "u", "h")
        kept = materialize(kept, "kept")
        if kept.isEmpty():
            break
        # the stretches of heavy paths from v up to the top; under: what the lowest row of each hangs below from now on
        step = kept.join(paths.withColumnRenamed("row", "v"), "v").select("head", "place", F.col("u").alias("under"), "h", "above")
        ways = step
        while True:
            step = materialize(step.where(F.col("above") != ROOT).select(F.col("head").alias("under"), F.col("above").alias("row")).join(paths, "row").select("head", "place", "under", F.lit(None).cast("long").alias("h"), "above"), "ways")
            if step.isEmpty():
                break
            ways = ways.unionByName(step)
        ways = materialize(ways.select("head", F.col("place").alias("last"), "under", "h"), "ways")
        on = paths.select("row", "head", "place").join(ways, "head").where("place <= last")
        below = paths.select(F.col("row").alias("next"), "head", (F.col("place") - 1).alias("place"))
        moved = on.join(below, ["head", "place"], "left").select("row", F.when(F.col("place") == F.col("last"), F.col("under")).otherwise(F.col("next")).alias("to"), F.when(F.col("place") == F.col("last"), F.col("h")).alias("h"))
        weights = now.select(F.col("row").alias("to"), F.col("weight").alias("w"))  # of the link that is turned round
        moved = moved.join(weights, "to").select("row", "to", F.coalesce("h", "w").alias("w"))
        now = materialize(now.join(moved, "row", "left").select("row", F.coalesce("to", "parent").alias("parent"), F.coalesce("w", "weight").alias("weight")), "tree")
    return depths(now).select("row", "parent", "weight", "depth")


def tree_of_links(inner: DataFrame, rows: DataFrame, alpha: int = 0) -> DataFrame:
    """row, parent, weight, depth: the minimum spanning tree of links between rows (a < b, w) and of root edges of nnz - alpha (row, nnz).

    Rows without a link have their root edge alone; the search is among the others.
    """
    inner = materialize(inner.select("a", "b", "w"), "links")
    linked = materialize(inner.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "linked")
    root = rows.join(linked, "row", "left_semi").select(F.lit(ROOT).cast("long").alias("a"), F.col("row").alias("b"), (F.col("nnz") - alpha).alias("w"))
    tree = orient_tree(_boruvka(inner.union(root)))
    tree = tree.select("row", "parent", (F.col("w") + F.when(F.col("parent").isNull(), alpha).otherwise(0)).alias("weight"), "depth")
    alone = rows.join(linked, "row", "left_anti").select("row", F.lit(None).cast("long").alias("parent"), F.col("nnz").cast("long").alias("weight"), F.lit(1).alias("depth"))
    return tree.union(alone)


def _exact(cand: DataFrame, largest: int) -> DataFrame:
    links = cand.where("parent is not null").select(F.col("parent").alias("a"), F.col("child").alias("b"))
    groups = components(links)
    rows = cand.join(groups.withColumnRenamed("node", "child"), "child", "left").withColumn("component", F.coalesce("component", "child"))
    sizes = rows.where("parent is null").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    if over := sizes.where(F.col("n") > largest).head(1):
        raise ValueError(f"a group of {over[0].n} rows is beyond {largest}; use method='mst'")

    def solve(frame):
        import pandas as pd

        ids = {r: k + 1 for k, r in enumerate(sorted(frame["child"].unique()))}
        names = {k: r for r, k in ids.items()}
        arcs = sorted((0 if pd.isna(p) else ids[int(p)], ids[c], int(w)) for p, c, w in zip(frame["parent"], frame["child"], frame["weight"], strict=True))
        weights = {(p, c): w for p, c, w in arcs}
        found = least_arborescence(len(ids) + 1, arcs)
        return pd.DataFrame({"row": [names[c] for c in found], "p": [names.get(p, ROOT) for p in found.values()], "w": [weights[p, c] for c, p in found.items()]})

    picked = rows.select("component", "parent", "child", "weight").groupBy("component").applyInPandas(solve, "row long, p long, w long")
    tree = orient_tree(picked.select(F.col("p").alias("a"), F.col("row").alias("b"), "w"))
    return tree.select("row", "parent", F.col("w").alias("weight"), "depth")


def path_sums(tree: DataFrame, values: DataFrame) -> DataFrame:
    """row, col, val: sums of ``values`` (row, col, val) along each row's path to the root; zeros are left out.

    Pointer doubling on sparse rows: a sum over part of a path is the difference
    of two rows, so what cancels goes at once.
    """
    sums = materialize(values.select("row", "col", F.col("val").cast("long").alias("val")), "sums")
    jump = materialize(tree.select("row", "parent").where("parent is not null"), "jump")
    while not jump.isEmpty():
        above = jump.join(sums.withColumnRenamed("row", "parent"), "parent").select("row", "col", "val")
        sums = materialize(sums.union(above).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0"), "sums")
        up = jump.select(F.col("row").alias("parent"), F.col("parent").alias("further"))
        jump = materialize(jump.join(up, "parent").select("row", F.col("further").alias("parent")), "jump")
    return sums


def _decomposed(frame):
    """row, head, place, level, above of the heavy paths of a small tree."""
    import pandas as pd

    up = {r: ROOT if pd.isna(p) else int(p) for r, p in zip(frame["row"].tolist(), frame["parent"], strict=True)}
    below: dict[int, list[int]] = {}
    for r, p in up.items():
        below.setdefault(p, []).append(r)
    order = list(below.get(ROOT, ()))
    for v in order:
        order += below.get(v, ())
    size = dict.fromkeys(order, 1)
    for v in reversed(order):
        if up[v] != ROOT:
            size[up[v]] += size[v]
    heavy = {p: max(vs, key=lambda v: (size[v], -v)) for p, vs in below.items() if p != ROOT}
    out: dict[int, tuple] = {}
    for v in order:
        p = up[v]
        if p != ROOT and heavy[p] == v:
            head, place, level, above = out[p]
            out[v] = (head, place + 1, level, above)
        else:
            out[v] = (v, 0, out[p][2] + 1 if p != ROOT else 0, p)
    return pd.DataFrame([(v, *x) for v, x in out.items()], columns=["row", "head", "place", "level", "above"], dtype="int64")


def _sized(tree: DataFrame) -> DataFrame:
    """row, p (its parent) and size (rows below and itself), by pointer doubling.

    After k rounds a row counts those less than 2^k below it and points 2^k up;
    those that point at it bring what they count.
    """
    now = materialize(tree.select("row", F.coalesce("parent", F.lit(ROOT)).cast("long").alias("p"), F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size")), "sizes")
    while not now.where("ptr is not null").isEmpty():
        up = now.select(F.col("row").alias("ptr"), F.col("ptr").alias("further"))
        more = now.where("ptr is not null").groupBy(F.col("ptr").alias("row")).agg(F.sum("size").alias("more"))
        now = materialize(now.join(up, "ptr", "left").join(more, "row", "left").select("row", "p", F.col("further").alias("ptr"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    return now.select("row", "p", "size")


def heavy_paths(tree: DataFrame, few: int = FEW) -> DataFrame:
    """row, head, place, level, above: the tree (row, parent) cut into paths. Written.

    A row goes on the path of its parent if no other child has more rows below
    it (ties: the least child), else it heads one of its own. ``place`` is its
    place on the path, ``above`` the parent of the path's head (``ROOT`` for
    those below the root), ``level`` the number of paths above: the logarithm of
    the rows at most, as each holds half of what is below at most.

    Trees of up to ``few`` rows are cut in one task. Larger ones take sizes,
    heads and levels from pointer doubling: rounds follow the logarithm of the depth.
    """
    if tree.limit(few + 1).count() <= few:
        cut = tree.select("row", "parent").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_decomposed, "row long, head long, place long, level long, above long")
        return materialize(cut, "paths")
    down = _sized(tree)
    heavy = down.where(F.col("p") != ROOT).groupBy("p").agg(F.max_by("row", F.struct("size", -F.col("row"))).alias("row")).select("row", F.lit(True).alias("on"))
    joined = down.join(heavy, "row", "left")
    now = materialize(joined.select("row", "p", F.when(F.col("on"), F.col("p")).alias("ptr"), F.when(F.col("on"), 1).otherwise(0).cast("long").alias("place"), F.when(F.col("on"), F.col("p")).otherwise(F.col("row")).alias("head")), "heads")
    while not now.where("ptr is not null").isEmpty():
        up = now.select(F.col("row").alias("ptr"), F.col("ptr").alias("further"), F.col("place").alias("more"), F.col("head").alias("top"))
        now = materialize(now.join(up, "ptr", "left").select("row", "p", F.col("further").alias("ptr"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("top", "head").alias("head")), "heads")
    heads = now.where("row = head").select("head", F.col("p").alias("above"))
    onto = heads.join(now.select(F.col("row").alias("above"), F.col("head").alias("parent")), "above", "left").select(F.col("head").alias("row"), "parent", "above")
    levels = depths(materialize(onto, "onto"))
    return materialize(now.select("row", "head", "place").join(levels.select(F.col("row").alias("head"), (F.col("depth") - 1).cast("long").alias("level"), "above"), "head").select("row", "head", "place", "level", "above"), "paths")


def tree_update(tree: DataFrame, z: DataFrame, paths: DataFrame | None = None, span: int = 4_096) -> DataFrame:
    """node, x: y_v = z_v + y_parent(v), the sum of z along the path to the root.

    ``z`` is (node, x); nodes out of the tree keep z. ``paths`` may be the
    tree's ``heavy_paths``. Sums along a path are running sums, over stretches
    of ``span`` rows and then over the stretches. What is above a path is one row
    for the path and joined once a level, so wide rows cross between paths only.
    """
    paths = heavy_paths(tree) if paths is None else paths
    z = materialize(z.select("node", "x"), "z")
    first = z.where("x is not null").first()
    if first is None:
        return z
    width = len(first.x)
    most = paths.agg(F.coalesce(F.max("level"), F.lit(0)), F.coalesce(F.max("place"), F.lit(0))).first()
    rows = z.join(paths.select(F.col("row").alias("node"), "head", "place"), "node", "left").withColumn("head", F.coalesce("head", "node")).withColumn("place", F.coalesce("place", F.lit(0)))
    slices = F.array(*[F.slice("x", k + 1, BLOCK) for k in range(0, width, BLOCK)])
    rows = rows.select("node", "head", "place", F.floor(F.col("place") / span).alias("part"), F.posexplode(slices).alias("block", "v"))
    inside = W.partitionBy("head", "block", "part").orderBy("place")
    sums = rows.select("node", "head", "place", "part", "block", F.array(*[F.sum(F.get("v", F.lit(k))).over(inside) for k in range(min(width, BLOCK))]).alias("s"))
    if most[1] >= span:
        totals = sums.groupBy("head", "block", "part").agg(F.max_by("s", "place").alias("t"))
        over = W.partitionBy("head", "block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each ``span`` rows of a path
        before = totals.select("head", "block", "part", F.array(*[F.coalesce(F.sum(F.get("t", F.lit(k))).over(over), F.lit(0.0)) for k in range(min(width, BLOCK))]).alias("before"))
        sums = sums.join(before, ["head", "block", "part"]).withColumn("s", add(F.col("s"), F.col("before")))
    sums = materialize(sums.select("node", "head", "block", "s"), "sums")
    heads, base = paths.where("level > 0 and place = 0").select(F.col("row").alias("head"), "above", "level"), None
    for level in range(1, most[0] + 1):
        here = heads.where(F.col("level") == level).join(sums.select(F.col("node").alias("above"), F.col("head").alias("up"), "block", "s"), "above")
        if base is not None:  # the path of ``above`` is one level up
            here = here.join(base.select(F.col("head").alias("up"), "block", F.col("s").alias("t")), ["up", "block"], "left").withColumn("s", F.when(F.col("t").isNull(), F.col("s")).otherwise(add(F.col("s"), F.col("t"))))
        made = materialize(here.select("head", "block", "s"), "base")
        base = made if base is None else base.unionByName(made)
    if base is not None:
        sums = sums.join(base.select("head", "block", F.col("s").alias("t")), ["head", "block"], "left").withColumn("s", F.when(F.col("t").isNull(), F.col("s")).otherwise(add(F.col("s"), F.col("t"))))
    if width <= BLOCK:
        return sums.select("node", F.col("s").alias("x"))
    whole = sums.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("block", "s"))).alias("p"))
    return whole.select("node", F.slice(F.flatten("p.s"), 1, width).alias("x"))


def tree_update_scaled(tree: DataFrame, z: DataFrame, scales: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The same with the row scale on the left: applied once, after the sums."""
    from ..functions.vectors import scale

    return tree_update(tree, z, paths).join(scales.select("node", "scale"), "node").select("node", scale(F.col("x"), F.col("scale")).alias("x"))
