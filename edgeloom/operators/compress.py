"""Rows stored as signed differences from a parent row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.vectors import inv_sqrt
from .edges import coalesce_edges, to_row_chunks, to_rows
from .propagate import spmm
from .similarity import _one_of_each, bitmap_pairs, candidate_edges, dense_rows, equal_rows, pruned_overlap, rising_forest, row_distances, spanning_links
from .tree import ROOT, _boruvka, compression_tree, heavy_paths, path_sums, tree_of_links, tree_update, tree_update_scaled


def row_deltas(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """row, col, val: +1 in the row and not its parent, -1 the other way round."""
    own = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(True).alias("mine"))
    above = tree.where("parent is not null").select("row", F.col("parent").alias("src")).join(edges, "src").select("row", F.col("dst").alias("col"), F.lit(True).alias("theirs"))
    both = own.join(above, ["row", "col"], "full_outer").where("mine is null or theirs is null")
    return both.select("row", "col", F.when(F.col("mine"), 1.0).otherwise(-1.0).alias("val"))


def row_deltas_scaled(edges: DataFrame, tree: DataFrame, scales: DataFrame) -> DataFrame:
    """Deltas times the column's scale (node, scale), and their sign, which a scale of 0 leaves as it is."""
    return row_deltas(edges, tree).join(scales.select(F.col("node").alias("col"), "scale"), "col").select("row", "col", (F.col("val") * F.col("scale")).alias("val"), F.col("val").alias("sign"))


def edge_digest(edges: DataFrame) -> tuple[int, int, int, int]:
    """Edges, two order-free digests of (src, dst), and rows with a null id. Repeats change it.

    The second is a sum of 40 bits an edge, taken as two sums of 20 bits each, which no number of edges lets overflow.
    """
    one, two = F.xxhash64("src", "dst"), F.pmod(F.xxhash64("src", "dst", F.lit(1)), F.lit(1 << 40))
    total = lambda bits: F.coalesce(F.sum(bits), F.lit(0))
    n, x, high, low, nulls = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(one), F.lit(0)), total(F.shiftright(two, 20)), total(two.bitwiseAND(F.lit((1 << 20) - 1))), F.count_if(F.col("src").isNull() | F.col("dst").isNull())).first()
    return n, x, ((high << 20) + low) % (1 << 63), nulls


@dataclass
class Compressed:
    """tree (row, parent, weight, depth), deltas (row, col, val); if normalised, deltas also have sign, and there are scales (node, scale).

    ``digest`` tells of which edges the form is; ``paths`` are the tree's, once a product has asked for them.
    """

    n: int
    tree: DataFrame
    deltas: DataFrame
    scales: DataFrame | None = None
    digest: tuple[int, int, int, int] | None = None
    paths: DataFrame | None = None

    def heavy_paths(self) -> DataFrame:
        """The tree's heavy paths, cut once for all products."""
        if self.paths is None:
            self.paths = heavy_paths(self.tree)
        return self.paths

    def matmul(self, x: DataFrame, width: int) -> DataFrame:
        """A x, or D (A D) x if normalised: deltas first, then sums down the tree."""
        z = spmm(self.deltas.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("val").alias("weight")), x, self.n, width)
        return tree_update(self.tree, z, self.heavy_paths()) if self.scales is None else tree_update_scaled(self.tree, z, self.scales, self.heavy_paths())

    def check_source(self, edges: DataFrame, normalized: bool | None = None) -> None:
        """Raise unless the form is of these edges, each of which may be there once; if asked, also unless it is (not) the normalised one. One pass."""
        if normalized is not None and normalized != (self.scales is not None):
            raise ValueError("the compressed form is " + ("not " if normalized else "") + "normalised")
        if self.digest is None:
            raise ValueError("the compressed form does not say of which edges it is")
        if edge_digest(edges) != self.digest:
            raise ValueError("the compressed form is of other edges (or edges are repeated)")

    def write(self, path: str) -> None:
        spark = self.tree.sparkSession
        self.tree.repartition("row").write.mode("overwrite").parquet(f"{path}/tree")
        self.deltas.repartition("row").write.mode("overwrite").parquet(f"{path}/deltas")
        self.heavy_paths().write.mode("overwrite").parquet(f"{path}/paths")
        if self.scales is not None:
            self.scales.write.mode("overwrite").parquet(f"{path}/scales")
        about = [(self.n, self.scales is not None, *(self.digest or (None,) * 4))]
        spark.createDataFrame(about, "n long, normalized boolean, edges long, x long, y long, nulls long").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def read(spark: SparkSession, path: str, n: int | None = None, normalized: bool | None = None) -> Compressed:
        """The written form. ``n`` and ``normalized`` are as written; others raise."""
        about = spark.read.parquet(f"{path}/about").first()
        if (n is not None and n != about.n) or (normalized is not None and normalized != about.normalized):
            raise ValueError(f"the written form has {about.n} rows and is " + ("" if about.normalized else "not ") + "normalised")
        digest = None if about.edges is None else (about.edges, about.x, about.y, about.nulls)
        return Compressed(about.n, spark.read.parquet(f"{path}/tree"), spark.read.parquet(f"{path}/deltas"), spark.read.parquet(f"{path}/scales") if about.normalized else None, digest, spark.read.parquet(f"{path}/paths"))


def similarity_forest(edges: DataFrame, alpha: int = 0, search: str = "pruned") -> DataFrame:
    """a, b, w: the spanning forest of all links between rows of different kinds; with root edges it gives the tree for ``alpha`` and any larger one.

    ``search``: ``pruned`` makes all candidates first, ``rising`` makes them by rising distance while they can help.
    """
    plain = _plain(edges)
    return _forest(_one_of_each(plain, equal_rows(plain)), alpha, search)


def _forest(reps: DataFrame, alpha: int, search: str) -> DataFrame:
    if search == "rising":
        return rising_forest(reps, alpha)[0]
    if search != "pruned":
        raise ValueError(f"unknown search {search}")
    return _boruvka(spanning_links(reps, alpha))


def _plain(edges: DataFrame) -> DataFrame:
    return materialize(coalesce_edges(edges.select("src", "dst")), "plain")


def _tree(plain: DataFrame, alpha: int, method: str, search: str, forest: DataFrame | None) -> DataFrame:
    """The compression tree, found among one row of each kind; the others hang below it, where that is legal (nnz > alpha), at no delta."""
    equal = equal_rows(plain)
    hangs = (F.col("row") != F.col("rep")) & (F.col("nnz") > alpha)
    if method == "mst":
        if forest is None:
            reps = _one_of_each(plain, equal)
            # links alone if they are few; a forest of them takes the same search
            inner = spanning_links(reps, alpha) if search == "pruned" else _forest(reps, alpha, search)
        else:
            inner = forest
        tree = tree_of_links(inner, equal.where(~hangs), alpha)
    else:
        single = plain.join(equal.where(hangs).select(F.col("row").alias("src")), "src", "left_anti")
        tree = compression_tree(candidate_edges(materialize(single, "single"), alpha), alpha, method)
    tree = tree.select("row", "parent", "weight", "depth")
    copies = equal.where(hangs).select("row", F.col("rep").alias("parent")).join(tree.select(F.col("row").alias("parent"), "depth"), "parent")
    return materialize(tree.unionByName(copies.select("row", "parent", F.lit(0).cast("long").alias("weight"), (F.col("depth") + 1).alias("depth"))), "tree")


def compress(edges: DataFrame, n: int, alpha: int = 0, normalized: bool = False, method: str = "mst", search: str = "pruned", forest: DataFrame | None = None) -> Compressed:
    """Compress a binary matrix; weights are ignored and repeats removed. Null ids raise.

    The scale of the normalised form is the degree of the matrix's own rows.
    ``forest`` may be that of ``similarity_forest`` over the same edges, for
    ``alpha`` or a smaller one.
    """
    plain = _plain(edges)
    digest = edge_digest(plain)
    if digest[3]:
        raise ValueError("edges hold null ids")
    tree = _tree(plain, alpha, method, search, forest)
    if not normalized:
        return Compressed(n, tree, materialize(row_deltas(plain, tree), "deltas"), None, digest)
    counts = plain.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    nodes = plain.sparkSession.range(n).withColumnRenamed("id", "node")
    scales = materialize(nodes.join(counts, "node", "left").select("node", inv_sqrt(F.coalesce("deg", F.lit(0))).alias("scale")), "scales")
    return Compressed(n, tree, materialize(row_deltas_scaled(plain, tree, scales), "deltas"), scales, digest)


def delta_layout(c: Compressed, layout: str = "rows") -> DataFrame:
    """Deltas as ``rows`` (sorted entries of each row), ``chunks`` (the same in bounded lists) or ``edges``."""
    if layout == "edges":
        return c.deltas
    if layout not in ("rows", "chunks"):
        raise ValueError(f"unknown layout {layout}")
    entries = c.deltas.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("val").alias("weight"))
    return to_rows(entries, c.n) if layout == "rows" else to_row_chunks(entries, n=c.n)


def _signs(c: Compressed) -> DataFrame:
    return c.deltas.select("row", "col", (F.col("val") if c.scales is None else F.col("sign")).alias("val"))


def decompress(c: Compressed) -> DataFrame:
    """src, dst: the rows again, as sums of deltas along each path to the root."""
    return path_sums(c.tree, _signs(c)).select(F.col("row").alias("src"), F.col("col").alias("dst"))


def check_compressed(c: Compressed, edges: DataFrame) -> bool:
    """Whether the compressed form gives the edges back; raises on a delta other than 1 and -1."""
    if not _signs(c).where("abs(val) <> 1").isEmpty():
        raise ValueError("a delta is neither 1 nor -1")
    plain, again = edges.select("src", "dst").distinct(), decompress(c)
    return plain.exceptAll(again).isEmpty() and again.exceptAll(plain).isEmpty()


def compression_ratio(n: int, n_edges: int, n_deltas: int) -> float:
    """Elements of the plain row form over those of tree and deltas."""
    return (n + 1 + 2 * n_edges) / (2 * n_deltas + (n + 1) + (n + 2) + n)


def _candidates(reps: DataFrame, kinds: DataFrame, alphas: list[int]) -> DataFrame:
    """alpha, pairs: candidates between rows of different kinds (row, nnz, copies). Pairs of dense rows are counted as they are made."""
    maps, words = dense_rows(reps, min(alphas))
    copies = kinds.select("row", "copies")
    if maps is not None:
        between = bitmap_pairs(maps.join(copies, "row"), words, maps.count(), ["copies"]).withColumn("cu", F.col("u_copies")).withColumn("cv", F.col("v_copies"))
    else:
        between = row_distances(reps, pruned_overlap(reps, min(alphas)))
        between = between.join(copies.select(F.col("row").alias("u"), F.col("copies").alias("cu")), "u").join(copies.select(F.col("row").alias("v"), F.col("copies").alias("cv")), "v")
    both = F.col("cu") * F.col("cv")
    sums = []
    for k, alpha in enumerate(alphas):
        ways = (F.col("h") < F.col("nnz_u") - alpha).cast("long") + (F.col("h") < F.col("nnz_v") - alpha).cast("long")
        sums.append(F.coalesce(F.sum(both * ways), F.lit(0)).alias(f"_{k}"))
    row = between.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"_{k}").alias("pairs")) for k, a in enumerate(alphas)])).alias("r")).select("r.alpha", "r.pairs")


def alpha_sweep(edges: DataFrame, n: int, alphas: list[int]) -> DataFrame:
    """alpha, candidates, deltas, ratio: what ``compress`` gives for each alpha.

    Only root edges depend on alpha, and links that fail a larger alpha are in no
    tree. So links are compared once and one forest of them is kept; the trees
    of all alphas are then one more search over that forest and the root edges, in
    which each alpha has ids of its own: at most 2 n links for each.
    """
    spark, plain = edges.sparkSession, _plain(edges)
    if edge_digest(plain)[3]:
        raise ValueError("edges hold null ids")
    equal = equal_rows(plain)
    kinds = equal.where("row = rep").select("row", "nnz", "copies")
    reps = _one_of_each(plain, equal)
    forest = _boruvka(spanning_links(reps, min(alphas)))
    levels = F.broadcast(spark.createDataFrame(list(enumerate(alphas)), "level int, alpha int"))  # a row for each alpha
    shift = F.col("level").cast("long") * n
    inner = forest.crossJoin(levels).select((F.col("a") + shift).alias("a"), (F.col("b") + shift).alias("b"), "w")
    root = kinds.crossJoin(levels).select(F.lit(ROOT).cast("long").alias("a"), (F.col("row") + shift).alias("b"), (F.col("nnz") - F.col("alpha")).alias("w"))
    trees = _boruvka(inner.union(root)).select(F.floor(F.col("b") / n).cast("int").alias("level"), "a", "w").join(levels, "level")
    deltas = trees.groupBy("level", "alpha").agg(F.sum(F.col("w") + F.when(F.col("a") == ROOT, F.col("alpha")).otherwise(0)).alias("deltas"))
    # rows of a kind that is no more than alpha long stay apart, and differ by nothing
    apart = kinds.crossJoin(levels).where("nnz <= alpha").groupBy("level").agg(F.sum((F.col("copies") - 1) * F.col("nnz")).alias("apart"))
    same = kinds.crossJoin(levels).where("nnz > alpha").groupBy("level").agg(F.sum(F.col("copies") * (F.col("copies") - 1)).alias("same"))
    pairs = _candidates(reps, kinds, alphas).join(levels, "alpha").select("level", "pairs")
    out = deltas.join(apart, "level", "left").join(same, "level", "left").join(pairs, "level", "left").na.fill(0)
    size, all_deltas = plain.agg(F.count(F.lit(1)).alias("edges")), F.col("deltas") + F.col("apart")
    return out.crossJoin(size).select("alpha", (F.col("pairs") + F.col("same")).alias("candidates"), all_deltas.alias("deltas"), compression_ratio(F.lit(n), F.col("edges"), all_deltas).alias("ratio"))  # one row
