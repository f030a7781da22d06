"""All-pairs similarity of the rows of a binary matrix (src = row, dst = column)."""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .tree import FEW, _boruvka, forest_components

#: Columns that are bits of a bitmap, at most; rows of a block of bitmaps.
MOST_HEAVY, BLOCK_ROWS = 1_024, 2_048
#: Blocks, before they hold more rows; tasks in which blocks meet, at most.
MOST_BLOCKS, MOST_TASKS = 64, 4_096
#: Rows that a task of a join on columns makes, about; rows of a column that meet in one task, about.
MADE_AT_ONCE, LOT = 10_000_000, 16_384
#: Comparisons of two bitmaps that cost as much as making one and looking it up, about.
LOOK_UP = 8
#: Words of bitmaps that are broadcast, at most (32 MB).
FEW_WORDS = 4_000_000


def row_overlap(edges: DataFrame, share: float = 1 / 16, least: int = 64) -> DataFrame:
    """u < v, overlap: columns that two rows share, for every pair that shares any.

    Columns that more than ``share`` of the rows have (and ``least`` rows; the
    ``MOST_HEAVY`` most frequent of them) are heavy. Pairs that share other
    columns come from a join on these. Heavy columns are bits of a bitmap of
    each row; rows are dealt into blocks, every two blocks meet once, and a pair's
    common bits are counted there, so that it is one row however many heavy columns
    it shares, and a column that all rows have is spread over all tasks.
    Null ids share nothing.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null"), "edges")
    rows = edges.select("src").distinct().count()
    bits, all_heavy = _heavy_columns(edges, max(share * rows, least))
    if bits is None:
        return _light_overlap(edges)
    both = _heavy_overlap(edges.join(F.broadcast(bits), "dst"), bits.count(), rows).select("u", "v", "overlap")
    if all_heavy:
        return both
    light = _light_overlap(edges.join(F.broadcast(bits), "dst", "left_anti"))
    return light.union(both).groupBy("u", "v").agg(F.sum("overlap").alias("overlap"))


def _heavy_columns(edges: DataFrame, above: float) -> tuple[DataFrame | None, bool]:
    """bit, dst: the most frequent columns that more than ``above`` rows have (``MOST_HEAVY`` at most; None without any); whether these are all that two rows can share."""
    degrees = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    heavy = [r.dst for r in degrees.where(F.col("d") > above).orderBy(F.desc("d"), "dst").limit(MOST_HEAVY).collect()]
    if not heavy:
        return None, False
    return edges.sparkSession.createDataFrame(list(enumerate(heavy)), "bit int, dst long"), degrees.limit(len(heavy) + 1).count() == len(heavy)


def _bitmaps(edges: DataFrame, n_bits: int) -> tuple[DataFrame, list[str]]:
    """row, nnz, w0, w1, ...: the heavy columns (bit; null: another) of each row, 64 to a word."""
    words = [f"w{k}" for k in range(-(-n_bits // 64))]
    bit = F.expr("shiftleft(1L, bit % 64)")
    return edges.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"), *[F.coalesce(F.bit_or(F.when(F.col("bit").between(64 * k, 64 * k + 63), bit)), F.lit(0)).cast("long").alias(w) for k, w in enumerate(words)]), words


def _common(words: list[str]) -> Column:
    return reduce(add, [F.bit_count(F.col(f"u_{w}").bitwiseAND(F.col(f"v_{w}"))) for w in words]).cast("long")


def _signatures(edges: DataFrame, most: int = 16) -> tuple[DataFrame, list[str], int]:
    """row, nnz, s0, s1, ...: a bit for each column's hash, about eight bits a column of a mean row (``most`` words at most); and the number of rows."""
    rows, cells = _sizes(edges).agg(F.count(F.lit(1)), F.coalesce(F.sum("nnz"), F.lit(0))).first()
    words = [f"s{k}" for k in range(min(most, max(1, -(-cells // max(1, 8 * rows)))))]
    at = F.pmod(F.xxhash64("dst", F.lit(2)), F.lit(64 * len(words)))
    marked = edges.select(F.col("src").alias("row"), at.alias("at")).withColumn("bit", F.expr("shiftleft(1L, cast(at % 64 as int))"))
    sums = [F.coalesce(F.bit_or(F.when(F.col("at").between(64 * k, 64 * k + 63), F.col("bit"))), F.lit(0)).cast("long").alias(w) for k, w in enumerate(words)]
    return marked.groupBy("row").agg(F.count(F.lit(1)).alias("nnz"), *sums), words, rows


def _missing(words: list[str], here: str, there: str) -> Column:
    """Columns of one row that the other has not, at least: bits of its signature alone."""
    return reduce(add, [F.bit_count(F.col(f"{here}_{w}").bitwiseAND(F.bitwise_not(F.col(f"{there}_{w}")))) for w in words])


def _apart(words: list[str]) -> Column:
    """Columns that only one of two rows has, at least: the bits in which their signatures differ."""
    return reduce(add, [F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in words])


def _counting_maps(edges: DataFrame, signed: bool = True) -> tuple | None:
    """What ``counted_overlap`` reads, made once: bitmaps of the most frequent columns with signatures of the others (if asked), written, their words, the number of rows and the edges of the others (None without any); None without frequent columns."""
    bits, all_heavy = _heavy_columns(edges, 16)
    if bits is None:
        return None
    maps, words = _bitmaps(edges.join(F.broadcast(bits), "dst", "left"), bits.count())
    if all_heavy:
        maps = materialize(maps, "bitmaps")
        return maps, words, [], maps.count(), None
    rest = edges.select("src", "dst").join(F.broadcast(bits), "dst", "left_anti").select("src", "dst")
    if not signed:
        maps = materialize(maps, "bitmaps")
        return maps, words, [], maps.count(), rest
    rest = materialize(rest, "light")
    marks, signs, _ = _signatures(rest, 32)
    maps = materialize(maps.join(marks.withColumnRenamed("nnz", "light"), "row", "left").na.fill(0, ["light", *signs]), "bitmaps")
    return maps, words, signs, maps.count(), rest


def counted_overlap(pairs: DataFrame, edges: DataFrame, maps: tuple | None = None, needed: Column | None = None) -> DataFrame:
    """``pairs`` (distinct u, v, and other columns) with overlap, the columns that both rows have.

    The most frequent columns are bits of a map that each row of a pair brings; the
    others are counted by a join on (v, column) of the columns of u. Pairs that have
    less than ``needed`` in common may be left out: the map also has signatures of
    the other columns, which tell most of these apart before that join. ``maps`` may be
    the ``_counting_maps`` of the edges.
    """
    maps = _counting_maps(edges, needed is not None) if maps is None else maps
    if maps is None:
        return _with_light(pairs.withColumn("overlap", F.lit(0).cast("long")), edges)
    table, words, signs, rows, rest = maps
    end = lambda e: _small(table, rows, words + signs).select(F.col("row").alias(e), *[F.col(w).alias(f"{e}_{w}") for w in (words + signs + ["light"] if signs else words)])
    both = pairs.join(end("u"), "u").join(end("v"), "v")
    if needed is not None and signs:
        others = F.least(F.col("u_light") - _missing(signs, "u", "v"), F.col("v_light") - _missing(signs, "v", "u"))
        both = both.where(_common(words) + others >= needed)
    heavy = both.select(*pairs.columns, _common(words).alias("overlap"))
    return heavy if rest is None else _with_light(materialize(heavy, "pairs") if signs else heavy, rest)


def _small(table: DataFrame, rows: int, words: list[str]) -> DataFrame:
    """The table, marked to be sent to all executors where it is no more than ``FEW_WORDS``, so that pairs need not carry bitmaps over the network."""
    return F.broadcast(table) if rows * len(words) <= FEW_WORDS else table


def _with_light(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    columns = pairs.select("u", "v").join(edges.select(F.col("src").alias("u"), "dst"), "u").join(edges.select(F.col("src").alias("v"), "dst"), ["v", "dst"])
    light = columns.groupBy("u", "v").agg(F.count(F.lit(1)).alias("_light"))
    return pairs.join(light, ["u", "v"], "left").withColumn("overlap", F.col("overlap") + F.coalesce("_light", F.lit(0))).drop("_light")


def _light_overlap(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("dst").alias("col"), F.col("src").alias("u"))
    b = edges.select(F.col("dst").alias("col"), F.col("src").alias("v"))
    return a.join(b, "col").where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("overlap"))


def _heavy_overlap(edges: DataFrame, n_bits: int, rows: int, alpha: int | None = None) -> DataFrame:
    """The same over edges of numbered columns (bit), by bitmaps: u, v, overlap, and nnz_u, nnz_v, the edges given of each.

    With ``alpha``, pairs of which one row can be the other's parent; edges then hold
    all columns of a row (bit null: one that no other row has).
    """
    maps, words = _bitmaps(edges, n_bits)
    met = bitmap_pairs(materialize(maps, "bitmaps"), words, rows, [])
    first = F.col("u") < F.col("v")
    end = lambda here, there: F.when(first, F.col(f"nnz_{here}")).otherwise(F.col(f"nnz_{there}"))
    near = F.col("overlap") > 0 if alpha is None else 2 * F.col("overlap") > F.least("nnz_u", "nnz_v") + alpha
    return met.where(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "overlap", end("u", "v").alias("nnz_u"), end("v", "u").alias("nnz_v"))


def _stored(edges: DataFrame) -> DataFrame:
    """src, dst, written unless they are a written table."""
    return edges.select("src", "dst") if hasattr(edges, "_written_to") else materialize(edges.select("src", "dst"), "edges")


def equal_rows(edges: DataFrame) -> DataFrame:
    """row, nnz, rep (the least row with the same columns), copies, by two order-free digests of the columns."""
    one, two = F.xxhash64("dst"), F.xxhash64("dst", F.lit(1))
    rows = edges.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"), F.bit_xor(one).alias("x"), F.sum(F.pmod(two, F.lit(1 << 32))).alias("y"))
    same = rows.groupBy("nnz", "x", "y").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return materialize(rows.join(same, ["nnz", "x", "y"]).select("row", "nnz", "rep", "copies"), "equal")


def _one_of_each(plain: DataFrame, equal: DataFrame) -> DataFrame:
    """The edges of one row of each kind. Written."""
    return materialize(plain.join(equal.where("row = rep").select(F.col("row").alias("src")), "src", "left_semi"), "reps")


def _sizes(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("nnz"))


def row_distances(edges: DataFrame, overlap: DataFrame | None = None, share: float = 1 / 16, least: int = 64) -> DataFrame:
    """u, v, nnz_u, nnz_v, overlap, h = nnz_u + nnz_v - 2 overlap, for every pair that shares any (or those of ``overlap``).

    Where all columns that rows share are heavy (``row_overlap``), blocks of
    bitmaps bring the sizes along and a pair is returned as it is made: none is
    sent, sorted or written.
    """
    if overlap is None:
        edges = _stored(edges)
        rows = edges.select("src").distinct().count()
        bits, all_heavy = _heavy_columns(edges.where("src is not null"), max(share * rows, least))
        if bits is not None and all_heavy:
            overlap = _heavy_overlap(edges.where("src is not null").join(F.broadcast(bits), "dst", "left"), bits.count(), rows)
        else:
            overlap = row_overlap(edges, share, least)
    if "nnz_u" not in overlap.columns:
        sizes = _sizes(edges)
        overlap = overlap.join(sizes.select(F.col("row").alias("u"), F.col("nnz").alias("nnz_u")), "u").join(sizes.select(F.col("row").alias("v"), F.col("nnz").alias("nnz_v")), "v")
    return overlap.select("u", "v", "nnz_u", "nnz_v", "overlap", (F.col("nnz_u") + F.col("nnz_v") - 2 * F.col("overlap")).alias("h"))


def kind_distances(edges: DataFrame) -> DataFrame:
    """u, v, nnz_u, nnz_v, overlap, h, same: ``row_distances`` between the least rows of each kind of equal rows, and membership.

    ``same`` marks membership: u is the least row of the kind of v, at no distance.
    So copies are a row each, and all pairs of rows follow by a join.
    """
    edges = _stored(edges)
    equal = equal_rows(edges)
    between = row_distances(_one_of_each(edges, equal)).withColumn("same", F.lit(False))
    members = equal.where("row <> rep").select(F.col("rep").alias("u"), F.col("row").alias("v"), F.col("nnz").alias("nnz_u"), F.col("nnz").alias("nnz_v"), F.col("nnz").alias("overlap"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("same"))
    return between.unionByName(members)


def kind_candidates(edges: DataFrame, alpha: int = 0) -> DataFrame:
    """Those of ``candidate_edges`` that a least tree needs: the forest of all links between the least rows of each kind, either way where legal, and from these to their copies; every row has its root edge.

    They are no more than a few for each row: dense rows have nearly all pairs as candidates.
    """
    edges = _stored(edges)
    equal = equal_rows(edges)
    links = _boruvka(spanning_links(_one_of_each(edges, equal), alpha))
    sizes = equal.select("row", "nnz")
    ways = links.select(F.col("a").alias("parent"), F.col("b").alias("child"), F.col("w").alias("weight")).union(links.select("b", "a", "w"))
    legal = ways.join(sizes.withColumnRenamed("row", "child"), "child").where(F.col("weight") < F.col("nnz") - alpha).select("parent", "child", "weight")
    down = equal.where((F.col("row") != F.col("rep")) & (F.col("nnz") > alpha)).select(F.col("rep").alias("parent"), F.col("row").alias("child"), F.lit(0).cast("long").alias("weight"))
    return legal.union(down).union(sizes.select(F.lit(None).cast("long"), "row", "nnz"))


def _rows_met(ranked: DataFrame, first: Column) -> int:
    """The rows that a join on dst of the rows with ``first`` and of all makes."""
    sizes = ranked.groupBy("dst").agg(F.count_if(first).alias("one"), F.count(F.lit(1)).alias("two"))
    return sizes.agg(F.coalesce(F.sum(F.col("one") * F.col("two")), F.lit(0))).first()[0]


def _met(one: DataFrame, two: DataFrame, made: int) -> DataFrame:
    """``one`` (dst, freq, u, ...) and ``two`` (dst, freq, v, ...) joined on dst, without freq; ``freq`` is how many rows have the column.

    The number of tasks follows the rows that are ``made``: what is read is few bytes
    for them, by which adaptive execution would put all in a few tasks. The rows v
    of a column that more than ``LOT`` rows have are dealt to several.
    """
    tasks = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-made // MADE_AT_ONCE))
    lots = F.ceil(F.col("freq") / LOT)
    one = one.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).drop("freq").repartition(tasks, "dst", "lot")
    two = two.withColumn("lot", F.pmod(F.xxhash64("v"), lots)).drop("freq").repartition(tasks, "dst", "lot")
    return one.join(two, ["dst", "lot"]).drop("lot")


def _smaller_first() -> Column:
    """Whether u is the smaller row of a pair (or of the lesser id), so that it is met one way round."""
    return (F.col("nnz_u") < F.col("nnz_v")) | ((F.col("nnz_u") == F.col("nnz_v")) & (F.col("u") < F.col("v")))


def pruned_overlap(edges: DataFrame, alpha: int, prefix: bool = True) -> DataFrame:
    """Overlaps of all pairs of which one row can be the other's parent.

    The smaller row u of such a pair is a parent, and it shares t = (nnz_u + alpha) / 2 + 1
    columns with its child, so under one order of columns, rarest first, the child
    has one of u's first nnz_u - t + 1. Only those columns of u are joined, which leaves
    most hub columns out (without ``prefix``, all are). Each row brings a signature of its
    columns to the join: where that shows more than nnz_u - t columns of u that v
    has not, the pair goes no further. Overlaps of the pairs that are left are counted in
    full; without ``prefix`` they are the columns in which the pair has met.

    Where that join would make more rows than there are pairs of rows, and all
    columns that rows share fit in a bitmap, blocks of bitmaps are compared in its
    place.
    """
    edges = _stored(edges)
    marks, words, rows = _signatures(edges)
    marks = marks.withColumnRenamed("row", "src")
    need = F.floor((F.col("nnz") + alpha) / 2) + 1
    if prefix:
        ranked, first = _ranked(edges, alpha), F.col("at") <= F.col("most")
        bits, all_heavy = _heavy_columns(edges, 0)
        if all_heavy and ranked.where(first).agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0] > rows * (rows - 1) // 2:
            return _heavy_overlap(edges.join(F.broadcast(bits), "dst", "left"), bits.count(), rows, alpha)
    else:
        ranked, first = edges.join(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("freq")), "dst"), F.lit(True)
    ranked, made = ranked.select("src", "dst", "freq", first.alias("first")), _rows_met(ranked, first)
    signed = ranked.join(marks, "src").where(F.col("nnz") > alpha)
    one = signed.where("first").select("dst", "freq", F.col("src").alias("u"), F.col("nnz").alias("nnz_u"), (F.col("nnz") - need).alias("spare"), *[F.col(w).alias(f"u_{w}") for w in words])
    two = signed.select("dst", "freq", F.col("src").alias("v"), F.col("nnz").alias("nnz_v"), *[F.col(w).alias(f"v_{w}") for w in words])
    pairs = _met(one, two, made).where(_smaller_first() & (_missing(words, "u", "v") <= F.col("spare")))
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if not prefix:  # a pair has met in all its columns
        return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("overlap"))
    both = materialize(pairs.distinct(), "pairs")
    if both.count() <= 4 * rows:  # their columns are no more than a few times the edges
        return _with_light(both.withColumn("overlap", F.lit(0).cast("long")), edges)
    return counted_overlap(both, edges)


def _ranked(edges: DataFrame, alpha: int) -> DataFrame:
    """src, dst, at (place of the column in its row, rarest columns first), nnz, most (last place of a first common column, where the row is the smaller of a link). Written; rows of ``alpha`` columns or less are in no link."""
    freq = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("freq"))
    joined = edges.join(freq, "dst").join(_sizes(edges).withColumnRenamed("row", "src"), "src").where(F.col("nnz") > alpha)
    at = F.row_number().over(W.partitionBy("src").orderBy("freq", "dst"))
    most = F.col("nnz") - F.floor((F.col("nnz") + alpha) / 2)
    return materialize(joined.select("src", "dst", at.cast("long").alias("at"), "nnz", most.alias("most"), "freq"), "ranked")


def rising_forest(edges: DataFrame, alpha: int = 0, first: int = 1, growth: int = 4, few: int = FEW) -> tuple[DataFrame, list[dict]]:
    """The minimum spanning forest of all links between rows, found by rising distance.

    Returns a, b, w (a < b), written, to which root edges of nnz - alpha may be added
    for the tree; and for each tier its bound, the rows joined, the pairs verified
    and the links found. ``edges`` (src, dst) are distinct and without nulls. A link
    is a pair with h < max(nnz) - alpha.

    A tier makes all pairs within a distance. Before the first column that two
    such rows share, under one order with the rarest first, there are ``bound``
    columns of the two together, at most; so only these places are joined. Once
    the links are in the forest, a component whose least root edge is at most
    bound + 1 has nothing to gain from longer links and makes no more pairs; one
    with a larger edge looks no further than that. So loose pairs are never made,
    and columns that most rows have are in few rows' first places. Equal rows hang
    below the least of them, which alone is compared. Where the rows are dense
    (``_dense``), a tier compares bitmaps (``_between_components``) and writes its links alone.
    """
    spark, plain = edges.sparkSession, _stored(edges)
    equal = equal_rows(plain)
    ranked = _ranked(_one_of_each(plain, equal), alpha)
    sizes = materialize(ranked.groupBy(F.col("src").alias("row")).agg(F.first("nnz").alias("nnz")), "sizes")
    copies = equal.where((F.col("row") != F.col("rep")) & (F.col("nnz") > alpha)).select(F.col("rep").alias("a"), F.col("row").alias("b"), F.lit(0).cast("long").alias("w"))
    rows = sizes.count()
    maps, words = _dense(ranked, rows)
    if maps is not None:
        columns = _all_columns(maps, words)
    else:
        marks, signs, _ = _signatures(ranked)
        marks = marks.select(F.col("row").alias("src"), *signs)
        counting = _counting_maps(ranked)
    forest = materialize(spark.createDataFrame([], "a long, b long, w long"), "forest")
    seen = materialize(spark.createDataFrame([], "u long, v long, h long, nnz long"), "seen")
    tiers, bound, before = [], first, -1
    while True:
        parts = sizes.join(forest_components(forest, few).withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        least = parts.groupBy("component").agg((F.min("nnz") - alpha - 1).alias("gain"))  # links up to this length can help
        state = materialize(parts.join(least, "component").select(F.col("row").alias("src"), "component", F.least("gain", F.lit(bound)).alias("reach")), "state")
        if state.where(F.col("reach") > before).isEmpty() or state.select("component").distinct().limit(2).count() < 2:
            return materialize(forest.union(copies), "forest"), tiers
        if maps is not None:
            here = materialize(maps.join(state.withColumnRenamed("src", "row"), "row"), "placed")
            pairs = _between_components(here, words, rows, columns, before, bound)
            near = (F.col("h") > before) & (F.col("h") <= F.greatest("u_reach", "v_reach")) & (F.col("h") < F.greatest("nnz_u", "nnz_v") - alpha)
            links = materialize(pairs.where(near).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("h").alias("w")), "pairs")
            made = (links.count(),) * 2
        else:
            # u is the smaller row of a pair; ``more`` is what the two may differ by
            places = ranked.where(F.col("at") <= bound + 1)
            here = places.join(state, "src").join(marks, "src")
            end = lambda e: [F.col("src").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("at", "nnz", "component", "reach")], *[F.col(w).alias(f"{e}_{w}") for w in signs]]
            one, two = here.where("at <= most").select("dst", "freq", *end("u")), here.select("dst", "freq", *end("v"))
            more = F.least(F.greatest("reach_u", "reach_v"), F.col("nnz_v") - alpha - 1)
            near = (F.col("at_u") + F.col("at_v") - 2 <= more) & (F.col("nnz_v") - F.col("nnz_u") <= more)
            rest = 2 * (F.least(F.col("nnz_u") - F.col("at_u"), F.col("nnz_v") - F.col("at_v")) + 1) >= F.col("nnz_u") + F.col("nnz_v") - more
            lives = (F.greatest("reach_u", "reach_v") > before) & (F.col("component_u") != F.col("component_v"))
            joined = _met(one, two, _rows_met(places, F.expr("at <= most"))).where(_smaller_first() & near & rest & lives & (_apart(signs) <= more))
            pairs = joined.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.first(F.col("nnz_u") + F.col("nnz_v")).alias("both"), F.first(F.greatest("nnz_u", "nnz_v")).alias("nnz"), F.first(more).alias("more"))
            pairs = materialize(pairs.join(seen.select("u", "v"), ["u", "v"], "left_anti"), "pairs")
            made = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
            # pairs that are further apart than ``more`` are no links of this tier; they are made again, if one looks further
            checked = counted_overlap(pairs.select("u", "v", "both", "nnz", "more"), ranked, counting, (F.col("both") - F.col("more")) / 2).select("u", "v", (F.col("both") - 2 * F.col("overlap")).alias("h"), "nnz")
            seen = materialize(seen.union(checked), "seen")
            links = seen.where((F.col("h") > before) & (F.col("h") <= bound) & (F.col("h") < F.col("nnz") - alpha)).select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("h").alias("w"))
        forest = _boruvka(forest.union(links), few)
        tiers.append({"bound": bound, "joined": made[1], "verified": made[0], "links": links.count()})
        before, bound = bound, bound * growth


def _dense(ranked: DataFrame, rows: int) -> tuple[DataFrame | None, list[str]]:
    """Bitmaps of all rows, written, where they have all columns that rows share and joining prefixes would make more rows than there are pairs; else None."""
    bits, all_heavy = _heavy_columns(ranked, 0)
    if not all_heavy or ranked.where("at <= most").agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0] <= rows * (rows - 1) // 2:
        return None, []
    maps, words = _bitmaps(ranked.join(F.broadcast(bits), "dst", "left"), bits.count())
    return materialize(maps, "bitmaps"), words


def dense_rows(edges: DataFrame, alpha: int) -> tuple[DataFrame | None, list[str]]:
    """The same for the rows of ``edges`` that can be in a link."""
    ranked = _ranked(edges, alpha)
    return _dense(ranked, ranked.select("src").distinct().count())


def _end(e: str, more: list[str]) -> list[Column]:
    return [F.col("row").alias(e), F.col("nnz").alias(f"nnz_{e}"), *[F.col(c).alias(f"{e}_{c}") for c in more]]


def _blocks(rows: int) -> int:
    """The number of blocks of rows. Each row is sent to so many, so from ``MOST_BLOCKS`` on they get larger, up to eight times."""
    return max(8, min(-(-rows // BLOCK_ROWS), max(MOST_BLOCKS, -(-rows // (8 * BLOCK_ROWS)))))


def _dealt(one: DataFrame, two: DataFrame, made: int) -> DataFrame:
    """Blocks under (p, q) that meet, in tasks that follow the pairs that they make; adaptive execution would look at the few bytes read."""
    tasks = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-made // MADE_AT_ONCE), MOST_TASKS))
    return one.repartition(tasks, "p", "q").join(two.repartition(tasks, "p", "q"), ["p", "q"])


def bitmap_pairs(maps: DataFrame, words: list[str], rows: int, more: list[str]) -> DataFrame:
    """u, v, nnz_u, nnz_v, overlap, h and ``more`` of both of all pairs of rows, by blocks; no pair is written here."""
    blocks = _blocks(rows)
    maps = maps.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    one = maps.select(F.col("block").alias("p"), F.explode(F.sequence("block", F.lit(blocks - 1).cast("long"))).alias("q"), *_end("u", words + more))
    two = maps.select(F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("p"), F.col("block").alias("q"), *_end("v", words + more))
    met = _dealt(one, two, rows * rows // 2).where("(p < q or u < v)").withColumn("overlap", _common(words))
    return met.withColumn("h", F.col("nnz_u") + F.col("nnz_v") - 2 * F.col("overlap"))


def _all_columns(maps: DataFrame, words: list[str]) -> int:
    """The number of columns, where the bitmaps hold all columns of all rows, so that no two are the same; else 0."""
    own = F.col("nnz") - reduce(add, [F.bit_count(w) for w in words])
    used = reduce(add, [F.bit_count(F.bit_or(w)) for w in words])
    found = maps.agg(F.max(own).alias("own"), used.alias("used")).first()
    return found.used if found.own == 0 else 0


def _between_components(maps: DataFrame, words: list[str], rows: int, columns: int, before: int, bound: int) -> DataFrame:
    """u, v, nnz_u, nnz_v, h, component and reach of both (u_component, ...): pairs of different components, once each, with all whose h is above ``before`` and ``bound`` at most.

    One row of such a pair is out of the largest component, and only those rows
    look for others. Where ``LOOK_UP`` times the bitmaps that differ from one in up to
    ``bound`` of the ``columns`` are less than the rows, these are made and looked up;
    else the rows that look are compared with all, by blocks.
    """
    largest = maps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").first().component
    some, more = maps.where(F.col("component") != largest), ["component", "reach"]
    if columns and LOOK_UP * sum(comb(columns, k) for k in range(1, bound + 1)) < rows:
        pairs = _turned_pairs(some, maps, words, columns, max(before, 0), bound, more)
    elif 2 * (looking := some.count()) < rows:
        pairs = _pairs_with_all(some, looking, maps, rows, words, more)
    else:
        return bitmap_pairs(maps, words, rows, more).where("u_component <> v_component")
    return pairs.where(f"u_component <> v_component and (u < v or v_component = {largest})")


def _turned_pairs(some: DataFrame, maps: DataFrame, words: list[str], columns: int, before: int, bound: int, more: list[str]) -> DataFrame:
    """The same of rows u of ``some`` and v of all that differ in more than ``before`` columns and ``bound`` at most: v has the bitmap of u with as many bits turned round."""
    now = some.select(*_end("u", more), *words, F.lit(-1).alias("last"))
    rest, found = [c for c in now.columns if c not in (*words, "last")], []
    for k in range(1, bound + 1):
        now = now.where(F.col("last") < columns - 1).withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.lit(columns - 1))))
        turn = F.expr("shiftleft(1L, last % 64)")
        now = now.select(*rest, *[F.col(w).bitwiseXOR(F.when(F.floor(F.col("last") / 64) == j, turn).otherwise(F.lit(0).cast("long"))).alias(w) for j, w in enumerate(words)], "last")
        if k > before:
            found.append(now.select(*rest, *words, F.lit(k).cast("long").alias("h")))
    return reduce(DataFrame.unionByName, found).join(maps.select(*_end("v", more), *words), words).drop(*words)


def _pairs_with_all(some: DataFrame, looking: int, maps: DataFrame, rows: int, words: list[str], more: list[str]) -> DataFrame:
    """The same of rows u of ``some`` and all v, by blocks."""
    ps, qs = -(-looking // BLOCK_ROWS), _blocks(rows)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    one = some.select(dealt(ps).alias("p"), every(qs).alias("q"), *_end("u", words + more))
    two = maps.select(every(ps).alias("p"), dealt(qs).alias("q"), *_end("v", words + more))
    return _dealt(one, two, looking * rows).where("u <> v").withColumn("h", F.col("nnz_u") + F.col("nnz_v") - 2 * _common(words))


def spanning_links(edges: DataFrame, alpha: int = 0) -> DataFrame:
    """a, b, w: links that hold the minimum spanning forest of all; dense rows by rising distance (of different rows), so that few links are written."""
    edges = _stored(edges)
    if dense_rows(edges, alpha)[0] is not None:
        return rising_forest(edges, alpha, growth=2)[0]
    return row_links(edges, alpha)


def row_links(edges: DataFrame, alpha: int = 0) -> DataFrame:
    """a < b, w: all links of the same kind, from the pruned join."""
    d = row_distances(edges, pruned_overlap(edges, alpha))
    return links_of(d, alpha)


def links_of(distances: DataFrame, alpha: int) -> DataFrame:
    return distances.where(F.col("h") < F.greatest("nnz_u", "nnz_v") - alpha).select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("h").alias("w"))


def candidate_edges(edges: DataFrame, alpha: int = 0, pruned: bool = True, distances: DataFrame | None = None) -> DataFrame:
    """parent, child, weight: each row's legal parents; the root is a null parent.

    u may be the parent of v if h < nnz_v - alpha. Root edges weigh nnz_v.
    ``pruned`` joins a prefix of each possible parent's columns, else all are joined; both give the same.
    """
    edges = edges if distances is not None else materialize(edges.select("src", "dst"), "edges")
    d = distances if distances is not None else row_distances(edges, pruned_overlap(edges, alpha, pruned))
    down = d.where(F.col("h") < F.col("nnz_v") - alpha).select(F.col("u").alias("parent"), F.col("v").alias("child"), F.col("h").alias("weight"))
    up = d.where(F.col("h") < F.col("nnz_u") - alpha).select(F.col("v").alias("parent"), F.col("u").alias("child"), F.col("h").alias("weight"))
    root = _sizes(edges).select(F.lit(None).cast("long").alias("parent"), F.col("row").alias("child"), F.col("nnz").alias("weight"))
    return down.union(up).union(root)
