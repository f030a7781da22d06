"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Raking scales the cells'
token weights until their sums over each margin meet the targets, with the bound
that no cell gives more than it has inside the loop; a document's probability
is what its cell's weight calls for. Everything is DataFrame functions.

Scale: one pass counts tokens by cell (partial sums, so a hot source costs one
row a task); raking works on the cells alone. The cells are counted: up to
``SMALL`` of them are raked in one partition and broadcast back, more are
raked by shuffled windows and joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, materialize, read

SMALL = 100_000
MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def with_tokens_and_topic(docs: DataFrame) -> DataFrame:
    """Adds mix_source, mix_lang, mix_topic and mix_tokens (words and one end).

    Documents here carry no topic, so a text's form stands for it: ``lines``
    (under 15 words a line, two lines at least), else ``note`` (under 60 words),
    ``article`` (under 500) or ``long``. Null sources and languages are the
    level ``(none)``; null texts are empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    topic = F.when((F.col("mix_lines") >= 2) & (F.col("mix_words") < 15 * F.col("mix_lines")), "lines").when(F.col("mix_words") < 60, "note").when(F.col("mix_words") < 500, "article").otherwise("long")
    none = F.lit("(none)")
    return (
        docs.withColumns({"mix_words": words, "mix_lines": lines})
        .withColumns({"mix_source": F.coalesce("source", none), "mix_lang": F.coalesce("lang", none), "mix_topic": topic, "mix_tokens": F.col("mix_words").cast("long") + 1})
        .drop("mix_words", "mix_lines")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> Column:
    """Target share of a cell's level: natural token shares to ``power``, summing to 1.

    Each cell of a level carries its share divided by the level's cells, so that
    the total is a plain sum over cells.
    """
    level = W.partitionBy(margin)
    return F.pow(F.sum("tokens").over(level).cast("double"), F.lit(power)) / F.count(F.lit(1)).over(level)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, rounds: int = 10, goals: bool = False) -> DataFrame:
    """Adds ``weight``: raked shares of ``cells`` (source, lang, topic, tokens), summing to about 1.

    ``targets`` gives shares by margin and level; a margin without targets takes
    natural shares to ``power``. Levels that no cell has are left out and the
    rest scaled up; cells of unlisted levels get weight 0. ``goals`` adds the
    targets as goal_source, goal_lang and goal_topic.
    """
    targets = targets or {}
    for m in MARGINS:
        if m in targets:
            given = F.coalesce(F.create_map(*[F.lit(x) for kv in targets[m].items() for x in kv])[F.col(m)], F.lit(0.0))
            part = given.cast("double") / F.count(F.lit(1)).over(W.partitionBy(m))
        else:
            part = tempered(cells, m, power)
        cells = cells.withColumn(f"part_{m}", part)
    total = cells.agg(*[F.sum(f"part_{m}").alias(f"all_{m}") for m in MARGINS], F.sum("tokens").alias("all_tokens")).withColumn("one", F.lit(1))
    cells = cells.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")  # one row
    for m in MARGINS:
        cells = cells.withColumn(f"goal_{m}", F.sum(f"part_{m}").over(W.partitionBy(m)) / F.col(f"all_{m}"))
    cells = cells.withColumn("weight", F.col("tokens") / F.col("all_tokens"))
    for k in range(rounds):
        for m in MARGINS:
            now = F.sum("weight").over(W.partitionBy(m))
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"goal_{m}") / now).otherwise(0.0))
        if k % 5 == 4:
            cells = materialize(cells, "rake")
            cells = cells.coalesce(1) if k + 1 < rounds and cells.count() <= SMALL else cells
    return cells.select(*MARGINS, "tokens", "weight", *([f"goal_{m}" for m in MARGINS] if goals else []))


def probabilities(cells: DataFrame, fraction: float, rounds: int = 4) -> DataFrame:
    """Adds ``probability`` so that about ``fraction`` of all tokens are drawn by weight.

    A cell gives all it has at most; each round spreads what full cells lack.
    """
    cells = cells.withColumn("full", F.lit(False)).withColumn("one", F.lit(1))
    scale = None
    for _ in range(rounds):
        sums = cells.groupBy("one").agg(F.sum("tokens").alias("t"), F.sum(F.when(F.col("full"), F.col("tokens")).otherwise(0)).alias("f"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("w"))
        scale = sums.select("one", F.when(F.col("w") > 0, (F.lit(fraction) * F.col("t") - F.col("f")) / F.col("w")).otherwise(0.0).alias("scale"))
        cells = cells.drop("scale").join(F.broadcast(scale), "one")  # one row
        cells = cells.withColumn("full", F.col("full") | (F.col("scale") * F.col("weight") >= F.col("tokens")))
    p = F.when(F.col("full"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("scale") * F.col("weight") / F.col("tokens"))))
    return cells.select(*MARGINS, p.alias("probability"))


def _filled(by: str, value: str, bound: str, goal: str) -> Column:
    """For each cell of a level, the factor f that meets ``goal`` if the cells of lower ratios are full and no others; and its ratio of bound to value."""
    ratio = F.when(F.col(value) > 0, F.col(bound) / F.col(value)).otherwise(0.0)
    in_order = W.partitionBy(by).orderBy(ratio, *MARGINS).rowsBetween(W.unboundedPreceding, W.currentRow)
    taken = F.sum(bound).over(in_order) - F.col(bound)
    left = F.sum(value).over(in_order.orderBy(ratio.desc(), *[F.desc(m) for m in MARGINS]))
    return F.struct(F.when(left > 0, (F.col(goal) - taken) / left).alias("f"), ratio.alias("ratio"))


def _raised(cells: DataFrame, by: str, value: str, bound: str, goal: str) -> DataFrame:
    """``value`` times the level's factor f for which least(bound, f * value) sums to ``goal``.

    Where all bounds together are less than the goal, the factor that meets every bound.
    """
    level = W.partitionBy(by)
    cells = cells.withColumn("fill", _filled(by, value, bound, goal))
    factor = F.coalesce(F.max(F.when(F.col("fill.f") <= F.col("fill.ratio"), F.greatest(F.col("fill.f"), F.lit(0.0)))).over(level), F.max("fill.ratio").over(level))
    return cells.withColumn(value, F.col(value) * factor).drop("fill")


def bounded(cells: DataFrame, fraction: float, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, rounds: int = 30) -> DataFrame:
    """Adds ``probability``, raked with its bound of 1 inside the loop, and ``goal_*`` shares of the drawn tokens.

    A cell's weight is the least of its bound, tokens / (``fraction`` * all
    tokens), and a product of one factor a margin; a step sets a margin's factors
    so that the bounded weights meet its goals, with open cells taking what full
    ones cannot give. Levels that have too few tokens for their goal give all
    they have (``reach_*``), and the margin's other goals rise alike.
    """
    cells = rake(cells, targets, power, 0, goals=True).withColumn("one", F.lit(1))
    total = cells.groupBy("one").agg(F.sum("tokens").alias("all"))
    cells = cells.join(F.broadcast(total), "one").withColumn("bound", F.col("tokens") / (F.lit(fraction) * F.col("all")))  # one row
    for m in MARGINS:
        level = W.partitionBy(m)
        cells = cells.withColumn("supply", F.sum("bound").over(level))
        cells = cells.withColumn("first", F.row_number().over(level.orderBy(*MARGINS)) == 1)
        # one row of a level stands for it: the others have neither value nor bound
        cells = cells.withColumns({"level_value": F.when(F.col("first"), F.col(f"goal_{m}")).otherwise(0.0), "level_bound": F.when(F.col("first"), F.col("supply")).otherwise(0.0), "whole": F.lit(1.0)})
        cells = _raised(cells, "one", "level_value", "level_bound", "whole")
        cells = cells.withColumn(f"reach_{m}", F.max(F.least("level_value", "level_bound")).over(level))
    cells = materialize(cells.drop("supply", "first", "level_value", "level_bound", "whole"), "goals")
    few = cells.limit(SMALL + 1).count() <= SMALL
    for k in range(rounds):
        cells = cells.coalesce(1) if few and k % 2 == 0 else cells
        for m in MARGINS[::-1]:  # the last one raked, source, is met best
            cells = _raised(cells, m, "weight", "bound", f"reach_{m}")
        cells = materialize(cells, "rake") if k % 2 else cells
    p = F.least(F.lit(1.0), F.col("weight") / F.col("bound"))
    return cells.select(*MARGINS, "tokens", p.alias("probability"), *[f"goal_{m}" for m in MARGINS], *[f"reach_{m}" for m in MARGINS])


def shares(cells: DataFrame) -> DataFrame:
    """margin, level, goal, reach (the goal that its tokens allow) and achieved share, from ``bounded`` cells."""
    drawn_ = F.col("tokens") * F.col("probability")
    every = cells.agg(F.sum(drawn_).alias("every"))
    parts = [cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("level")).agg(F.max(f"goal_{m}").alias("goal"), F.max(f"reach_{m}").alias("reach"), F.sum(drawn_).alias("drawn")) for m in MARGINS]
    made = parts[0].unionAll(parts[1]).unionAll(parts[2]).crossJoin(F.broadcast(every))
    return made.select("margin", "level", "goal", "reach", (F.col("drawn") / F.col("every")).alias("achieved"))


def draw(seed: int) -> Column:
    """A number in 0 to 1 that depends on the doc_id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), id_text()).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, fraction: float = 0.8, seed: int = 7, rounds: int = 10, within: bool = True) -> DataFrame:
    """Adds mix_source, mix_lang, mix_topic, mix_tokens, probability and sampled to ``docs``.

    ``docs`` has doc_id, text, lang and source. A document's draw depends on its
    id alone (columns of these names are replaced), so repeated rows are drawn together; a null id draws as the empty
    text. Null sources and languages are a level of their own. No rows give no
    rows. Raking has the bound inside the loop (``bounded``): goals are met as far
    as tokens reach. Without ``within``, weights are raked first and cut to 1
    afterwards, which misses the margins.
    """
    known = with_tokens_and_topic(docs.drop("probability", "sampled"))
    by = known.groupBy(*[F.col(f"mix_{m}").alias(m) for m in MARGINS]).agg(F.sum("mix_tokens").alias("tokens"))
    cells = materialize(by, "cells")
    few = cells.limit(SMALL + 1).count() <= SMALL
    cells = cells.coalesce(1) if few else cells
    cells = materialize(bounded(cells, fraction, targets, power, rounds) if within else probabilities(rake(cells, targets, power, rounds), fraction), "mix")
    cells = cells.select(*[F.col(m).alias(f"mix_{m}") for m in MARGINS], "probability")
    out = known.join(F.broadcast(cells) if few else cells, [f"mix_{m}" for m in MARGINS])
    return out.withColumn("sampled", draw(seed) < F.col("probability"))


def drawn(docs: DataFrame, fraction: float = 0.8, power: float = 0.7, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its columns."""
    return mix(docs, power=power, fraction=fraction, seed=seed).where("sampled").select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their calibrated probability and whether they are drawn."""
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("probability", 6).alias("probability"), "sampled")


def oracle(power: float = 0.7, fraction: float = 0.8, seed: int = 7, rounds: int = 10) -> str:
    """The same as DuckDB SQL."""

    def raised(step: str, source: str, by: str, value: str, bound: str, goal: str, order: str) -> str:
        """``value`` times the factor by which least(bound, value) sums to ``goal`` over ``by``."""
        part = f"PARTITION BY {by} " if by else ""
        down = ", ".join(f"{x} DESC" for x in order.split(", "))
        ratio = f"(SELECT *, CASE WHEN {value} > 0 THEN {bound} / {value} ELSE 0 END AS ratio FROM {source})"
        fill = f"(SELECT *, ({goal} - (sum({bound}) OVER ({part}ORDER BY ratio, {order} ROWS UNBOUNDED PRECEDING) - {bound})) / nullif(sum({value}) OVER ({part}ORDER BY ratio DESC, {down} ROWS UNBOUNDED PRECEDING), 0) AS f FROM {ratio})"
        factor = f"coalesce(max(CASE WHEN f <= ratio THEN greatest(f, 0) END) OVER ({part}), max(ratio) OVER ({part}))"
        return f"{step} AS MATERIALIZED (SELECT * EXCLUDE ({value}, ratio, f), {value} * {factor} AS {value} FROM {fill})"

    ctes = [
        "d0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM documents)",
        r"d1 AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM d0)",
        "d AS (SELECT doc_id, source, lang, CAST(words + 1 AS BIGINT) AS tokens, CASE WHEN n_lines >= 2 AND words < 15 * n_lines THEN 'lines' WHEN words < 60 THEN 'note' WHEN words < 500 THEN 'article' ELSE 'long' END AS topic FROM d1)",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY 1, 2, 3)",
        f"b AS (SELECT *, tokens / ({fraction} * (SELECT sum(tokens) FROM c)) AS bound FROM c)",
    ]
    for m in MARGINS:
        ctes.append(f"g_{m} AS (SELECT {m} AS level, sum(bound) AS supply, pow(sum(tokens), {power}) AS g FROM b GROUP BY 1)")
        ctes.append(f"h_{m} AS (SELECT level, supply, g / (SELECT sum(g) FROM g_{m}) AS goal FROM g_{m})")
        ctes.append(raised(f"i_{m}", f"h_{m}", "", "goal", "supply", "1.0", "level"))
        ctes.append(f"r_{m} AS (SELECT level AS {m}, least(goal, supply) AS reach_{m} FROM i_{m})")
    ctes.append("w0 AS (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS weight FROM b " + " ".join(f"JOIN r_{m} USING ({m})" for m in MARGINS) + ")")
    k = 0
    for _ in range(rounds):
        for m in MARGINS[::-1]:
            ctes.append(raised(f"w{k + 1}", f"w{k}", m, "weight", "bound", f"reach_{m}", ", ".join(MARGINS)))
            k += 1
    ctes.append(f"p AS (SELECT source, lang, topic, least(1.0, weight / bound) AS probability FROM w{k})")
    u = f"CAST('0x' || substr(md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, source, lang, topic, tokens, CAST(round(probability, 6) AS DOUBLE) AS probability, {u} < probability AS sampled FROM d JOIN p USING (source, lang, topic)"
