"""Graph statistics: packing ratio, hubs, leaves, weights, and set-pair counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.sets import WIDTH
from tessera.operators.cores import dense_positions
from tessera.operators.graph import cut, deal, degrees, with_gaps


def packed_sides(edges: DataFrame, width: int = WIDTH) -> DataFrame:
    """(v, out_deg, in_deg, deg, po, pi) of every vertex: degrees of the bag, and packs of its out- and in-list."""
    edges = cut(edges.select("src", "dst"))
    end = lambda side, v, w: F.struct(F.col(v).alias("v"), F.lit(side).alias("out"), F.floor(F.col(w) / width).alias("base"))
    ends = edges.select(F.explode(F.array(end(1, "src", "dst"), end(0, "dst", "src"))).alias("x")).select("x.*")
    packs = deal(ends, 2 * edges.count(), "v").groupBy("v", "out", "base").agg(F.count(F.lit(1)).alias("n"))
    n = lambda out, x: F.sum(F.when(F.col("out") == out, x).otherwise(0))
    found = packs.groupBy("v").agg(n(1, F.col("n")).alias("out_deg"), n(0, F.col("n")).alias("in_deg"), n(1, F.lit(1)).alias("po"), n(0, F.lit(1)).alias("pi"))
    return with_gaps(found).select("v", "out_deg", "in_deg", (F.col("out_deg") + F.col("in_deg")).alias("deg"), "po", "pi")


def ratio_metrics() -> dict[str, Column]:
    """Aggregates over packed_sides(): packs an edge for out- and in-lists, their mean, the degree-weighted score, packs a list, and sizes in MB."""
    out, into, edges, lists = F.sum("po"), F.sum("pi"), F.sum("out_deg"), F.count(F.lit(1))
    weighted, roots = F.sum(F.col("po") * F.sqrt("out_deg") + F.col("pi") * F.sqrt("in_deg")), F.sum(F.sqrt("out_deg") + F.sqrt("in_deg"))
    mb = 4.0 / 1024 / 1024
    return {
        "out_ratio": out / edges, "in_ratio": into / edges, "comp_ratio": (out + into) / edges / 2, "score": weighted / roots, "norm": (out + into) / (2 * lists),
        "plain_mb": (2 * edges + 4 * lists) * mb, "packed_mb": (1.5 * (out + into) + 4 * lists) * mb,
    }


def comp_ratio(edges: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of ratio_metrics(). Counts the bag."""
    return packed_sides(edges, width).agg(*[m.alias(n) for n, m in ratio_metrics().items()])


def big_nodes(edges: DataFrame, ratio: float) -> DataFrame:
    """(v, deg, running): the shortest run of vertices by falling degree whose degrees sum to 2 E ratio or more.

    Only the degrees are ranked: one row a distinct degree is summed up in one
    task, and ties at the edge are dealt by ids.
    """
    return _biggest(degrees(edges).select("v", "deg"), ratio)


def _biggest(deg: DataFrame, ratio: float) -> DataFrame:
    levels = deg.groupBy("deg").agg(F.count(F.lit(1)).alias("n"))
    run = levels.withColumn("before", F.coalesce(F.sum(F.col("deg") * F.col("n")).over(W.orderBy(F.desc("deg")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goal = F.lit(ratio) * F.sum(F.col("deg") * F.col("n")).over(W.partitionBy())
    run = run.withColumn("goal", goal).where(F.col("before") < F.col("goal"))
    ranked = dense_positions(deg.join(run.select("deg", "before", "goal"), "deg"), [F.desc("deg"), F.col("v")])
    first = ranked.groupBy("deg").agg(F.min("position").alias("p0"))
    out = ranked.join(first, "deg").withColumn("running", F.col("before") + F.col("deg") * (F.col("position") - F.col("p0") + 1))
    return out.where(F.col("running") - F.col("deg") < F.col("goal")).select("v", "deg", "running")


def big_node_stats(edges: DataFrame, ratio: float) -> DataFrame:
    """One row over big_nodes(): count, share of all vertices, mean and variance of the degree, (out, in) degrees of the first and the last of the run."""
    deg = degrees(edges)
    rows = _biggest(deg.select("v", "deg"), ratio).join(deg.select("v", "out_deg", "in_deg"), "v")
    ends = F.struct("out_deg", "in_deg")
    s = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("deg").alias("avg_deg"), F.var_pop("deg").alias("var_deg"),
        F.min_by(ends, "running").alias("first"), F.max_by(ends, "running").alias("last"),
    )
    total = deg.agg(F.count(F.lit(1)).alias("v"))
    return s.join(F.broadcast(total)).select(
        "n", (F.col("n") / F.col("v")).alias("ratio"), "avg_deg", "var_deg", F.col("first.out_deg").alias("max_out_deg"), F.col("first.in_deg").alias("max_in_deg"),
        F.col("last.out_deg").alias("min_out_deg"), F.col("last.in_deg").alias("min_in_deg"),
    )


def leaf_count(edges: DataFrame) -> DataFrame:
    """One row (n): vertices of out-degree 1 or in-degree 1."""
    return degrees(edges).agg(F.count_if((F.col("out_deg") == 1) | (F.col("in_deg") == 1)).alias("n"))


def degree_weights(edges: DataFrame) -> DataFrame:
    """(v, alpha_out, alpha_in): square roots of degrees over their sum."""
    deg = degrees(edges)
    total = deg.agg(F.sum(F.sqrt("out_deg") + F.sqrt("in_deg")).alias("t"))
    return deg.join(F.broadcast(total)).select("v", (F.sqrt("out_deg") / F.col("t")).alias("alpha_out"), (F.sqrt("in_deg") / F.col("t")).alias("alpha_in"))


def given_weights(weights: DataFrame) -> DataFrame:
    """(v, out_weight, in_weight) to weights that sum to 1 together."""
    total = weights.agg(F.sum(F.col("out_weight") + F.col("in_weight")).alias("t"))
    return weights.join(F.broadcast(total)).select("v", (F.col("out_weight") / F.col("t")).alias("alpha_out"), (F.col("in_weight") / F.col("t")).alias("alpha_in"))


def ranked_sides(weights: DataFrame) -> DataFrame:
    """(v, side, alpha, position): both lists of each vertex by falling weight."""
    sides = weights.select("v", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("alpha_out").alias("alpha")), F.struct(F.lit(1).alias("side"), F.col("alpha_in").alias("alpha")))).alias("x")).select("v", "x.side", "x.alpha")
    return dense_positions(sides, [F.desc("alpha"), F.col("v"), F.col("side")])


def pair_counters(pairs: DataFrame) -> DataFrame:
    """One row of counters over set pairs (a, b): pairs, without common elements, skewed (32 times as large), of low selectivity."""
    na, nb = F.size("a"), F.size("b")
    low, high, common = F.least(na, nb), F.greatest(na, nb), F.size(F.array_intersect("a", "b"))
    skew = low * 32 < high
    few = ((F.try_divide(common, low) < 0.3) | (low < 8)) & ~skew
    return pairs.agg(F.count(F.lit(1)).alias("inter_cnt"), F.count_if(common == 0).alias("no_match_cnt"), F.count_if(skew).alias("skew_cnt"), F.count_if(few).alias("low_select_cnt"))
