"""Id densification and mappings, and generated labels and queries.

Generators use integer arithmetic on the row number, so any engine gets the
same values: a Lehmer step modulo 2**31 - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cores import dense_positions

PRIME, FACTOR = 2_147_483_647, 48_271


def lehmer(n: Column, seed: int) -> Column:
    """Two Lehmer steps of n * 40503 + seed: 0 to PRIME - 1."""
    x = (n * 40_503 + seed + 1) % PRIME
    return (((x * FACTOR) % PRIME) * FACTOR) % PRIME


def uniform(n: Column, seed: int, bound: Column | int) -> Column:
    return lehmer(n, seed) % bound


def densify_first_seen(raw: DataFrame) -> DataFrame:
    """(raw_id, new_id) of (raw_src, raw_dst, line) or read_raw_edges(): ids in order of first appearance, source before target."""
    place = [c for c in ("file", "block", "line") if c in raw.columns]
    end = lambda c, side: F.struct(F.col(c).alias("raw_id"), F.struct(*place, F.lit(side).alias("side")).alias("at"))
    ends = raw.select(F.explode(F.array(end("raw_src", 0), end("raw_dst", 1))).alias("x")).select("x.*")
    first = ends.groupBy("raw_id").agg(F.min("at").alias("at"))
    return dense_positions(first, ["at", "raw_id"], "new_id").select("raw_id", "new_id")


def densify_sorted(edges: DataFrame) -> DataFrame:
    """(org_id, new_id): ranks of the ids in numeric order."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("org_id")).distinct()
    return dense_positions(ids, ["org_id"], "new_id").select("org_id", "new_id")


def relabel(edges: DataFrame, ids: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Both ends through (org_id, new_id)."""
    out = edges.join(ids.withColumnsRenamed({"org_id": a, "new_id": "_na"}), a).join(ids.withColumnsRenamed({"org_id": b, "new_id": "_nb"}), b)
    return out.select(F.col("_na").alias(a), F.col("_nb").alias(b))


def relabel_raw(raw: DataFrame, ids: DataFrame, both_directions: bool = False) -> DataFrame:
    """(src, dst) of raw edges through densify_first_seen()."""
    out = raw.join(ids.withColumnsRenamed({"raw_id": "raw_src", "new_id": "src"}), "raw_src").join(ids.withColumnsRenamed({"raw_id": "raw_dst", "new_id": "dst"}), "raw_dst").select("src", "dst")
    return out.union(out.select("dst", "src")) if both_directions else out


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """org_id to the new_id that `second` gives to first's new_id."""
    return first.withColumnRenamed("new_id", "_mid").join(second.withColumnRenamed("org_id", "_mid"), "_mid").select("org_id", "new_id")


def gen_labels(spark: SparkSession, n: int, labels: int = 100, seed: int = 0) -> DataFrame:
    v = spark.range(n).select(F.col("id").alias("vertex"))
    return v.select("vertex", uniform(F.col("vertex"), seed, labels).alias("label"))


def relabel_labels(labels: DataFrame, ids: DataFrame) -> DataFrame:
    return labels.join(ids.withColumnRenamed("org_id", "vertex"), "vertex").select(F.col("new_id").alias("vertex"), "label")


def gen_vertex_queries(spark: SparkSession, vertices: int, n: int = 1000, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("query_id"), uniform(F.col("id"), seed, vertices).alias("vertex"))


def gen_distance_queries(spark: SparkSession, vertices: int, n: int = 50_000, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("query_id"), uniform(2 * F.col("id"), seed, vertices).alias("src"), uniform(2 * F.col("id") + 1, seed, vertices).alias("dst"))


def relabel_queries(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, line): every id of a text line through the mapping, shape kept."""
    token = queries.select("query_id", F.posexplode(F.split("line", " ")).alias("at", "id")).withColumn("org_id", F.col("id").cast("bigint"))
    new = token.join(ids, "org_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "new_id"))).alias("x"))
    return new.select("query_id", F.array_join(F.transform("x", lambda y: y["new_id"].cast("string")), " ").alias("line"))
