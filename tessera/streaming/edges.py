"""Edge streams: an extension; the batch operators don't depend on it.

Micro-batches of edges are added to a graph kept as Parquet, and each batch adds
the triangles that it closes, so a count follows the stream without a recount.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.graph import canonical, cut

_EDGES = "src bigint, dst bigint, batch bigint"
_COUNTS = "batch bigint, triangles bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def add_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Adds a batch's new edges to folder/edges and the triangles that they close to folder/counts.

    Both parts are named by the batch and replaced if it is repeated, so a
    restart counts nothing twice. A triangle is counted at its last new edge:
    older edges or the batch's smaller ones must hold the other two.
    """
    spark = batch.sparkSession
    old = _read(spark, f"{folder}/edges", _EDGES).where(F.col("batch") < batch_id).select("src", "dst")
    new = cut(canonical(batch).join(old, ["src", "dst"], "left_anti"))
    every = old.withColumn("at", F.lit(0)).union(new.withColumn("at", F.lit(1)))
    both = every.union(every.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "at"))
    side = lambda end, at: both.select(F.col("src").alias(end), F.col("dst").alias("w"), F.col("at").alias(at))
    closed = new.join(side("src", "a1"), "src").join(side("dst", "a2"), ["dst", "w"])
    # of a triangle's new edges the largest counts it
    this = F.struct("src", "dst")
    other = lambda end: F.struct(F.least(end, "w"), F.greatest(end, "w"))
    last = ((F.col("a1") == 0) | (other("src") < this)) & ((F.col("a2") == 0) | (other("dst") < this))
    count = closed.where(last).agg(F.count(F.lit(1)).alias("triangles"))
    count.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
    new.write.mode("overwrite").parquet(f"{folder}/edges/batch={batch_id}")


def follow(edges: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the count over a streaming DataFrame (src, dst)."""
    return edges.writeStream.foreachBatch(lambda df, i: add_batch(df, i, folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def triangle_total(spark: SparkSession, folder: str) -> int:
    return _read(spark, f"{folder}/counts", _COUNTS).agg(F.coalesce(F.sum("triangles"), F.lit(0))).first()[0]
