"""Sets as chunked bitmaps, and as runs.

A chunked bitmap is rows (keys, bucket, bitmap): 32,768 elements a bucket, built and
joined by Spark's bitmap aggregates, which combine before they shuffle. Sizes of unions over coarser keys come from
the chunks; no element is looked at again.

Runs are rows (v, start, end), ends inclusive: what a set of long stretches takes. They are
cut at the borders of chunks of CHUNK elements while they are made or
swept, so a window holds a chunk of a set, and joined over the borders in the end, where a window holds
two runs a chunk at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Elements of a chunk of runs.
CHUNK = 1 << 20


# chunked bitmaps


def bitmaps(rows: DataFrame, keys: list[str], element: str = "x", dealt: list[str] | None = None) -> DataFrame:
    """(keys, bucket, bitmap) of (keys, element) rows, repeated ones too.

    With dealt, some of the keys, rows are dealt by these first, and a bitmap is made once: where sets are many and small,
    the bitmaps that tasks would combine take far more room than the rows. Without, tasks combine first: for few and large sets.
    """
    if dealt:
        rows = rows.select(*keys, element).repartition(*dealt)
    return rows.groupBy(*keys, F.bitmap_bucket_number(element).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(element)).alias("bitmap"))


def bitmap_union(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The union of all sets that share the (coarser) keys."""
    return chunks.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_intersection(chunks: DataFrame, keys: list[str], sets: int) -> DataFrame:
    """The intersection of the `sets` sets that share the keys; a bucket that one of them lacks is empty."""
    both = chunks.groupBy(*keys, "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == sets) & (F.bitmap_count("bitmap") > 0)).drop("n")


def bitmap_sizes(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n)."""
    return chunks.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


# runs


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that touch or overlap become one, within the keys."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    # a run that begins after a gap begins an island
    new = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    marked = rows.select(*keys, "start", "end", new.alias("_new")).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _joined(runs: DataFrame, key: str, chunk: int) -> DataFrame:
    """Runs that were cut at chunk borders, joined over them. Only those that touch a border are looked at."""
    touches = (F.pmod("start", F.lit(chunk)) == 0) | (F.pmod(F.col("end") + 1, F.lit(chunk)) == 0)
    runs = runs.select(key, "start", "end")
    return runs.where(~touches).union(_islands(runs.where(touches), [key]).select(key, "start", "end"))


def to_runs(rows: DataFrame, key: str = "v", element: str = "x", chunk: int = CHUNK) -> DataFrame:
    """(key, start, end) of (key, element) rows, repeated ones too."""
    one = rows.select(key, F.col(element).alias("start")).distinct().withColumn("_chunk", F.floor(F.col("start") / chunk))
    # elements of a run have the same distance to their place
    place = F.row_number().over(W.partitionBy(key, "_chunk").orderBy("start"))
    inside = one.withColumn("_run", F.col("start") - place).groupBy(key, "_chunk", "_run").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    return _joined(inside, key, chunk)


def _in_chunks(runs: DataFrame, key: str, chunk: int) -> DataFrame:
    """Runs cut at chunk borders: a row a chunk, never one an element."""
    at = runs.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("end") / chunk))).alias("_chunk"))
    return at.select(key, "_chunk", F.greatest("start", F.col("_chunk") * chunk).alias("start"), F.least("end", F.col("_chunk") * chunk + chunk - 1).alias("end"))


def _swept(sets: list[DataFrame], least: int, key: str, chunk: int) -> DataFrame:
    """Stretches that lie in `least` of the sets or more. Runs of a set don't overlap."""
    events = None
    for runs in sets:
        own = _in_chunks(runs, key, chunk)
        both = own.select(key, "_chunk", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
        events = both if events is None else events.union(both)
    # a chunk's events are few or many, but a hot set's are in as many chunks as it has
    steps = events.groupBy(key, "_chunk", "e.at").agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(key, "_chunk").orderBy("at")
    deep = steps.select(key, "_chunk", F.col("at").alias("start"), (F.lead("at").over(w) - 1).alias("end"), F.sum("d").over(w).alias("depth")).where(F.col("depth") >= least)
    return _joined(_islands(deep, [key, "_chunk"]), key, chunk)


def runs_union(a: DataFrame, b: DataFrame, key: str = "v", chunk: int = CHUNK) -> DataFrame:
    return _swept([a, b], 1, key, chunk)


def runs_intersect(a: DataFrame, b: DataFrame, key: str = "v", chunk: int = CHUNK) -> DataFrame:
    return _swept([a, b], 2, key, chunk)


def runs_size(runs: DataFrame, key: str = "v") -> DataFrame:
    """(key, n_runs, n): runs and elements of each set."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("end") - F.col("start") + 1).alias("n"))


def from_runs(runs: DataFrame, key: str = "v", element: str = "x", chunk: int = CHUNK) -> DataFrame:
    return _in_chunks(runs, key, chunk).select(key, F.explode(F.sequence("start", "end")).alias(element))
