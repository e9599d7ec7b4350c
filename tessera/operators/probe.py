"""Intersections that look at little of the large side.

Stored sets are a table of (v, x) rows in directories of element ranges, bucketed and sorted by
element. A small set that is joined to it names the ranges it needs, so the other
directories' files aren't opened, and the large side is joined where it lies: no
exchange, no sort.

A Bloom filter of one side's elements, built by one aggregation and sized from their count, is
tested on the other before that is shuffled.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import BROADCAST_ENTRIES, new_folder

#: Elements that a directory of stored sets and a file in it are to have.
RANGE_ROWS, FILE_ROWS = 64_000_000, 4_000_000
#: Ranges that a probe may name one by one; one that needs more reads all between its least and its largest.
NAMED_RANGES = 10_000
#: Bits of a Bloom filter's word, how many of them an element sets, and words that a filter may have (16 bytes each as rows).
WORD, HASHES, MOST_WORDS = 64, 4, 1_000_000


# stored sets


def store_sets(rows: DataFrame, table: str | None = None, range_rows: int = RANGE_ROWS, file_rows: int = FILE_ROWS) -> str:
    """Write (v, x) rows, each once, as a table of stored sets; its name. Ranges and buckets are as many as the count calls for."""
    spark = rows.sparkSession
    table = table or f"stored_sets_{uuid.uuid4().hex}"
    n, least, most = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    span = max(1, math.ceil(((most or 0) - (least or 0) + 1) * range_rows / max(range_rows, n)))
    buckets = max(1, math.ceil(min(n, range_rows) / file_rows))
    # a bucket is written by one task, so a range has one file a bucket
    dealt = rows.select("v", "x").distinct().withColumn("part", F.floor(F.col("x") / span).cast("bigint")).repartition(buckets, "x")
    dealt.write.partitionBy("part").bucketBy(buckets, "x").sortBy("x", "v").option("path", new_folder(spark, "stored-sets")).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('tessera.span' = '{span}')")
    return table


def _span(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table} ('tessera.span')").first()
    return int(rows["value"])


def probe_sets(table: str, probe: DataFrame, broadcast_rows: int = BROADCAST_ENTRIES) -> DataFrame:
    """(v, x, and the probe's other columns): stored elements that the probe (x, ...) has too."""
    spark = probe.sparkSession
    span = _span(spark, table)
    parts = probe.select(F.floor(F.col("x") / span).cast("bigint").alias("part")).distinct()
    named = [r[0] for r in parts.limit(NAMED_RANGES + 1).collect()]
    stored = spark.table(table)
    if len(named) <= NAMED_RANGES:
        stored = stored.where(F.col("part").isin(named)) if named else stored.where(F.lit(False))
    else:
        low, high = parts.agg(F.min("part"), F.max("part")).first()
        stored = stored.where(F.col("part").between(low, high))
    small = probe.count() <= broadcast_rows
    # beyond a broadcast the probe alone is dealt out, into the table's buckets
    return stored.drop("part").join(F.broadcast(probe) if small else probe.hint("merge"), "x")


# Bloom filters


def _bits(key: Column) -> Column:
    """HASHES of a word's bits."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("bigint")
    for i in range(HASHES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(WORD - 1).cast("int")))
    return out


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def bloom_words(n: int, bits_per_key: int = 12, most: int = MOST_WORDS) -> int:
    """Words of a filter of n elements; 0 where `most` words would be too full to tell much (fewer than 4 bits an element)."""
    words = max(1, math.ceil(n * bits_per_key / WORD))
    return words if words <= most else most if most * WORD >= 4 * n else 0


def bloom_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, state): every element's bits, in one word of the filter; combined before the shuffle."""
    return keys.select(_word(F.col(key), words).alias("word"), _bits(F.col(key)).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("state"))


def maybe_in(rows: DataFrame, key: str, filter_: DataFrame, words: int) -> DataFrame:
    """The rows whose element may be in the filter: all that are, and few others. At most MOST_WORDS rows are broadcast."""
    tested = rows.withColumns({"_tsr_word": _word(F.col(key), words), "_tsr_bits": _bits(F.col(key))})
    side = F.broadcast(filter_.withColumnsRenamed({"word": "_tsr_word", "state": "_tsr_state"}))
    hit = tested.join(side, "_tsr_word").where(F.col("_tsr_state").bitwiseAND(F.col("_tsr_bits")) == F.col("_tsr_bits"))
    return hit.select(*rows.columns)


def filtered_intersect(small: DataFrame, large: DataFrame, key: str, bits_per_key: int = 12) -> DataFrame:
    """Rows of both that agree in all of small's columns, which large has too; large is tested by `key` before it is shuffled."""
    words = bloom_words(small.count(), bits_per_key)
    if words:
        large = maybe_in(large, key, bloom_filter(small, key, words), words)
    return large.join(small.hint("shuffle_hash"), small.columns)
