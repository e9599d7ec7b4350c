"""Random set pairs of given overlap, the filter cost model and relative speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ids import PRIME


def set_pair(spark: SparkSession, length: int, skew: float = 1.0, selectivity: float = 0.1, density: float = 0.01) -> DataFrame:
    """(set_id, x) of two sets: |a| = length, |b| = length / skew, and |b| or length * selectivity elements in common, whichever is less.

    Elements are the first values of a permutation of the universe, x -> x * step
    mod a prime at least as large, so they are distinct without a shuffle.
    """
    nb = int(length / skew)
    common = min(nb, int(length * selectivity))
    total = length + nb - common
    size = next_prime(max(total + 1, min(int(total / density), PRIME)))
    step = 48_271 % size or 1
    x = ((F.col("id") + 1) * step) % size
    rows = spark.range(total).withColumn("x", x)
    a = rows.where(F.col("id") < length).select(F.lit("a").alias("set_id"), "x")
    b = rows.where((F.col("id") < common) | (F.col("id") >= length)).select(F.lit("b").alias("set_id"), "x")
    return a.union(b)


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


#: Modelled instructions a block pair. Word check: blocks without and with a byte match.
#: Byte filter: blocks without, with one and with several byte matches in a lane.
WORD_CHECK = (4.0, 12.0)
BYTE_FILTER = (2.0, 6.0, 8.2)


def filter_cost(spark: SparkSession, p: float = 0.25, w: int = 32, b: int = 8) -> DataFrame:
    """One row: chances that a pair of four-word blocks has no byte match, or several in a lane, and the expected costs of both methods.

    p: chance that two words are equal; w: bits of a word; b: bits compared first.
    """
    miss = (1 - p) * (1 - (2.0 ** (w - b) - 1) / (2.0**w - 1))  # two words differ in the b bits
    lane = [miss**4, 4 * miss**3 * (1 - miss)]  # none and one of a lane's four comparisons match
    none, several = lane[0] ** 4, 1 - sum(lane) ** 4
    word = WORD_CHECK[0] * none + WORD_CHECK[1] * (1 - none)
    byte = BYTE_FILTER[0] * none + BYTE_FILTER[1] * (1 - none - several) + BYTE_FILTER[2] * several
    return spark.range(1).select(F.lit(none).alias("no_match"), F.lit(several).alias("multi_match"), F.lit(word).alias("word_check_cost"), F.lit(byte).alias("byte_filter_cost"))


def relative_speed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, ratio) of two series (x, t): t of b over t of a."""
    return a.withColumnRenamed("t", "ta").join(b.withColumnRenamed("t", "tb"), "x").select("x", (F.col("tb") / F.col("ta")).alias("ratio"))
