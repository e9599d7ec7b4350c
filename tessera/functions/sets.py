"""Set algebra: on ascending bigint arrays, and on bit-packed relations.

A bit-packed set is rows (v, base, state): element x is bit x % width of base
x // width, and state is never 0. Widths up to 63 keep states non-negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import deal

WIDTH = 32


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# arrays


def intersect(a, b) -> Column:
    return F.array_sort(F.array_intersect(_c(a), _c(b)))


def intersect_count(a, b) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b)))


def union(a, b) -> Column:
    return F.array_sort(F.array_union(_c(a), _c(b)))


def merge_disjoint(a, b) -> Column:
    """Sorted union of sets known to be disjoint; equal elements would stay twice."""
    return F.array_sort(F.concat(_c(a), _c(b)))


def subtract(a, b) -> Column:
    return F.array_sort(F.array_except(_c(a), _c(b)))


def symmetric_difference(a, b) -> Column:
    return F.array_sort(F.concat(F.array_except(_c(a), _c(b)), F.array_except(_c(b), _c(a))))


def union_count(a, b) -> Column:
    return F.size(_c(a)) + F.size(_c(b)) - intersect_count(a, b)


def subtract_count(a, b) -> Column:
    return F.size(_c(a)) - intersect_count(a, b)


def symmetric_difference_count(a, b) -> Column:
    return F.size(_c(a)) + F.size(_c(b)) - 2 * intersect_count(a, b)


def jaccard(a, b) -> Column:
    """Null for two empty sets."""
    return F.try_divide(intersect_count(a, b).cast("double"), union_count(a, b))


def overlaps(a, b) -> Column:
    return F.arrays_overlap(_c(a), _c(b))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(_c(a), _c(b))) == 0


def is_strict_subset(a, b) -> Column:
    return is_subset(a, b) & (F.size(_c(a)) < F.size(_c(b)))


def add(a, x) -> Column:
    return F.array_sort(F.array_union(_c(a), F.array(_c(x))))


def remove(a, x) -> Column:
    return F.array_remove(_c(a), _c(x))


def contains(a, x) -> Column:
    return F.array_contains(_c(a), _c(x))


def select(a, rank) -> Column:
    """The element with that many smaller ones; null beyond the end."""
    return F.get(F.array_sort(_c(a)), _c(rank))


def rank(a, x) -> Column:
    """How many elements are at most x."""
    return F.size(F.filter(_c(a), lambda y: y <= _c(x)))


def flip(a, start: int, end: int) -> Column:
    """Elements of [start, end) change sides."""
    return symmetric_difference(a, F.sequence(F.lit(start).cast("bigint"), F.lit(end - 1).cast("bigint"))) if end > start else F.array_sort(_c(a))


# bit-packed relations


def pack(rows: DataFrame, key: str = "v", element: str = "x", width: int = WIDTH, n: int | None = None) -> DataFrame:
    """(key, element) rows, repeated ones too, to (key, base, state). n: how many rows there are, where that is known; they are then dealt by pack first."""
    bits = rows.select(key, F.floor(F.col(element) / width).cast("bigint").alias("base"), F.expr(f"cast(pmod({element}, {width}) as int)").alias("bit"))
    return (bits if n is None else deal(bits, n, key, "base")).groupBy(key, "base").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("state"))


def unpack(packs: DataFrame, key: str = "v", element: str = "x", width: int = WIDTH) -> DataFrame:
    bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.getbit("state", b) == 1)
    return packs.select(key, "base", F.explode(bits).alias("bit")).select(key, (F.col("base") * width + F.col("bit")).alias(element))


def packed_size(packs: DataFrame, key: str = "v") -> DataFrame:
    return packs.groupBy(key).agg(F.sum(F.bit_count("state")).alias("n"))


def packed_intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """AND of packs with equal keys and base; empty ones go."""
    both = a.withColumnRenamed("state", "sa").join(b.withColumnRenamed("state", "sb"), [*keys, "base"])
    return both.select(*keys, "base", F.col("sa").bitwiseAND(F.col("sb")).alias("state")).where("state <> 0")


def packed_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "base", "state").union(b.select(*keys, "base", "state")).groupBy(*keys, "base").agg(F.bit_or("state").alias("state"))


def fast_union(packs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of all sets that share the keys, however many: one aggregation, combined before the shuffle."""
    return packs.groupBy(*keys, "base").agg(F.bit_or("state").alias("state"))


def packed_subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.withColumnRenamed("state", "sa").join(b.withColumnRenamed("state", "sb"), [*keys, "base"], "left")
    return both.select(*keys, "base", F.col("sa").bitwiseAND(F.bitwise_not(F.coalesce("sb", F.lit(0).cast("bigint")))).alias("state")).where("state <> 0")


def packed_add(a: DataFrame, elements: DataFrame, key: str = "v", width: int = WIDTH) -> DataFrame:
    """a with further (key, x) elements."""
    return packed_union(a, pack(elements, key, "x", width), [key])


def split_visited(rows: DataFrame, visited: DataFrame, on: str = "x") -> tuple[DataFrame, DataFrame]:
    """Rows outside visited, and rows inside: P and X of a clique search."""
    return rows.join(visited, on, "left_anti"), rows.join(visited, on, "left_semi")


# hierarchical partitions: high 16 bits, then low 16


def partition16(rows: DataFrame, key: str = "v", element: str = "x") -> DataFrame:
    """(key, prefix, lows): elements by their high bits."""
    return rows.groupBy(key, F.shiftright(element, 16).alias("prefix")).agg(F.sort_array(F.collect_set(F.col(element).bitwiseAND(65535))).alias("lows"))


def combine16(parts: DataFrame, key: str = "v", element: str = "x") -> DataFrame:
    return parts.select(key, "prefix", F.explode("lows").alias("low")).select(key, F.shiftleft("prefix", 16).bitwiseOR(F.col("low")).alias(element))


def intersect16(a: DataFrame, b: DataFrame, key: str = "v") -> DataFrame:
    """Prefixes by equi-join, then the low parts."""
    both = a.withColumnRenamed("lows", "la").join(b.withColumnRenamed("lows", "lb"), [key, "prefix"])
    return both.select(key, "prefix", intersect("la", "lb").alias("lows")).where(F.size("lows") > 0)
