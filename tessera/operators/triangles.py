"""Triangle counts: neighbour arrays (default), wedges, bit-packed rows, and an edge grid.

The grid hashes vertices into p parts. A triangle lies in the cell of its three
parts, and an edge goes to the p cells that hold both of its parts, so a cell has about
6 E / p**2 edges whatever the degrees: a hub's edges spread over p**2 / 2
cells, and none of them carries a list. Cells are counted by themselves.

Undirected counts are taken by blocks of id ranges (blocks.py) wherever ranges serve: the edges go to the cells, and the
lists, wedges or packs are made and met there. Else, and on directed input, they are joined.

Directed input follows one rule: a triangle is w < u < v with the edges u->v,
u->w and v->w. On symmetric graphs these are the undirected triangles; on files
that hold only src < dst there are none. undirected=True counts the triangles of
the underlying undirected graph whatever directions are stored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import sets
from tessera.operators import blocks
from tessera.operators.graph import BROADCAST_ENTRIES, adjacency, canonical, cut, deduplicate, degree_oriented


#: Edges that a cell of the grid is to have, and paths of two edges that a worker looks at at a time.
CELL_EDGES, PATHS = 400_000, 4_000_000
#: How a cell of id ranges is counted.
METHODS = {"array": "lists", "wedge": "wedges", "bsr": "packs", "grid": "lists"}


def _wanted(edges: DataFrame, undirected: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs, lists): triangles are common targets in lists of both ends of pairs."""
    if undirected:
        out = degree_oriented(cut(canonical(edges)))
        return out, out
    clean = deduplicate(edges)
    return clean.where("src < dst"), clean.where("src > dst")


def _with_lists(pairs: DataFrame, lists: DataFrame, small: bool) -> DataFrame:
    """pairs with a and b, the lists of both ends."""
    adj = cut(adjacency(lists))
    n = adj.agg(F.sum(F.size("nbrs"))).first()[0] or 0
    side = F.broadcast(adj) if small and n <= BROADCAST_ENTRIES else adj
    return pairs.join(side.select(F.col("v").alias("src"), F.col("nbrs").alias("a")), "src").join(side.select(F.col("v").alias("dst"), F.col("nbrs").alias("b")), "dst")


def triangle_count(edges: DataFrame, strategy: str = "array", undirected: bool = False) -> DataFrame:
    """One row (n)."""
    if strategy not in METHODS:
        raise ValueError(f"strategy must be array, wedge, bsr or grid, not {strategy!r}")
    per_edge = None
    if undirected:
        edges, ranges = blocks.canonical_plan(canonical(edges))
        if ranges:
            per_edge = blocks.counts(edges, ranges, METHODS[strategy], sets.WIDTH)
    if per_edge is not None:
        pass
    elif strategy == "array":
        pairs, lists = _wanted(edges, undirected)
        per_edge = _with_lists(pairs, lists, small=True).select(sets.intersect_count("a", "b").cast("bigint").alias("c"))
    elif strategy == "wedge":
        pairs, lists = _wanted(edges, undirected)
        pairs, lists = cut(pairs), cut(lists)
        wedge = pairs.join(lists.select("src", F.col("dst").alias("w")), "src")
        per_edge = wedge.join(lists.select(F.col("src").alias("dst"), F.col("dst").alias("w")), ["dst", "w"], "left_semi").select(F.lit(1).cast("bigint").alias("c"))
    elif strategy == "bsr":
        pairs, lists = _wanted(edges, undirected)
        packs = cut(sets.pack(lists.select(F.col("src").alias("v"), F.col("dst").alias("x"))))
        a = packs.select(F.col("v").alias("src"), "base", F.col("state").alias("sa"))
        b = packs.select(F.col("v").alias("dst"), "base", F.col("state").alias("sb"))
        both = pairs.join(a, "src").join(b, ["dst", "base"])
        per_edge = both.select(F.bit_count(F.col("sa").bitwiseAND(F.col("sb"))).cast("bigint").alias("c"))
    else:
        pairs, lists = _wanted(edges, undirected)
        per_edge = _by_cells(pairs, lists)
    return per_edge.agg(F.coalesce(F.sum("c"), F.lit(0).cast("bigint")).alias("n"))


def grid_parts(edges: int, cell_edges: int = CELL_EDGES) -> int:
    """Parts for cells of about cell_edges edges."""
    return max(2, math.ceil(math.sqrt(6 * edges / cell_edges)))


def _part(v, parts: int):
    return F.pmod(F.xxhash64(v), F.lit(parts)).cast("int")


def grid_cells(edges: DataFrame, parts: int) -> DataFrame:
    """edges with cell, the numbers x <= y <= z of three parts as (x * parts + y) * parts + z: a row for each of the `parts` cells that hold both ends' parts."""
    parted = edges.withColumns({"ps": _part("src", parts), "pd": _part("dst", parts)})
    third = parted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    x, z = F.least("ps", "pd", "k"), F.greatest("ps", "pd", "k")
    return third.withColumn("cell", ((x * parts + (F.col("ps") + F.col("pd") + F.col("k") - x - z)) * parts + z).cast("bigint")).drop("k")


def count_cell(src: np.ndarray, dst: np.ndarray, ps: np.ndarray, pd: np.ndarray, side: np.ndarray, cell: int, parts: int) -> int:
    """Triangles of one cell: pairs src->dst (side 0) with a common target among the lists (side 1), parts of the three exactly the cell's.

    A pair's first list is walked and each target looked up among the edges of its second, in bounded numbers of paths.
    """
    names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = flat[: len(src)], flat[len(src) :]
    part = np.zeros(len(names), np.int64)
    part[s], part[d] = ps, pd
    pairs, lists = side == 0, side == 1
    a, b = s[pairs], d[pairs]
    keys = np.sort(s[lists] * len(names) + d[lists])
    starts = np.searchsorted(keys, np.arange(len(names) + 1) * len(names))
    degree = np.diff(starts)
    # the shorter of the two lists is walked
    swap = degree[b] < degree[a]
    walk, other = np.where(swap, b, a), np.where(swap, a, b)
    ends = np.cumsum(degree[walk])
    x, rest = cell // parts // parts, cell % (parts * parts)
    wanted = (x, rest // parts, rest % parts)
    found, at = 0, 0
    while at < len(walk):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PATHS, side="right")))
        w, o = walk[at:to], other[at:to]
        n = degree[w]
        row = np.repeat(np.arange(len(w)), n)
        third = keys[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[w][row]] % len(names)
        # only paths whose parts are the cell's are looked up: another cell has the rest
        exact = (part[w][row] + part[o][row] + part[third] == sum(wanted)) & (np.minimum(np.minimum(part[w], part[o])[row], part[third]) == wanted[0]) & (np.maximum(np.maximum(part[w], part[o])[row], part[third]) == wanted[2])
        key = o[row[exact]] * len(names) + third[exact]
        place = np.searchsorted(keys, key)
        found += int((keys[np.minimum(place, len(keys) - 1)] == key).sum()) if len(keys) else 0
        at = to
    return found


def _by_cells(pairs: DataFrame, lists: DataFrame, parts: int | None = None) -> DataFrame:
    """(c): triangles of each cell."""
    one = pairs is lists
    both = pairs.withColumn("sides", F.lit(3)) if one else pairs.withColumn("sides", F.lit(1)).union(lists.withColumn("sides", F.lit(2)))
    both = cut(both)
    parts = parts or grid_parts(both.count())

    def count(key: tuple, table: pa.Table) -> pa.Table:
        src, dst, ps, pd, sides = (table[c].to_numpy() for c in ("src", "dst", "ps", "pd", "sides"))
        as_pair, as_list = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)
        rows = np.concatenate([as_pair, as_list])
        side = np.repeat([0, 1], [len(as_pair), len(as_list)])
        return pa.table({"c": pa.array([count_cell(src[rows], dst[rows], ps[rows], pd[rows], side, key[0].as_py(), parts)], pa.int64())})

    return grid_cells(both, parts).groupBy("cell").applyInArrow(count, "c bigint")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: every undirected triangle."""
    edges, ranges = blocks.canonical_plan(canonical(edges))
    if ranges:
        return blocks.listed(edges, ranges)
    pairs, lists = _wanted(edges, True)
    found = _with_lists(pairs, lists, small=True).select("src", "dst", F.explode(F.array_intersect("a", "b")).alias("w"))
    t = F.array_sort(F.array("src", "dst", "w"))
    return found.select(*[F.get(t, F.lit(i)).alias(c) for i, c in enumerate("abc")])


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    """(v, n) of the vertices in triangles."""
    edges, ranges = blocks.canonical_plan(canonical(edges))
    if ranges:
        return blocks.counts_per_vertex(edges, ranges).groupBy("v").agg(F.sum("n").alias("n"))
    return triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
