"""Triangles by blocks of id ranges.

Ids are dealt into ranges of about equal numbers of edge ends; the edges between two
ranges are a block. A triangle a < b < c of the ranges i <= j <= k lies in the cell of the three
blocks (i, j), (i, k), (j, k), and a cell is there only if none of them is empty: where ids near each other
are linked, nearly all cells are not, and an edge goes to a few cells however large the graph is. Where ids say nothing about links, it goes to about as
many cells as there are ranges, about sqrt(6 E / edges of a cell), so a block is packed once and travels as bytes: two or three
an edge and cell. The coarsest ranges
whose cells are small enough are taken; where no ranges serve (a block stays too large, or
the ranges are too many) there is no plan, and callers join instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cut

#: Edges that a cell may have; paths of two edges that a worker looks at at a time.
CELL_EDGES, PATHS = 1_500_000, 4_000_000
#: Steps of the id space from which ranges are made, ranges at most, cells at most, and cells that an edge may go to on average.
STEPS, RANGES, CELLS, COPIES = 1 << 16, 512, 200_000, 16
#: Where that would be more than COPIES: cells may have so many times the edges, and an edge may go to so many cells.
LARGER, MORE = 4, 64


@dataclass
class Plan:
    """Ranges of ids: step v is (v - least) // width; part[step] is its range. cells: (i, j, k) of i <= j <= k."""

    least: int
    width: int
    part: np.ndarray
    cells: np.ndarray
    #: edges of all cells over those that a cell may have: tasks that are due
    full: int = 1

    def bounds(self, i: int) -> tuple[int, int]:
        """The first id of range i and how many ids it spans."""
        steps = np.flatnonzero(self.part == i)
        return int(self.least + steps[0] * self.width), int(steps[-1] - steps[0] + 1) * self.width

    def placed(self, pairs: DataFrame) -> DataFrame:
        """pairs with _i and _j, the ranges of src and dst."""
        return _placed(pairs, self.part, self.least, self.width)

    def of(self, v: np.ndarray) -> np.ndarray:
        return self.part[(v - self.least) // self.width]


def _step(v: str, least: int, width: int) -> Column:
    return F.floor((F.col(v) - F.lit(least)) / F.lit(width))


def _placed(pairs: DataFrame, part: np.ndarray, least: int, width: int) -> DataFrame:
    table = pa.table({"_step": pa.array(np.arange(len(part)), pa.int64()), "_part": pa.array(part, pa.int32())})
    steps = F.broadcast(pairs.sparkSession.createDataFrame(table))
    for end, name in (("src", "_i"), ("dst", "_j")):
        pairs = pairs.withColumn("_step", _step(end, least, width)).join(steps.withColumnRenamed("_part", name), "_step").drop("_step")
    return pairs


def _cells_of(there: np.ndarray, most: int) -> np.ndarray | None:
    """The triangles of the graph of blocks; None if there are more than `most`."""
    found, n = [], 0
    for i in range(len(there)):
        near = np.flatnonzero(there[i])
        j, k = np.nonzero(there[np.ix_(near, near)])
        n += len(j)
        if n > most:
            return None
        found.append(np.stack([np.full(len(j), i), near[j], near[k]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def plan(pairs: DataFrame, cell_edges: int | None = None) -> Plan | None:
    """Ranges for edges src < dst; None where none serve. Counts of steps and of blocks alone reach the driver."""
    cell_edges = cell_edges or CELL_EDGES
    least, top, n = pairs.agg(F.min("src"), F.max("dst"), F.count(F.lit(1))).first()
    if not n:
        return Plan(0, 1, np.zeros(1, np.int64), np.zeros((0, 3), np.int64))
    width = -(-(top - least + 1) // STEPS)
    if n <= cell_edges:
        return Plan(least, width, np.zeros((top - least) // width + 1, np.int64), np.zeros((1, 3), np.int64))
    ends = np.zeros((top - least) // width + 1, np.int64)
    for at, k in pairs.select(F.explode(F.array(_step("src", least, width), _step("dst", least, width))).alias("s")).groupBy("s").count().toLocalIterator():
        ends[at] = k
    # the finest ranges; coarser ones are unions of them
    before = np.cumsum(ends) - ends
    fine = before * RANGES // (2 * n)
    rows = _placed(pairs, fine, least, width).groupBy("_i", "_j").count().collect()
    i, j, k = (np.array([r[c] for r in rows], np.int64) for c in range(3))
    for most, copies in ((cell_edges, COPIES), (LARGER * cell_edges, MORE)):
        parts = 2
        while parts <= RANGES:
            size = np.zeros((parts, parts), np.int64)
            np.add.at(size, (i * parts // RANGES, j * parts // RANGES), k)
            cells = _cells_of(size > 0, CELLS) if size.max() <= most else None
            load = None if cells is None else _load(size, cells)
            if load is not None and (not len(load) or load.max() <= most):
                if load.sum() <= copies * n:
                    return Plan(least, width, fine * parts // RANGES, cells, -(-int(load.sum()) // most))
                break
            parts += max(1, parts // 8)
        else:
            # a block of its own that is too large
            return None
    return None


def _load(size: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Edges of each cell: those of its distinct blocks."""
    i, j, k = cells.T
    ij, ik, jk = size[i, j], size[i, k], size[j, k]
    return ij + np.where(j == k, 0, ik) + np.where((i == j) | (j == k) & (i == k), 0, jk)


def _cells_of_blocks(spark: SparkSession, plan: Plan) -> DataFrame:
    """(_i, _j, _cells): the places of the cells that have the block."""
    at: dict[tuple[int, int], list[int]] = {}
    for cell, (i, j, k) in enumerate(plan.cells.tolist()):
        for block in {(i, j), (i, k), (j, k)}:
            at.setdefault(block, []).append(cell)
    return spark.createDataFrame([(i, j, cells) for (i, j), cells in at.items()], "_i int, _j int, _cells array<int>")


def dealt(pairs: DataFrame, plan: Plan) -> DataFrame:
    """pairs with cell, the place among the plan's cells: a row for each cell that has the edge's block."""
    return plan.placed(pairs).join(F.broadcast(_cells_of_blocks(pairs.sparkSession, plan)), ["_i", "_j"]).withColumn("cell", F.explode("_cells")).drop("_i", "_j", "_cells")


def encoded(keys: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending numbers of 0 or more as gaps of so many bytes each, and the gaps that don't fit, in full."""
    gaps = np.diff(keys, prepend=0)
    width = 1 + int(np.argmin([len(gaps) * w + 8 * int((gaps >= 256**w - 1).sum()) for w in range(1, 8)]))
    top = 256**width - 1
    low = np.minimum(gaps, top).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return width, low.T.tobytes(), gaps[gaps >= top].astype("<i8").tobytes()


def decoded(width: int, data: bytes, far: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(width, -1)
    gaps = np.zeros((low.shape[1], 8), np.uint8)
    gaps[:, :width] = low.T
    gaps = gaps.reshape(-1).view("<i8")
    gaps[gaps == 256**width - 1] = np.frombuffer(far, "<i8")
    return np.cumsum(gaps)


def pack(src: np.ndarray, dst: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[int, bytes, bytes]:
    """A block's edges as bytes; width 0: as they are, as the ids of its ranges have no common number of 63 bits."""
    (a, _), (b, n) = i, j
    if i[1] * n >= 1 << 62:
        return 0, np.stack([src, dst]).astype("<i8").tobytes(), b""
    return encoded(np.sort((src - a) * n + (dst - b)))


def unpack(width: int, data: bytes, far: bytes, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    if not width:
        src, dst = np.frombuffer(data, "<i8").reshape(2, -1)
        return src, dst
    s, d = np.divmod(decoded(width, data, far), j[1])
    return s + i[0], d + j[0]


def packed(pairs: DataFrame, plan: Plan) -> DataFrame:
    """(cell, _i, _j, width, data, far): what dealt() has, a row for each cell and block, dealt by cell."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        width, data, far = pack(table["src"].to_numpy(), table["dst"].to_numpy(), plan.bounds(i), plan.bounds(j))
        return pa.table({"_i": pa.array([i], pa.int32()), "_j": pa.array([j], pa.int32()), "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary()), "far": pa.array([far], pa.binary())})

    rows = plan.placed(pairs.select("src", "dst")).select("_i", "_j", F.col("src").cast("bigint"), F.col("dst").cast("bigint")).groupBy("_i", "_j").applyInArrow(run, "_i int, _j int, width int, data binary, far binary")
    return rows.join(F.broadcast(_cells_of_blocks(pairs.sparkSession, plan)), ["_i", "_j"]).withColumn("cell", F.explode("_cells")).drop("_cells").repartition(_tasks(pairs, plan), "cell")


def _tasks(pairs: DataFrame, plan: Plan) -> int:
    return max(pairs.sparkSession.sparkContext.defaultParallelism, 2 * plan.full)


def _cell(plan: Plan, key: tuple, table: pa.Table) -> Cell:
    ends = [unpack(r["width"], r["data"], r["far"], plan.bounds(r["_i"]), plan.bounds(r["_j"])) for r in table.to_pylist()]
    return Cell(plan, key[0].as_py(), *(np.concatenate(x) for x in zip(*ends)))


def _named(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that are there, ascending, and the places of src and dst among them."""
    ids = np.concatenate([src, dst])
    least, top = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    if top - least > 4 * len(ids) + (1 << 20):
        names, flat = np.unique(ids, return_inverse=True)
        return names, flat[: len(src)].astype(np.int64), flat[len(src) :].astype(np.int64)
    there = np.zeros(top - least + 1, bool)
    there[ids - least] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + least, place[src - least], place[dst - least]


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for n[0] places, then starts[1], ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Slices of about PATHS in all, one item at least."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PATHS, side="right")))
        yield slice(at, to)
        at = to


class Keys:
    """Ascending numbers, asked for by `in_` whether they have others. A table of hashes tells most of those that they don't."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, min(26, int(16 * len(keys)).bit_length())))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)
        self.some[self._hash(keys)] = True

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def in_(self, wanted: np.ndarray) -> np.ndarray:
        """Places of what is there."""
        maybe = np.flatnonzero(self.some[self._hash(wanted)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0]
        asked = wanted[maybe]
        return maybe[self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked]


class Cell:
    """One cell's edges a -> b by places; a triangle counts if a is of range i, b of j, c of k."""

    def __init__(self, plan: Plan, cell: int, src: np.ndarray, dst: np.ndarray):
        self.names, self.s, self.d = _named(src, dst)
        self.n = len(self.names)
        part = plan.of(self.names)
        ps, pd = part[self.s], part[self.d]
        i, j, k = plan.cells[cell]
        self.pairs = (ps == i) & (pd == j)
        #: lists whose elements are of range k, of vertices of i and of j
        self.sides = (ps == i) & (pd == k), (ps == j) & (pd == k)
        self.part, self.wanted = part, (i, j, k)

    def by_lists(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (a, b, c): the shorter of an edge's two lists is walked, its elements looked up in the other."""
        a, b = self.s[self.pairs], self.d[self.pairs]
        keys = [np.sort(self.s[x] * self.n + self.d[x]) for x in self.sides]
        starts = [np.searchsorted(x, np.arange(self.n + 1) * self.n) for x in keys]
        sets = [Keys(x) for x in keys]
        na, nb = np.diff(starts[0])[a], np.diff(starts[1])[b]
        some = (na > 0) & (nb > 0)
        for mine, other, walk in ((0, 1, some & (na <= nb)), (1, 0, some & (nb < na))):
            ends = np.stack([a[walk], b[walk]])
            n = (na, nb)[mine][walk]
            for at in _slices(n):
                x, y, m = ends[mine][at], ends[other][at], n[at]
                third = keys[mine][_runs(starts[mine][x], m)] % self.n
                row = np.repeat(np.arange(len(m)), m)
                hit = sets[other].in_(y[row] * self.n + third)
                yield ends[0][at][row[hit]], ends[1][at][row[hit]], third[hit]

    def by_wedges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (a, b, c): two edges of a vertex that is the first of its triangle by (degree in the cell, id), closed by a third edge."""
        degree = np.bincount(self.s, minlength=self.n) + np.bincount(self.d, minlength=self.n)
        rank = np.empty(self.n, np.int64)
        rank[np.argsort(degree, kind="stable")] = np.arange(self.n)
        low, high = np.minimum(rank[self.s], rank[self.d]), np.maximum(rank[self.s], rank[self.d])
        keys = np.sort(low * self.n + high)
        there = Keys(keys)
        first, second = keys // self.n, keys % self.n
        ends = np.searchsorted(first, first, side="right")
        at_rank = np.argsort(rank)
        # an edge and each later one of its first vertex
        n = ends - np.arange(len(keys)) - 1
        for at in _slices(n):
            row = np.repeat(np.arange(len(keys))[at], n[at])
            other = _runs(np.arange(len(keys))[at] + 1, n[at])
            hit = there.in_(second[row] * self.n + second[other])
            t = np.sort(at_rank[np.stack([first[row[hit]], second[row[hit]], second[other[hit]]])], axis=0)
            own = np.all(self.part[t] == np.array(self.wanted)[:, None], axis=0)
            yield t[0][own], t[1][own], t[2][own]

    def packed(self, width: int) -> int:
        """The number of triangles: lists as packs (vertex, element // width, bits), and the bits that both ends of an edge have."""
        packs = []
        for side in self.sides:
            x = self.names[self.d[side]]
            packs.append((self.s[side], x // width, np.left_shift(np.int64(1), x % width)))
        bases = np.unique(np.concatenate([p[1] for p in packs]))
        keys, states, starts = [], [], []
        for v, base, bit in packs:
            key, place = np.unique(v * len(bases) + np.searchsorted(bases, base), return_inverse=True)
            state = np.zeros(len(key), np.int64)
            np.bitwise_or.at(state, place, bit)
            keys.append(key)
            states.append(state)
            starts.append(np.searchsorted(key, np.arange(self.n + 1) * len(bases)))
        a, b, found = self.s[self.pairs], self.d[self.pairs], 0
        na, nb = np.diff(starts[0])[a], np.diff(starts[1])[b]
        some = (na > 0) & (nb > 0)
        for mine, other, walk in ((0, 1, some & (na <= nb)), (1, 0, some & (nb < na))):
            x, y, n = (a, b)[mine][walk], (a, b)[other][walk], (na, nb)[mine][walk]
            for at in _slices(n):
                pack = _runs(starts[mine][x[at]], n[at])
                wanted = np.repeat(y[at], n[at]) * len(bases) + keys[mine][pack] % len(bases)
                place = np.minimum(np.searchsorted(keys[other], wanted), len(keys[other]) - 1)
                hit = keys[other][place] == wanted
                found += int(np.bitwise_count(states[mine][pack[hit]] & states[other][place[hit]]).sum())
        return found


def counts(pairs: DataFrame, plan: Plan, method: str, width: int) -> DataFrame:
    """(c): triangles of each cell, by `lists`, `wedges` or `packs` of so many bits."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        cell = _cell(plan, key, table)
        n = cell.packed(width) if method == "packs" else sum(len(a) for a, _, _ in (cell.by_lists() if method == "lists" else cell.by_wedges()))
        return pa.table({"c": pa.array([n], pa.int64())})

    return packed(pairs, plan).groupBy("cell").applyInArrow(count, "c bigint")


def counts_per_vertex(pairs: DataFrame, plan: Plan) -> DataFrame:
    """(v, n): a row for each cell in which v has triangles."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        cell = _cell(plan, key, table)
        n = np.zeros(cell.n, np.int64)
        for found in cell.by_lists():
            for side in found:
                n += np.bincount(side, minlength=cell.n)
        return pa.table({"v": cell.names[n > 0], "n": n[n > 0]})

    return packed(pairs, plan).groupBy("cell").applyInArrow(count, "v bigint, n bigint")


def listed(pairs: DataFrame, plan: Plan, keys: DataFrame | None = None) -> DataFrame:
    """(a, b, c): every triangle, ascending; with keys, (v, key) of every vertex that has edges, by (key, id)."""
    ranked = keys is not None

    def found(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        of_vertex = pc.equal(table["_j"], -1)
        cell = _cell(plan, key, table.filter(pc.invert(of_vertex)))
        rank = np.arange(cell.n)
        if ranked:
            of = np.zeros(cell.n, np.int64)
            for row in table.filter(of_vertex).to_pylist():
                v, values = np.frombuffer(row["data"], "<i8").reshape(2, -1)
                place = np.minimum(np.searchsorted(cell.names, v), cell.n - 1)
                there = cell.names[place] == v
                of[place[there]] = values[there]
            rank[np.argsort(of, kind="stable")] = np.arange(cell.n)
        at_rank = np.argsort(rank)
        for t in cell.by_lists():
            t = cell.names[at_rank[np.sort(rank[np.stack(t)], axis=0)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in t], names=["a", "b", "c"])

    rows = packed(pairs, plan)
    if ranked:
        rows = rows.union(_keys_of_cells(keys, plan)).repartition(_tasks(pairs, plan), "cell")
    return rows.groupBy("cell").applyInArrow(found, "a bigint, b bigint, c bigint")


def _keys_of_cells(keys: DataFrame, plan: Plan) -> DataFrame:
    """Like packed(): the vertices of a range and their keys, as bytes, for each cell that has the range. _j is -1."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data = np.stack([table["v"].to_numpy(), table["key"].to_numpy()]).astype("<i8").tobytes()
        return pa.table({"_i": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    at: dict[int, list[int]] = {}
    for cell, ranges in enumerate(plan.cells.tolist()):
        for i in set(ranges):
            at.setdefault(i, []).append(cell)
    cells = keys.sparkSession.createDataFrame(list(at.items()), "_i int, _cells array<int>")
    v = F.col("v").cast("bigint")
    of = plan.placed(keys.select(v.alias("src"), v.alias("dst"), F.col("key").cast("bigint").alias("key"))).select("_i", F.col("src").alias("v"), "key")
    rows = of.groupBy("_i").applyInArrow(run, "_i int, data binary").join(F.broadcast(cells), "_i")
    return rows.select("_i", F.lit(-1).alias("_j"), F.lit(0).alias("width"), "data", F.lit(b"").alias("far"), F.explode("_cells").alias("cell"))


def canonical_plan(pairs: DataFrame) -> tuple[DataFrame, Plan | None]:
    """Canonical edges as a table, and their plan."""
    pairs = cut(pairs)
    return pairs, plan(pairs)
