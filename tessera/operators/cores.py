"""k-core decomposition by h-indices.

Every vertex starts with its degree and takes, round by round, the largest h
such that h neighbours have a value of h or more. Values only fall and end at
the core numbers. A round is one join and one aggregation; a vertex whose
neighbours didn't change keeps its value by itself.

A graph of at most WHOLE edges is peeled whole by a worker. A larger one whose ids stay below IDS keeps its neighbour
lists as bytes, some LIST neighbours a row: a round reads them, moves none of them, and gives each task the values as one array.
Beyond IDS, components of at most WHOLE edges are peeled by a worker each, and larger ones go by joins.

The degeneracy order comes from peeling: see peeling().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import BROADCAST_ENTRIES, Rounds, bucketed, canonical, components, cut, new_folder, symmetrise, vertices

#: Rounds between two checkpoints and tests for change.
ROUNDS = 3
#: A component of at most so many edges may be peeled by one worker.
WHOLE = 2_000_000
#: Ids below which every task gets the values of all vertices, 4 bytes each: as much as BROADCAST_ENTRIES rows of two numbers. Neighbours in a row of lists.
IDS, LIST = 4 * BROADCAST_ENTRIES, 1_000_000


def core_numbers(edges: DataFrame) -> DataFrame:
    """(v, core) of every vertex 0..V-1."""
    edges = cut(edges.select("src", "dst"))
    if (lists := _lists(edges)) is not None:
        return _with_all(edges, _valued(edges.sparkSession, "v bigint, core bigint", [_by_lists(lists)]))
    found, rest = _whole(edges)
    found = found.select("v", "core")
    return _with_all(edges, found if rest is None else found.union(_cores(rest)))


def peel(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of undirected edges, each once, with their core numbers and rounds of peeling.

    k grows to the least degree that is left; what has at most k neighbours left goes, all at once, round after round.
    """
    names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat, np.concatenate([flat[len(src) :], flat[: len(src)]])
    b = b[np.argsort(a, kind="stable")]
    left = np.bincount(a, minlength=len(names))
    starts = np.cumsum(left) - left
    n = left.copy()
    core, at = np.zeros(len(names), np.int64), np.zeros(len(names), np.int32)
    rest = np.arange(len(names))
    while len(rest):
        k, turn = int(left[rest].min()), 0
        gone = rest[left[rest] <= k]
        while len(gone):
            turn += 1
            core[gone], at[gone] = k, turn
            m = n[gone]
            near = b[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[gone], m)]
            near = near[at[near] == 0]
            hit, times = np.unique(near, return_counts=True)
            left[hit] -= times
            gone = hit[left[hit] <= k]
        rest = rest[at[rest] == 0]
    return names, core, at


def _whole(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(v, core, round) of the vertices of components of at most WHOLE edges, and the symmetric edges of larger ones, None if there are none.

    Nothing outside a component counts for its cores and rounds, so a worker peels it by itself; small components share a task.
    """
    pairs = cut(canonical(edges))
    comp = cut(components(pairs))
    found = cut(pairs.join(_broadcast_if(comp.count())(comp), pairs["src"] == comp["v"]).select("src", "dst", "comp"))
    size = cut(found.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
    total, largest = size.agg(F.sum("n"), F.max("n")).first()
    tasks = 1 + 2 * (total or 0) // WHOLE
    # a task of its own for what is large
    task = F.when(F.col("n") > WHOLE // 8, F.col("comp")).otherwise(-1 - F.pmod(F.xxhash64("comp"), F.lit(tasks)))
    dealt = found.join(size.where(F.col("n") <= WHOLE).select("comp", task.alias("task")), "comp").select("task", "src", "dst")

    def run(table: pa.Table) -> pa.Table:
        v, core, at = peel(table["src"].to_numpy(), table["dst"].to_numpy())
        return pa.table({"v": v, "core": core, "round": at})

    whole = dealt.groupBy("task").applyInArrow(run, "v bigint, core bigint, round int")
    if not largest or largest <= WHOLE:
        return whole, None
    return whole, cut(symmetrise(found.join(size.where(F.col("n") > WHOLE).select("comp"), "comp", "left_semi")))


def _with_all(edges: DataFrame, found: DataFrame, *more) -> DataFrame:
    return vertices(edges).join(found, "v", "left").select("v", F.coalesce("core", F.lit(0).cast("bigint")).alias("core"), *more)


def _lists(edges: DataFrame) -> DataFrame | None:
    """(v, n, near): neighbour lists of some vertices a row, as bytes of 32-bit numbers: vertices, how many neighbours each has, and these. None where a worker can peel all, or ids go too far."""
    pairs = cut(canonical(edges))
    n, least, top = pairs.agg(F.count(F.lit(1)), F.min("src"), F.max("dst")).first()
    if n <= WHOLE or least < 0 or top >= IDS:
        return None

    def run(table: pa.Table) -> pa.Table:
        src, dst = (table[c].to_numpy().astype("<i4") for c in ("src", "dst"))
        order = np.argsort(src, kind="stable")
        v, times = np.unique(src, return_counts=True)
        return pa.table({c: pa.array([x.astype("<i4").tobytes()], pa.binary()) for c, x in (("v", v), ("n", times), ("near", dst[order]))})

    rows = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-2 * n // LIST))
    both = symmetrise(pairs).select(F.col("src").cast("int"), F.col("dst").cast("int"), F.pmod(F.xxhash64("src"), F.lit(rows)).alias("row"))
    return cut(both.repartition(rows, "row").groupBy("row").applyInArrow(run, "v binary, n binary, near binary"))


def _each(lists: DataFrame, change: Callable, state: list[np.ndarray]) -> int:
    """Run change(vertices, counts, neighbours, state) on every row of lists and put what it returns, (vertices, values), into the last array of state; how many there were. Values alone pass the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x.copy() for x in state]
        for batch in batches:
            for row in zip(*(batch[c] for c in ("v", "n", "near"))):
                found = change(*(np.frombuffer(x.as_buffer(), "<i4") for x in row), own)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in found], names=["v", "to"])

    changed = 0
    for v, to in lists.mapInArrow(run, "v binary, to binary").collect():
        at = np.frombuffer(v, "<i4")
        state[-1][at] = np.frombuffer(to, "<i4")
        changed += len(at)
    return changed


def h_indices(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest h such that h values are h or more, of each of the lists of so many values that follow one another."""
    row, top = np.repeat(np.arange(len(counts)), counts), int(values.max(initial=0)) + 1
    ranked = np.sort(row * top + (top - 1 - values))
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.bincount(row[top - 1 - ranked % top > place], minlength=len(counts))


def _by_lists(lists: DataFrame) -> np.ndarray:
    """The core numbers by id, -1 for ids that have no edge. Values only fall, so a task goes on with those that it has found."""

    def degrees(v: np.ndarray, n: np.ndarray, near: np.ndarray, state: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return v, n

    def fall(v: np.ndarray, n: np.ndarray, near: np.ndarray, state: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        now = state[-1]
        value = now[near]
        enough = np.add.reduceat(value >= np.repeat(now[v], n), np.cumsum(n) - n, dtype=np.int64)
        less = enough < now[v]
        v, new = v[less], h_indices(value[np.repeat(less, n)].astype(np.int64), n[less].astype(np.int64))
        now[v] = new
        return v, new

    state = [np.full(1 + _top(lists), -1, np.int32)]
    _each(lists, degrees, state)
    while _each(lists, fall, state):
        pass
    return state[0]


def _top(lists: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x.as_buffer(), "<i4").max()) for x in batch["v"]], pa.int64())], names=["top"])

    return lists.select("v").mapInArrow(run, "top bigint").agg(F.max("top")).first()[0]


def _rounds_by_lists(lists: DataFrame, core: np.ndarray) -> np.ndarray:
    """The round in which each vertex goes (see peeling()), by id, over lists of those neighbours that count: of a vertex's own core, and still there."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, n, near, *most in zip(*(np_rows(batch, c) for c in batch.schema.names)):
                row = np.repeat(np.arange(len(v)), n)
                of = core[v][row]
                same = (core[near] == of) & (gone[near] == 0)
                # how many of these neighbours a vertex may have to go
                most = most[0] if most else core[v] - np.bincount(row[core[near] > of], minlength=len(v))
                stays = gone[v] == 0
                out = v[stays], np.bincount(row[same], minlength=len(v))[stays], near[same & stays[row]], most[stays]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in out], names=["v", "n", "near", "most"])

    def np_rows(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), "<i4") for x in batch[name]]

    def going(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, n, near, most in zip(*(np_rows(batch, c) for c in ("v", "n", "near", "most"))):
                left = np.bincount(np.repeat(np.arange(len(v)), n)[gone[near] == 0], minlength=len(v))
                yield pa.RecordBatch.from_arrays([pa.array([v[(gone[v] == 0) & (left <= most)].astype("<i4").tobytes()], pa.binary())], names=["v"])

    gone = np.where(core < 0, -1, 0).astype(np.int32)
    rounds, rest, at = Rounds(lists.sparkSession), int((gone == 0).sum()), 0
    written = None
    while rest:
        # written anew when half of the vertices have gone
        if written is None or rest * 2 < written:
            lists, written = rounds.cut(lists.mapInArrow(inner, "v binary, n binary, near binary, most binary")), rest
        at += 1
        found = [np.frombuffer(r[0], "<i4") for r in lists.mapInArrow(going, "v binary").collect()]
        for v in found:
            gone[v] = at
        rest -= sum(map(len, found))
    return gone


def _valued(spark: SparkSession, schema: str, state: list[np.ndarray]) -> DataFrame:
    """A row for each id with a first value of 0 or more, from arrays by id that tasks take slices of."""
    size = len(state[0])
    step = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch["id"].to_pylist():
                v = at * step + np.flatnonzero(state[0][at * step : (at + 1) * step] >= 0)
                table = pa.table([v, *(x[v] for x in state)], names=names).cast(kinds)
                yield from table.to_batches()

    kinds = pa.schema([("v", pa.int64()), ("core", pa.int64()), ("round", pa.int32())][: 1 + len(state)])
    names = kinds.names
    return cut(spark.range(-(-size // step)).mapInArrow(run, schema))


def _cores(both: DataFrame) -> DataFrame:
    """(v, core) of the vertices of symmetric edges.

    Edges lie dealt out by their source, and values are broadcast while they are few: a round then moves no edge.
    """
    rounds = Rounds(both.sparkSession)
    both = bucketed(both, "src")
    now = rounds.cut(both.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("core")))
    side = _broadcast_if(now.count())
    while True:
        new = now.withColumn("old", F.col("core"))
        for _ in range(ROUNDS):
            # neighbours count by value, so a hub's group has at most as many rows as there are values
            at = both.join(side(new), both["dst"] == new["v"]).groupBy("src", "core").agg(F.count(F.lit(1)).alias("n"))
            above = F.sum("n").over(W.partitionBy("src").orderBy(F.desc("core")))
            h = at.withColumn("h", F.least("core", above)).groupBy("src").agg(F.max("h").alias("h"))
            new = new.join(h, new["v"] == h["src"]).select("v", F.least("core", "h").alias("core"), "old")
        new = rounds.cut(new)
        if new.where("core <> old").isEmpty():
            return new.select("v", "core")
        now = new.select("v", "core")


def degeneracy(edges: DataFrame) -> DataFrame:
    """One row (degeneracy): the largest core number."""
    return core_numbers(edges).agg(F.max("core").alias("degeneracy"))


def _broadcast_if(rows: int) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if rows <= BROADCAST_ENTRIES else lambda df: df


def peeling(edges: DataFrame) -> DataFrame:
    """(v, core, round) of every vertex: a vertex goes in the first round in which it has at most `core` neighbours of a higher core, or of its own that are left.

    When lower cores are gone, the vertices of a core of c lose each other alone, so all cores are peeled at once, and
    only edges inside a core matter. A vertex that goes has at most c neighbours left, those that go with it included: any order by
    (core, round) keeps the degeneracy's bound.
    """
    edges = cut(edges.select("src", "dst"))
    if (lists := _lists(edges)) is not None:
        core = _by_lists(lists)
        gone = _valued(edges.sparkSession, "v bigint, core bigint, round int", [core, _rounds_by_lists(lists, core)])
        return _with_all(edges, gone.select("v", "core", "round"), F.coalesce("round", F.lit(1)).alias("round"))
    found, rest = _whole(edges)
    gone = cut(found if rest is None else found.union(_peeled(rest)))
    return _with_all(edges, gone.select("v", "core")).join(gone.select("v", "round"), "v", "left").select("v", "core", F.coalesce("round", F.lit(1)).alias("round"))


def _peeled(both: DataFrame) -> DataFrame:
    """(v, core, round) of the vertices of symmetric edges, by joins."""
    spark = both.sparkSession
    core = cut(_cores(both))
    ends = lambda end, c: core.select(F.col("v").alias(end), F.col("core").alias(c))
    ranked = both.join(ends("src", "cs"), "src").join(ends("dst", "cd"), "dst")
    inner = bucketed(ranked.where("cs = cd").select("src", "dst"), "dst")
    small = _broadcast_if(core.count())
    # how many neighbours too many a vertex still has
    left = ranked.where("cd >= cs").groupBy(F.col("src").alias("v"), F.col("cs").alias("core")).agg((F.count(F.lit(1)) - F.first("cs")).alias("excess"))
    rounds = Rounds(spark)
    left = rounds.cut(left.withColumn("round", F.lit(None).cast("int")))
    path = new_folder(spark, "peeled")
    at = 0
    while not left.isEmpty():
        for _ in range(ROUNDS):
            at += 1
            left = left.withColumn("round", F.coalesce("round", F.when(F.col("excess") <= 0, at)))
            hit = inner.join(small(left.where(F.col("round") == at).select(F.col("v").alias("src"))), "src").groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            left = left.join(small(hit), "v", "left").select("v", "core", (F.col("excess") - F.coalesce("n", F.lit(0))).alias("excess"), "round")
        done = rounds.cut(left)
        # what is gone is written once; only what is left goes on
        done.where("round is not null").select("v", "core", "round").write.mode("append").parquet(path)
        left = done.where("round is null")
    return spark.read.schema("v bigint, core bigint, round int").parquet(path) if at else spark.createDataFrame([], "v bigint, core bigint, round int")


def degeneracy_order(edges: DataFrame) -> DataFrame:
    """(v, rank) by (core, round of peeling, v): no vertex has more later neighbours than the degeneracy.

    Ranks are dealt by ranges: each partition numbers its rows after the sizes
    of the ones before, so no single task holds all vertices.
    """
    return dense_positions(peeling(edges), ["core", "round", "v"]).select("v", F.col("position").alias("rank"))


def later_neighbours(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(v, later): how many neighbours of each vertex come after it in an order (v, rank)."""
    pairs = canonical(edges)
    side = lambda end, r: order.select(F.col("v").alias(end), F.col("rank").alias(r))
    first = pairs.join(side("src", "rs"), "src").join(side("dst", "rd"), "dst").select(F.when(F.col("rs") < F.col("rd"), F.col("src")).otherwise(F.col("dst")).alias("v"))
    n = first.groupBy("v").agg(F.count(F.lit(1)).alias("later"))
    return order.select("v").join(n, "v", "left").select("v", F.coalesce("later", F.lit(0).cast("bigint")).alias("later"))


def dense_positions(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """rows with their place, from 0, in the given order; the order must be total for a fixed result."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # one row a partition
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).select("_part", "_first", "_before")
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")
