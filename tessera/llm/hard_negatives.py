"""Hard negatives by blocked dense products.

Anchors are the rows whose id is divisible by EVERY. They are taken in groups
of at most ANCHORS rows of at most ANCHOR_BYTES, dealt by a hash, and a group is broadcast as a matrix: that bound, not the data,
is the size of a broadcast. Candidates stay where they are: each task multiplies its
blocks with the group's blocks in float64 and keeps, for every
anchor, the best `positives` rows of its label; these lists merge, so a task's
are ranked with the other tasks' by a window that prunes before it shuffles. A second
pass, with the anchors' positives known, keeps the best `negatives` rows of other labels inside each
positive's window of scores in the same way.

Components are floor(256 x), so scores are integers. Where
dimensions times the largest components could reach 2**53, float64 isn't exact, and that
block's products are taken in Python integers; a score that needs more than 64 bits is an error.

Defined cases: rows with a null id, label or vector, or a component that is null or not finite,
take no part; an anchor meets rows of its own dimension alone; repeated rows are rows of their own: a repeated
anchor is returned as often as it comes, and its copies are other rows to it; ties go by smaller id; an
anchor without positives, or a positive without negatives, has no rows; empty tables have none; other columns aren't looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._shared import new_folder

EVERY = 100
#: Anchors of one broadcast, and bytes of their components as float64.
ANCHORS, ANCHOR_BYTES = 65_536, 64 << 20
#: Rows of a block of anchors and of a block of candidates.
ANCHOR_BLOCK, BLOCK = 512, 2_048
EXACT = 1 << 53


def vectors(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def shifted_label() -> Column:
    """The label, of rows whose id is divisible by 7 the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of a batch's rows, up to `size` rows of one dimension at a time, ids ascending."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    lists = batch.column(2)
    flat = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = pc.list_value_length(lists).to_numpy()
    begins = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        own = own[np.argsort(ids[own], kind="stable")]
        for at in range(0, len(own), size):
            part = own[at : at + size]
            yield ids[part], labels[part], flat[begins[part][:, None] + np.arange(d)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and of b, as float64 where that is exact, else as Python integers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    out = whole(a) @ whole(b).T
    if any(not -(1 << 63) <= x < 1 << 63 for x in out.flat):
        raise ValueError("a score needs more than 64 bits")
    return out


class Best:
    """For each of n keys the best `keep` of what was added: larger scores first, ties by smaller id."""

    def __init__(self, n: int, keep: int):
        self.n, self.keep = n, keep
        self.key, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        #: A new row must reach this score to matter.
        self.least = np.full(n, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, key))  # ~x orders as -x does and can't overflow
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, key)
        rank = np.arange(len(key)) - first
        held = rank < self.keep
        full = rank == self.keep - 1
        # rounded down, as float64 may lie above an integer beyond 2**53
        self.least[key[full]] = np.nextafter(score[full].astype(np.float64), -np.inf) if np.abs(score).max() >= EXACT else score[full]
        self.key, self.score, self.id = key[held], score[held], ids[held]


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where mask holds."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Anchors:
    """A group of anchors by dimension: places in the group, ids, labels, components."""

    def __init__(self, table: pa.Table):
        self.count = table.num_rows
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(self.count)), table["label"].combine_chunks(), table["embedding"].combine_chunks()], ["vec_id", "label", "embedding"]) if self.count else None
        self.ids = table["vec_id"].to_numpy().astype(np.int64)
        self.parts: dict[int, list] = {}
        for place, labels, x in blocks(numbered, ANCHOR_BLOCK) if numbered else ():
            self.parts.setdefault(x.shape[1], []).append((place, labels, x))
        self.own = np.zeros(self.count, np.int64)
        for place, _, x in (p for parts in self.parts.values() for p in parts):
            self.own[place] = [products(r[None], r[None])[0, 0] for r in x]


def _group_rows(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.score), pa.array(best.id)], ["key", "score", "id"])


_FOUND = "key bigint, score bigint, id bigint"


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """found with rank, the best `keep` of each key over all tasks: Spark keeps a task's best before it shuffles."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep)


def _positives(rows: DataFrame, group, keep: int) -> DataFrame:
    """(key, score, id, rank): the best rows of each anchor's label, itself among them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = group.value
        best = Best(anchors.count, keep)
        for batch in batches:
            for ids, labels, x in blocks(batch, BLOCK):
                for place, own, a in anchors.parts.get(x.shape[1], ()):
                    s = products(a, x)
                    i, j = _hits((s >= best.least[place][:, None]) & (own[:, None] == labels))
                    best.add(place[i], s[i, j], ids[j])
        yield _group_rows(best)

    return _merged(rows.mapInArrow(task, _FOUND), keep)


def _negatives(rows: DataFrame, group, bounds, keep: int) -> DataFrame:
    """(key, score, id, rank): for each pair of an anchor and a positive the best rows of other labels inside the pair's bounds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (least, most, pair) = group.value, bounds.value
        best = Best(int(pair.max(initial=-1)) + 1, keep)
        # float64 may round a bound beyond 2**53, so a sieve is one step wider and integers decide
        wider = lambda x, to: np.where(np.abs(x) < EXACT, x, np.nextafter(x.astype(np.float64), to))
        floor, ceiling = wider(least, -np.inf), wider(most, np.inf)
        for batch in batches:
            for ids, labels, x in blocks(batch, BLOCK):
                for place, own, a in anchors.parts.get(x.shape[1], ()):
                    s = products(a, x)
                    for k in range(pair.shape[1]):
                        has = np.flatnonzero(pair[place, k] >= 0)
                        at, which = place[has], pair[place[has], k]
                        some = s if len(has) == len(place) else s[has]
                        i, j = _hits((some <= ceiling[at, k][:, None]) & (some >= np.maximum(floor[at, k], best.least[which])[:, None]))
                        score = some[i, j].astype(np.int64)
                        real = (own[has[i]] != labels[j]) & (score >= least[at[i], k]) & (score <= most[at[i], k])
                        best.add(which[i[real]], score[real], ids[j[real]])
        yield _group_rows(best)

    return _merged(rows.mapInArrow(task, _FOUND), keep)


def _bounds(found: list, n: int, keep: int, window: tuple[int, int, int]) -> tuple[list, tuple]:
    """The pairs (anchor's place, id, score), and for each anchor and rank the least and most score of a negative and the pair's place (-1: none)."""
    low, of, high = window
    least, most, pair = np.full((n, keep), 1), np.full((n, keep), 0), np.full((n, keep), -1)
    pairs = []
    for place, rank, i, p in found:
        pair[place, rank], least[place, rank], most[place, rank] = len(pairs), -(-low * p // of), high * p // of
        pairs.append((place, i, p))
    return pairs, (least, most, pair)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 100, 90), every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(). Each group of anchors is two passes over the rows; its results are written under the shared folder."""
    spark = rows.sparkSession
    # copies of an anchor have the same results: one of them is asked for, and its rows come as often as it did
    wanted = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    count, widest = wanted.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    limit = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(1, widest or 1))))
    groups = -(-count // limit)
    of = lambda n: F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(n))
    while groups > 1 and wanted.groupBy(of(groups).alias("g")).count().agg(F.max("count")).first()[0] > limit:
        groups += -(-groups // 4)
    path = new_folder(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for g in range(groups):
        table = wanted.where(of(groups) == g).toArrow()
        if table.num_rows:
            _mine_group(rows, table, positives, negatives, window).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _mine_group(rows: DataFrame, table: pa.Table, positives: int, negatives: int, window: tuple[int, int, int]) -> DataFrame:
    spark = rows.sparkSession
    anchors, copies = Anchors(table), table["copies"].to_pylist()
    group = spark.sparkContext.broadcast(anchors)
    # one more than wanted, as an anchor finds itself
    found: dict[int, list] = {}
    for r in sorted(_positives(rows, group, positives + 1).toArrow().to_pylist(), key=lambda r: (r["key"], r["rank"])):
        found.setdefault(r["key"], []).append((r["id"], r["score"]))
    kept = []
    for place, own in found.items():
        itself = (int(anchors.ids[place]), int(anchors.own[place]))
        if itself in own:
            own.remove(itself)
        kept += [(place, rank, i, p) for rank, (i, p) in enumerate(own[:positives])]
    pairs, bounds = _bounds(kept, anchors.count, positives, window)
    found_negatives = _negatives(rows, group, spark.sparkContext.broadcast(bounds), negatives)
    columns = {"key": range(len(pairs)), "anchor_id": [int(anchors.ids[p]) for p, _, _ in pairs], "positive_id": [i for _, i, _ in pairs], "positive_score": [p for _, _, p in pairs], "copies": [copies[p] for p, _, _ in pairs]}
    names = spark.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()}))
    # at most `positives` rows an anchor of the group
    out = found_negatives.join(F.broadcast(names), "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
