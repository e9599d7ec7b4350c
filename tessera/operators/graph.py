"""Edges, vertices, neighbour lists and components.

An edge relation has bigint columns src and dst. Undirected graphs are kept
either canonical (src < dst, each once) or symmetric (both directions).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A neighbour-list side of at most so many entries (8 bytes each) may be broadcast.
BROADCAST_ENTRIES = 2_000_000
#: Edges that a task links at a time.
LINK_EDGES = 1_000_000
#: Rows that deal() gives a task.
TASK_ROWS = 1_000_000
#: Ids may run up to so many times the number of vertices that have edges (and SPARE more) before vertices() asks for dense ones.
SPARSE, SPARE = 64, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df as it now is, written to the shared folder and read from there: its lineage ends, and a plan's statistics don't grow from round to round."""
    return Rounds(df.sparkSession, keep=0).cut(df)


class Rounds:
    """Tables of a loop. Of those that were cut here the last `keep` stay (0: all), as a round reads none older than that."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep, self.paths = spark, keep, []

    def cut(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "cut")
        df.write.parquet(path)
        self.paths.append(path)
        if self.keep and len(self.paths) > self.keep:
            drop_folder(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table dealt out by key, so what groups by it, or by it and more, needs no exchange."""
    spark = df.sparkSession
    name, n = f"dealt_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", new_folder(spark, "dealt")).saveAsTable(name)
    return spark.table(name)


def deal(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df, of about so many rows, dealt by keys into tasks of TASK_ROWS rows: tasks grow in number and not in size, as a number that is given isn't merged again."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


class Levels:
    """A relation that grows level by level: each level is a folder of its own, written once, and no row is written again."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.paths, self.rows = spark, schema, [], 0
        self.path = new_folder(spark, "levels")

    def add(self, df: DataFrame) -> int:
        """Write the next level; how many rows it has."""
        seen = Observation()
        self.paths.append(f"{self.path}/{len(self.paths)}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.paths[-1])
        self.rows += seen.get["n"]
        return seen.get["n"]

    def last(self, n: int | None = None) -> DataFrame:
        """The last n levels, or all."""
        return self.spark.read.schema(self.schema).parquet(*(self.paths[-n:] if n else self.paths))


def is_symmetric(arcs: DataFrame) -> bool:
    """Whether every arc (each once) has its reverse."""
    return arcs.join(reverse(arcs), ["src", "dst"], "left_anti").isEmpty()


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def deduplicate(edges: DataFrame) -> DataFrame:
    """Directed edges without self-loops, each once."""
    return no_loops(edges).select("src", "dst").distinct()


def canonical(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Undirected edges as src < dst, each once, without self-loops. rows: how many edges there are, where that is known; they are then dealt first."""
    found = no_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (found if rows is None else deal(found, rows, "src", "dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; a bag, as it comes."""
    return edges.select("src", "dst").union(reverse(edges))


def orient(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward (src < dst) and backward (src > dst) edges."""
    return edges.where("src < dst"), edges.where("src > dst")


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def vertices(edges: DataFrame) -> DataFrame:
    """(v): 0 to the largest id, so gaps are vertices without edges; none of an empty relation.

    Ids must be dense: where the largest is far beyond the number of vertices with edges, or one is negative, the ids are an error
    (operators.ids has densify_first_seen and densify_sorted).
    """
    # one look at the edges, which may be a plan that is dear to run
    return _up_to(edges.sparkSession, *edges.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.min("v"), F.max("v"), F.approx_count_distinct("v")).first())


def _up_to(spark: SparkSession, least: int | None, top: int | None, n: int) -> DataFrame:
    """(v): 0 to the largest id; n: how many vertices have edges."""
    if top is None:
        return spark.range(0).toDF("v")
    if least < 0 or top > SPARSE * n + SPARE:
        raise ValueError(f"ids from {least} to {top} aren't dense: number the vertices first")
    return spark.range(0, top + 1).toDF("v")


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, nbrs): ascending distinct targets of each source."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))


def adjacency_both(edges: DataFrame) -> DataFrame:
    """(v, out_nbrs, in_nbrs) of every vertex with edges, as bags: nothing is dropped."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("out_nbrs"))
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.sort_array(F.collect_list("src")).alias("in_nbrs"))
    none = F.array().cast("array<bigint>")
    return out.join(into, "v", "full").select("v", F.coalesce("out_nbrs", none).alias("out_nbrs"), F.coalesce("in_nbrs", none).alias("in_nbrs"))


def degrees(edges: DataFrame, every: bool = True) -> DataFrame:
    """(v, out_deg, in_deg, deg) counting the bag as it is; every=True adds vertices without edges. Edges are run through once: with every=True, now."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    found = ends.groupBy("v").agg(F.sum("o").alias("out_deg"), F.sum(1 - F.col("o")).alias("in_deg"))
    if every:
        found = with_gaps(found)
    return found.withColumn("deg", F.col("out_deg") + F.col("in_deg"))


def with_gaps(found: DataFrame) -> DataFrame:
    """A row a vertex with edges, (v, numbers), and rows of zeros for the other vertices of vertices()."""
    found = cut(found)
    every = _up_to(found.sparkSession, *found.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first())
    return cut(every.join(found, "v", "left").select("v", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in found.columns if c != "v"]))


def degree_oriented(edges: DataFrame) -> DataFrame:
    """Canonical edges turned from the end of lower (degree, id) to the higher one.

    No vertex then has more than about sqrt(2 E) targets, however large a hub is.
    """
    deg = degrees(edges, every=False).select("v", "deg")
    # every row keeps its edge; only two numbers a vertex are joined to it
    e = edges.join(deg.withColumnsRenamed({"v": "src", "deg": "ds"}), "src").join(deg.withColumnsRenamed({"v": "dst", "deg": "dd"}), "dst")
    first = F.struct("ds", "src") < F.struct("dd", "dst")
    return e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def least_labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of edges, ascending, and the least one that each is linked with."""
    names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = flat[: len(src)], flat[len(src) :]
    label = np.arange(len(names))
    while len(s):
        a, b = label[s], label[d]
        open_ = a != b
        s, d, a, b = s[open_], d[open_], a[open_], b[open_]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(up := label[label], label):
            label = up
    return names, names[label]


def forests(edges: DataFrame) -> DataFrame:
    """(src, dst): fewer edges that link the same vertices. Ranges of ids are linked by themselves; what is left is a vertex and the least one it is linked with there."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more: list[pa.RecordBatch] = []

        def linked() -> tuple[np.ndarray, np.ndarray]:
            v, least = least_labels(*(np.concatenate([x, *(b[c].to_numpy() for b in more)]) for x, c in ((src, "src"), (dst, "dst"))))
            return v[v != least], least[v != least]

        for batch in batches:
            more.append(batch)
            if sum(b.num_rows for b in more) >= LINK_EDGES:
                src, dst = linked()
                more = []
        src, dst = linked()
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartitionByRange(n, "src").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).mapInArrow(link, "src bigint, dst bigint")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the least vertex reachable over undirected edges, for vertices with edges.

    Ranges of ids are linked by themselves first, which leaves some edges a vertex. A round then takes the least label among
    the neighbours, then that label's own
    label; labels jump, so rounds grow with the logarithm of the longest path.
    """
    both = cut(symmetrise(forests(cut(no_loops(edges).select("src", "dst")))))
    rounds = Rounds(edges.sparkSession)
    comp = rounds.cut(both.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m")).select("v", F.least("v", "m").alias("comp")))
    while True:
        near = both.join(comp, both["dst"] == comp["v"]).groupBy("src").agg(F.min("comp").alias("m"))
        step = comp.join(near, comp["v"] == near["src"]).select("v", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = step.select(F.col("v").alias("at"), F.col("comp").alias("to"))
        new = rounds.cut(step.join(jump, step["comp"] == jump["at"]).select("v", F.least("comp", "to").alias("comp"), "old"))
        if new.where("comp <> old").isEmpty():
            return new.select("v", "comp")
        comp = new.select("v", "comp")
