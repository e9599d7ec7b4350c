"""What several training-data operators need: the shared folder, row keys, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a lookup side may have to be broadcast; beyond it operators go block by block.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: spark.checkpoint.dir.

    Only where that setting is absent and everything runs on one machine
    (tests) a temporary folder is made and set as the checkpoint folder; a
    cluster without the setting is an error, as its executors couldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder: lineage ends and lost executors cost nothing."""
    spark = df.sparkSession
    base = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids have none."""
    return F.crc32(doc_id.cast("string")) % n


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label), one row an id: repeated ids keep their smallest non-null label."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias(label))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return unused memory to the system: workers live on from stage to stage, and what they hold back adds up in an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library of another make
        ctypes.CDLL(None).malloc_trim(0)


def arrow_slices(*columns: pa.Array, size: int = 1 << 19) -> Iterator[tuple[pa.Array, ...]]:
    """Successive rows of equally long columns, about `size` bytes of strings and binaries at a time; a longer row comes alone."""
    n = len(columns[0])
    sized = [c for c in columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sized)) if n else []
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield tuple(c.slice(at, to - at) for c in columns)
        at = to
    give_back()


def slices(*columns: pa.Array, size: int = 1 << 19) -> Iterator[tuple[list, ...]]:
    """The same as Python lists. A batch from Spark may hold thousands of long rows; Python objects then exist for a slice of it alone."""
    for group in arrow_slices(*columns, size=size):
        yield tuple(c.to_pylist() for c in group)


class TwoTurns:
    """A table of at most `limit` entries from bytes or text to what `learn` makes of a list of keys; what was used in the last turn is kept into the next."""

    def __init__(self, limit: int, learn: Callable[[list], list]):
        self.half, self.learn, self.now, self.old = max(1, limit // 2), learn, {}, {}

    def __len__(self) -> int:
        return len(self.now) + len(self.old)

    def clear(self) -> None:
        self.now, self.old = {}, {}

    def look_up(self, keys: list) -> list:
        """A value for each of the (distinct) keys."""
        out = list(map(self.now.get, keys))
        missing = [k for k, v in zip(keys, out) if v is None]
        if not missing:
            return out
        if len(self.now) + len(missing) > self.half:
            self.old, self.now = self.now, {}
            missing = keys
        known = list(map(self.old.get, missing))
        new = [k for k, v in zip(missing, known) if v is None]
        self.now.update((k, v) for k, v in zip(missing, known) if v is not None)
        self.now.update(zip(new, self.learn(new)))
        out = list(map(self.now.__getitem__, keys))
        if len(self.now) > self.half:  # a turn with more keys than that leaves nothing
            self.now, self.old = {}, {}
        return out


def spread(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian 32-bit integers of ids[at[0]], ids[at[1]], ... in a row, and where each ends (first a 0)."""
    if not len(at):
        return np.empty(0, "<i4"), np.zeros(1, np.int64)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    flat = lists.take(pa.array(at)).flatten().to_numpy()
    return flat, np.concatenate([[0], np.cumsum(sizes[at])])


def distinct(words: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct values as Python objects, and each word's place among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
