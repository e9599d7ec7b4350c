"""Merkle manifest of a table: digests of its rows, a tree for each group, a tree of the groups.

A leaf is the SHA-256 of a row's fields. Within a group leaves ascend by id, and
every FANOUT consecutive nodes become the digest of their concatenated hex
text, level by level, while several remain; the groups' roots, in the
groups' order, likewise give the manifest's root.

The tree is built in rounds over aligned blocks of FANOUT**depth nodes, wherever
these lie: a block is a contiguous numpy matrix of 64-byte hex digests, reshaped by the
fanout and hashed row by row, and yields one node for the next round. Proofs come the other
way: a block of a round gets its own node's path from the round above, and every
sibling below is found by index arithmetic. So no task sees more than a block,
and nothing but row counts reaches the driver.

Defined cases: null fields have a mark of their own, and a null group is the first one; null ids come first
in their group, rows of equal id by leaf, and repeated rows are leaves of their own;
an empty table has no rows and no root; a group of one leaf has it as its root, a
manifest of one group has that group's; texts are digested whole whatever their
length; other columns aren't looked at, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._shared import BROADCAST_ROWS, new_folder

FANOUT = 8
#: Levels of a block, which has FANOUT**LEVELS nodes where no other depth is given.
LEVELS = 4
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields as binary: each `-` if null, else its UTF-8 bytes' count, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown]), 256))


def _stored(rows: DataFrame, what: str) -> DataFrame:
    path = new_folder(rows.sparkSession, f"merkle-{what}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def number_rows(rows: DataFrame, order: list[str], path: str = "ranked") -> DataFrame:
    """rows (group, ...) with pos, their place from 0 in their group by `order`; no window sees more than one row a partition and group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_tsr_tie", F.monotonically_increasing_id())  # rows that are alike may be any number
    by = ["group", *order, "_tsr_tie"]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_tsr_part", F.spark_partition_id()).withColumn("_tsr_row", F.monotonically_increasing_id())
    dealt = _stored(dealt, path)
    sizes = dealt.groupBy("_tsr_part", "group").agg(F.count(F.lit(1)).alias("n"), F.min("_tsr_row").alias("_tsr_first"))
    before = sizes.withColumn("_tsr_before", F.sum("n").over(W.partitionBy("group").orderBy("_tsr_part")) - F.col("n")).select("_tsr_part", "group", "_tsr_first", "_tsr_before")
    side = F.broadcast(before) if sizes.count() <= BROADCAST_ROWS else before
    return dealt.join(side, ["_tsr_part", "group"]).withColumn("pos", F.col("_tsr_before") + F.col("_tsr_row") - F.col("_tsr_first")).drop("_tsr_part", "_tsr_row", "_tsr_first", "_tsr_before", "_tsr_tie")


def block_levels(digests: list[bytes], block: int, depth: int = LEVELS) -> list[bytes]:
    """Hex texts of a block's levels, from its nodes up. The first block of a group that isn't full is the group's only one: it ends where one node remains."""
    text = b"".join(digests).hex().encode()
    whole = block > 0 or len(digests) >= FANOUT**depth
    out = [text]
    while len(out) <= depth if whole else len(out[-1]) > HEX:
        matrix = np.frombuffer(out[-1], np.uint8).reshape(-1, HEX)
        full = len(matrix) // FANOUT
        rows = matrix[: full * FANOUT].reshape(full, FANOUT * HEX)
        hashed = [hashlib.sha256(r).hexdigest() for r in rows]
        if full * FANOUT < len(matrix):
            hashed.append(hashlib.sha256(matrix[full * FANOUT :].tobytes()).hexdigest())
        out.append("".join(hashed).encode())
    return out


def siblings(levels: list[bytes], i: int) -> list[tuple[bytes, bytes]]:
    """For a block's node i: of each level what stands left and right of its ancestor in its run."""
    out = []
    for text in levels[:-1]:
        run, slot = divmod(i, FANOUT)
        at = run * FANOUT * HEX
        out.append((text[at : at + slot * HEX], text[at + (slot + 1) * HEX : at + FANOUT * HEX]))
        i = run
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node (hex) has by its path."""
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pa.compute.sort_indices(table["pos"]))


def _block(depth: int) -> Column:
    return F.floor(F.col("pos") / FANOUT**depth).cast("bigint").alias("block")


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(group, pos, digest): a node a block."""

    def top(key: tuple, table: pa.Table) -> pa.Table:
        last = block_levels(_ordered(table)["digest"].to_pylist(), key[1].as_py(), depth)[-1]
        return pa.table({"group": pa.array([key[0].as_py()]), "pos": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array([bytes.fromhex(last.decode())], pa.binary())})

    return nodes.select("group", "pos", "digest").groupBy("group", _block(depth)).applyInArrow(top, "group string, pos bigint, digest binary")


def rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """nodes (group, pos, digest), the nodes of each further round, and in the end one a group."""
    out = [nodes]
    while len(out) == 1 or not out[-1].where("pos > 0").isEmpty():
        out.append(_stored(_tops(out[-1], depth), f"round{len(out)}"))
    return out


_PATH = "path array<struct<left: string, right: string>>"


def _below(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(group, pos, path, subroot, root) of a round's nodes, from the same of the round above."""

    def down(key: tuple, own: pa.Table, upper: pa.Table) -> pa.Table:
        own = _ordered(own)
        levels = block_levels(own["digest"].to_pylist(), key[1].as_py(), depth)
        up = upper.to_pylist()[0]
        paths = [[{"left": a.decode(), "right": b.decode()} for a, b in siblings(levels, i)] + up["path"] for i in range(own.num_rows)]
        return pa.table({"group": own["group"], "pos": own["pos"], "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), "subroot": pa.array([up["subroot"]] * own.num_rows, pa.string()), "root": pa.array([up["root"]] * own.num_rows, pa.string())})

    return nodes.select("group", "pos", "digest").groupBy("group", _block(depth)).cogroup(above.groupBy("group", "pos")).applyInArrow(down, f"group string, pos bigint, {_PATH}, subroot string, root string")


@dataclass
class Manifest:
    """levels[0]: the leaves (group, pos, digest, doc_id, claimed); further rounds' nodes after it. groups: (group, pos, subroot). top: the rounds above the groups."""

    levels: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    depth: int

    def root(self) -> DataFrame:
        """(root), one row; none of an empty table."""
        return self.top[-1].select(F.lower(F.hex("digest")).alias("root"))

    def subroots(self) -> DataFrame:
        """(group, subroot), group null for the rows whose group is null."""
        return self.groups.select(F.when(F.col("group") != "0", F.expr("substring(group, 2)")).alias("group"), "subroot")

    def block_paths(self) -> DataFrame:
        """(group, pos, path, subroot, root): the path of each block of leaves from its node to the root."""
        above = self.top[-1].select("group", "pos", F.array().cast(_PATH[5:]).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        for nodes in self.top[-2::-1]:
            above = _below(nodes, above, self.depth)
        # a row a group
        above = above.select(F.col("pos").alias("place"), "path", "root").join(self.groups, "place").select("group", F.lit(0).cast("bigint").alias("pos"), "path", "subroot", "root")
        for nodes in self.levels[-2:0:-1]:
            above = _below(nodes, above, self.depth)
        return above

    def audit(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf; folded_root comes from its claimed digest, or from its own where none is claimed."""

        depth = self.depth

        def check(key: tuple, own: pa.Table, upper: pa.Table) -> pa.Table:
            own = _ordered(own)
            levels = block_levels(own["digest"].to_pylist(), key[1].as_py(), depth)
            up = upper.to_pylist()[0]
            path = [(p["left"].encode(), p["right"].encode()) for p in up["path"]]
            rest = b"".join(a + b for a, b in path)
            proofs, folded, leaves = [], [], []
            for i, claimed in enumerate(own["claimed"].to_pylist()):
                own_path = siblings(levels, i)
                node = levels[0][i * HEX : (i + 1) * HEX]
                leaves.append(node.decode())
                proofs.append(hashlib.sha256(b"".join([x for pair in own_path for x in pair] + [rest])).hexdigest())
                folded.append(fold(fold(claimed.hex().encode() if claimed else node, own_path), path).decode())
            same = lambda x: pa.array([x] * own.num_rows, pa.string())
            return pa.table({"doc_id": own["doc_id"], "leaf": leaves, "subroot": same(up["subroot"]), "root": same(up["root"]), "proof_sha256": proofs, "folded_root": folded, "verified": pa.array([f == up["root"] for f in folded], pa.bool_())})

        leaves = self.levels[0].select("group", "pos", "digest", "doc_id", "claimed").groupBy("group", _block(depth))
        return leaves.cogroup(self.block_paths().groupBy("group", "pos")).applyInArrow(check, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, by: str = "lang", claimed: Column | None = None, depth: int = LEVELS) -> Manifest:
    """The manifest of docs (FIELDS) with a tree for each value of `by`, in rounds of `depth` levels. claimed: a binary digest that audit() takes for a row's leaf, null where it takes the leaf itself."""
    group = F.coalesce(F.concat(F.lit("1"), F.col(by).cast("string")), F.lit("0"))  # in the order of the values' bytes, null first
    rows = docs.select(group.alias("group"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(*[F.col(c) for c in FIELDS]).alias("digest"), (F.lit(None) if claimed is None else claimed).cast("binary").alias("claimed"))
    # stored before it is dealt out: ranges are found by a pass of their own, which would digest every text again
    leaves = number_rows(_stored(rows, "leaves"), ["doc_id", "digest"])
    levels = rounds(leaves, depth)
    subroots = levels[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    ranked = number_rows(subroots, ["name"], "groups")
    groups = ranked.select(F.col("name").alias("group"), F.col("pos").alias("place"), F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(levels, groups, rounds(ranked.select("group", "pos", "digest"), depth), depth)
