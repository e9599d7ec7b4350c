"""Readers and writers of graph text files.

Edge lists hold `u<sep>v` lines. mode="sane" (default) parts columns at any
white space and skips blank lines and lines that start with # or %; a line that
doesn't start with two numbers is no edge, and malformed_lines() has it. mode="strict" reads as the classic parser does: only # lines are skipped, the
separator is exactly one character, missing numbers are 0.

The order of lines is that of file names, then of the places in a file, however many tasks read them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Two numbers with white space between, and nothing else but more columns.
_EDGE = r"^\s*(\d+)\s+(\d+)(?:\s|$)"
#: Bytes of pattern files that are read.
PATTERN_BYTES = 64 << 20


def _numbers(value, pattern: str, names: tuple[str, str]) -> list:
    return [F.regexp_extract(value, pattern, i).try_cast("bigint").alias(n) for i, n in enumerate(names, 1)]


def _skipped(value):
    return F.trim(value).rlike(r"^([#%]|$)")


def parse_edges(lines: DataFrame, mode: str = "sane") -> DataFrame:
    """(src, dst) of a DataFrame of lines (value)."""
    value = F.col("value")
    if mode == "strict":
        return lines.where(~value.startswith("#")).select(*_numbers(value, r"^(\d*)(?:.(\d*))?", ("src", "dst"))).na.fill(0, ["src", "dst"])
    if mode != "sane":
        raise ValueError(f"mode must be sane or strict, not {mode!r}")
    return lines.where(~_skipped(value) & value.rlike(_EDGE)).select(*_numbers(value, _EDGE, ("src", "dst"))).where("src is not null and dst is not null")


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Lines (with all their columns) that aren't skipped and yet no edge: they don't start with two numbers of 64 bits."""
    value = F.col("value")
    whole = [F.regexp_extract(value, _EDGE, i).try_cast("bigint").isNotNull() for i in (1, 2)]
    return lines.where(~_skipped(value) & ~(value.rlike(_EDGE) & whole[0] & whole[1]))


def read_edges(spark: SparkSession, path: str, mode: str = "sane") -> DataFrame:
    return parse_edges(spark.read.text(path), mode)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line): a file is read in blocks, each by one task from its first line to its last, so (file, block, line) is the order of the lines."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_raw_edges(spark: SparkSession, path: str) -> DataFrame:
    """(raw_src, raw_dst, file, block, line) with ids as text, in the order of (file, block, line). # and % lines, blank ones and those of one word are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = read_lines(spark, path).where(~_skipped(F.col("value")))
    return lines.select(F.get(parts, F.lit(0)).alias("raw_src"), F.get(parts, F.lit(1)).alias("raw_dst"), "file", "block", "line").where(F.col("raw_dst").isNotNull())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(org_id, new_id) of an id mapping or vertex order file."""
    return parse_edges(spark.read.text(path)).select(F.col("src").alias("org_id"), F.col("dst").alias("new_id"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, label); the vertex column counts, not the line's place."""
    return parse_edges(spark.read.text(path)).select(F.col("src").alias("vertex"), F.col("dst").alias("label"))


@dataclass(frozen=True)
class Pattern:
    """A small labelled undirected graph: labels by query vertex, and edges as (u, v), u <= v."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...] = field(default=())

    def __post_init__(self):
        edges = tuple(sorted({(min(e), max(e)) for e in self.edges if e[0] != e[1]}))
        if any(not 0 <= x < len(self.labels) for e in edges for x in e):
            raise ValueError("an edge names a vertex that has no label")
        object.__setattr__(self, "edges", edges)

    def neighbours(self, u: int) -> set[int]:
        return {a + b - u for a, b in self.edges if u in (a, b)}

    def echo(self) -> str:
        """The pattern as it is logged: counts, labels, then a line an edge."""
        lines = [f"query: v_num={len(self.labels)} e_num={len(self.edges)}", "".join(f"{x} " for x in self.labels), *(f"{a} {b}" for a, b in self.edges)]
        return "".join(f"{x}\n" for x in lines)

    def block(self) -> str:
        """The pattern as a block of a pattern file."""
        return "".join(f"{x}\n" for x in (f"{len(self.labels)} {len(self.edges)}", *self.labels, *(f"{a} {b}" for a, b in self.edges)))


def parse_patterns(text: str) -> list[Pattern]:
    """Blocks of `v_num e_num`, v_num labels, e_num edges `u v`."""
    numbers = iter(map(int, text.split()))
    out = []
    for v_num in numbers:
        e_num = next(numbers)
        labels = tuple(next(numbers) for _ in range(v_num))
        out.append(Pattern(labels, tuple((next(numbers), next(numbers)) for _ in range(e_num))))
    return out


def read_patterns(spark: SparkSession, path: str) -> list[Pattern]:
    """Pattern files are small by nature: one query a block. More than PATTERN_BYTES of them are an error."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > PATTERN_BYTES:
        raise ValueError(f"{path} has {size} bytes of patterns; {PATTERN_BYTES} is the limit")
    return parse_patterns("\n".join(r[0] for r in spark.read.text(path, wholetext=True).orderBy("_metadata.file_path").collect()))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "dst").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    write_lines(edge_lines(edges), path)


def write_ids(ids: DataFrame, path: str) -> None:
    """`org new` lines, org ascending."""
    write_lines(ids.orderBy("org_id").select(F.concat_ws(" ", "org_id", "new_id").alias("value")), path)


def clique_lines(cliques: DataFrame, braces: bool = False) -> DataFrame:
    """One line a clique: `1 2 3`, or `{1,2,3}` with braces."""
    c = F.array_sort("clique").cast("array<string>")
    return cliques.select((F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}")) if braces else F.array_join(c, " ")).alias("value"))


def write_cliques(cliques: DataFrame, path: str, braces: bool = False) -> None:
    write_lines(clique_lines(cliques, braces), path)


def write_match_counts(counts: DataFrame, path: str) -> None:
    """`ans0=12` lines of (query_id, n)."""
    write_lines(counts.orderBy("query_id").select(F.concat(F.lit("ans"), F.col("query_id").cast("string"), F.lit("="), F.col("n").cast("string")).alias("value")), path)


def output_name(path: str, order: str, ids: bool = False) -> str:
    """graph.txt -> graph_GRO.txt, and graph_GRO_newID.txt for the mapping."""
    stem, ext = os.path.splitext(path)
    return f"{stem}_{order}{'_newID' if ids else ''}{ext or '.txt'}"
