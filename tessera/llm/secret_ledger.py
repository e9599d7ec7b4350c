"""Secret scans with an incremental blob ledger, with DataFrame functions alone.

Texts are blobs addressed by their SHA-256. The ledger, Parquet under one
folder, lists the (blob, rule, version) pairs that were scanned and what was
found. A run hashes every text, takes the pairs that the ledger lacks, scans
one copy of each such blob by just those rules, appends findings and pairs (in
that order, so a run that breaks off is scanned again, not forgotten), and
joins the findings of the current rule versions to every path with that blob.

Places come from what lies between matches: split() by the pattern gives the
gaps, regexp_extract_all() the matches, and running sums of their lengths the
starts and ends, in code points.

Defined cases: null is the empty text; equal texts share a blob whatever their
ids, null ids too; repeated rows get equal results; texts are scanned whole
whatever their length; of spans with one start the kind that comes first in the
rules is first; an empty table writes an empty ledger; other columns aren't
looked at, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._shared import BROADCAST_ROWS, cut


@dataclass(frozen=True)
class Rule:
    """pattern finds matches; those whose `group` has under `least` characters drop out. A changed rule needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds in their order, then further ones. The least lengths of access and hex stand in
#: the pattern: both match whole runs, so that finds the same spans and no short ones.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")

_SEEN = "blob string, kind string, version int"
_FOUND = "blob string, kind string, version int, start int, end int"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _pieces(text: Column, rule: Rule) -> Column:
    """Array of (kind, version, i, gap, size, held): match i, the characters before it since the last one, its own, and its group's."""
    p = F.lit(rule.pattern)
    gaps, found, held = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    rows = F.transform(F.arrays_zip(found.alias("m"), held.alias("g"), F.slice(gaps, 1, F.size(found)).alias("gap")), lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["g"]).alias("held")))
    return F.when(text.rlike(rule.pattern), rows)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, start, end) of blobs (blob, text, kinds): each text by the rules that kinds names."""
    none = F.array().cast("array<struct<kind:string,version:int,i:int,gap:int,size:int,held:int>>")
    each = [F.coalesce(F.when(F.array_contains("kinds", r.kind), _pieces(F.col("text"), r)), none) for r in rules]
    rows = blobs.select("blob", F.explode_outer(F.concat(*each)).alias("x")).where(F.col("x").isNotNull()).select("blob", "x.*").distinct()  # a blob that came twice counts once
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("blob", "kind").orderBy("i"))
    out = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    return out.where(F.col("held") >= F.element_at(least, F.col("kind"))).select("blob", "kind", "version", "start", "end")


def update_ledger(docs: DataFrame, paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger lacks of docs (doc_id, text); paths: (doc_id, blob) of the same rows. Returns the number of blobs scanned."""
    spark = docs.sparkSession
    todo = paths.groupBy("blob").agg(F.min("doc_id").alias("owner"))
    todo = todo.select("blob", "owner", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")).select("blob", "owner", "r.kind", "r.version")
    seen = _ledger(spark, f"{ledger}/seen", _SEEN)
    if seen is not None:
        todo = todo.join(seen, ["blob", "kind", "version"], "left_anti")
    todo = cut(todo.groupBy("blob", "owner").agg(F.collect_set("kind").alias("kinds")))
    n = todo.count()
    if n:
        # one copy of each blob: its owner's row; rows that repeat it are scanned twice and found once
        rows = docs.select("doc_id", "text", blob_of(F.col("text")).alias("_tsr_blob"))
        # a run that has little to add leaves the texts where they are
        few = n <= BROADCAST_ROWS and 20 * n <= paths.count()
        rows = rows.join(F.broadcast(todo) if few else todo, (rows["_tsr_blob"] == todo["blob"]) & rows["doc_id"].eqNullSafe(todo["owner"]))
        scan(rows.select("blob", "text", "kinds"), rules).distinct().write.mode("append").parquet(f"{ledger}/found")
        versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
        todo.select("blob", F.explode("kinds").alias("kind")).withColumn("version", F.element_at(versions, F.col("kind"))).write.mode("append").parquet(f"{ledger}/seen")
    return n


def scan_documents(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found): every row of docs with its spans, array of (start, rank, kind, end) in order; rank is the kind's place in rules."""
    spark = docs.sparkSession
    paths = cut(docs.select("doc_id", blob_of(F.col("text")).alias("blob")))
    update_ledger(docs, paths, ledger, rules)
    found = _ledger(spark, f"{ledger}/found", _FOUND)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    # one text's spans: never more than it has characters times rules
    by_blob = found.where(current).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    by_blob = cut(by_blob)
    # copies of a blob may be a third of all rows: broadcast if there are few spans, else from a table, so that skewed partitions can be split
    small = (by_blob.agg(F.sum(F.size("found") + 1)).first()[0] or 0) <= BROADCAST_ROWS
    return paths.join(F.broadcast(by_blob) if small else by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("found"))


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
