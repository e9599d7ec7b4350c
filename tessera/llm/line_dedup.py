"""Line dedup by overlapping three-line windows, with DataFrame functions alone.

Every three consecutive lines make a window; a text of one or two lines is one
window of all its lines, equal to none of another number. Windows are grouped over the whole
corpus by a 128-bit hash; a window that occurs again keeps its first occurrence
in order of (doc_id, text hash, position), and the lines that any later
occurrence covers go. Every removed line has an equal one earlier in that
order, so one copy of each line always stays.

Defined cases: null texts stay null and have no lines; an empty table gives no
rows; texts and lines of any length are hashed whole; windows of blank lines alone don't count; rows that
repeat an id and text are one document and get one result; null ids come first
in the order; a window that repeats within a text removes its later part;
clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import cut

LINES = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _tsr_text, n, pos, h1, h2): every window of n lines, LINES or all of a shorter text, that has a character besides blanks."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_tsr_text"), F.split("text", "\n").alias("l")).withColumn("n", F.least(F.size("l"), F.lit(LINES)))
    # lines that a shorter text doesn't have are null, which hashes skip; n tells such texts apart
    window = lambda i: [F.get("l", i + j) for j in range(LINES)]
    starts = F.when(F.col("l").isNotNull(), F.sequence(F.lit(0), F.size("l") - F.col("n")))
    made = F.transform(starts, lambda i: F.when(F.concat_ws("", *window(i)).rlike("\\S"), F.struct(F.xxhash64("n", *window(i)).alias("h1"), F.xxhash64(F.lit("second"), "n", *window(i)).alias("h2"))))
    rows = lines.select("doc_id", "_tsr_text", "n", F.posexplode_outer(made).alias("pos", "x")).where(F.col("x").isNotNull())
    return rows.select("doc_id", "_tsr_text", "n", "pos", "x.h1", "x.h2")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _tsr_text, gone): the places of the lines that go, for texts that lose any."""
    rows = cut(line_windows(docs))
    place = F.struct("doc_id", "_tsr_text", "pos")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = rows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    # one document's places: never more than it has lines
    return later.groupBy("doc_id", "_tsr_text").agg(F.max("n").alias("n"), F.collect_set("pos").alias("p")).select("doc_id", "_tsr_text", F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda i: F.sequence(i, i + F.col("n") - 1))))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without the repeated lines, n_lines (before) and n_removed."""
    gone = repeated_lines(docs).withColumnsRenamed({"doc_id": "_tsr_id", "_tsr_text": "_tsr_key", "gone": "_tsr_gone"})
    out = docs.withColumn("_tsr_text", F.xxhash64("text"))
    out = out.join(gone, out["doc_id"].eqNullSafe(gone["_tsr_id"]) & (out["_tsr_text"] == gone["_tsr_key"]), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_tsr_lines") - 1), "_tsr_gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_tsr_lines", i)), "\n")
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))).withColumn("n_removed", F.coalesce(F.size("_tsr_gone"), F.lit(0)))
    return out.withColumn("_tsr_lines", F.when(F.col("_tsr_gone").isNotNull(), lines)).withColumn("text", F.when(F.col("_tsr_gone").isNull(), F.col("text")).otherwise(kept)).drop("_tsr_id", "_tsr_text", "_tsr_key", "_tsr_gone", "_tsr_lines")
