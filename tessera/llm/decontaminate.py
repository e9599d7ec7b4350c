"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Words are hashed, k = 5 of them make a gram, and of every 9 grams in a row the
least is a fingerprint. 5 + 9 - 1 = 13, so any 13 shared words share a
fingerprint: the join of document and benchmark fingerprints misses none. A
match is extended to the at most nine 13-word windows around it, which are
compared word by word with the benchmark's windows. Items of fewer words are
one window each and are matched by the hash of all their words.

A benchmark side is broadcast only in blocks of at most BROADCAST_ROWS
fingerprints; a larger benchmark takes several passes over the documents.
Windows are grouped by their words, so items that share a passage cost one
match. Groups hold one document's hits, never more than it has words times the
window lengths in use.

Defined cases: null and empty texts have no words and are clean; texts of any
length are read whole; an empty table gives no rows; documents
that repeat an id and text get equal results, and one id with several texts is
told apart by the text's hash; null ids are kept; an empty benchmark hits
nothing; null item ids count as items named "null"; clashing columns are
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import BROADCAST_ROWS, ascii_lower, cut

WINDOW, GRAM = 13, 5
_BLANK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"


def words_of(text: Column) -> Column:
    """Maximal runs of 0-9, A-Z, a-z and non-ASCII characters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANK + "+"), "")


def _hash(word: Column) -> Column:
    """Hash of a word in any case. Words that are equal but for A-Z have one; that others do too (É and é) is left to the comparison of windows."""
    return F.xxhash64(F.lower(word))


def _count_words(text: Column) -> Column:
    # every word becomes one character; a text without any keeps its blanks and is told apart
    return F.when(text.rlike(_WORD), F.length(F.regexp_replace(text, f"{_BLANK}*{_WORD}+{_BLANK}*", "w"))).otherwise(0).cast("long")


def _positions(last: Column) -> Column:
    """0 to last, empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    """Hash of every k successive word hashes."""
    return F.transform(_positions(F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _winnow(grams: Column, width: int) -> Column:
    """The distinct least grams of all windows of that width (of all grams, if there are fewer)."""
    m = F.transform(_positions(F.size(grams) - F.lit(width)), lambda i: F.least(*[F.get(grams, i + j) for j in range(width)]))
    return F.array_distinct(m)


def _windows(words: Column, n: int) -> Column:
    return F.transform(_positions(F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(window, n, items): each distinct window's words, its length, and its items' ids as sorted text."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(ascii_lower(F.col("text"))).alias("w"))
    rows = words.select("item", F.least(F.size("w"), F.lit(WINDOW)).alias("n"), F.explode(F.when(F.size("w") == 0, F.array().cast("array<string>")).when(F.size("w") < WINDOW, F.array(F.array_join("w", " "))).otherwise(_windows(F.col("w"), WINDOW))).alias("window"))
    return rows.groupBy("window", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(rows: DataFrame, limit: int) -> list[DataFrame]:
    """rows (with a hash column h) in parts of about `limit` rows at most."""
    n = rows.count()
    parts = -(-n // max(1, limit // 2))
    return [rows] if n <= limit else [rows.where(F.pmod(F.xxhash64("h", F.lit("block")), F.lit(parts)) == i) for i in range(parts)]


def find_hits(docs: DataFrame, benchmark: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, _tsr_text, start, n, items): every occurrence of a benchmark window in a document, with the words' place."""
    windows = cut(benchmark_windows(benchmark))
    short = [r[0] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # at most 12 numbers
    split = F.split("window", " ")
    prints = windows.where(F.col("n") == WINDOW).select(F.explode(_winnow(_grams(F.transform(split, _hash), GRAM), WINDOW - GRAM + 1)).alias("h")).distinct()
    base = docs.select("doc_id", F.xxhash64("text").alias("_tsr_text"), words_of(F.col("text")).alias("w"))
    base = base.withColumn("wh", F.transform("w", _hash))
    found = []
    # outer explodes: for others Catalyst adds a filter below that computes the arrays a second time
    full = base.withColumn("g", _grams(F.col("wh"), GRAM)).withColumn("f", _winnow(F.col("g"), WINDOW - GRAM + 1))
    for block in _blocks(cut(prints), block_rows):
        hit = full.withColumn("h", F.explode_outer("f")).join(F.broadcast(block), "h")
        at = hit.withColumn("p", F.explode_outer(F.filter(_positions(F.size("g") - 1), lambda i: F.get(F.col("g"), i) == F.col("h"))))
        first, last = F.greatest(F.col("p") - (WINDOW - GRAM), F.lit(0)), F.least(F.col("p"), F.size("w") - WINDOW)
        found.append(at.select("doc_id", "_tsr_text", F.lit(WINDOW).alias("n"), F.explode_outer(F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), ascii_lower(F.array_join(F.slice("w", s + 1, WINDOW), " ")).alias("window")))).alias("x")))
    for n in short:
        keys = windows.where(F.col("n") == n).select(F.xxhash64(*[_hash(F.get(split, F.lit(j))) for j in range(n)]).alias("h")).distinct()
        for block in _blocks(keys, block_rows):
            at = base.select("doc_id", "_tsr_text", "w", F.posexplode_outer(_grams(F.col("wh"), n)).alias("start", "h")).join(F.broadcast(block), "h")
            found.append(at.select("doc_id", "_tsr_text", F.lit(n).alias("n"), F.struct("start", ascii_lower(F.array_join(F.slice("w", F.col("start") + 1, n), " ")).alias("window")).alias("x")))
    rows = reduce(DataFrame.union, found).select("doc_id", "_tsr_text", "n", "x.start", "x.window").distinct()
    return rows.join(windows, ["window", "n"]).select("doc_id", "_tsr_text", "start", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, _tsr_text, n_hit, items) of the documents with hits: words inside windows, and the items' ids sorted as text."""
    hits = find_hits(docs, benchmark, block_rows)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    # covered words: spans in order, each adding what lies beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("far")), lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["far"]))).alias("sum"), F.greatest(a["far"], s["end"]).alias("far")), lambda a: a["sum"])
    by_doc = hits.groupBy("doc_id", "_tsr_text").agg(spans.alias("spans"), F.collect_set("items").alias("items"))
    return by_doc.select("doc_id", "_tsr_text", covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with n_words, n_hit, items (array of text) and contaminated: n_hit > 0 and 20 * n_hit >= n_words."""
    hits = contamination(docs, benchmark, block_rows).select(F.col("doc_id").alias("_tsr_id"), F.col("_tsr_text").alias("_tsr_key"), F.col("n_hit").alias("_tsr_hit"), F.col("items").alias("_tsr_items"))
    out = docs.withColumn("_tsr_text", F.xxhash64("text"))
    out = out.join(hits, out["doc_id"].eqNullSafe(hits["_tsr_id"]) & (out["_tsr_text"] == hits["_tsr_key"]), "left")
    out = out.withColumn("n_words", _count_words(F.col("text"))).withColumn("n_hit", F.coalesce("_tsr_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("_tsr_items", F.array().cast("array<string>")))
    return out.withColumn("contaminated", _contaminated()).drop("_tsr_id", "_tsr_text", "_tsr_key", "_tsr_hit", "_tsr_items")


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the contaminated ones. Few are, so their keys are broadcast if they are counted to be few; texts aren't shuffled then."""
    slim = decontaminate_digest(docs, benchmark, block_rows=block_rows, key=True)
    bad = cut(slim.where("contaminated").select(F.col("doc_id").alias("_tsr_id"), F.col("_tsr_text").alias("_tsr_key")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    out = docs.withColumn("_tsr_text", F.xxhash64("text"))
    return out.join(bad, out["doc_id"].eqNullSafe(F.col("_tsr_id")) & (F.col("_tsr_text") == F.col("_tsr_key")), "left_anti").drop("_tsr_text")


def decontaminate_digest(docs: DataFrame, benchmark: DataFrame, block_rows: int = BROADCAST_ROWS, key: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) without the texts: only ids, hashes and counts are shuffled. key adds _tsr_text, the text's hash."""
    slim = docs.select("doc_id", "text")
    hits = contamination(slim, benchmark, block_rows).withColumnsRenamed({"doc_id": "_tsr_id", "_tsr_text": "_tsr_key"})
    out = slim.select("doc_id", F.xxhash64("text").alias("_tsr_text"), _count_words(F.col("text")).alias("n_words"))
    out = out.join(hits, out["doc_id"].eqNullSafe(hits["_tsr_id"]) & (out["_tsr_text"] == hits["_tsr_key"]), "left")
    out = out.select("doc_id", "_tsr_text", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn("contaminated", _contaminated())
    return out if key else out.drop("_tsr_text")
