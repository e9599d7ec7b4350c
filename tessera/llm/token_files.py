"""Token ids as Parquet list columns.

Documents are dealt out by ranges of doc_id, sorted, tokenised and written with
columns row, doc_id, n_tokens and ids. ids is dictionary-encoded; row, doc_id
and n_tokens are delta-encoded (data pages version 2, no dictionary). Row
groups and pages have set sizes, and the writer adds page indexes, so a reader
of a few documents, or of the small columns alone, skips the other pages.
Files come from Spark's committed writer: a lost executor's tasks are repeated
without half-written or double rows.

Offsets are sums of n_tokens, first within a file, then over the files' totals,
which are one row a file.

Tokenising: ASCII white space parts words before the vocabulary's own rules
apply, the library encodes each distinct word of a worker once (bounded tables),
and Arrow parts the texts, finds their distinct words and puts the ids in place.

Defined cases: null is the empty text (the end id alone); rows of equal doc_id
are ordered by text hash; null ids come first; an empty table writes no rows;
texts are whole whatever their length, some MB of them at a time; other columns
aren't looked at, so their names can't clash.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm._shared import TwoTurns, arrow_slices, distinct, spread

TABLE_WORDS = 300_000
#: Bytes of text that are taken to words at a time.
SLICE = 1 << 21
#: A file's rows are numbered from file * 2**33 on, as monotonically_increasing_id does.
_FILE_SHIFT = 33
#: A word of Latin letters, and punctuation after it that starts a part of its own.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@[-`{}~]*)")
#: A stop or comma that another mark joins, or that comes after a character whose normal form may end in a mark.
_JOINED = r"[^0-9A-Za-zÀ-ÖØ-öø-ÿ \t\n\v\f\r][.,][ \t\n\v\f\r]"


class WordTable:
    """Distinct word -> little-endian 32-bit ids.

    A plain word (Latin letters, then perhaps punctuation) goes straight to the
    vocabulary's merges in lower case; any other takes the library's whole way.
    """

    def __init__(self, vocabulary: str, limit: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model
        self.table, self.known = TwoTurns(limit, self.learn), {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(i) for i in range(0x41, 0x100) if _PLAIN.fullmatch(chr(i))]
        # to lower case, and to the characters that stand for a letter's bytes
        self.letters = str.maketrans({c: as_bytes.pre_tokenize_str(c.lower())[0][0] for c in letters if c[:1].isalpha()})
        self.parts = self._parts_words(letters)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts_words(self, letters: list[str]) -> bool:
        """Whether the vocabulary parts words at white space, and punctuation from lower-cased letters."""
        try:
            apart = b"".join(map(self.whole, ("some", "words", ",", "here", "!?")))
            same = all(self.whole(c + "bcd") == self.plain(c + "bcd") for c in letters if c.isalpha())
        except Exception:
            return False
        return same and self.whole("Some  words, here!?") == apart and not self.whole(" ") and self.whole("a1. B\n") == self.whole("a1 . b")

    def plain(self, word: str) -> bytes:
        word = word.lower() if word.isascii() else word.translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        plain, merged, out = _PLAIN.fullmatch, self.merges.tokenize, []
        for w in words:
            if len(w) > 200:
                out.append(self.whole(w))
            elif w.isalpha() and w.isascii():
                out.append(array("I", [t.id for t in merged(w.lower())]).tobytes())
            elif m := plain(w):
                out.append(self.plain(m[1]) + (self.tail(m[2]) if m[2] else b""))
            else:
                out.append(self.whole(w))
        return out

    def tail(self, marks: str) -> bytes:
        if marks not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[marks] = self.whole(marks)
        return self.known[marks]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one text after the other, and the number of each text's."""
        if not self.parts:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), "<i4"), np.array([len(x) // 4 for x in each], np.int64)
        cut = self.split(texts)
        words, at = distinct(cut.flatten())
        flat, ends = spread(self.table.look_up(words), at)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        return flat, np.diff(ends[bounds - bounds[0]])

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, sizes = self.encode_array(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [flat[b - n : b].astype("<u4").tobytes() for b, n in zip(ends, sizes)]

    @staticmethod
    def split(texts: pa.Array) -> pa.Array:
        """Words between ASCII white space. A-Z are lower-cased where that can't make a special token; stops and commas part
        from the letter or digit before them, unless the text has one that something else joins."""
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        apart = pc.replace_substring(pc.replace_substring(pc.replace_substring(texts, ". ", " . "), ", ", " , "), ".\n", " .\n")
        return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _JOINED), texts, apart))


_tables: dict[str, WordTable] = {}


def word_table(vocabulary: str) -> WordTable:
    if vocabulary not in _tables:
        _tables.clear()
        _tables[vocabulary] = WordTable(vocabulary)
    return _tables[vocabulary]


def tokens_column(vocabulary: str, end_id: int, text: Column) -> Column:
    """array<int> of a text's ids and the end id."""

    @F.arrow_udf("array<int>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = word_table(vocabulary)
        for texts in batches:
            for (group,) in arrow_slices(texts, size=SLICE):
                flat, sizes = table.encode_array(group)
                ends = np.cumsum(sizes)
                ids = np.insert(flat, ends, np.int32(end_id)).astype(np.int32, copy=False)
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), pa.int32()), pa.array(ids))

    return tokens(text)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, row_group_mb: int = 32, page_rows: int = 2_000) -> None:
    """Write docs (doc_id, text) as token files under path, in ascending doc_id."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens_column(vocabulary, end_id, F.col("text")).alias("ids"))
    out = ids.select("row", "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    how = {"parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows), "parquet.writer.version": "v2", "parquet.enable.dictionary": "true"}
    how |= {f"parquet.enable.dictionary#{c}": "false" for c in ("row", "doc_id", "n_tokens")}
    out.write.mode("errorifexists").options(**how).parquet(path)


def read_offsets(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """(row, doc_id, start, n_tokens, *more) of token files: start counts the ids of all rows before."""
    rows = spark.read.parquet(path).select("row", "doc_id", "n_tokens", *more)
    file = F.shiftright(F.col("row"), _FILE_SHIFT)
    totals = spark.read.parquet(path).groupBy(file.alias("file")).agg(F.sum("n_tokens").alias("_tsr_total"))
    # one row a file, so the window over all of them is small whatever the documents
    before = totals.select("file", (F.sum("_tsr_total").over(W.orderBy("file")) - F.col("_tsr_total")).alias("_tsr_before"))
    rows = rows.withColumn("file", file).withColumn("_tsr_in", F.sum("n_tokens").over(W.partitionBy("file").orderBy("row")) - F.col("n_tokens"))
    out = rows.join(before, "file").withColumn("start", F.col("_tsr_before") + F.col("_tsr_in"))
    return out.select("row", "doc_id", "start", *[c for c in rows.columns if c not in ("row", "doc_id", "file", "_tsr_in")])


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of ids as little-endian 32-bit integers."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())
