"""Harmonic packing of documents into sequences.

A document's ids (its text's, then an end id) are cut into pieces of at most
`capacity`: whole sequences first, then the remainder. A piece of length n is of
class k = capacity // n, and a sequence of class k holds exactly k pieces, of
whichever documents. Each worker fills the classes' sequences from its own rows,
without looking at any other worker's; what is left in sequences that it can't
fill goes through a second round over few tasks, where the last open pieces of
all classes are packed together, longest first.

A class wastes up to 1 / (k + 1) of its sequences, so a remainder stays whole only
where its share of that padding is at most `capacity // SLACK` ids. Else a
piece of the next class's full length, capacity // (k + 1), is cut off, and the rest,
now of class k (k + 1) or more, is looked at again: at most four pieces.

Ids: texts are parted where the vocabulary's own rules part them whatever stands
around (before blanks and line ends that follow a mark, letter or digit, between a letter or
digit and a punctuation mark), the library encodes each distinct part of a worker once (a
bounded table), and Arrow puts the ids in place. Texts that hold a special token, and
parts of over LONG bytes, go through the library as they are.

Defined cases: null is the empty text, a document of the end id alone; an empty
table has no pieces; repeated rows and ids, null ids too, are documents of their own; texts
are whole whatever their length; other columns aren't looked at, so
their names can't clash.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import TwoTurns, arrow_slices, distinct, new_folder, spread

TABLE_WORDS = 300_000
#: Parts of more bytes aren't kept in the table.
LONG = 200
#: Bytes of text that are taken to parts at a time.
SLICE = 1 << 21
#: A remainder may cost capacity // SLACK ids of padding before it is cut.
SLACK = 64
#: Pieces that a task of the second round takes.
PER_TASK = 50_000
#: A worker's sequences are numbered from worker * 2**33 on, those of the second round above 2**62.
_WORKER_SHIFT, _SECOND = 33, 1 << 62
#: A blank and letters, ASCII or À to ÿ.
_SPACED = re.compile(b" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_byte = np.arange(256)
_MARK = (_byte > 0x20) & (_byte < 0x7F)
_WORD = np.isin(_byte, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
# an apostrophe may begin a part together with the letters after it
_PUNCTUATION = _MARK & ~_WORD & (_byte != ord("'"))


class ByteTable:
    """Distinct part of a text, as bytes -> little-endian 32-bit ids."""

    def __init__(self, vocabulary: str, limit: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = TwoTurns(limit, self.learn)
        self.merger, self.sizes = self._merger(vocabulary)
        self.parts = self._parts()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _merger(vocabulary: str) -> tuple:
        """The vocabulary's merges in a form that takes many words in one call, and each id's number of bytes; (None, None) if its ids aren't in the order of its merges."""
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [ids["".join(m)] for m in merges]
        # byte-level vocabularies write a printable byte as its character, the others as the characters from 256 on
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        shown = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - printable))}
        if made != sorted(made) or any(c not in ids or ids[c] >= made[0] for c in shown):
            return None, None
        ranks = {bytes(shown[c] for c in t): i for t, i in ids.items() if i <= made[-1]}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            sizes[i] = len(t)
        return tiktoken.Encoding("words", pat_str=r" ?\p{L}+|[^\p{L}]", mergeable_ranks=ranks, special_tokens={}), sizes

    def _parts(self) -> bool:
        """Whether the vocabulary parts texts as cuts() does, and merges words as the merger does."""
        try:
            words = ["Some", " words", "12", ", (", "it's", ").", "\n", "here", "  \n\n x", "\n\ny", " z"]
            spaced = [b" words", " größer".encode(), b" Zq", " ÿÀß".encode(), b" unbelievably"]
            same = self.merger is None or self.merged(spaced) == [self.whole(w.decode()) for w in spaced]
            return same and self.whole("".join(words)) == b"".join(map(self.whole, words))
        except Exception:
            return False

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that _SPACED matches: they part from each other, so one call takes them all."""
        ids = np.array(self.merger.encode_ordinary(b"".join(words).decode()), "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(list(map(len, words)))) + 1
        data, at = ids.tobytes(), 0
        return [data[at : (at := 4 * e)] for e in ends.tolist()]

    def learn(self, words: list[bytes]) -> list[bytes]:
        out: list = [None] * len(words)
        spaced = [i for i, w in enumerate(words) if _SPACED.fullmatch(w)] if self.merger else []
        if spaced:
            for i, ids in zip(spaced, self.merged([words[i] for i in spaced])):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.tokenizer.encode_batch([words[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = array("I", found.ids).tobytes()
        return out

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Whether a part surely begins at a byte of UTF-8 text.

        White space never stands inside a part but at its head, so every run of it that follows another character begins a part; a
        single line end between others is a part; letters and digits end before punctuation.
        """
        out = np.zeros(len(data), bool)
        if len(data) < 3:
            return out
        end = _MARK[data]
        # À to ÿ end in a byte after 0xC3
        end[1:] |= data[:-1] == 0xC3
        after = end[:-1]
        line = (data == 0x0A)[1:] & after
        out[1:] = (data[1:] == 0x20) & after
        out[1:] |= line
        out[2:] |= line[:-1] & (_MARK[data[2:]] | (data[2:] == 0xC3))
        out[1:] |= _PUNCTUATION[data[1:]] & _WORD[data[:-1]]
        return out

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one text after the other, and where each begins and the last ends."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        start = self.cuts(own) if self.parts else np.zeros(len(own), bool)
        for i in np.flatnonzero(self._special(texts)):
            start[ends[i] : ends[i + 1]] = False
        start[ends[:-1][np.diff(ends) > 0]] = True
        at = np.flatnonzero(start)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(own)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(own))])
        keys, place = distinct(words)
        flat, bounds = spread(self._ids(keys), place)
        return flat, bounds[np.searchsorted(at, ends)]

    def _special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for s in self.special:
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if max(map(len, words), default=0) <= LONG:
            return self.table.look_up(words)
        known = iter(self.table.look_up([w for w in words if len(w) <= LONG]))
        return [next(known) if len(w) <= LONG else self.whole(w.decode()) for w in words]


_tables: dict[str, ByteTable] = {}


def byte_table(vocabulary: str) -> ByteTable:
    if vocabulary not in _tables:
        _tables.clear()
        _tables[vocabulary] = ByteTable(vocabulary)
    return _tables[vocabulary]


def remainder_pieces(n: int, capacity: int) -> list[int]:
    """Lengths that a remainder of n < capacity ids is cut into."""
    out = []
    while n:
        k = capacity // n
        if (capacity - k * n) <= k * (capacity // SLACK):
            return [*out, n]
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


def cut_lengths(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of the given sizes: each piece's document, start and length."""
    tails = [remainder_pieces(n, capacity) for n in range(capacity)]
    most = max(map(len, tails), default=0)
    lengths = np.zeros((capacity, max(1, most)), np.int64)
    for n, t in enumerate(tails):
        lengths[n, : len(t)] = t
    full, rest = sizes // capacity, sizes % capacity
    counts = full + np.fromiter(map(len, tails), np.int64, capacity)[rest]
    doc = np.repeat(np.arange(len(sizes)), counts)
    firsts = np.cumsum(counts) - counts
    # a piece's place among those of its document, less that document's whole sequences
    nth = np.arange(len(doc)) - (firsts + full)[doc]
    length = np.where(nth < 0, capacity, lengths[rest[doc], np.clip(nth, 0, lengths.shape[1] - 1)])
    ends = np.cumsum(length)
    return doc, ends - length - (ends - length)[firsts[doc]] if len(doc) else ends, length


#: A piece on its way: doc_id, start, length, ids_crc32, doc_tokens, ids (None where they aren't wanted).
Piece = tuple
_COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"
_SCHEMA = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in (x.split()[0] for x in _COLUMNS.split(", "))])


class Filler:
    """A worker's open sequences, at most one a class."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, {}

    def close(self, pieces: list[Piece]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, pieces: list[Piece]) -> list[tuple]:
        """Rows of the sequences that these pieces fill."""
        out = []
        for p in pieces:
            k = self.capacity // p[2]
            held = self.open.setdefault(k, [])
            held.append(p)
            if len(held) == k:
                out += self.close(self.open.pop(k))
        return out

    def left(self) -> list[Piece]:
        return [p for k in sorted(self.open) for p in self.open[k]]

    def finish(self) -> list[tuple]:
        """Rows of the sequences that take the open pieces of all classes (fewer than one sequence each), longest first, each where it first fits."""
        bins: list[list[Piece]] = []
        room: list[int] = []
        for p in sorted(self.left(), key=lambda p: -p[2]):
            at = next((i for i, r in enumerate(room) if r >= p[2]), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[at].append(p)
            room[at] -= p[2]
        self.open = {}
        return [row for b in bins for row in self.close(b)]


def _batches(rows: list[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + size]), _SCHEMA)], schema=_SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with_ids=True: and ids as little-endian 32-bit integers; a row a piece.

    Both rounds write Parquet under the shared folder, and the result reads it: a piece's place is settled once, whoever is lost later.
    """
    spark = docs.sparkSession

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(vocabulary)
        filler = Filler(capacity, TaskContext.get().partitionId() << _WORKER_SHIFT)
        for batch in batches:
            for ids, texts in arrow_slices(*batch.columns, size=SLICE):
                flat, bounds = table.encode_array(texts)
                # the end id after each text
                flat = np.insert(flat, bounds[1:], end_id).astype("<i4", copy=False)
                bounds = bounds + np.arange(len(bounds))
                sizes = np.diff(bounds)
                doc, start, length = cut_lengths(sizes, capacity)
                own = ids.to_pylist()
                begins = bounds[doc] + start
                pieces = []
                for d, s, n, at in zip(doc.tolist(), start.tolist(), length.tolist(), begins.tolist()):
                    data = flat[at : at + n].tobytes()
                    pieces.append((own[d], s, n, zlib.crc32(data), int(sizes[d]), data if with_ids else None))
                yield from _batches(filler.add(pieces))
        yield from _batches([(*p, None, None) for p in filler.left()])

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(capacity, _SECOND | TaskContext.get().partitionId() << _WORKER_SHIFT)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:6])))
            yield from _batches(filler.add(rows))
        yield from _batches(filler.finish())

    one, two = new_folder(spark, "packed"), new_folder(spark, "packed-rest")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(first_round, _COLUMNS).write.parquet(one)
    done = spark.read.schema(_COLUMNS).parquet(one)
    rest = done.where("sequence_id is null")
    tasks = -(-rest.count() // PER_TASK)
    if tasks:
        rest.repartition(tasks).mapInArrow(second_round, _COLUMNS).write.parquet(two)
        done = done.where("sequence_id is not null").union(spark.read.schema(_COLUMNS).parquet(two))
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of packed pieces with ids: ids (array<int>) is padded to capacity, except where n_tokens is a power of two.

    A sequence's pieces are at most `capacity`, so its group is bounded.
    """

    @F.arrow_udf("array<int>")
    def numbers(ids: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False) // 4
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(x or b"" for x in ids.to_pylist()), "<i4")))

    part = F.struct("offset", "doc_id", "start", "length", numbers("ids").alias("ids"))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("pieces"))
    n = F.col("n_tokens")
    short = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(capacity) - n).cast("int")
    ids = F.concat(F.flatten(F.transform("pieces", lambda p: p["ids"])), F.array_repeat(F.lit(pad_id).cast("int"), short))
    return out.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"))
