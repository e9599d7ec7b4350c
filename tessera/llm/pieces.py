"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model runs from a character into a following whitespace
marker, so merges never cross the start of a marked word: a text is cut before
each run of spaces that follows another character. Every distinct chunk is
segmented once by the library, and its ids are joined back by position. Where
the vocabulary shows that no piece crosses them either, chunks are also cut around
line ends and before the stop or comma that ends a word, which makes fewer of
them distinct. Decoding reads nothing but ids: they are cut before each piece that begins with
a marker (and at line ends, stops and commas), every distinct run of ids is decoded once by the library, and the
texts are joined by position.

Both tables live in the Python worker and hold at most TABLE_CHUNKS entries, so
memory is bounded; no occurrence is shuffled. They serve a task and are emptied
after it: a worker lives on into other stages. Arrow parts the texts, finds
what is distinct and puts ids and texts in place. A model whose pieces do cross
markers, or that rewrites text, is refused.

Defined cases: null is the empty text, which has begin and end ids alone;
null ids decode to the empty text; an empty table gives no rows; texts are whole
whatever their length; repeated texts are encoded alike; clashing columns are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import TwoTurns, arrow_slices, distinct, give_back, spread

TABLE_CHUNKS = 60_000
#: Bytes of text that are taken to chunks at a time.
SLICE = 1 << 19
MARK = "▁"
#: Between chunks, and at the head of one that has no marker, while Arrow parts texts without these characters; Python parts the others.
_CUT, _BARE = "\uf8f0", "\uf8f1"
_CHUNK = re.compile(" +[^ ]*")
_JOINED = "[^0-9A-Za-zÀ-ÖØ-öø-ÿ ][.,] "


class ChunkTable:
    """Distinct chunk -> little-endian 32-bit ids, and ids of a run from marker to marker -> its text.

    A chunk is a str without its first marker, which the library adds; one that has no marker is bytes.
    So no character of a text can be taken for a mark.
    """

    def __init__(self, model_path: str, limit: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or self.model.encode("a  b", out_type=str)[:1] != [MARK + "a"]:
            raise ValueError("pieces of this model cross whitespace markers, or it doesn't mark the first word")
        if self.model.decode(self.model.encode("  A  é ")) != "  A  é ":
            raise ValueError("this model rewrites texts")
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        self.table, self.texts = TwoTurns(limit, self.segment), TwoTurns(limit, self.surfaces)
        self.mark = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.control = np.array([self.model.is_control(i) for i in range(n)])
        # a piece without marker: what follows it is decoded as inside a text
        self.before = next(i for i, p in enumerate(pieces) if p == "a")
        # runs also begin at a line end, after it, and at a stop or comma: fewer of them are distinct
        single = lambda c: [i for i in self.model.encode(c) if self.model.decode([self.before, i])[1:] == c]
        self.ends = self.control.copy()
        self.ends[single("\n")] = True
        self.starts = self.marked | self.ends
        self.starts[single(".") + single(",")] = True
        # whether merges never cross a line end, or come from a letter or digit to a stop or comma
        self.lines = not any("\n" in p for p in pieces if len(p) > 1)
        self.stops = not any(re.search("[0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]", p) for p in pieces)
        self.line = len(self.model.encode("\n"))

    def segment(self, chunks: list[str | bytes]) -> list[bytes]:
        """Ids of new chunks. The library marks every text; one that has no marker is segmented after a line end."""
        bare = [isinstance(c, bytes) for c in chunks]
        found = self.model.encode(["\n" + c.decode() if b else c for c, b in zip(chunks, bare)], num_threads=1)
        if any(bare):
            found = [f[self.line :] if b else f for f, b in zip(found, bare)]
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        at, out = 0, []
        for c, ids, b in zip(chunks, found, bare):
            # a marker alone: the library marks no empty text
            out.append(flat[at : (at := at + 4 * len(ids))] if c or b else self.mark)
        return out

    def surfaces(self, runs: list[bytes]) -> list[str]:
        """Texts of new runs of ids."""
        flat = np.frombuffer(b"".join(runs), "<u4").tolist()
        at, lists, first = 0, [], [self.before]
        for r in runs:
            lists.append(first + flat[at : (at := at + len(r) // 4)])
        return [t[1:] for t in self.model.decode(lists, num_threads=1)]

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
        """How many chunks each text has, the distinct chunks, and each chunk's place among them.

        A chunk begins at each run of spaces; further cuts where no piece crosses them."""
        texts = pc.replace_substring(texts, MARK, " ")
        if pc.any(pc.match_substring_regex(texts, f"[{_CUT}{_BARE}]")).as_py():
            lists = pa.array([[c[1:] for c in _CHUNK.findall(" " + t)] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
            return pc.list_value_length(lists).to_numpy(), *distinct(lists.flatten())
        lists = self._parted(texts)
        flat = lists.flatten()
        bare = pc.starts_with(flat, _BARE)
        marked, place = distinct(flat.filter(pc.invert(bare)))
        loose, own = distinct(pc.utf8_slice_codeunits(flat.filter(bare), 1).cast(pa.binary()))
        bare = bare.to_numpy(zero_copy_only=False)
        at = np.empty(len(flat), np.int64)
        at[~bare], at[bare] = place, own + len(marked)
        return pc.list_value_length(lists).to_numpy(), marked + loose, at

    def _parted(self, texts: pa.Array) -> pa.Array:
        """Lists of the chunks of texts without _CUT and _BARE; chunks without marker begin with _BARE."""
        if self.stops:
            apart = pc.replace_substring(pc.replace_substring(texts, ". ", f"{_CUT}{_BARE}. "), ", ", f"{_CUT}{_BARE}, ")
            # a stop at the head of a text or after a blank has that blank's marker
            texts = pc.if_else(pc.match_substring_regex(texts, f"{_JOINED}|(^| )[.,] "), texts, apart)
        if self.lines:
            texts = pc.replace_substring(texts, "\n", f"{_CUT}{_BARE}\n{_CUT}{_BARE}")
        # blanks at the head of a text are one run with the marker that the library adds
        texts = pc.if_else(pc.starts_with(texts, " "), pc.binary_join_element_wise(f"{_BARE} ", texts, ""), texts)
        runs = pc.match_substring(texts, "  ")
        single = pc.replace_substring(texts, " ", _CUT)
        if pc.any(runs).as_py():
            # of a run of spaces the first parts, the others belong to the chunk after them
            single = pc.if_else(runs, pc.replace_substring_regex(pc.if_else(runs, texts, ""), " ( *)", f"{_CUT}\\1"), single)
        out = pc.split_pattern(single, _CUT)
        empty = pc.equal(pc.binary_length(texts), 0)
        return pc.if_else(empty, pa.array([[]], out.type)[0], out) if pc.any(empty).as_py() else out

    def encode_array(self, texts: pa.Array, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one text after the other, and where each begins and the last ends."""
        counts, chunks, at = self.cut(texts)
        flat, ends = spread(self.table.look_up(chunks), at)
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        more = [i for i, wanted in ((self.begin, bos), (self.end, eos)) if wanted]
        if more:
            places = np.stack([x for x, wanted in ((bounds[:-1], bos), (bounds[1:], eos)) if wanted], axis=1).ravel()
            flat = np.insert(flat, places, np.tile(np.array(more, np.int32), len(texts)))
            bounds = bounds + len(more) * np.arange(len(bounds))
        return flat.astype("<i4", copy=False), bounds

    def decode_array(self, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ids that stand one text after the other."""
        start = self.starts[flat]
        start[1:] |= self.ends[flat[:-1]]
        start[bounds[:-1][bounds[:-1] < len(flat)]] = True
        at = np.nonzero(start)[0]
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(4 * np.append(at, len(flat)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
        keys, place = distinct(runs)
        texts = pa.array(self.texts.look_up(keys), pa.large_string()).take(pa.array(place))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]) if len(texts) else np.zeros(1, np.int64)
        of_text = ends[np.searchsorted(at, bounds)].astype(np.int64)
        data = texts.buffers()[2] if len(texts) else None
        out = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(of_text), data or pa.py_buffer(b"")).cast(pa.string())
        # the marker that the first piece of a text begins with is the library's own
        return pc.if_else(pa.array(self._leads(flat, bounds)), pc.utf8_slice_codeunits(out, 1), out)

    def _leads(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a text's first piece besides control ones begins with a marker."""
        real = np.append(np.nonzero(~self.control[flat])[0], len(flat))
        at = real[np.searchsorted(real, bounds[:-1])]
        inside = at < bounds[1:]
        out = np.zeros(len(bounds) - 1, bool)
        out[inside] = self.marked[flat[at[inside]]]
        return out

    def clear(self) -> None:
        """Forget what was learned of texts; the model stays."""
        self.table.clear()
        self.texts.clear()
        give_back()

    def encode(self, texts: list[str], bos: bool, eos: bool) -> list[list[int]]:
        flat, bounds = self.encode_array(pa.array(texts, pa.string()), bos, eos)
        return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]

    def decode(self, rows: list[list[int]]) -> list[str]:
        flat = np.fromiter(chain.from_iterable(rows), "<i4")
        return self.decode_array(flat, np.cumsum([0] + [len(r) for r in rows])).to_pylist()


_tables: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """One table a worker process and model."""
    if model_path not in _tables:
        _tables.clear()
        _tables[model_path] = ChunkTable(model_path)
    return _tables[model_path]


def _array(flat: np.ndarray, bounds: np.ndarray, as_list: bool) -> pa.Array:
    if as_list:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(4 * bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def encode_pieces(docs: DataFrame, model_path: str, bos: bool = True, eos: bool = True, as_list: bool = True) -> DataFrame:
    """docs with ids and what they decode to. ids is array<int>, or with as_list=False the same ids as little-endian 32-bit integers in binary."""

    @F.arrow_udf(f"ids {'array<int>' if as_list else 'binary'}, decoded string")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = chunk_table(model_path)
        try:
            for texts in batches:
                for (group,) in arrow_slices(texts, size=SLICE):
                    flat, bounds = table.encode_array(group, bos, eos)
                    yield pa.StructArray.from_arrays([_array(flat, bounds, as_list), table.decode_array(flat, bounds)], ["ids", "decoded"])
                    del flat, bounds
                    give_back()
        finally:
            table.clear()

    out = docs.withColumn("_tsr_out", encoded(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumns({"ids": F.col("_tsr_out.ids"), "decoded": F.col("_tsr_out.decoded")}).drop("_tsr_out")


def decode_pieces(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (ids: array<int>) with decoded, the text of the ids; control ids have none."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = chunk_table(model_path)
        try:
            for lists in batches:
                yield pa.array(table.decode([x or [] for x in lists.to_pylist()]), pa.string())
        finally:
            table.clear()

    return rows.withColumn("decoded", decoded("ids"))
