"""Quality classifier: a generalised additive model with pairwise interactions.

Training cycles over the features; in its turn a feature gets one shallow tree
on its bins, fitted to the logistic gradient and added to that feature's lookup
table. Then the strongest pairs of features get two-dimensional tables the
same way. A score is the sum of table entries through the logistic function.

Defined cases: null and empty texts have all-zero features and are scored like
any text, an empty table gives no rows; texts are read whole whatever their
length; repeated rows are scored alike, and in training an id is one row (of
several texts the one of least features); ids of equal hash come by id; with no
labelled rows of both classes every score is the share of label 1 (0.5 without
any labels); columns that clash with an output name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import crc_mod, one_label, slices

FEATURES = (
    "log_words", "word_length", "symbols", "upper", "digits", "stops", "bangs", "distinct_words", "adjacent_repeats",
    "repeated_lines", "words_per_line", "longest_word", "non_ascii", "bars", "distinct_pairs", "short_words",
)

_CLASS = np.zeros(256, np.intp)  # byte -> class
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".?", b"!", b"|", b"#*$%&<>", b" \t\n\v\f\r"), 1):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[0x80:0xC0] = 9  # continuation bytes
_CLASS[0xC0:] = 10


def text_features(text: bytes | None) -> list[float]:
    """The FEATURES of one text, given as UTF-8."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 11)
    upper, lower, digit, stop, bang, bar, symbol, space, tail, lead = counts[1:]
    chars = len(text) - tail - space
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ids = np.fromiter(map(hash, words), np.int64, n)
    pairs = ids[1:] * 1_000_003 + ids[:-1]
    return [
        float(np.log1p(n)), chars / n, (symbol + bar) / n, upper / max(1, upper + lower + lead), digit / chars, stop / n, bang / n, len(set(words)) / n ** 0.75,
        float((ids[1:] == ids[:-1]).sum()) / n, 1 - len(set(lines)) / len(lines), n / len(lines), float(np.log1p(lengths.max())), lead / chars, bar / n,
        len(np.unique(pairs)) / max(1, n - 1), float((lengths <= 3).mean()),
    ]


@dataclass
class Gam:
    """Lookup tables. Bounded: features x bins, and pairs x coarse bins squared."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best cut of ordered bins: gain, and the first bin right of it (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gs, hs = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton values of a tree with so many leaves, greedily grown, by bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], ridge), a, b) for a, b in parts), key=lambda s: s[0])
        if not best[1]:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Depth-two tree on a grid: the better axis first, then each side on the other one."""
    best, most = np.zeros_like(g), 0.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, k = _split(a.sum(1), b.sum(1), ridge)
        out, gain = np.zeros_like(a), 0.0
        for rows in (slice(0, k), slice(k, None)) if k else (slice(None),):
            _, m = _split(a[rows].sum(0), b[rows].sum(0), ridge)
            for cols in (slice(0, m), slice(m, None)) if m else (slice(None),):
                s, w = a[rows, cols].sum(), b[rows, cols].sum() + ridge
                out[rows, cols] = s / w
                gain += s * s / w
        if gain > most:
            best, most = out.T if flip else out, gain
    return best, most


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 150, pair_rounds: int = 100, n_pairs: int = 8, leaves: int = 4, rate: float = 0.1, ridge: float = 10.0) -> Gam:
    """Cyclic boosting: every round gives each feature (then each pair) one shallow tree."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Gam(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    model.coarse = [_cuts(x[:, j], coarse_bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = 1 / (1 + np.exp(-f))
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), leaves, ridge)
            model.tables[j] += step
            f += step[b]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        k = low[i] * width[j] + low[j]
        shape = (width[i], width[j])
        return np.bincount(k, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(k, p * (1 - p), shape[0] * shape[1]).reshape(shape), k

    ranked = sorted(((-_tree_2d(*grids(i, j)[:2], ridge)[1], i, j) for i in range(x.shape[1]) for j in range(i)))
    chosen = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in chosen:
            g, h, k = grids(i, j)
            step = rate * _tree_2d(g, h, ridge)[0]
            t += step
            f += step.ravel()[k]
    model.pairs = chosen
    return model


def features_of(texts: Sequence[bytes | None]) -> np.ndarray:
    return np.array([text_features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `limit` labelled rows, those of smallest id hash."""
    picked = one_label(labels, "quality").where(learnable & F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features_of(texts)))

    # the sample has at most `limit` rows of two numbers, so it is broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", features("text").alias("x"), "quality")
    # one row an id, whatever repeats: at most `limit` rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).orderBy("doc_id").select("r.x", "r.quality").toPandas()
    return np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES)), rows["quality"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> Gam:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1, at most `limit` of them."""
    return fit_gam(*labelled_sample(docs, labels, crc_mod(F.col("doc_id"), 3) != 1, limit))


def score_column(model: Gam, text: Column) -> Column:
    """P(label 1) of a text column. The tables travel with the function: they are small and bounded."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for (group,) in slices(texts):
                yield pa.array(model.score(features_of(group)), pa.float64())

    return scored(text.cast("binary"))


def classify(docs: DataFrame, model: Gam, threshold: float = 0.5) -> DataFrame:
    """docs with score, predicted (score >= threshold) and held_out."""
    scored = docs.withColumn("score", score_column(model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))
