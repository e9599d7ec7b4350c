"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Trained by backpropagation through time on windows of bytes, each position
labelled with its document's language. A document is read whole, in windows of
WINDOW bytes, all windows of a batch advancing together; every position gets
language probabilities from the forward and backward states, and a document's
are the mean over its positions.

Training rows are bounded by documented parameters: at most `per_language`
documents of each of the `max_languages` languages with most ids, those of least
id hash, and of each the windows at `windows` places spread over the whole text. Scoring has no bounds.

Defined cases: null texts and texts without a letter are "und" with score 0;
with nothing to learn from (an empty table too) there is no model and every text is
"und"; an empty table to score gives no rows; repeated rows are scored alike, and in
the fit an id is one document however many rows it has (its least language, its text
of least hash); languages with as many ids come by name, and of equal probabilities
the language first by name is predicted; a very long text is read whole, BATCH windows
at a time; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._shared import crc_mod, slices

WINDOW, BATCH = 96, 2048


class Gru:
    """One direction. Arrays have the features first and the batch last, so that
    numpy's inner loops are long. Gates: update, reset, candidate;
    the first two through the hard sigmoid min(1, max(0, a / 4 + 1 / 2)).
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.x = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.h = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)

    def states(self, bytes_: np.ndarray, keep: list | None = None, mask: np.ndarray | None = None) -> np.ndarray:
        """(T, B) bytes -> (T, H, B) states. keep gathers what backpropagation needs; where mask (T, B) is 0 the state is 0."""
        steps, batch = bytes_.shape
        n = self.h.shape[1]
        # the hard sigmoid's a / 4 + 1 / 2 is put into the weights
        slope = np.ones((3 * n, 1), np.float32)
        slope[: 2 * n] = 0.25
        wx, wh = self.x * slope, self.h * slope
        wx[: 2 * n] += 0.5
        wx = np.ascontiguousarray(wx.T)
        hz, hc = np.ascontiguousarray(wh[: 2 * n]), np.ascontiguousarray(wh[2 * n :])
        h = np.zeros((n, batch), np.float32)
        out = np.empty((steps, n, batch), np.float32)
        for t in range(steps):
            x = np.ascontiguousarray(wx[bytes_[t]].T)
            gates = hz @ h
            gates += x[: 2 * n]
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            z, r = gates[:n], gates[n:]
            rh = r * h
            c = hc @ rh
            c += x[2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, rh, c))
            new = c - h
            new *= z
            new += h
            if mask is not None:
                new *= mask[t]
            out[t] = h = new
        return out

    def gradients(self, bytes_: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time: gradients of x and h. d_out: (T, H, B)."""
        n = self.h.shape[1]
        gx, gh = np.zeros((256, 3 * n), np.float32), np.zeros_like(self.h)
        dh = np.zeros_like(d_out[0])
        da = np.empty((len(kept), 3 * n, d_out.shape[2]), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, rh, c = kept[t]
            dh = dh + d_out[t]
            dc = dh * z * (1 - c * c)
            drh = self.h[2 * n :].T @ dc
            da[t, :n] = dh * (c - h) * 0.25 * ((z > 0) & (z < 1))
            da[t, n : 2 * n] = drh * h * 0.25 * ((r > 0) & (r < 1))
            da[t, 2 * n :] = dc
            gh[: 2 * n] += da[t, : 2 * n] @ h.T
            gh[2 * n :] += dc @ rh.T
            dh = dh * (1 - z) + drh * r + self.h[: 2 * n].T @ da[t, : 2 * n]
        flat = bytes_.ravel()
        order = np.argsort(flat, kind="stable")
        firsts = np.flatnonzero(np.diff(flat[order].astype(int), prepend=-1))
        gx[flat[order][firsts]] = np.add.reduceat(da.transpose(0, 2, 1).reshape(-1, 3 * n)[order], firsts)
        return [gx.T, gh]


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Gru
    backward: Gru
    weights: np.ndarray
    bias: np.ndarray

    def logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = f.shape[1]
        return self.weights[:, :n] @ f + self.weights[:, n:] @ b + self.bias[:, None]

    def windows(self, bytes_: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, B) bytes, (T, B) mask -> (B, L) sums of the positions' probabilities."""
        # backwards a window begins with its padding, which must leave no trace
        p = self.logits(self.forward.states(bytes_), self.backward.states(bytes_[::-1], mask=mask[::-1])[::-1])
        np.clip(p, -40, 40, out=p)  # float32's exponential stays finite
        np.exp(p, out=p)
        p *= (mask / p.sum(1))[:, None]
        return p.sum(0).T

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages) mean probabilities over every position; zeros for empty texts."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t)
            if size >= WINDOW * BATCH or i + 1 == len(texts):
                self._add(out, texts, group)
                group, size = [], 0
        return out / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]

    def _add(self, out: np.ndarray, texts: list[bytes], group: list[int]) -> None:
        lengths = np.array([len(texts[i]) for i in group])
        counts = -(-lengths // WINDOW)
        flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
        mask = np.zeros(len(flat), np.float32)
        for i, n, at in zip(group, lengths, (np.cumsum(counts) - counts) * WINDOW):
            flat[at : at + n] = np.frombuffer(texts[i], np.uint8)
            mask[at : at + n] = 1
        flat, mask = flat.reshape(-1, WINDOW), mask.reshape(-1, WINDOW)
        owner = np.repeat(group, counts)
        for at in range(0, len(flat), BATCH):  # a long text takes several rounds
            part = self.windows(np.ascontiguousarray(flat[at : at + BATCH].T), np.ascontiguousarray(mask[at : at + BATCH].T))
            np.add.at(out, owner[at : at + BATCH], part)


def fit_language_model(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = 8, steps: int = 500, batch: int = 192, rate: float = 0.02, seed: int = 7) -> LanguageModel:
    """windows: (N, T) bytes; labels: (N,) indices into languages. Adam on each position's cross entropy."""
    rng = np.random.default_rng(seed)
    n, count = hidden, len(languages)
    model = LanguageModel(languages, Gru(n, rng), Gru(n, rng), rng.normal(0, 0.3, (count, 2 * n)).astype(np.float32), np.zeros(count, np.float32))
    params = [model.forward.x, model.forward.h, model.backward.x, model.backward.h, model.weights, model.bias]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x = np.ascontiguousarray(windows[pick].T)
        kf: list = []
        kb: list = []
        f, b = model.forward.states(x, kf), model.backward.states(x[::-1], kb)[::-1]
        p = model.logits(f, b)
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, labels[pick], np.arange(batch)] -= 1
        p /= p.shape[0] * batch
        grads = model.forward.gradients(x, kf, model.weights[:, :n].T @ p) + model.backward.gradients(x[::-1], kb, (model.weights[:, n:].T @ p)[::-1])
        grads += [np.concatenate([np.einsum("tlb,thb->lh", p, f, optimize=True), np.einsum("tlb,thb->lh", p, b, optimize=True)], axis=1), p.sum((0, 2))]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, a, c in zip(params, grads, m, v):
            np.clip(g, -0.5, 0.5, out=g)
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            q -= now * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-6)
    return model


def training_windows(docs: DataFrame, learnable: Column, per_language: int = 400, windows: int = 6, max_languages: int = 200) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """At most per_language x max_languages x windows rows of WINDOW bytes from learnable documents, of the languages with most ids.

    An id is one document, however many rows it has: its least language, and of several texts in it the one of least hash.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    # ids of least hash: a few more than per_language a language lie below its bound, however many ids and rows there are
    bound = lambda n: -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * (1.5 * per_language + 100) / n))
    below = F.lit(False)
    for lang, n in counts.items():
        below = below | ((F.col("lang") == lang) & (F.xxhash64("doc_id") <= F.lit(bound(n))))
    ids = rows.where(below).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = ids.withColumn("_tsr_n", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("_tsr_n") <= per_language).select("doc_id", "lang")
    raw = docs.select("doc_id", F.col("lang").alias("_tsr_lang"), F.col("text").cast("binary").alias("b")).where(F.length("b") > 0).join(F.broadcast(chosen), "doc_id").where(F.col("_tsr_lang") == F.col("lang"))
    start = lambda i: 1 + F.floor(F.greatest(F.octet_length("b") - WINDOW, F.lit(0)) * i / max(1, windows - 1)).cast("int")
    # a text's windows alone are grouped, never the text
    parts = raw.select("doc_id", "lang", F.struct(F.xxhash64("b").alias("h"), F.array(*[F.substring(F.col("b"), start(F.lit(i)), F.lit(WINDOW)) for i in range(windows)]).alias("w")).alias("x"))
    one = parts.groupBy("doc_id", "lang").agg(F.min("x").alias("x"))
    got = one.select("lang", "doc_id", F.explode("x.w").alias("w")).orderBy("lang", F.xxhash64("doc_id"), "w").select("lang", "w").toPandas()
    languages = sorted(got["lang"].unique())
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, w in enumerate(got["w"]):
        part = np.frombuffer(bytes(w), np.uint8)
        x[i] = np.resize(part, WINDOW)  # short texts repeat
    return x, np.searchsorted(languages, got["lang"].to_numpy()) if len(got) else np.zeros(0, int), list(languages)


def train(docs: DataFrame, per_language: int = 400, **how) -> LanguageModel | None:
    """Fit on documents with a lang whose crc32(doc_id) mod 4 is not 2."""
    x, y, languages = training_windows(docs, crc_mod(F.col("doc_id"), 4) != 2, per_language)
    return fit_language_model(x, y, languages, **how) if languages else None


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred and score."""

    @F.arrow_udf("k int, p double")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for (group,) in slices(texts, size=4 * WINDOW * BATCH):
                p = model.predict(group)
                yield pa.StructArray.from_arrays([pa.array(p.argmax(1), pa.int32()), pa.array(np.clip(p.max(1), 0, 1), pa.float64())], ["k", "p"])

    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    out = docs.withColumn("_tsr_best", best(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumn("lang_pred", F.when(letter, F.get(names, F.col("_tsr_best.k"))).otherwise(F.lit("und")))
    return out.withColumn("score", F.when(letter, F.col("_tsr_best.p")).otherwise(F.lit(0.0))).drop("_tsr_best")
