"""Quality rules with risk-controlled thresholds.

Each rule compares one text statistic with a cutoff. Per stratum, labelled
rows are halved by an id hash. The first half proposes, for each of a fixed
ladder of levels, the cutoffs that reject that share of good rows by each
rule. The second half certifies levels from the mildest on: a level holds if
an exact binomial test refutes "more than max_false_rejection of the good
documents that pass the base rule are rejected" at error / strata (Bonferroni over the strata; walking the ladder in
fixed order and stopping at the first failure needs no correction within one).
Certified cutoffs therefore reject at most that share of the good documents that
pass the base rule, in every stratum at once, except with probability `error`;
what the base rule rejects before is outside this promise. A doc_id is one trial
however often it comes. Strata are the languages
stated as parameters and one for all else, so their number is fixed.

Counts over labelled rows are sums over fixed integer grids: exact, one row a
grid cell, independent of partitioning. No row is sampled.

Defined cases: null and empty texts have no words and fail the base rule; a
stratum without enough labels certifies nothing and rejects by the base rule
alone; an empty table gives no rows, empty labels certify nothing; texts are
read whole whatever their length; repeated rows are judged alike, and an id with
several texts is one trial by its worst cells; columns are chosen by name, so
clashing ones are left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm._shared import cut, one_label

#: Rule statistics; each rejects above its cutoff. Those that start with "few" are 1 / (1 + x).
RULES = ("symbols", "dup_lines", "repeats", "long_words", "upper", "bangs", "bars", "few_chars", "few_words")
GRID = 1024
LEVELS = (0.0005, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.006, 0.008, 0.012, 0.016, 0.024)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_bars")


def repeated_window_words(words: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more in the list."""
    n = len(words)
    if n <= k:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    span, base = codes, len(known)
    for j in range(1, k):  # exact: codes are ranked anew before they could overflow
        if base * len(known) >= 1 << 62:
            _, span = np.unique(span, return_inverse=True)
            base = int(span.max()) + 1
        span = span[:-1] * len(known) + codes[j:]
        base *= len(known)
    _, at, counts = np.unique(span, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The STATS of one text, given as UTF-8."""
    if not text:
        return (0,) * 9
    words = text.split()  # bytes.split parts at exactly \x20 and \x09-\x0D
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(by[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), points - int(by[9:14].sum() + by[32]), int(by[list(b"#*$%&|<>")].sum()), len(lines) - len(set(lines)),
        repeated_window_words(words), len(lines), int(by[65:91].sum()), int(by[33]), int(by[124]),
    )


@F.pandas_udf(StructType([StructField(c, LongType()) for c in STATS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=STATS).astype("int64")


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the statistics of their texts and base_failed."""
    out = docs.withColumn("_tsr_stats", _stats(F.col("text").cast("binary")))
    out = out.withColumns({c: F.col(f"_tsr_stats.{c}") for c in STATS}).drop("_tsr_stats")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _cells() -> dict[str, Column]:
    """Every rule's statistic as a grid cell, 0 to GRID; larger is worse. x / (c + x) keeps order."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    part = {
        "symbols": F.col("n_symbols") / (F.col("n_symbols") + 0.25 * n), "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / (F.col("word_chars") + 8 * n), "upper": F.col("n_upper") / chars, "bangs": F.col("n_bangs") / (F.col("n_bangs") + 0.25 * n), "bars": F.col("n_bars") / (F.col("n_bars") + 0.25 * n),
        "few_chars": n / (n + F.col("word_chars")), "few_words": 10 / (10 + F.col("n_words")),
    }
    return {r: F.floor(GRID * part[r]).cast("int") for r in RULES}


def log_beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - log_beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(0, 2000):
        m = i // 2
        top = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (d * top + 1 or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly."""
    return 1.0 if k >= n else log_beta_cdf(1 - p, n - k, k + 1)


def propose(counts: dict[int, int], share: float) -> int:
    """Smallest cell above which lie at most that share of the counted rows."""
    total, above = sum(counts.values()), 0
    for cell in sorted(counts, reverse=True):
        above += counts[cell]
        if above > share * total:
            return cell
    return 0


def certify(rejected: list[int], n: int, limit: float, error: float) -> int:
    """How many levels, from the mildest, are proven to reject at most `limit`."""
    for level, k in enumerate(rejected):
        if not n or binomial_tail(k, n, limit) > error:
            return level
    return len(rejected)


def select_rules(stats: DataFrame, labels: DataFrame, languages: tuple[str, ...] = ("en", "de", "fr", "es"), max_false_rejection: float = 0.03, error: float = 0.05, label: str = "quality") -> dict[str, dict[str, int]]:
    """Certified cutoffs by stratum and rule. stats: with_stats() of documents, with doc_id and lang."""
    good = one_label(labels, label).where(F.col(label) == 1).select("doc_id")
    # one trial an id: of repeated rows the worst cells count
    rows = cut(stats.where(~F.col("base_failed")).select("doc_id", stratum(languages).alias("stratum"), *[c.alias(r) for r, c in _cells().items()]).join(good, "doc_id").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *[F.max(r).alias(r) for r in RULES]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))))
    first = rows.where("half = 0")
    # at most strata x rules x (GRID + 1) rows
    cells = first.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("cell")) for r in RULES])).alias("x")).groupBy("stratum", "x.rule", "x.cell").count().collect()
    counts: dict[str, dict[str, dict[int, int]]] = {}
    for s, rule, cell, n in cells:
        counts.setdefault(s, {}).setdefault(rule, {})[cell] = n
    ladder = {s: [{r: propose(by[r], share) for r in RULES} for share in LEVELS] for s, by in counts.items()}
    if not ladder:
        return {}

    def reject(cutoffs: dict[str, int]) -> Column:
        return reduce(lambda a, b: a | b, (F.col(r) > F.lit(k) for r, k in cutoffs.items()))

    # one row a stratum: its good rows, and how many of them each level rejects
    second = rows.where("half = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(reduce(lambda a, b: a | b, ((F.col("stratum") == s) & reject(steps[i]) for s, steps in ladder.items()))).alias(f"k{i}") for i in range(len(LEVELS))]).collect()
    chosen = {}
    for row in second:
        held = certify(list(row[2:]), row[1], max_false_rejection, error / (len(languages) + 1)) if row[0] in ladder else 0
        if held:
            chosen[row[0]] = ladder[row[0]][held - 1]
    return chosen


def stratum(languages: tuple[str, ...]) -> Column:
    return F.when(F.col("lang").isin(*languages), F.col("lang")).otherwise(F.lit("other"))


def apply_rules(stats: DataFrame, rules: dict[str, dict[str, int]], languages: tuple[str, ...] = ("en", "de", "fr", "es")) -> DataFrame:
    """stats with failed_rules (array) and kept."""
    cells, s = _cells(), stratum(languages)
    hits = [F.when(reduce(lambda a, b: a | b, ((s == name) & (cells[r] > F.lit(cutoffs[r])) for name, cutoffs in rules.items()), F.lit(False)), F.lit(r)) for r in RULES]
    out = stats.withColumn("failed_rules", F.array_compact(F.array(*hits)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, lang, statistics, base_failed, failed_rules, kept), one row a document."""
    stats = cut(with_stats(docs.select("doc_id", "text", "lang")).drop("text"))
    rules = select_rules(stats, labels, **how)
    return apply_rules(stats, rules, **{k: v for k, v in how.items() if k == "languages"})
