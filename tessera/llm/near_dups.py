"""Near-duplicate groups by HyperMinHash.

A text's set is its distinct five-word shingles. Each of 192 buckets has a hash
function of its own and keeps the least hash of the set, compressed to its
leading-zero count and ten mantissa bits. Some successive buckets make a band;
texts that agree in one band are candidates. Bands are as long as a miss
probability of MISS allows: 32 of 6 buckets at a similarity of 0.85 (a pair
just there is missed with probability 3e-7), 38 of 5 at 0.80 (3e-7).

No bucket emits its pairs. Equal sets are one node throughout. First each
band bucket links its members to its least member (a star): candidates pass by
the Jaccard similarity estimated from the registers, corrected for the chance of
equal compressed registers, seven standard deviations below the threshold; what
passes is confirmed on the full sets. Connected components follow. Buckets that
still hold several components are then compared in full: their members outside
the bucket's largest component with all others, block by block on the full
sets, whatever the bucket's size. Blocks are bounded by shingles and members,
their pairs stay inside one matrix product, and a block returns at most one
link for each component it joins. So every pair that shares a band is decided.

That second look costs (members outside the largest component) times (members)
of a bucket in arithmetic, though not in rows: copies that hang together are
settled by the star, a large crowd of texts just under the threshold is not.

Nothing is collected to the driver; loops end by counts. Intermediate tables go
to the shared folder.

Defined cases: null and empty texts have an empty set and are groups of their
own; an empty table gives no rows; texts of any length are one set each; fewer
than five words are one shingle; rows that repeat an id and text are one node;
null ids count as larger than any in component_id; an id with several texts
joins a group by each of them; clashing columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from tessera.llm._shared import BROADCAST_ROWS, cut, give_back, slices

WORDS, REGISTERS, MANTISSA = 5, 192, 10
#: Largest probability that a pair at the threshold shares no band.
MISS = 1e-6
#: Shingles in a block of the full comparison; a member counts as 256 more, so a block has at most 1,024 of them.
BLOCK, MEMBER = 1 << 18, 256
#: Links that a task joins at a time.
LINKS = 100_000

_rng = np.random.default_rng(20)
_MULT = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased and words part at \\x20 and \\x09-\\x0D."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, WORDS)
    out = np.full(n - k + 1, k, np.uint64)  # k, so that a short text equals no shingle of a longer one
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    return np.unique(_mix(out))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of the set in each bucket."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048] * _MULT + _ADD).min(axis=1), out=least)
    return least


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (0 to 32) and the bits after the leading one, in 16 bits."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    mantissa = np.where(least > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0)
    return ((32 - exponent).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


@F.arrow_udf(StructType([StructField("n", LongType()), StructField("node", BinaryType()), StructField("regs", BinaryType())]))
def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for (group,) in slices(texts):
            sets = [shingle_set(t) for t in group]
            regs = compress(np.array([least_hashes(s) for s in sets])).astype("<u2")
            yield pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["n", "node", "regs"])


@F.arrow_udf(StructType([StructField("node", BinaryType()), StructField("shingles", BinaryType())]))
def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for (group,) in slices(texts):
            sets = [shingle_set(t) for t in group]
            yield pa.StructArray.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "shingles"])


@F.arrow_udf(LongType())
def _shared_size(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        for left, right in slices(a, b):
            yield pa.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(left, right)], pa.int64())


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity from registers, corrected for chance collisions of compressed ones."""
    x = np.frombuffer(b"".join(a), "<u2").reshape(-1, REGISTERS)
    y = np.frombuffer(b"".join(b), "<u2").reshape(-1, REGISTERS)
    chance = 0.7 / (1 << MANTISSA)  # two unlike registers share the leading zeros and all mantissa bits
    return pd.Series(((x == y).mean(axis=1) - chance) / (1 - chance))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, _tsr_text, n, node, regs): hash of the text, set size, digest of the set, registers."""
    return docs.select("doc_id", F.xxhash64("text").alias("_tsr_text"), _sketch(F.col("text").cast("binary")).alias("s")).select("doc_id", "_tsr_text", "s.n", "s.node", "s.regs")


def _short(node: Column) -> Column:
    """64 bits of a node's digest; two nodes that share them only bring each other more candidates."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of the links (a, b) of a task: each node and the least one it is linked with here. Links are gathered by LINKS, of those before a row a node stays."""
    seen, known, rows = [], (np.empty(0, object), np.empty(0, object)), 0

    def join() -> tuple[np.ndarray, np.ndarray]:
        sides = ([x, *(b[c].to_numpy(zero_copy_only=False) for b in seen)] for x, c in zip(known, ("a", "b")))
        a, b = map(np.concatenate, sides)
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label, left, right = np.arange(len(names)), at[: len(a)], at[len(a) :]
        while len(left):
            x, y = label[left], label[right]
            apart = x != y
            left, right, x, y = left[apart], right[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label = up
        return names, names[label]

    for batch in batches:
        seen.append(batch)
        rows += batch.num_rows
        if rows >= LINKS:
            known, seen, rows = join(), [], 0
    nodes, comps = join() if seen else known
    for at in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000], pa.binary()) for x in (nodes, comps)], ["node", "comp"])
    give_back()


def _components(links: DataFrame) -> DataFrame:
    """(node, comp) of every linked node; comp is the least node reachable. links: materialised (a, b).

    Tasks of some LINKS links join these by themselves, without an exchange; of
    one task, that is all. Else each round takes the least label among
    neighbours and then that label's own label, so the number of rounds grows
    with the logarithm of a chain.
    """
    tasks = max(1, -(-links.count() // LINKS))
    own = cut(links.select("a", "b").coalesce(tasks).mapInArrow(_linked, "node binary, comp binary"))
    if tasks == 1:
        return own
    both = cut(own.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(own.select("comp", "node")).distinct())
    comp = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(comp, both["b"] == comp["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = comp.join(near, comp["node"] == near["a"]).select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        labels = step.select(F.col("node").alias("at"), F.col("comp").alias("jump"))
        new = cut(step.join(labels, step["comp"] == labels["at"]).select("node", F.least("comp", "jump").alias("comp"), "old"))
        if new.where(F.col("comp") != F.col("old")).isEmpty():
            return new.select("node", "comp")
        comp = new.select("node", "comp")


def band_size(percent: int) -> int:
    """Buckets in a band: as many as keep the probability of sharing no band, at the threshold, within MISS."""
    return max((k for k in range(1, REGISTERS) if (1 - (percent / 100) ** k) ** (REGISTERS // k) <= MISS), default=1)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of wanted (label, node). Materialised."""
    keys = wanted.select(F.col("label").alias("_label"), F.col("node").alias("_node"))
    small = keys.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = texts.join(F.broadcast(keys.select("_label").distinct()) if small else keys.select("_label").distinct(), texts["doc_id"].eqNullSafe(F.col("_label")), "left_semi")
    # not deterministic to Catalyst: else filters on the result move below the first join, and sets are made of all texts
    sets = texts.select(_sets.asNondeterministic()("text").alias("s")).select("s.*")
    return cut(sets.join(keys.select("_node"), F.col("node") == F.col("_node")).select("node", "shingles").dropDuplicates(["node"]))


def _star_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) digests of the pairs (x, y) of short nodes whose sets are similar enough. Materialised."""
    regs = nodes.select("short", "n", "regs")
    seen = pairs.join(regs.select(F.col("short").alias("x"), F.col("n").alias("nx"), F.col("regs").alias("rx")), "x").join(regs.select(F.col("short").alias("y"), F.col("n").alias("ny"), F.col("regs").alias("ry")), "y")
    # sets of too unlike sizes can't be similar; then the estimate, seven standard deviations below
    seen = seen.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    j = percent / 100
    likely = cut(seen.where(_estimate("rx", "ry") >= j - 7 * (j * (1 - j) / REGISTERS) ** 0.5).select("x", "y"))
    wanted = likely.select(F.col("x").alias("short")).union(likely.select("y")).distinct()
    sets = _sets_of(docs, cut(nodes.select("short", "node", "label").join(wanted, "short"))).withColumn("short", _short(F.col("node")))
    left = sets.select(F.col("short").alias("x"), F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("short").alias("y"), F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = likely.join(left, "x").join(right, "y").where(F.col("a") != F.col("b"))
    sized = both.select("a", "b", (F.octet_length("sa") / 8 + F.octet_length("sb") / 8).cast("long").alias("sum"), _shared_size("sa", "sb").alias("common"))
    return cut(sized.where(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b"))


def _shared_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets (rows) and the right ones; a matrix product over a few thousand shingles at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times > 1  # what one set alone has is in no intersection
    owner, column = owner[keep[column]], (np.cumsum(keep) - 1)[column[keep[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    step = 2048
    for at in range(0, int(keep.sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _block_links(percent: int):
    """Of the sets in the blocks (rows with m = i, rows with m = j), the links between components: one for each that a link joins."""

    def links(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, "<u8") for x in rows["shingles"].to_pylist()]
        comps, m = rows["comp"].to_pylist(), rows["m"].to_numpy()
        ids = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]
        left, right = np.nonzero(m == rows["i"][0].as_py())[0], np.nonzero(m == rows["j"][0].as_py())[0]
        sizes = np.array([len(s) for s in sets], np.int64)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            common = _shared_sizes(sets, left, right)
            similar = (100 * common >= percent * (sizes[left][:, None] + sizes[right][None] - common)) & (ids[left][:, None] != ids[right][None])
            top = list(range(len(comps)))  # of component numbers

            def root(c: int) -> int:
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            for x, y in zip(*(k.tolist() for k in np.nonzero(similar))):
                p, q = root(ids[left[x]]), root(ids[right[y]])
                if p != q:
                    top[p] = q
                    found.append((left[x], right[y]))
            del common, similar
        give_back()
        return pa.table({"a": pa.array([comps[x] for x, _ in found], pa.binary()), "b": pa.array([comps[y] for _, y in found], pa.binary())})

    return links


def _links_across(docs: DataFrame, members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) components that a pair of similar sets in a bucket joins. members: (band, short); nodes: (short, node, label, n, comp). Materialised."""
    rows = members.join(nodes, "short").select("band", "node", "label", "n", "comp")
    weight = F.col("n") + MEMBER
    per = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(weight).alias("w"))
    # the star has compared buckets of two
    mixed = per.groupBy("band").agg(F.max(F.struct("k", "w", "comp")).alias("main"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps")).where((F.col("comps") > 1) & (F.col("k") > 2))
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    mixed = mixed.select("band", F.col("main.comp").alias("main"), blocks(F.col("w") - F.col("main.w")).alias("others"), blocks(F.col("main.w")).alias("mains"))
    # block m of a member: those outside the largest component come first; blocks i <= j meet where i is one of these
    h = F.xxhash64("node")
    rows = cut(rows.join(mixed, "band").withColumn("m", F.when(F.col("comp") == F.col("main"), F.col("others") + F.pmod(h, "mains")).otherwise(F.pmod(h, "others")).cast("int")).drop("main"))
    if rows.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    sets = _sets_of(docs, rows.select("label", "node").distinct())
    meets = F.sequence(F.lit(0), F.when(F.col("m") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1)
    tasks = rows.select("band", "node", "comp", "m", F.explode(meets).alias("o")).select("band", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), "m", "node", "comp")
    return cut(tasks.join(sets, "node").select("band", "i", "j", "m", "comp", "shingles").groupBy("band", "i", "j").applyInArrow(_block_links(percent), "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, _tsr_text, n_shingles, component_id, node), one row a row of docs (doc_id, text)."""
    sketch = cut(sketches(docs))
    # equal sets have equal registers, so any copy's will do
    nodes = cut(sketch.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("regs").alias("regs")).withColumn("short", _short(F.col("node"))))
    size = band_size(percent)
    bands = nodes.select("short", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * size * i + 1, 2 * size)) for i in range(REGISTERS // size)])).alias("band"))
    hubs = bands.groupBy("band").agg(F.min("short").alias("hub"), F.max("short").alias("last")).where(F.col("hub") != F.col("last")).drop("last")
    members = cut(bands.join(hubs, "band"))  # of the buckets with several nodes
    star = _star_links(docs, nodes, members.where(F.col("short") != F.col("hub")).select(F.col("hub").alias("x"), F.col("short").alias("y")).distinct(), percent)
    of_node = nodes.select("short", "node", "label", "n").join(_components(star), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_node = cut(of_node)
    more = _links_across(docs, members.select("band", "short"), of_node, percent)
    if not more.isEmpty():
        joined = _components(more).withColumnsRenamed({"node": "_tsr_comp", "comp": "_tsr_top"})
        of_node = of_node.join(joined, F.col("comp") == F.col("_tsr_comp"), "left").withColumn("comp", F.coalesce("_tsr_top", "comp"))
    # ids: the least of a component's nodes'
    # from a table, so that the join can split the partition of a large component
    least = cut(of_node.groupBy("comp").agg(F.min("label").alias("component_id")))
    ids = of_node.join(least, "comp").select("node", "component_id")
    out = sketch.select("doc_id", "_tsr_text", F.col("n").alias("n_shingles"), "node").join(ids, "node", "left")
    return out.select("doc_id", "_tsr_text", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the documents (doc_id, text) whose own set's group has a smaller doc_id; null ids are larger than any.

    Rows that repeat an id and text are one document and stay or go together.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), percent)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_tsr_id"), F.col("_tsr_text").alias("_tsr_key")).distinct()
    # once: counted and joined from a table, not from the groups' plan
    gone = cut(gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_tsr_id")) & (F.xxhash64(docs["text"]) == F.col("_tsr_key")), "left_anti")
