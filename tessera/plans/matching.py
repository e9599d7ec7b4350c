"""Labelled subgraph matching.

`extend` (default) grows partial matches by one query vertex at a time: neighbour lists are
indexed by the neighbours' label, and a partial match's candidates are the
intersection of the lists of all its bound neighbours, the smallest first. A candidate that doesn't close every edge
to what is bound is never a row; candidates stay an array until the next vertex needs them one by
one. The order comes from how many edges there are between two labels. `join` is
a chain of joins on edges, in an order from label counts.

Embeddings are injective and not induced; mirror images count. Data edges are
taken as undirected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import BROADCAST_ENTRIES, canonical, cut, deal, symmetrise
from tessera.sources.text import Pattern

#: Lists are parted by their elements' high bits, so none has more than 2**PREFIX elements.
PREFIX = 16


def label_counts(labels: DataFrame, patterns: list[Pattern]) -> dict[int, int]:
    """How many vertices carry each label that the patterns name."""
    wanted = sorted({x for p in patterns for x in p.labels})
    rows = labels.where(F.col("label").isin(wanted)).groupBy("label").count().collect()
    return {x: 0 for x in wanted} | {r[0]: r[1] for r in rows}


def join_order(pattern: Pattern, counts: dict[int, int]) -> list[int] | None:
    """Depth first from the rarest label, rarer neighbours first, then smaller ones; None if the pattern isn't connected."""
    key = lambda u: (counts.get(pattern.labels[u], 0), u)
    if not pattern.labels:
        return None
    order: list[int] = []
    stack = [min(range(len(pattern.labels)), key=key)]
    while stack:
        u = stack.pop()
        if u in order:
            continue
        order.append(u)
        stack += sorted(pattern.neighbours(u) - set(order), key=key, reverse=True)
    return order if len(order) == len(pattern.labels) else None


def labelled_edges(edges: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """(src, dst, ls, ld): both directions with the ends' labels. rows: as canonical() takes it."""
    both = symmetrise(canonical(edges, rows))
    one = labels.select("vertex", "label")
    return both.join(one.withColumnsRenamed({"vertex": "src", "label": "ls"}), "src").join(one.withColumnsRenamed({"vertex": "dst", "label": "ld"}), "dst")


def match_pattern(both: DataFrame, labels: DataFrame, pattern: Pattern, counts: dict[int, int], verticals: DataFrame | None = None) -> DataFrame:
    """(m0, m1, ...) by query vertex. both: labelled_edges(), best materialised.

    Each step joins the one edge list that holds both labels, on as many bound
    neighbours as the new vertex has: further query edges are semi joins on two keys.
    """
    spark = both.sparkSession
    names = [f"m{u}" for u in range(len(pattern.labels))]
    order = join_order(pattern, counts)
    if order is None:
        return spark.createDataFrame([], ", ".join(f"{n} bigint" for n in names) or "m0 bigint")

    def between(a: int, b: int) -> DataFrame:
        return both.where((F.col("ls") == pattern.labels[a]) & (F.col("ld") == pattern.labels[b])).select(F.col("src").alias(f"m{a}"), F.col("dst").alias(f"m{b}"))

    first = order[0]
    rows = labels.where(F.col("label") == pattern.labels[first]).select(F.col("vertex").alias(f"m{first}"))
    bound = [first]
    for u in order[1:]:
        near = [b for b in bound if b in pattern.neighbours(u)]
        rows = rows.join(between(near[0], u), f"m{near[0]}")
        # only vertices of the same label can be taken already
        same = [F.col(f"m{u}") != F.col(f"m{b}") for b in bound if pattern.labels[b] == pattern.labels[u]]
        if same:
            rows = rows.where(reduce(lambda a, b: a & b, same))
        for b in near[1:]:
            rows = rows.join(between(b, u), [f"m{b}", f"m{u}"], "left_semi")
        bound.append(u)
    return rows.select(*names)


def pair_counts(both: DataFrame, patterns: list[Pattern]) -> dict[tuple[int, int], int]:
    """How many edges of labelled_edges() run between the label pairs of the patterns' edges: a row a pair."""
    pairs = {(p.labels[a], p.labels[b]) for p in patterns for e in p.edges for a, b in (e, e[::-1])}
    named = sorted({x for pair in pairs for x in pair})
    rows = both.where(F.col("ls").isin(named) & F.col("ld").isin(named)).groupBy("ls", "ld").count().collect()
    return dict.fromkeys(pairs, 0) | {(r[0], r[1]): r[2] for r in rows if (r[0], r[1]) in pairs}


def extension_order(pattern: Pattern, counts: dict[int, int], pairs: dict[tuple[int, int], int]) -> list[int] | None:
    """The rarest edge first, then always the vertex that closes most edges to the bound ones, of those the one with fewest candidates a match; None if the pattern isn't connected."""
    if len(pattern.labels) <= 1:
        return [0] if pattern.labels else None
    if not pattern.edges:
        return None
    label = lambda u: pattern.labels[u]
    size = lambda a, b: pairs.get((label(a), label(b)), 0)
    order = list(min(pattern.edges, key=lambda e: (size(*e), e)))
    order.sort(key=lambda u: (counts.get(label(u), 0), u))
    while len(order) < len(pattern.labels):
        reach = {u for b in order for u in pattern.neighbours(b)} - set(order)
        if not reach:
            return None
        closes = lambda u: [b for b in order if b in pattern.neighbours(u)]
        each = lambda u: min(size(b, u) / max(1, counts.get(label(b), 0)) for b in closes(u))
        order.append(min(reach, key=lambda u: (-len(closes(u)), each(u), u)))
    return order


def label_lists(both: DataFrame) -> DataFrame:
    """(v, ls, ld, prefix, nbrs): the neighbours of label ld of each vertex, ascending, by their high bits."""
    return both.groupBy(F.col("src").alias("v"), "ls", "ld", F.shiftright("dst", PREFIX).alias("prefix")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def _common(lists: list[Column]) -> Column:
    """The intersection of array columns, the smallest first."""
    if len(lists) == 1:
        return lists[0]
    by_size = F.array_sort(F.array(*[F.struct(F.size(x).alias("n"), x.alias("x")) for x in lists]))
    return F.aggregate(F.slice(by_size, 2, len(lists) - 1), F.get(by_size, F.lit(0))["x"], lambda a, b: F.array_intersect(a, b["x"]))


def extend_pattern(lists: DataFrame, labels: DataFrame, pattern: Pattern, counts: dict[int, int], pairs: dict[tuple[int, int], int], steps: list[DataFrame] | None = None) -> DataFrame:
    """(m0, m1, ...) by query vertex. lists: label_lists(), best materialised. steps gathers the relations between the steps: matches so far, each with a non-empty array of candidates for the next vertex."""
    names = [f"m{u}" for u in range(len(pattern.labels))]
    order = extension_order(pattern, counts, pairs)
    if order is None:
        return lists.sparkSession.createDataFrame([], ", ".join(f"{n} bigint" for n in names) or "m0 bigint")
    label = lambda u: pattern.labels[u]
    if len(order) == 1:
        return labels.where(F.col("label") == label(0)).select(F.col("vertex").alias("m0"))

    def side(b: int, u: int, name: str) -> DataFrame:
        own = lists.where((F.col("ls") == label(b)) & (F.col("ld") == label(u))).select(F.col("v").alias(f"m{b}"), "prefix", F.col("nbrs").alias(name))
        # the number of its entries is known
        return F.broadcast(own) if pairs.get((label(b), label(u)), 0) <= BROADCAST_ENTRIES else own

    rows = side(order[0], order[1], "found")
    for k, u in enumerate(order[1:], 1):
        if steps is not None:
            steps.append(rows)
        bound = order[:k]
        rows = rows.select(*[f"m{b}" for b in bound], F.explode("found").alias(f"m{u}"))
        # only vertices of the same label can be taken already
        same = [F.col(f"m{u}") != F.col(f"m{b}") for b in bound if label(b) == label(u)]
        if same:
            rows = rows.where(reduce(lambda a, b: a & b, same))
        if k + 1 < len(order):
            new = order[k + 1]
            near = [b for b in order[: k + 1] if b in pattern.neighbours(new)]
            for i, b in enumerate(near):
                rows = rows.join(side(b, new, f"_n{i}"), [f"m{b}", "prefix"] if i else f"m{b}")
            rows = rows.withColumn("found", _common([F.col(f"_n{i}") for i in range(len(near))])).where(F.size("found") > 0)
            rows = rows.select(*[f"m{b}" for b in order[: k + 1]], "found")
    return rows.select(*names)


def match_patterns(edges: DataFrame, labels: DataFrame, patterns: list[Pattern], strategy: str = "extend") -> list[DataFrame]:
    """One DataFrame of embeddings a pattern."""
    counts = label_counts(labels, patterns)
    edges = cut(edges.select("src", "dst"))
    both = cut(labelled_edges(edges, labels, edges.count()))
    if strategy == "join":
        return [match_pattern(both, labels, p, counts) for p in patterns]
    if strategy != "extend":
        raise ValueError(f"strategy must be extend or join, not {strategy!r}")
    named = sorted({x for p in patterns for x in p.labels})
    lists = cut(label_lists(both.where(F.col("ls").isin(named) & F.col("ld").isin(named))))
    pairs = pair_counts(both, patterns)
    return [extend_pattern(lists, labels, p, counts, pairs) for p in patterns]


def match_counts(edges: DataFrame, labels: DataFrame, patterns: list[Pattern], strategy: str = "extend") -> DataFrame:
    """(query_id, n), patterns without embeddings included."""
    each = [m.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("query_id"), "n") for i, m in enumerate(match_patterns(edges, labels, patterns, strategy))]
    return reduce(DataFrame.union, each)


def match_packed(edges: DataFrame, labels: DataFrame, pattern: Pattern) -> DataFrame:
    """The same embeddings with bit-packed candidate sets: bound neighbours' packs are ANDed before they are unpacked."""
    from tessera.functions import sets

    order = join_order(pattern, label_counts(labels, [pattern]))
    names = [f"m{u}" for u in range(len(pattern.labels))]
    if order is None:
        return edges.sparkSession.createDataFrame([], ", ".join(f"{n} bigint" for n in names) or "m0 bigint")
    edges = cut(edges.select("src", "dst"))
    n = edges.count()
    both = labelled_edges(edges, labels, n)
    bits = both.select(F.col("src").alias("v"), F.col("ld").alias("label"), F.floor(F.col("dst") / sets.WIDTH).cast("bigint").alias("base"), F.expr(f"cast(pmod(dst, {sets.WIDTH}) as int)").alias("bit"))
    packs = cut(deal(bits, 2 * n, "v", "label", "base").groupBy("v", "label", "base").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("state")))
    rows = labels.where(F.col("label") == pattern.labels[order[0]]).select(F.col("vertex").alias(f"m{order[0]}"))
    for k, u in enumerate(order[1:], 1):
        bound = order[:k]
        near = [b for b in bound if b in pattern.neighbours(u)]
        own = packs.where(F.col("label") == pattern.labels[u]).select("v", "base", "state")
        for i, b in enumerate(near):
            side = own.select(F.col("v").alias(f"m{b}"), "base", F.col("state").alias(f"s{i}"))
            rows = rows.join(side, [f"m{b}", "base"] if i else f"m{b}")
        state = reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"s{i}") for i in range(len(near))])
        bits = F.filter(F.sequence(F.lit(0), F.lit(sets.WIDTH - 1)), lambda x: F.getbit("state", x) == 1)
        rows = rows.withColumn("state", state).where("state <> 0").select(*[f"m{b}" for b in bound], "base", F.explode(bits).alias("bit"))
        rows = rows.select(*[f"m{b}" for b in bound], (F.col("base") * sets.WIDTH + F.col("bit")).alias(f"m{u}"))
        for b in bound:
            if pattern.labels[b] == pattern.labels[u]:
                rows = rows.where(F.col(f"m{u}") != F.col(f"m{b}"))
    return rows.select(*names)
