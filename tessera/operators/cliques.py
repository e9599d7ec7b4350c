"""Maximal cliques.

`search` (default): every vertex is the root of the cliques in which it comes
first in an order. A state is a clique's members R, the candidates P that come
later and are next to all of R, and the excluded X, earlier and next to all of R. All is kept as
rows: the candidates, and the edges of a state that end in a candidate, which are the triangles that
its newest member makes. X holds only vertices next to a candidate, so a
hub that comes last costs its neighbours no more than the triangles they share. States with
many candidates or edges grow by one member, by joins, round after round; small ones
are searched by themselves, with pivots, on masks of as many bits as they have candidates. In degree order (default) a root has at most sqrt(2 E)
candidates; in degeneracy order no more than the degeneracy, for the price of the
k-core rounds. `levels` grows cliques by joins
alone; it lists every clique and is meant for graphs whose cliques are small.

Vertices without neighbours, id gaps too, are maximal cliques of one vertex. An
empty relation has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import canonical_plan, listed
from tessera.operators.cores import degeneracy_order
from tessera.operators.graph import canonical, cut, degrees, symmetrise, vertices
from tessera.operators.triangles import triangles

#: A state of no more candidates and edges than these is searched, a larger one grows by a member.
CANDIDATES, EDGES = 512, 2_000_000
#: Rows of roots that a task is to have.
ROWS = 1_000_000


def search_cliques(near: list[int], outer: list[int], among: int | None = None) -> Iterator[list[int]]:
    """The maximal cliques, as lists of places, of candidates whose neighbours are the masks `near`; none that lies within a mask of `outer`, an excluded vertex's neighbours. among: the mask of the candidates that count, all without it."""
    # a stack of (members, candidates, excluded ones' masks)
    stack: list[tuple[tuple[int, ...], int, list[int]]] = [((), (1 << len(near)) - 1 if among is None else among, outer)]
    while stack:
        members, cand, gone = stack.pop()
        if not cand:
            if not gone:
                yield list(members)
            continue
        # the vertex with most candidates about it covers them: a clique without it has one that it isn't next to
        cover, most, rest = 0, -1, cand
        while rest:
            low = rest & -rest
            rest ^= low
            mask = near[low.bit_length() - 1]
            if (n := (mask & cand).bit_count()) > most:
                cover, most = mask, n
        for mask in gone:
            if (n := (mask & cand).bit_count()) > most:
                cover, most = mask, n
        branch = cand & ~cover
        while branch:
            low = branch & -branch
            i = low.bit_length() - 1
            branch ^= low
            left = cand & near[i]
            # once candidates are left, an excluded vertex that is next to none of them no longer matters
            stack.append(((*members, i), left, [m for m in gone if m & low and (m & left or not left)]))
            cand ^= low
            gone = [*gone, near[i]]


def search_parts(near: list[int], outer: list[int]) -> Iterator[list[int]]:
    """The same as search_cliques, for one candidate or more, by linked parts of the candidates: a clique lies in one of them."""
    rest = (1 << len(near)) - 1
    while rest:
        part = todo = rest & -rest
        members = []
        while todo:
            low = todo & -todo
            i = low.bit_length() - 1
            members.append(i)
            todo ^= low
            todo |= near[i] & ~part
            part |= near[i]
        rest &= ~part
        inside = [m for x in outer if (m := x & part)]
        whole = all(near[i] | 1 << i == part for i in members)
        if not whole:
            yield from search_cliques(near, inside, part)
        elif part not in inside:
            yield members


def search_state(candidates: list[int], near: list[tuple[int, list[int]]], outer: list[list[int]]) -> Iterator[list[int]]:
    """A state's cliques without its members. near: (candidate, its neighbours among the candidates); outer: those of each excluded vertex."""
    place = {v: i for i, v in enumerate(candidates)}
    mask = lambda vs: sum(1 << place[v] for v in vs)
    masks = [0] * len(candidates)
    for v, others in near:
        masks[place[v]] = mask(others)
    for found in search_cliques(masks, [mask(vs) for vs in outer]):
        yield [candidates[i] for i in found]


def search_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[list[int]]:
    """The maximal cliques of roots. Rows: (root, candidate, -1), (root, candidate, later candidate next to it), (root, candidate, -2 - excluded vertex next to it)."""
    order = np.lexsort((b, a, root))
    root, a, b = root[order], a[order], b[order]
    own = b == -1
    # (root, candidate) once each, ascending as the rows are: an edge's a is that of the last one before it
    starts = np.flatnonzero(own)
    roots, first, n = np.unique(root[own], return_index=True, return_counts=True)
    at = np.searchsorted(roots, root)
    # an excluded vertex's rows come before its candidate's own
    place_a = np.cumsum(own) - np.where(b >= -1, 1, 0) - first[at]
    inner, outer = b >= 0, b < -1
    names, flat = np.unique(np.concatenate([a[own], b[inner]]), return_inverse=True)
    keys = np.repeat(np.arange(len(roots)), n) * len(names) + flat[: len(starts)]
    place_b = np.searchsorted(keys, at[inner] * len(names) + flat[len(starts) :]) - first[at[inner]]
    edges = place_a[inner].tolist(), place_b.tolist()
    # an excluded vertex's neighbours, one excluded vertex after the other
    by = np.lexsort((-b[outer], at[outer]))
    outs = place_a[outer][by].tolist(), b[outer][by].tolist()
    ends, out_ends = (np.searchsorted(at[x], np.arange(len(roots) + 1)).tolist() for x in (inner, outer))
    candidates, first, n = a[own].tolist(), first.tolist(), n.tolist()
    for k, v in enumerate(roots.tolist()):
        near = [0] * n[k]
        for e in range(ends[k], ends[k + 1]):
            x, y = edges[0][e], edges[1][e]
            near[x] |= 1 << y
            near[y] |= 1 << x
        gone: dict[int, int] = {}
        for e in range(out_ends[k], out_ends[k + 1]):
            gone[outs[1][e]] = gone.get(outs[1][e], 0) | 1 << outs[0][e]
        for found in search_parts(near, list(set(gone.values()))):
            yield sorted([v, *(candidates[first[k] + i] for i in found)])


def _ranked(both: DataFrame, order: str) -> DataFrame:
    """(v, rank) in a total order."""
    if order == "degeneracy":
        return degeneracy_order(both)
    if order == "degree":
        # any total order serves; ranks needn't be dense, so no sort is due
        return degrees(both, every=False).select("v", F.struct("deg", "v").alias("rank"))
    raise ValueError(f"order must be degree or degeneracy, not {order!r}")


def _triangles(forward: DataFrame, rank: DataFrame, order: str) -> DataFrame:
    """(p, q, r) of every triangle, by rank, of edges (p, q, rp, rq) with their ranks. Materialised."""
    pairs, ranges = canonical_plan(forward.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")))
    if ranges:
        # ranks of equal degree go by id, as they do there
        keys = rank.select("v", (F.col("rank")["deg"] if order == "degree" else F.col("rank")).alias("key"))
        return cut(listed(pairs, ranges, keys).toDF("p", "q", "r"))
    wedge = forward.join(forward.select("p", F.col("q").alias("r"), F.col("rq").alias("rr")), "p").where("rq < rr").select("p", "q", "r")
    return cut(wedge.join(forward.select(F.col("p").alias("q"), F.col("q").alias("r")), ["q", "r"], "left_semi"))


def _by_rank(both: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The edges (p, q) and triangles (p, q, r) of the graph, by rank.

    The root p has the candidates q. Every triangle p < q < r is an edge between candidates below p, and one from r to the excluded p below q.
    """
    rank = cut(_ranked(both, order))
    ranked = both.where("src < dst").join(rank.withColumnsRenamed({"v": "src", "rank": "rs"}), "src").join(rank.withColumnsRenamed({"v": "dst", "rank": "rd"}), "dst")
    first = F.col("rs") < F.col("rd")
    ends = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    forward = cut(ranked.select(ends("src", "dst").alias("p"), ends("dst", "src").alias("q"), ends("rs", "rd").alias("rp"), ends("rd", "rs").alias("rq")))
    return forward.select("p", "q"), _triangles(forward, rank, order)


def _roots(both: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    return _states(*_by_rank(both, order))


def _states(forward: DataFrame, tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states of one member: (id, v) rows of candidates, and (id, a, b, out) rows of edges from candidate a to candidate or (out) excluded vertex b; a comes before b where both are candidates."""
    edges = tri.select(F.explode(F.array(F.struct(F.col("p").alias("id"), F.col("q").alias("a"), F.col("r").alias("b"), F.lit(False).alias("out")), F.struct(F.col("q").alias("id"), F.col("r").alias("a"), F.col("p").alias("b"), F.lit(True).alias("out")))).alias("e")).select("e.*")
    return forward.select(F.array("p").alias("id"), F.col("q").alias("v")), edges.withColumn("id", F.array("id"))


def _searched_roots(forward: DataFrame, tri: DataFrame, large: DataFrame) -> DataFrame:
    """(clique) of the roots that aren't large. A root's rows move once, as three numbers each."""
    step = lambda root, a, b: F.struct(root.alias("root"), a.alias("a"), b.alias("b"))
    p, q, r = (F.col(c).cast("bigint") for c in "pqr")
    edges = tri.select(F.explode(F.array(step(p, q, r), step(q, r, F.lit(-2).cast("bigint") - p))).alias("e")).select("e.*")
    rows = forward.select(p.alias("root"), q.alias("a"), F.lit(-1).cast("bigint").alias("b")).union(edges).join(large.select(F.get("id", F.lit(0)).alias("root")), "root", "left_anti")
    tasks = max(forward.sparkSession.sparkContext.defaultParallelism, -(-(forward.count() + 2 * tri.count()) // ROWS))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cliques = search_roots(*(table[c].to_numpy() for c in ("root", "a", "b")))
        while out := list(islice(cliques, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["clique"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(list(batches)))

    dealt = rows.withColumn("_task", F.pmod(F.xxhash64("root"), F.lit(tasks))).repartition(tasks, "_task")
    return dealt.groupBy("_task").applyInArrow(whole, "clique array<bigint>")


def _grown(candidates: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each state's successors by one candidate: their candidates, their edges, and the ids of those that are maximal cliques."""
    one = lambda c: F.concat("id", F.array(c)).alias("id")
    # the neighbours of a candidate a in its state: later ones are its candidates, earlier ones and excluded vertices are excluded
    near = edges.select(one("a"), F.col("b").alias("v"), F.col("out").alias("out")).union(edges.where("not out").select(one("b"), F.col("a"), F.lit(True)))
    grown = candidates.select(one("v")).join(near, "id", "left").select("id", "v", "out")
    sizes = grown.groupBy("id").agg(F.count("v").alias("n"))
    inside = near.where("not out").select("id", "v")
    # an edge of the state stays in a successor whose new member is next to both its ends: the triangles of the state
    old = edges.select("id", "a", "b", "out")
    x, y = old.where("not out").select("id", F.col("a").alias("x"), F.col("b").alias("y")), old.select("id", F.col("a").alias("x"), F.col("b").alias("z"), "out")
    # x < y candidates, z a later candidate or excluded; the third side closes it
    wedge = x.join(y, ["id", "x"]).where("out or y < z or z < y")
    later = wedge.where("not out").join(old.where("not out").select("id", F.col("a").alias("y"), F.col("b").alias("z")), ["id", "y", "z"], "left_semi")
    with_out = wedge.where("out").join(old.where("out").select("id", F.col("a").alias("y"), F.col("b").alias("z")), ["id", "y", "z"], "left_semi")
    step = lambda new, a, b, out: F.struct(F.concat("id", F.array(new)).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(out).alias("out"))
    edges_in = later.select(F.explode(F.array(step("x", "y", "z", False), step("y", "z", "x", True))).alias("e"))
    edges_out = with_out.select(F.explode(F.array(step("x", "y", "z", True))).alias("e"))
    return inside, edges_in.union(edges_out).select("e.*"), sizes.where("n = 0").select("id")


def _searched(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(clique) of small states. Excluded vertices with the same neighbours are one."""
    near = edges.where("not out").select("id", F.col("a").alias("v"), F.col("b").alias("w")).union(edges.where("not out").select("id", F.col("b"), F.col("a")))
    near = near.groupBy("id", "v").agg(F.collect_list("w").alias("ws"))
    outer = edges.where("out").groupBy("id", "b").agg(F.sort_array(F.collect_list("a")).alias("ws")).select("id", "ws").distinct()
    own = candidates.join(near, ["id", "v"], "left").groupBy("id").agg(F.collect_list(F.struct("v", "ws")).alias("near"))
    states = own.join(outer.groupBy("id").agg(F.collect_list("ws").alias("outer")), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["clique"])
        for batch in batches:
            out: list[list[int]] = []
            for row in batch.to_pylist():
                near = [(r["v"], r["ws"] or []) for r in row["near"]]
                for found in search_state([v for v, _ in near], near, row["outer"] or []):
                    out.append(sorted([*row["id"], *found]))
                    if len(out) >= 50_000:
                        yield as_batch(out)
                        out = []
            yield as_batch(out)

    # dealt at random: a core's costly states have neighbouring ids
    return states.repartition(F.xxhash64("id")).mapInArrow(run, "clique array<bigint>")


def _by_states(both: DataFrame, order: str, most_candidates: int, most_edges: int) -> DataFrame:
    forward, tri = _by_rank(both, order)
    # no row moves for a count but those of the counts
    ends = tri.select(F.explode(F.array("p", "q")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    size = forward.groupBy("p").agg(F.count(F.lit(1)).alias("n")).join(ends, "p", "left")
    large = cut(size.where((F.col("n") > most_candidates) | (F.col("m") > most_edges)).select(F.array("p").alias("id")))
    found = _searched_roots(forward, tri, large)
    if large.isEmpty():
        return found
    candidates, edges = _states(forward, tri)
    while True:
        candidates, edges, done = _grown(candidates.join(large, "id", "left_semi"), edges.join(large, "id", "left_semi"))
        found = found.union(done.select(F.array_sort("id")))
        candidates, edges = cut(candidates), cut(edges)
        size = candidates.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(edges.groupBy("id").agg(F.count(F.lit(1)).alias("m")), "id", "left")
        large = cut(size.where((F.col("n") > most_candidates) | (F.col("m") > most_edges)).select("id"))
        found = found.union(_searched(candidates.join(large, "id", "left_anti"), edges.join(large, "id", "left_anti")))
        if large.isEmpty():
            return found


def maximal_cliques(edges: DataFrame, strategy: str = "search", order: str = "degree", most_candidates: int = CANDIDATES, most_edges: int = EDGES) -> DataFrame:
    """(clique): ascending vertex arrays."""
    edges = cut(edges.select("src", "dst"))
    both = cut(symmetrise(canonical(edges)))
    if strategy == "levels":
        found = _by_levels(edges)
    elif strategy == "search":
        found = _by_states(both, order, most_candidates, most_edges)
    else:
        raise ValueError(f"strategy must be search or levels, not {strategy!r}")
    single = vertices(edges).join(both.select(F.col("src").alias("v")).distinct(), "v", "left_anti")
    return found.union(single.select(F.array("v").alias("clique")))


def _by_levels(edges: DataFrame) -> DataFrame:
    """Cliques of two vertices or more, one size a round; maximal if no vertex is next to all members."""
    pairs, ranges = canonical_plan(canonical(edges))
    # what is next to both ends of an edge: the third vertices of its triangles, so no whole list goes to an edge
    tri = (listed(pairs, ranges) if ranges else triangles(pairs)).select(F.explode(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(z).alias("w")) for x, y, z in ("abc", "acb", "bca")])).alias("t")).select("t.*")
    shared = cut(tri.groupBy("src", "dst").agg(F.collect_list("w").alias("common")))
    found = pairs.join(shared, ["src", "dst"], "left_anti").select(F.array("src", "dst").alias("clique"))
    level = shared.select(F.array("src", "dst").alias("clique"), "common")
    first = shared.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("common").alias("next"))
    while True:
        grow = level.select("clique", "common", F.get("clique", F.lit(0)).alias("u"), F.explode(F.filter("common", lambda x: x > F.element_at("clique", -1))).alias("v"))
        # all of common is next to the first member, so what is next to the new one too is in those two's list
        level = cut(grow.join(first, ["u", "v"]).select(F.concat("clique", F.array("v")).alias("clique"), F.array_intersect("common", "next").alias("common")))
        if level.isEmpty():
            return found
        found = found.union(level.where(F.size("common") == 0).select("clique"))


def maximum_clique_size(cliques: DataFrame) -> DataFrame:
    return cliques.agg(F.coalesce(F.max(F.size("clique")), F.lit(0)).alias("maximum_clique_size"))


def clique_sizes(cliques: DataFrame) -> DataFrame:
    """(size, n)."""
    return cliques.groupBy(F.size("clique").alias("size")).agg(F.count(F.lit(1)).alias("n"))
