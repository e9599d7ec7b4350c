"""Degeneracy orders, the triangle grid and clique states: against plain versions, and on graphs with hubs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cliques, cores, graph, triangles


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def plain_cliques(pairs):
    near, out = neighbours(pairs), set()

    def grow(r, p, x):
        if not p and not x:
            out.add(tuple(sorted(r)))
        for v in sorted(p):
            grow([*r, v], p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow([], set(near), set())
    return out


def plain_degeneracy(pairs):
    near, most = {v: set(n) for v, n in neighbours(pairs).items()}, 0
    while near:
        v = min(near, key=lambda u: len(near[u]))
        most = max(most, len(near[v]))
        for u in near.pop(v):
            near[u].discard(v)
    return most


TREE = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]
GRAPHS = {"tree": TREE, "path": [(i, i + 1) for i in range(12)], "dense": random_graph(24, 140, 1), "sparse": random_graph(60, 90, 2), "star and clique": [*((0, i) for i in range(1, 30)), *itertools.combinations(range(25, 32), 2)]}


@pytest.mark.parametrize("name", ["tree", "path", "dense", "star and clique"])
def test_degeneracy_order_keeps_its_bound(spark, name):
    pairs = GRAPHS[name]
    e = graph.cut(frame(spark, [(b, a) for a, b in pairs]))
    order = graph.cut(cores.degeneracy_order(e))
    rank = {r["v"]: r["rank"] for r in order.collect()}
    assert sorted(rank.values()) == list(range(len(rank)))
    near = neighbours(pairs)
    later = {v: sum(rank[u] > rank[v] for u in near.get(v, ())) for v in rank}
    assert max(later.values()) == plain_degeneracy(pairs) == cores.degeneracy(e).first()[0]
    assert {r["v"]: r["later"] for r in cores.later_neighbours(e, order).collect()} == later


def test_peeling_of_nothing(spark):
    assert cores.degeneracy_order(frame(spark, [])).count() == 0
    # loops and gaps are vertices without neighbours
    assert {tuple(r) for r in cores.peeling(frame(spark, [(2, 2), (3, 3)])).collect()} == {(v, 0, 1) for v in range(4)}


def test_empty_graphs(spark):
    """Nothing in, nothing out; an observation of no rows is one too."""
    from tessera.operators import reorder

    none = frame(spark, [])
    assert [f(none).count() for f in (reorder.bfs_levels, reorder.bfs_order, reorder.rcm_order, cores.core_numbers, cliques.maximal_cliques)] == [0] * 5
    loop = frame(spark, [(2, 2)])
    assert sorted(tuple(r) for r in reorder.bfs_levels(loop).collect()) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert sorted(tuple(r) for r in reorder.bfs_order(loop).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_grid_counts(spark):
    for pairs in (GRAPHS["dense"], GRAPHS["star and clique"]):
        near = neighbours(pairs)
        want = sum(len(near[a] & near[b]) for a, b in pairs) // 3
        for parts in (2, 3, 7):
            one = graph.degree_oriented(frame(spark, pairs))
            assert triangles._by_cells(one, one, parts).agg(F.sum("c")).first()[0] == want
    # the directed rule: w < u < v with u->v, u->w, v->w
    rng = random.Random(3)
    arcs = {tuple(rng.sample(range(15), 2)) for _ in range(120)}
    want = sum((u, v) in arcs and (u, w) in arcs and (v, w) in arcs for w, u, v in itertools.combinations(range(15), 3))
    assert triangles.triangle_count(frame(spark, arcs), "grid").first()[0] == want > 0
    assert triangles.triangle_count(frame(spark, []), "grid").first()[0] == 0


def test_grid_spreads_hubs(spark):
    """A hub of a million edges beside a clique: no task has more than a small multiple of its share."""
    hub = spark.range(1, 1_000_001).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    ring = frame(spark, itertools.combinations(range(1_000_001, 1_000_301), 2))
    e = graph.cut(hub.union(ring))
    parts = triangles.grid_parts(e.count(), 20_000)
    cells = triangles.grid_cells(e, parts)
    # a cell has a hub's edges to three parts at most
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 1.2 * 3 * 1_000_000 / parts
    tasks = [r[0] for r in cells.repartition(8, "cell").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(tasks) == 8 and max(tasks) <= 3 * sum(tasks) / 8
    assert triangles.triangle_count(e, "grid", undirected=True).first()[0] == 300 * 299 * 298 // 6


@pytest.mark.parametrize("name", ["dense", "sparse", "star and clique"])
def test_clique_states(spark, name):
    pairs = GRAPHS[name]
    want = plain_cliques(pairs)
    e = graph.cut(frame(spark, pairs))
    singles = {(v,) for v in range(max(map(max, pairs)) + 1)} - {(v,) for v in neighbours(pairs)}
    for limits, order in (((512, 10**6), "degree"), ((3, 10**6), "degree"), ((2, 10**6), "degeneracy"), ((512, 4), "degree")):
        found = [tuple(r[0]) for r in cliques.maximal_cliques(e, order=order, most_candidates=limits[0], most_edges=limits[1]).collect()]
        assert len(found) == len(set(found)) and set(found) == want | singles


def test_cliques_beside_a_hub(spark):
    """Two hubs share 200,000 neighbours: no state has more candidates than a small number, and masks are that small."""
    n = 200_000
    leaves = spark.range(2, n + 2)
    e = graph.cut(leaves.select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst")).union(leaves.select(F.lit(1).cast("bigint"), "id")).union(frame(spark, [(0, 1), (2, 3), (3, 4), (2, 4)])))
    candidates, _ = cliques._roots(graph.cut(graph.symmetrise(e)), "degree")
    assert candidates.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    sizes = {r["size"]: r["n"] for r in cliques.clique_sizes(cliques.maximal_cliques(e)).collect()}
    assert sizes == {3: n - 3, 5: 1}
