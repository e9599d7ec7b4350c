"""Triangles and cliques by blocks of id ranges: against plain versions, and what goes to the cells."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, cliques, triangles


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def plain(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return sorted((a, b, c) for a, b in pairs for c in near[a] & near[b] if c > b)


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("edges_a_cell", [1_500_000, 60, 25])
def test_all_methods(spark, monkeypatch, edges_a_cell):
    monkeypatch.setattr(blocks, "CELL_EDGES", edges_a_cell)
    monkeypatch.setattr(blocks, "COPIES", 10_000)
    monkeypatch.setattr(blocks, "PATHS", 50)
    pairs = sorted({*random_graph(40, 160, 1), *((0, i) for i in range(1, 40)), *((a + 60, b + 60) for a, b in random_graph(20, 60, 2))})
    want = plain(pairs)
    e = frame(spark, [(b, a) for a, b in pairs] + pairs)
    found, plan = blocks.canonical_plan(triangles.canonical(e))
    assert plan is not None and (len(plan.cells) > 1) == (edges_a_cell < 1000)
    for method in triangles.METHODS:
        assert triangles.triangle_count(e, method, undirected=True).first()[0] == len(want) > 0
    assert sorted(tuple(r) for r in triangles.triangles(e).collect()) == want
    n = {v: sum(v in t for t in want) for v in range(80)}
    assert {r["v"]: r["n"] for r in triangles.triangles_per_vertex(e).collect()} == {v: k for v, k in n.items() if k}
    assert blocks.dealt(found, plan).groupBy("cell").count().agg(F.max("count")).first()[0] <= edges_a_cell


def test_edges_go_to_few_cells(spark, monkeypatch):
    """Thirty parts that aren't linked: copies of an edge don't grow with the graph, as they did with hashed parts."""
    monkeypatch.setattr(blocks, "CELL_EDGES", 1500)
    for copies in (6, 30):
        e = frame(spark, [(a + 60 * i, b + 60 * i) for i in range(copies) for a, b in random_graph(60, 600, i)])
        found, plan = blocks.canonical_plan(triangles.canonical(e))
        assert blocks.dealt(found, plan).count() <= 4 * found.count()


def test_no_ranges_serve(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_EDGES", 1)
    pairs = random_graph(20, 60, 4)
    e = frame(spark, pairs)
    assert blocks.canonical_plan(triangles.canonical(e))[1] is None
    for method in triangles.METHODS:
        assert triangles.triangle_count(e, method, undirected=True).first()[0] == len(plain(pairs))
    assert len(cliques.maximal_cliques(e).collect()) == len(cliques.maximal_cliques(e, "levels").collect())


@pytest.mark.parametrize("edges_a_cell", [1_500_000, 30])
def test_cliques_by_blocks(spark, monkeypatch, edges_a_cell):
    monkeypatch.setattr(blocks, "CELL_EDGES", edges_a_cell)
    monkeypatch.setattr(blocks, "COPIES", 10_000)
    pairs = sorted({*random_graph(30, 130, 5), *itertools.combinations(range(34, 40), 2)})
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(40)}
    want = set()

    def grow(r, p, x):
        if not p and not x:
            want.add(tuple(sorted(r)))
        for v in sorted(p):
            grow([*r, v], p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow([], set(range(40)), set())
    for how in ({}, {"order": "degeneracy"}, {"most_candidates": 3}, {"strategy": "levels"}):
        found = [tuple(r[0]) for r in cliques.maximal_cliques(frame(spark, pairs), **how).collect()]
        assert len(found) == len(set(found)) and set(found) == want
