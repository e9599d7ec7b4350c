"""Closed forms, differential checks and properties of the graph operators."""

import itertools
import math

import plain_orders
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import sets, synth
from tessera.functions.queues import BucketQueue, OrderedPool, ReducibleHeap
from tessera.operators import cliques, cores, graph, ids, reorder, stats, triangles
from tessera.plans import matching
from tessera.sources import text
from tessera.sources.text import Pattern


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def both(pairs):
    return [*pairs, *((b, a) for a, b in pairs)]


def complete(n):
    return list(itertools.combinations(range(n), 2))


MOON = [(a, b) for a, b in complete(9) if a % 3 != b % 3]
CASES = {  # name: edges, triangles, maximal cliques, largest core
    "K5": (complete(5), 10, 1, 4),
    "C5": ([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], 0, 5, 2),
    "star": ([(0, i) for i in range(1, 5)], 0, 4, 1),
    "K33": ([(a, b) for a in range(3) for b in range(3, 6)], 0, 9, 3),
    "moon": (MOON, 27, 27, 6),
    "gap": ([(0, 1), (3, 4)], 0, 3, 1),
    "loops": ([(0, 1), (1, 2), (0, 2), (0, 2), (1, 1)], 1, 1, 2),
}


@pytest.mark.parametrize("name", ["K5", "moon", "gap", "loops"])
def test_closed_forms(spark, name):
    pairs, tri, n_cliques, core = CASES[name]
    e = graph.cut(frame(spark, both(pairs)))
    assert [triangles.triangle_count(e, s).first()[0] for s in ("array", "wedge", "bsr", "grid")] == [tri] * 4
    assert triangles.triangle_count(frame(spark, pairs), undirected=True).first()[0] == tri
    found = {tuple(r[0]) for r in cliques.maximal_cliques(e).collect()}
    assert len(found) == n_cliques
    assert found == {tuple(r[0]) for r in cliques.maximal_cliques(e, "levels").collect()}
    assert cores.degeneracy(e).first()[0] == core


def test_small_kernels():
    for pairs, tri, n_cliques, _ in CASES.values():
        near = {v: {b for a, b in both(pairs) if a == v} - {v} for v in range(max(map(max, pairs)) + 1)}
        n = 0
        for v in near:
            later, earlier = sorted(x for x in near[v] if x > v), sorted(x for x in near[v] if x < v)
            n += len(list(cliques.search_state(later, [(x, sorted(near[x] & set(later))) for x in later], [sorted(near[x] & set(later)) for x in earlier])))
        assert n == n_cliques
    assert list(cliques.search_cliques([], [])) == [[]] and list(cliques.search_cliques([], [0])) == []


def test_directed_rule(spark):
    assert triangles.triangle_count(frame(spark, [(0, 1), (1, 2), (0, 2)])).first()[0] == 0
    assert triangles.triangle_count(frame(spark, [])).first()[0] == 0
    assert cliques.maximal_cliques(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        triangles.triangle_count(frame(spark, []), "fast")


def test_degeneracy_roots(spark):
    e = frame(spark, both(MOON))
    assert cliques.maximal_cliques(e, order="degeneracy").count() == 27
    ranks = [r["rank"] for r in cores.degeneracy_order(e).collect()]
    assert sorted(ranks) == list(range(9))


def test_parsers(spark):
    lines = ["# c", "% c", "", "1\t2", "3 4", "5  6", "7 8\r", "9 10 11", "x y"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in text.parse_edges(df).collect()] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    assert [r[0] for r in text.malformed_lines(df).collect()] == ["x y"]
    strict = [tuple(r) for r in text.parse_edges(df, "strict").collect()]
    assert strict == [(0, 0), (0, 0), (1, 2), (3, 4), (5, 0), (7, 8), (9, 10), (0, 0)]
    with pytest.raises(ValueError):
        text.parse_edges(df, "loose")
    p = text.parse_patterns("3 2\n5\n6\n5\n1 0\n2 1\n1 0\n7\n")
    assert p == [Pattern((5, 6, 5), ((0, 1), (1, 2))), Pattern((7,))]
    assert p[0].echo() == "query: v_num=3 e_num=2\n5 6 5 \n0 1\n1 2\n"
    assert text.parse_patterns("".join(x.block() for x in p)) == p
    assert text.output_name("d/graph.txt", "GRO", ids=True) == "d/graph_GRO_newID.txt"


def test_files(spark, tmp_path):
    e = frame(spark, [(0, 1), (2, 3)])
    text.write_edges(e, f"{tmp_path}/e")
    assert {tuple(r) for r in text.read_edges(spark, f"{tmp_path}/e").collect()} == {(0, 1), (2, 3)}
    (tmp_path / "raw.txt").write_text("#x\nb a\na c\n")
    raw = text.read_raw_edges(spark, f"{tmp_path}/raw.txt")
    new = ids.densify_first_seen(raw)
    assert {r[0]: r[1] for r in new.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {tuple(r) for r in ids.relabel_raw(raw, new, True).collect()} == {(0, 1), (1, 2), (1, 0), (2, 1)}
    (tmp_path / "lab.txt").write_text("1 7\n0 5\n")
    assert {tuple(r) for r in text.read_labels(spark, f"{tmp_path}/lab.txt").collect()} == {(1, 7), (0, 5)}
    (tmp_path / "q.txt").write_text("1 0\n7\n")
    assert text.read_patterns(spark, f"{tmp_path}/q.txt") == [Pattern((7,))]
    c = spark.createDataFrame([([3, 1],)], "clique array<bigint>")
    assert text.clique_lines(c).first()[0] == "1 3" and text.clique_lines(c, braces=True).first()[0] == "{1,3}"


def brute_matches(pairs, labels, p):
    near = set(both(pairs))
    return {m for m in itertools.permutations(range(len(labels)), len(p.labels)) if all(labels[v] == x for v, x in zip(m, p.labels)) and all((m[a], m[b]) in near for a, b in p.edges)}


@pytest.mark.parametrize("p", [Pattern((0,)), Pattern((0, 1, 0), ((0, 1), (1, 2))), Pattern((0, 0, 0), ((0, 1), (1, 2), (0, 2))), Pattern((0, 1, 0, 1), ((0, 1), (1, 2), (2, 3), (0, 3)))])
def test_matching(spark, p):
    labels = [0, 1, 0, 0, 1, 0]
    pairs = [(0, 1), (1, 2), (2, 3), (0, 2), (3, 4), (4, 5), (0, 4), (0, 3), (2, 4)]
    lab = spark.createDataFrame(list(enumerate(labels)), "vertex bigint, label bigint")
    found = {tuple(r) for r in matching.match_patterns(frame(spark, both(pairs)), lab, [p])[0].collect()}
    assert found == brute_matches(pairs, labels, p)
    assert found == {tuple(r) for r in matching.match_packed(frame(spark, pairs), lab, p).collect()}


def test_no_match(spark):
    lab = spark.createDataFrame([(0, 0), (1, 1)], "vertex bigint, label bigint")
    e = frame(spark, [(0, 1)])
    assert matching.match_patterns(e, lab, [Pattern((0, 9), ((0, 1),))])[0].count() == 0
    apart = matching.match_patterns(e, lab, [Pattern((0, 1))])[0]
    assert apart.count() == 0 and apart.columns == ["m0", "m1"]
    assert matching.join_order(Pattern((5, 6, 5), ((0, 1), (1, 2))), {5: 9, 6: 1}) == [1, 0, 2]


GRAPH = [(a, (a * a * 7 + 3 * k) % 60) for a in range(60) for k in range(4)]


@pytest.mark.parametrize("name", sorted(reorder.KERNELS))
def test_kernels_permute(name):
    n = 70
    pairs = sorted({(a, b) for a, b in both(GRAPH) if a != b})
    out = [[b for a, b in pairs if a == v] for v in range(n)]
    assert sorted(reorder.KERNELS[name](out, out)) == list(range(n))


def test_kernel_orders_exact():
    out = [[1, 2], [0, 3], [0], [1], []]
    assert reorder.dfs_kernel(out, out) == [0, 1, 3, 2, 4]
    assert plain_orders.bfs_kernel(out, out) == [0, 1, 2, 3, 4]
    assert plain_orders.rcm_kernel(out, out)[-1] == 4


def test_slashburn_exact():
    pairs = [(0, 1), (0, 2), (0, 3), (0, 4), (4, 5), (5, 6), (7, 8)]
    out = [sorted(b for a, b in both(pairs) if a == v) for v in range(9)]
    # hub 0 frees 1, 2, 3; hub 5 frees 6; 7 and 8 wait until they are hubs, the larger first
    assert reorder.slashburn_kernel(out, out) == [0, 5, 8, 7, 4, 6, 3, 2, 1]


def test_bisections_exact():
    path = [[v + d for d in (-1, 1) if 0 <= v + d < 8] for v in range(8)]
    # 7 is farthest from 0, and changes places with it; 7, 6, 5, 4 fill the left side
    assert reorder.bfs_bisection_kernel(path, path, 5) == [7, 4, 5, 6, 1, 2, 3, 0]
    # two cliques; 3 and 4 start on the wrong sides
    parts = {0, 1, 2, 4}, {3, 5, 6, 7}
    out = [sorted(p - {v}) for v in range(8) for p in parts if v in p]
    for found in (reorder.bisection_kernel(out, out, 8), reorder.level_bisection_kernel(out, out, 1)):
        assert (set(found[:4]), set(found[4:])) == parts
    assert reorder.level_bisection_kernel(out, out, 0) == list(range(8))


def test_reorder_keeps_graph(spark):
    e = graph.cut(frame(spark, both([p for p in GRAPH if p[0] != p[1]])))
    before = triangles.triangle_count(e).first()[0]
    new, mapping = reorder.reorder(e, "gro")
    got = sorted(r["new_id"] for r in mapping.collect())
    assert got == list(range(len(got))) and new.count() == e.count()
    assert triangles.triangle_count(new).first()[0] == before
    assert sorted(r["new_id"] for r in reorder.hybrid_order(e).collect()) == got
    with pytest.raises(ValueError):
        reorder.vertex_order(e, "best")


def test_kernels_refuse_larger_graphs(spark, monkeypatch):
    e = frame(spark, [(0, 1), (1, 2)])
    monkeypatch.setattr(reorder, "MOST_EDGES", 1)
    with pytest.raises(ValueError, match="edges"):
        reorder.vertex_order(e, "gro")
    monkeypatch.setattr(reorder, "MOST_VERTICES", 2)
    with pytest.raises(ValueError, match="vertices"):
        reorder.vertex_order(e, "dfs")


def test_levels_are_written_once(spark, monkeypatch):
    """A path, the graph with most levels: every vertex is written in one level, and nothing else grows with their number."""
    made = []

    class Recorded(graph.Levels):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(reorder, "Levels", Recorded)
    n = 60
    path = frame(spark, both([(v, v + 1) for v in range(n - 1)]))
    assert [r["level"] for r in reorder.bfs_levels(path).orderBy("v").collect()] == list(range(n))
    assert [r["new_id"] for r in reorder.bfs_order(path).orderBy("org_id").collect()] == list(range(n))
    assert [(x.rows, len(x.paths)) for x in made] == [(n, n + 1)] * 2
    # one way only: all levels before are looked at
    made.clear()
    ring = frame(spark, [(v, (v + 1) % 12) for v in range(12)] + [(5, 2), (7, 1)])
    assert [r["new_id"] for r in reorder.bfs_order(ring).orderBy("org_id").collect()] == list(range(12))
    assert made[0].rows == 12


def test_levels_take_both_directions(spark):
    got = {r["v"]: (r["root"], r["level"]) for r in reorder.bfs_levels(frame(spark, [(1, 0), (2, 1), (4, 4)])).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (3, 0), 4: (4, 0)}


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("name", sorted(plain_orders.ORDERS))
def test_order_plans(spark, name, limit, monkeypatch):
    """The plans find the orders that follow one vertex after another, on a directed graph with loops, repeats, gaps and several sources."""
    import random

    monkeypatch.setattr(reorder, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(3, 3), (3, 3), (35, 33), (35, 33)]
    out, into = ([sorted({p[1 - k] for p in pairs if p[k] == v}) for v in range(36)] for k in (0, 1))
    got = sorted(reorder.vertex_order(frame(spark, pairs), name).collect(), key=lambda r: r["new_id"])
    assert [r["new_id"] for r in got] == list(range(36))
    assert [r["org_id"] for r in got] == plain_orders.ORDERS[name](out, into)


@pytest.mark.parametrize("name", ["bfs", "dfs"])
def test_large_graph_is_ordered_whole(spark, name):
    """No edge of a graph of more than 200,000 vertices is dropped."""
    n, fan = 200_500, 80
    new = lambda v: v * 7919 % n
    e = spark.range(1, n).select((F.floor((F.col("id") - 1) / fan) * 7919 % n).alias("src"), (F.col("id") * 7919 % n).alias("dst"))
    out = [[] for _ in range(n)]
    for v in range(1, n):
        out[new((v - 1) // fan)].append(new(v))
    out = [sorted(x) for x in out]
    got = reorder.vertex_order(e, name).orderBy("new_id").toPandas()
    assert got["org_id"].tolist() == (plain_orders.ORDERS | reorder.KERNELS)[name](out, out)


def test_gro_packs_better():
    import random

    rng = random.Random(1)
    place = list(range(256))
    rng.shuffle(place)
    pairs = {(place[a], place[b]) for g in range(8) for a in range(32 * g, 32 * g + 32) for b in range(32 * g, 32 * g + 32) if a != b and rng.random() < 0.5}
    out = [[] for _ in place]
    for a, b in sorted(pairs | {(b, a) for a, b in pairs}):
        out[a].append(b)
    packs = lambda new: sum(len({new[b] // 32 for b in x}) for x in out)
    for kernel in (reorder.gro_kernel, reorder.bisection_kernel):
        new = {v: i for i, v in enumerate(kernel(out, out))}
        assert packs(new) < 0.6 * packs({v: v for v in range(256)})


def test_stats(spark):
    e = frame(spark, [(0, 1), (0, 2), (0, 3), (1, 2)])
    assert [tuple(r) for r in stats.big_nodes(e, 0.5).orderBy("v").collect()] == [(0, 3, 3), (1, 2, 5)]
    assert stats.leaf_count(e).first()[0] == 2  # vertices 1 and 3, each once
    w = stats.degree_weights(e)
    assert math.isclose(w.agg(F.sum(F.col("alpha_out") + F.col("alpha_in"))).first()[0], 1)
    assert [r["position"] for r in stats.ranked_sides(w).orderBy("position").collect()] == list(range(8))
    g = stats.given_weights(spark.createDataFrame([(0, 1.0, 3.0)], "v bigint, out_weight double, in_weight double"))
    assert tuple(g.first()) == (0, 0.25, 0.75)
    c = stats.comp_ratio(e).first()
    assert c["out_ratio"] == 0.5 and c["in_ratio"] == 0.75


def test_big_node_stats(spark):
    e = frame(spark, [(0, 1), (0, 2), (0, 3), (1, 2)])
    assert tuple(stats.big_node_stats(e, 0.5).first()) == (2, 0.5, 2.5, 0.25, 3, 0, 1, 1)


small = st.sets(st.integers(0, 200), max_size=40)


def test_set_functions(spark):
    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.tuples(small, small), min_size=1, max_size=30))
    def check(pairs):
        df = spark.createDataFrame([(i, sorted(a), sorted(b)) for i, (a, b) in enumerate(pairs)], "k bigint, a array<bigint>, b array<bigint>")
        cols = [sets.intersect("a", "b"), sets.union("a", "b"), sets.subtract("a", "b"), sets.symmetric_difference("a", "b"), sets.intersect_count("a", "b"), sets.union_count("a", "b"), sets.is_subset("a", "b"), sets.is_strict_subset("a", "b"), sets.flip("a", 5, 60), sets.rank("a", F.lit(50)), sets.select("a", F.lit(2))]
        for r in df.select("k", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
            a, b = pairs[r["k"]]
            s = sorted(a)
            assert list(r)[1:] == [sorted(a & b), sorted(a | b), sorted(a - b), sorted(a ^ b), len(a & b), len(a | b), a <= b, a < b, sorted(a ^ set(range(5, 60))), sum(x <= 50 for x in a), s[2] if len(s) > 2 else None]
        rows = lambda side: spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p[side]], "v bigint, x bigint")
        pa, pb = sets.pack(rows(0)), sets.pack(rows(1), width=32)
        back = lambda p: {tuple(r) for r in sets.unpack(p).collect()}
        both_ = {(i, x) for i, (a, b) in enumerate(pairs) for x in a & b}
        assert back(sets.packed_intersect(pa, pb, ["v"])) == both_
        assert back(sets.packed_union(pa, pb, ["v"])) == {(i, x) for i, (a, b) in enumerate(pairs) for x in a | b}
        assert back(sets.packed_subtract(pa, pb, ["v"])) == {(i, x) for i, (a, b) in enumerate(pairs) for x in a - b}

    check()


def test_synth(spark):
    s = synth.set_pair(spark, 1000, 4.0, 0.1, 0.05)
    by = {k: {r["x"] for r in s.where(F.col("set_id") == k).collect()} for k in "ab"}
    assert len(by["a"]) == 1000 and len(by["b"]) == 250 and len(by["a"] & by["b"]) == 100
    c = synth.filter_cost(spark).first()
    assert round(c["word_check_cost"], 2) == 11.92 and round(c["byte_filter_cost"], 2) == 7.53


def test_queues():
    q = BucketQueue(range(5))
    q.raise_score(3)
    q.raise_score(3)
    q.raise_score(1)
    assert q.top() == (3, 2) and q.pop() == (3, 2) and q.pop() == (1, 1) and q.pop() == (0, 0) and len(q) == 2 and 1 not in q
    q.reset()
    assert q.score(2) == 0
    h = ReducibleHeap()
    for v, p in ((1, 5), (2, 7), (1, 9)):
        h.put(v, p)
    assert h.pop() == (1, 9) and h.top() == (2, 7) and len(h) == 1
    o = OrderedPool([3, 1, 2])
    o.remove(1)
    o.add(9)
    o.add(2)
    assert list(o) == [3, 2, 9] and o.pop_tail() == 9 and o.pop_head() == 3 and o.head() == o.tail() == 2
