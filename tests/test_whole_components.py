"""Components, cores and peeling: component by component and by joins, against plain versions."""

import random

import numpy as np
import pytest

from tessera.operators import cores, graph


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def graph_of_parts(seed):
    rng = random.Random(seed)
    out = set()
    for at, n, m in ((0, 20, 80), (20, 9, 12), (30, 15, 60), (50, 2, 1)):
        out |= {tuple(sorted((at + a, at + b))) for a, b in (rng.sample(range(n), 2) for _ in range(m))}
    return sorted(out | {(a + 60, a + 61) for a in range(12)} | {(72, 80)})


def plain_peeling(pairs):
    near = {v: set() for v in range(max(map(max, pairs)) + 1)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, k, last, turn = {}, 0, None, 0
    while near:
        k = max(k, min(map(len, near.values())))
        turn = turn + 1 if k == last else 1
        last = k
        gone = {v for v, n in near.items() if len(n) <= k}
        out |= {v: (k, turn) for v in gone}
        near = {v: n - gone for v, n in near.items() if v not in gone}
    return out


@pytest.mark.parametrize("most", [2_000_000, 20, 0])
def test_peeling(spark, monkeypatch, most):
    pairs = graph_of_parts(1)
    want = plain_peeling(pairs)
    monkeypatch.setattr(cores, "WHOLE", max(most, 1))
    if most > 1000:
        # no rounds over edges where components fit
        monkeypatch.setattr(cores, "Rounds", None)
    e = frame(spark, pairs + [(b, a) for a, b in pairs[:30]])
    assert {r["v"]: (r["core"], r["round"]) for r in cores.peeling(e).collect()} == want
    assert {r["v"]: r["core"] for r in cores.core_numbers(e).collect()} == {v: c for v, (c, _) in want.items()}


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINK_EDGES", 7)
    pairs = graph_of_parts(2) + [(100 + i, 101 + i) for i in range(0, 60)] + [(5, 100)]
    names, least = graph.least_labels(*np.array(pairs).T)
    assert {r["v"]: r["comp"] for r in graph.components(frame(spark, pairs)).collect()} == dict(zip(names.tolist(), least.tolist()))
    label = {v: v for p in pairs for v in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert label == dict(zip(names.tolist(), least.tolist()))
