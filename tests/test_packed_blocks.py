"""Blocks as bytes, and graphs whose ids say nothing about links."""

import random

import numpy as np
import pytest

from tessera.operators import blocks, triangles


@pytest.mark.parametrize("gaps", [[], [0], [3, 1, 254, 255, 256, 70_000, 1 << 40, 2], [65_534, 65_535, 65_536] * 40])
def test_numbers_as_bytes(gaps):
    keys = np.cumsum(np.array(gaps, np.int64))
    assert blocks.decoded(*blocks.encoded(keys)).tolist() == keys.tolist()


@pytest.mark.parametrize("span", [1000, 1 << 40])
def test_blocks_as_bytes(span):
    i, j = (5, span), (5 + span, span)
    pairs = sorted({(5 + random.Random(k).randrange(span), 5 + span + random.Random(-k).randrange(span)) for k in range(200)})
    src, dst = blocks.unpack(*blocks.pack(*np.array(pairs).T, i, j), i, j)
    assert sorted(zip(src.tolist(), dst.tolist())) == pairs


def test_ids_that_say_nothing(spark, monkeypatch):
    """An edge would go to more than COPIES small cells; larger ones serve, and bytes travel. There was no plan."""
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(3000)})
    monkeypatch.setattr(blocks, "CELL_EDGES", 80)
    monkeypatch.setattr(blocks, "COPIES", 9)
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    found, plan = blocks.canonical_plan(triangles.canonical(e))
    assert plan is not None
    rows = blocks.packed(found, plan).collect()
    assert 9 * len(pairs) > sum(len(r["data"]) // r["width"] for r in rows) and sum(len(r["data"]) + len(r["far"]) for r in rows) < 4 * 9 * len(pairs)
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(300)}
    want = sum(len(near[a] & near[b]) for a, b in pairs) // 3
    for method in triangles.METHODS:
        assert triangles.triangle_count(e, method, undirected=True).first()[0] == want
    assert sum(r["n"] for r in triangles.triangles_per_vertex(e).collect()) == 3 * want


def test_roots_move_once(spark, monkeypatch):
    """Roots are searched from rows that move once, by (degree, id) where ids say nothing; the lists and masks that were joined for them are for large states alone."""
    from tessera.operators import cliques

    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(500)})
    monkeypatch.setattr(blocks, "CELL_EDGES", 60)
    monkeypatch.setattr(blocks, "COPIES", 3)
    monkeypatch.setattr(cliques, "_searched", None)
    monkeypatch.setattr(cliques, "ROWS", 200)
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(60)}
    want = set()

    def grow(r, p, x):
        if not p and not x:
            want.add(tuple(sorted(r)))
        for v in sorted(p):
            grow([*r, v], p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow([], set(range(60)), set())
    found = [tuple(r[0]) for r in cliques.maximal_cliques(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()]
    assert len(found) == len(set(found)) and set(found) == want
