"""Cores and peeling over neighbour lists as bytes, and by joins where ids go too far: against a plain version."""

import random

import pytest

from tessera.operators import cores
from test_whole_components import frame, graph_of_parts, plain_peeling


@pytest.mark.parametrize("ids", [cores.IDS, 0])
def test_large_component(spark, monkeypatch, ids):
    """One component beyond a worker's bound: no round joins edges (they all did), but where ids go too far."""
    rng = random.Random(3)
    pairs = sorted({*graph_of_parts(3), *(tuple(sorted(rng.sample(range(95), 2))) for _ in range(250)), *((i, i + 1) for i in range(100, 130))})
    want = plain_peeling(pairs)
    monkeypatch.setattr(cores, "WHOLE", 20)
    monkeypatch.setattr(cores, "LIST", 30)
    monkeypatch.setattr(cores, "IDS", ids)
    if ids:
        monkeypatch.setattr(cores, "bucketed", None)
    e = frame(spark, pairs + [(b, a) for a, b in pairs[:30]] + [(133, 133)])
    want |= {v: (0, 1) for v in (131, 132, 133)}
    assert {r["v"]: (r["core"], r["round"]) for r in cores.peeling(e).collect()} == want
    assert {r["v"]: r["core"] for r in cores.core_numbers(e).collect()} == {v: c for v, (c, _) in want.items()}
