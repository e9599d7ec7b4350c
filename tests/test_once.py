"""Edges that are dear to make are made once, and tasks grow in number with the rows, not in size."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, reorder, stats
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
PAIRS = [(0, 1), (0, 2), (1, 2), (2, 5), (5, 6), (8, 9), (9, 8), (0, 1)]


def counted(spark, pairs):
    """Edges, and how many rows of them were made so far."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.createDataFrame(pairs, "src bigint, dst bigint").mapInArrow(rows, "src bigint, dst bigint"), made


@pytest.mark.parametrize("name", ["degrees", "vertices", "comp_ratio", "big_node_stats", "degree_weights", "bfs_levels", "hybrid", "bfs", "bfs_degree", "rcm", "first_touch"])
def test_edges_are_made_once(spark, name):
    run = {"degrees": graph.degrees, "vertices": graph.vertices, "comp_ratio": stats.comp_ratio, "big_node_stats": lambda e: stats.big_node_stats(e, 0.2), "degree_weights": stats.degree_weights, "bfs_levels": reorder.bfs_levels}
    edges, made = counted(spark, PAIRS)
    assert run.get(name, lambda e: reorder.vertex_order(e, name))(edges).collect()
    assert made.value == len(PAIRS)


def test_packed_sides_of_a_bag(spark):
    edges = spark.createDataFrame([(0, 1), (0, 1), (0, 40), (3, 3)], "src bigint, dst bigint")
    got = {r["v"]: tuple(r)[1:] for r in stats.packed_sides(edges).collect()}
    assert len(got) == 41 and got[0] == (3, 0, 3, 2, 0) and got[1] == (0, 2, 2, 0, 1) and got[3] == (1, 1, 2, 1, 1) and got[40] == (0, 1, 1, 0, 1) and got[7] == (0,) * 5


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_tasks_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 300)
    assert tasks(registry._pairs(spark, SF)) > 30
    assert tasks(registry._packed_sides(spark, SF)[0]) > 15


def test_packed_matches_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    same = [sorted(tuple(r) for r in registry.QUERIES[q](spark, SF).collect()) for q in ("sm_triangle", "sm_triangle_packed")]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", ["relabel_edges", "relabel_queries", "order_degree_asc", "order_degree_desc"])
def test_repeated_pairs_in_many_tasks(spark, monkeypatch, name):
    want = sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).collect())
    monkeypatch.setattr(graph, "TASK_ROWS", 300)
    assert tasks(registry.repeat_graph(spark, SF)) > 30
    assert sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).collect()) == want
