import pytest

from tessera import cli


def test_commands(spark, tmp_path):
    g = tmp_path / "g.txt"
    g.write_text("# K4\n" + "".join(f"{a} {b}\n" for a in range(4) for b in range(4) if a != b))
    (tmp_path / "l.txt").write_text("0 0\n1 0\n2 0\n3 1\n")
    (tmp_path / "q.txt").write_text("2 1\n0\n1\n0 1\n1 0\n1\n")
    out = cli.main(["tc", str(g)])
    assert (out["triangles"], out["edges"], out["vertices"]) == (4, 12, 4)
    out = cli.main(["mc", str(g), str(tmp_path / "mc")])
    assert (out["cliques"], out["maximum_clique_size"]) == (1, 4)
    assert spark.read.text(str(tmp_path / "mc")).first()[0] == "0 1 2 3"
    assert cli.main(["sm", str(g), str(tmp_path / "l.txt"), str(tmp_path / "q.txt"), str(tmp_path / "sm")])["matches"] == {0: 3, 1: 1}
    assert cli.main(["reorder", str(g), "--order", "dfs"])["comp_ratio"] == pytest.approx(4 / 12)
    assert spark.read.text(str(tmp_path / "g_DFS_newID.txt")).count() == 4
    assert cli.main(["intersect", "--length", "5000", "--repeats", "1"])["packed"]["n"] == 500
    with pytest.raises(SystemExit):
        cli.main(["tc"])


def test_intersect_always_runs_arrays(spark):
    out = cli.main(["intersect", "--length", "1000001", "--repeats", "1"])
    assert {out[k]["n"] for k in ("join", "packed", "hierarchical", "array")} == {100_000}


def test_metrics_take_no_jobs(spark, tmp_path):
    """The counts that are printed come from the rows as they are written."""
    from pyspark.sql import functions as F

    rows = spark.range(100).repartition(3)
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("plain", "")
    rows.write.parquet(f"{tmp_path}/plain")
    spark.sparkContext.setJobGroup("observed", "")
    seen_rows, seen = cli._observed(rows, n=F.count(F.lit(1)), largest=F.max("id"))
    seen_rows.write.parquet(f"{tmp_path}/observed")
    assert seen.get == {"n": 100, "largest": 99}
    assert jobs("observed") == jobs("plain") > 0
    g = tmp_path / "g.txt"
    g.write_text("0 1\n1 2\n0 2\n2 3\n")
    # --ratio reads the edges once, and packs them in one query
    spark.sparkContext.setJobGroup("ratio", "")
    out = cli.main(["reorder", str(g), "--ratio"])
    spark.sparkContext.setJobGroup("rest", "")
    assert out["edges"] == 4 and out["vertices"] == 4 and out["comp_ratio"] == 6 / 8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
