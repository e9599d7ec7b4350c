"""Stored sets, Bloom filters, bitmaps and runs: plans, and results against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import bitmaps
from tessera.operators import graph, ids, probe
from tessera.plans import matching
from tessera.sources import text
from tessera.sources.text import Pattern


def rows(spark, sets):
    return spark.createDataFrame([(v, x) for v, xs in sets.items() for x in xs], "v bigint, x bigint").repartition(3)


def as_sets(df):
    out = {}
    for v, x in df.select("v", "x").collect():
        out.setdefault(v, []).append(x)
    return {v: sorted(xs) for v, xs in out.items()}


def above(plan: str, scan: str) -> list[str]:
    """The nodes of a plan's text between its root and the first line that names the scan."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if scan in x)
    depth, out = lines[at].index(lines[at].lstrip(" :+-")[0]), []
    for x in reversed(lines[:at]):
        own = len(x) - len(x.lstrip(" :+-"))
        if own < depth:
            out.append(x)
            depth = own
    return out


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_probe_moves_no_large_side(spark, limit):
    rng = random.Random(1)
    sets = {v: {rng.randrange(100_000) for _ in range(4000)} for v in range(5)}
    table = probe.store_sets(rows(spark, sets), range_rows=4000, file_rows=1500)
    wanted = {rng.randrange(20_000, 30_000) for _ in range(300)}
    small = spark.createDataFrame([(x, -x) for x in wanted], "x bigint, y bigint")
    found = probe.probe_sets(table, small, broadcast_rows=limit)
    assert as_sets(found) == {v: sorted(xs & wanted) for v, xs in sets.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    nodes = above(plan[: plan.find("Initial Plan") if "Initial Plan" in plan else None], f"spark_catalog.default.{table}")
    assert nodes and not any("Exchange" in x for x in nodes), plan
    # of 20,000 elements in 5 ranges or more only one tenth of the values is asked for
    files = len(spark.table(table).inputFiles())
    opened = spark.table(table).where(F.col("part").isin([r[0] for r in small.select(F.floor(F.col("x") / probe._span(spark, table))).distinct().collect()])).inputFiles()
    assert 0 < len(opened) < files / 2
    spark.sql(f"DROP TABLE {table}")


def test_probe_edges(spark):
    table = probe.store_sets(rows(spark, {1: [-5, 0, 7], 2: []}))
    assert as_sets(probe.probe_sets(table, spark.createDataFrame([(-5,), (7,), (8,)], "x bigint"))) == {1: [-5, 7]}
    assert probe.probe_sets(table, spark.createDataFrame([], "x bigint")).count() == 0
    table = probe.store_sets(spark.createDataFrame([], "v bigint, x bigint"))
    assert probe.probe_sets(table, spark.createDataFrame([(1,)], "x bigint")).count() == 0


def test_bloom_sieves_before_the_shuffle(spark):
    small = spark.range(0, 2000).select((F.col("id") * 7).alias("x"))
    large = spark.range(0, 200_000).select(F.col("id").alias("x"), F.lit("y").alias("y"))
    words = probe.bloom_words(2000)
    left = probe.maybe_in(large, "x", probe.bloom_filter(small, "x", words), words)
    n = left.count()
    # nothing is lost, and of 198,000 others few pass
    assert left.join(small, "x", "left_semi").count() == 2000 and 2000 <= n <= 2000 + 198_000 * 0.03
    found = probe.filtered_intersect(small, large, "x")
    assert found.count() == 2000 and found.columns == ["x", "y"]
    assert probe.filtered_intersect(small.limit(0), large, "x").count() == 0
    assert probe.bloom_words(10**6) * 64 >= 12 * 10**6 and probe.bloom_words(16 * 10**6) == probe.MOST_WORDS and probe.bloom_words(10**9) == 0


def test_bitmaps(spark):
    rng = random.Random(2)
    sets = {v: {rng.randrange(-50_000, 200_000) for _ in range(900)} | {0, 32_768, 32_769, -32_768} for v in range(4)}
    chunks = graph.cut(bitmaps.bitmaps(rows(spark, sets).union(rows(spark, sets)), ["v"]))
    assert {r["v"]: r["n"] for r in bitmaps.bitmap_sizes(chunks, ["v"]).collect()} == {v: len(xs) for v, xs in sets.items()}
    by = chunks.withColumn("g", F.col("v") % 2)
    union = bitmaps.bitmap_sizes(bitmaps.bitmap_union(by, ["g"]), ["g"])
    both = bitmaps.bitmap_sizes(bitmaps.bitmap_intersection(by, ["g"], 2), ["g"])
    assert {r["g"]: r["n"] for r in union.collect()} == {g: len(sets[g] | sets[g + 2]) for g in (0, 1)}
    assert {r["g"]: r["n"] for r in both.collect()} == {g: len(sets[g] & sets[g + 2]) for g in (0, 1)}
    # partial aggregates of binaries before the exchange
    plan = bitmaps.bitmap_union(chunks.withColumn("g", F.lit(1)), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_or_agg" in plan


def plain_runs(xs):
    out = []
    for x in sorted(xs):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


def test_runs(spark):
    rng = random.Random(3)

    def some():
        out = set()
        for _ in range(12):
            a = rng.randrange(-100, 150)
            out |= set(range(a, a + rng.randrange(1, 40)))
        return out

    a, b = {v: some() for v in range(4)}, {v: some() for v in range(1, 5)}
    got = lambda df: {v: sorted((r["start"], r["end"]) for r in g) for v, g in group(df.collect()).items()}

    def group(rs):
        out = {}
        for r in rs:
            out.setdefault(r["v"], []).append(r)
        return out

    want = lambda sets: {v: plain_runs(xs) for v, xs in sets.items() if xs}
    for chunk in (16, 1, 1 << 20):
        x, y = (graph.cut(bitmaps.to_runs(rows(spark, s), chunk=chunk)) for s in (a, b))
        assert got(x) == want(a)
        assert got(bitmaps.runs_intersect(x, y, chunk=chunk)) == want({v: a[v] & b[v] for v in a if v in b})
        assert got(bitmaps.runs_union(x, y, chunk=chunk)) == want({v: a.get(v, set()) | b.get(v, set()) for v in {*a, *b}})
    assert as_sets(bitmaps.from_runs(x, chunk=16)) == {v: sorted(xs) for v, xs in a.items()}
    # a long run is never expanded
    long = spark.createDataFrame([(1, 0, 10**12)], "v bigint, start bigint, end bigint")
    other = spark.createDataFrame([(1, 5, 9), (1, 10**12 - 3, 10**12 + 5)], "v bigint, start bigint, end bigint")
    assert got(bitmaps.runs_intersect(long, other, chunk=1 << 36)) == {1: [(5, 9), (10**12 - 3, 10**12)]}


def test_first_seen_over_files(spark, tmp_path):
    """Ids by first appearance are the same whether the lines lie in one file or in many, and however many tasks read them."""
    rng = random.Random(4)
    lines = [f"n{rng.randrange(200)} n{rng.randrange(200)}" for _ in range(800)] + ["# no", "", "alone"]
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    (tmp_path / "one" / "all.txt").write_text("\n".join(lines) + "\n")
    for i in range(8):
        # the order of names isn't the order of sizes
        (tmp_path / "many" / f"part-{i:02}.txt").write_text("".join(x + "\n" * (1 + 3 * (7 - i)) for x in lines[i * 101 : (i + 1) * 101]))
    want = {}
    for x in lines[:800]:
        for v in x.split():
            want.setdefault(v, len(want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            for name in ("one", "many"):
                assert {r[0]: r[1] for r in ids.densify_first_seen(text.read_raw_edges(spark, f"{tmp_path}/{name}")).collect()} == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_lines(spark):
    lines = ["abc", "7", "-3 4", "1 2", "# c", "3 4x", "99999999999999999999 1", " 5\t6 7"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(tuple(r) for r in text.parse_edges(df).collect()) == [(1, 2), (5, 6)]
    assert sorted(r[0] for r in text.malformed_lines(df).collect()) == sorted(["abc", "7", "-3 4", "3 4x", "99999999999999999999 1"])


def test_sparse_ids_are_an_error(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "src bigint, dst bigint")
    for pairs in ([(0, 10**7)], [(-1, 2)], [(5, 1 << 62)]):
        with pytest.raises(ValueError, match="dense"):
            graph.vertices(frame(pairs))
    assert graph.vertices(frame([(0, 1000)])).count() == 1001 and graph.vertices(frame([])).count() == 0


# matching by extension


def plain_matches(pairs, labels, p):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = [()]
    for u, want in enumerate(p.labels):
        out = [(*m, v) for m in out for v, own in labels.items() if own == want and v not in m and all(m[b] in near.get(v, ()) for b in p.neighbours(u) if b < u)]
    return sorted(out)


PATTERNS = [
    Pattern((0, 1, 0), ((0, 1), (1, 2))), Pattern((0, 0, 1), ((0, 1), (1, 2), (0, 2))), Pattern((0, 1, 0, 1), ((0, 1), (1, 2), (2, 3), (0, 3))),
    Pattern((0, 1, 0, 1), ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))), Pattern((1, 0, 0, 0), ((0, 1), (0, 2), (0, 3))), Pattern((1,)), Pattern((0, 1), ()), Pattern((0, 1, 5), ((0, 1), (1, 2))),
]


def test_extension_matches(spark, monkeypatch):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(260)})
    labels = {v: rng.randrange(3) for v in range(30)}
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    lab = spark.createDataFrame(list(labels.items()), "vertex bigint, label bigint")
    want = [plain_matches(pairs, labels, p) if len(p.labels) == 1 or p.edges else [] for p in PATTERNS]
    for prefix, limit in ((16, 2_000_000), (2, 0)):  # lists in several parts, none broadcast
        monkeypatch.setattr(matching, "PREFIX", prefix)
        monkeypatch.setattr(matching, "BROADCAST_ENTRIES", limit)
        got = matching.match_patterns(e, lab, PATTERNS)
        assert [sorted(tuple(r) for r in df.collect()) for df in got] == want
    assert all(want[:5])


def test_extension_keeps_intermediates_small(spark):
    """No relation between the steps has more rows than the final one and the rarest edges together, though open paths are many."""
    rng = random.Random(6)
    # a hub of each of two labels: very many open squares, few closed ones
    pairs = {(0, v) for v in range(10, 310)} | {(1, v) for v in range(200, 500)} | {tuple(sorted((rng.randrange(10, 500), rng.randrange(10, 500)))) for _ in range(300)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    labels = {v: 0 if v < 2 else 1 if v < 260 else 2 for v in range(500)}
    e, lab = spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame(list(labels.items()), "vertex bigint, label bigint")
    both = graph.cut(matching.labelled_edges(e, lab))
    for p in (Pattern((0, 1, 0, 2), ((0, 1), (1, 2), (2, 3), (0, 3))), Pattern((0, 1, 2), ((0, 1), (1, 2), (0, 2))), Pattern((0, 1, 1, 2), ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)))):
        counts, sizes = matching.label_counts(lab, [p]), matching.pair_counts(both, [p])
        steps: list = []
        final = matching.extend_pattern(matching.label_lists(both), lab, p, counts, sizes, steps).count()
        assert final == len(plain_matches(pairs, labels, p)) if len(p.labels) < 4 else True
        assert max(s.count() for s in steps) <= final + min(sizes.values())


def test_small_sets_are_dealt_before_they_are_bitmaps(spark):
    """Many small sets: their rows are shuffled, once, and no bitmap is."""
    import re

    from tessera.functions import bitmaps

    rows = spark.range(3000).selectExpr("id % 500 AS k", "id % 3 AS f", "id * 7 % 1000 AS x")
    dealt, combined = (bitmaps.bitmap_intersection(bitmaps.bitmaps(rows, ["k", "f"], dealt=d), ["k"], 3) for d in (["k"], None))
    as_set = lambda df: {(r["k"], r["n"]) for r in bitmaps.bitmap_sizes(df, ["k"]).collect()}
    assert as_set(dealt) == as_set(combined)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(k", plan)) == 1
