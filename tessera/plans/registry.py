"""Registered queries over the driver's tables, and the same in SQL.

Graphs: parts bought together in an order (part_graph); pairs in two orders or
more (repeat_graph). Labels: a part's brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import bitmaps, sets, synth
from tessera.operators import cliques, cores, graph, ids, probe, reorder, stats, triangles
from tessera.plans import matching
from tessera.sources import text
from tessera.sources.text import Pattern

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_LI = "li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
_PART = f"{_LI}, g AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM li a JOIN li b ON a.o = b.o AND a.p < b.p)"
_REPEAT = f"{_LI}, g AS (SELECT a.p AS src, b.p AS dst FROM li a JOIN li b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2)"
_SYM = "sym AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)"
_LABELS = "lab AS (SELECT p_partkey AS vertex, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part)"
_DEG = "deg AS (SELECT v.v, count(*) FILTER (WHERE s = 0 AND e.src IS NOT NULL) AS out_deg, count(*) FILTER (WHERE s = 1 AND e.src IS NOT NULL) AS in_deg FROM (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM {g}) + 1)) AS v) v LEFT JOIN (SELECT src, 0 AS s FROM {g} UNION ALL SELECT dst, 1 FROM {g}) e ON e.src = v.v GROUP BY v.v)"
_SETS = "s AS (SELECT l_suppkey AS k, list_sort(list_distinct(list(l_partkey))) AS x FROM lineitem GROUP BY 1), p AS (SELECT a.k, a.x AS a, b.x AS b FROM s a JOIN s b ON b.k = a.k + 1)"
_AB = "a AS (SELECT DISTINCT l_suppkey AS v, l_partkey AS x FROM lineitem WHERE l_quantity <= 25), b AS (SELECT DISTINCT l_suppkey AS v, l_partkey AS x FROM lineitem WHERE l_quantity > 25)"
_PACK = "pa AS (SELECT v, x // 32 AS base, bit_or(1::BIGINT << (x % 32)::INT) AS state FROM a GROUP BY 1, 2), pb AS (SELECT v, x // 32 AS base, bit_or(1::BIGINT << (x % 32)::INT) AS state FROM b GROUP BY 1, 2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# inputs

#: Pairs that a row of lineitem is allowed for when pairs are dealt to tasks: orders of 1 to 7 parts make two.
PAIRS = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), src < dst, once for each order with both parts. An order's parts are grouped and paired within it: no self-join. Equal pairs are dealt to one task."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = li.count()
    li = graph.deal(li, n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    tails = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    return graph.deal(li.select(F.explode(tails).alias("e")).select("e.src", "e.dst"), PAIRS * n, "src", "dst")


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).distinct()


def repeat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("src", "dst").count().where("count >= 2").select("src", "dst")


def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # the window ranks distinct brands, not parts
    brands = part.select("p_brand").distinct().withColumn("label", F.row_number().over(W.orderBy("p_brand")) - 1)
    return part.join(brands, "p_brand").select(F.col("p_partkey").alias("vertex"), F.col("label").cast("bigint").alias("label"))


def _set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sort_array(F.collect_set("l_partkey")).alias("x"))
    return s.select("k", F.col("x").alias("a")).join(s.select((F.col("k") - 1).alias("k"), F.col("x").alias("b")), "k")


def _side_rows(spark: SparkSession, sf_dir: str) -> tuple[int, list[DataFrame]]:
    """Rows of lineitem, and (v, x) on both sides, as bags."""
    li = _table(spark, sf_dir, "lineitem")
    return li.count(), [li.where(c).select(F.col("l_suppkey").alias("v"), F.col("l_partkey").alias("x")) for c in ("l_quantity <= 25", "l_quantity > 25")]


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, (a, b) = _side_rows(spark, sf_dir)
    return graph.deal(a, n, "v", "x").distinct(), graph.deal(b, n, "v", "x").distinct()


def _packed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, (a, b) = _side_rows(spark, sf_dir)
    return sets.pack(a, n=n), sets.pack(b, n=n)


def _text(c):
    return F.array_join(c, " ")


def _folder(spark: SparkSession, what: str) -> str:
    return graph.new_folder(spark, what)


# edges and vertices


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def edge_normalise(spark, sf_dir):
    return graph.deduplicate(_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"WITH {_PART} SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g")
def symmetrise(spark, sf_dir):
    return graph.symmetrise(part_graph(spark, sf_dir))


@query("SELECT l_partkey AS src, l_suppkey AS dst, 'forward' AS side FROM lineitem WHERE l_partkey < l_suppkey UNION ALL SELECT l_partkey, l_suppkey, 'backward' FROM lineitem WHERE l_partkey > l_suppkey")
def orientation_split(spark, sf_dir):
    a, b = graph.orient(_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))
    return a.withColumn("side", F.lit("forward")).union(b.withColumn("side", F.lit("backward")))


@query(f"WITH {_PART}, {_DEG.format(g='g')} SELECT v, out_deg, in_deg, out_deg + in_deg AS deg FROM deg")
def degree_stats(spark, sf_dir):
    return graph.degrees(part_graph(spark, sf_dir))


@query(f"WITH {_PART} SELECT src, dst FROM g ORDER BY src, dst")
def edge_order(spark, sf_dir):
    return graph.ordered(part_graph(spark, sf_dir))


@query(f"WITH {_PART}, {_SYM} SELECT src AS v, array_to_string(list_sort(list(dst)), ' ') AS nbrs FROM sym GROUP BY src")
def csr_adjacency(spark, sf_dir):
    return graph.adjacency(graph.symmetrise(part_graph(spark, sf_dir))).select("v", _text("nbrs").alias("nbrs"))


@query("WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem), o AS (SELECT src AS v, list_sort(list(dst)) AS x FROM e GROUP BY 1), i AS (SELECT dst AS v, list_sort(list(src)) AS x FROM e GROUP BY 1) SELECT coalesce(o.v, i.v) AS v, coalesce(array_to_string(o.x, ' '), '') AS out_nbrs, coalesce(array_to_string(i.x, ' '), '') AS in_nbrs FROM o FULL JOIN i ON o.v = i.v")
def csr_csc_adjacency(spark, sf_dir):
    e = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.adjacency_both(e).select("v", _text("out_nbrs").alias("out_nbrs"), _text("in_nbrs").alias("in_nbrs"))


@query(f"WITH RECURSIVE {_PART}, {_SYM}, r(v, comp) AS (SELECT src, src FROM sym UNION SELECT s.dst, r.comp FROM r JOIN sym s ON s.src = r.v WHERE r.comp < s.dst) SELECT v, min(comp) AS comp FROM r GROUP BY v")
def connected_components(spark, sf_dir):
    return graph.components(part_graph(spark, sf_dir))


# triangles

_TC = "SELECT count(*)::BIGINT AS n FROM g uv JOIN g uw ON uw.src = uv.src JOIN g vw ON vw.src = uv.dst AND vw.dst = uw.dst"


@query(f"WITH {_PART} {_TC}")
def tc_array(spark, sf_dir):
    return triangles.triangle_count(part_graph(spark, sf_dir), "array", undirected=True)


@query(f"WITH {_PART} {_TC}")
def tc_wedge(spark, sf_dir):
    return triangles.triangle_count(part_graph(spark, sf_dir), "wedge", undirected=True)


@query(f"WITH {_PART} {_TC}")
def tc_bsr(spark, sf_dir):
    return triangles.triangle_count(part_graph(spark, sf_dir), "bsr", undirected=True)


@query(f"WITH {_PART} {_TC}")
def tc_grid(spark, sf_dir):
    return triangles.triangle_count(part_graph(spark, sf_dir), "grid", undirected=True)


@query("WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT count(*)::BIGINT AS n FROM e uv JOIN e uw ON uw.src = uv.src JOIN e vw ON vw.src = uv.dst AND vw.dst = uw.dst WHERE uv.src < uv.dst AND uw.dst < uv.src")
def tc_directed(spark, sf_dir):
    return triangles.triangle_count(_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"WITH {_PART}, t AS (SELECT uv.src AS a, uv.dst AS b, uw.dst AS c FROM g uv JOIN g uw ON uw.src = uv.src JOIN g vw ON vw.src = uv.dst AND vw.dst = uw.dst) SELECT v, count(*) AS n FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v")
def tc_per_vertex(spark, sf_dir):
    return triangles.triangles_per_vertex(part_graph(spark, sf_dir))


# set algebra on lists


@query(f"WITH {_SETS} SELECT k, array_to_string(list_sort(list_intersect(a, b)), ' ') AS x FROM p")
def set_intersect(spark, sf_dir):
    return _set_pairs(spark, sf_dir).select("k", _text(sets.intersect("a", "b")).alias("x"))


@query(f"WITH {_SETS} SELECT k, len(list_intersect(a, b))::INT AS n FROM p")
def set_intersect_count(spark, sf_dir):
    return _set_pairs(spark, sf_dir).select("k", sets.intersect_count("a", "b").alias("n"))


@query(f"WITH {_SETS} SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS x FROM p")
def set_union(spark, sf_dir):
    return _set_pairs(spark, sf_dir).select("k", _text(sets.union("a", "b")).alias("x"))


@query(f"WITH {_SETS} SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS x FROM p")
def set_merge(spark, sf_dir):
    """Merging the disjoint parts b \\ a and a."""
    return _set_pairs(spark, sf_dir).select("k", _text(sets.merge_disjoint("a", F.array_except("b", "a"))).alias("x"))


@query(f"WITH {_SETS} SELECT k, array_to_string(list_filter(a, lambda y: NOT list_contains(b, y)), ' ') AS x FROM p")
def set_subtract(spark, sf_dir):
    return _set_pairs(spark, sf_dir).select("k", _text(sets.subtract("a", "b")).alias("x"))


@query(f"WITH {_SETS}, c AS (SELECT k, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM p) SELECT k, (na + nb - n)::INT AS n_or, (na - n)::INT AS n_andnot, (na + nb - 2 * n)::INT AS n_xor, round(n / (na + nb - n), 9) AS jaccard, n > 0 AS overlap FROM c")
def set_cardinalities(spark, sf_dir):
    return _set_pairs(spark, sf_dir).select("k", sets.union_count("a", "b").alias("n_or"), sets.subtract_count("a", "b").alias("n_andnot"), sets.symmetric_difference_count("a", "b").alias("n_xor"), F.round(sets.jaccard("a", "b"), 9).alias("jaccard"), sets.overlaps("a", "b").alias("overlap"))


@query(f"WITH {_SETS} SELECT k, list_max(a) AS largest, list_min(a) AS smallest, list_contains(a, k) AS has_k, a[4] AS fourth, len(list_filter(a, lambda y: y <= 100))::INT AS rank_100, len(list_filter(a, lambda y: y < 10 OR y >= 50)) + 40 - len(list_filter(a, lambda y: y >= 10 AND y < 50)) AS flipped, len(list_intersect(a, b)) = len(a) AS subset, array_to_string(list_sort(list_distinct(list_append(a, 7))), ' ') AS added, array_to_string(list_filter(a, lambda y: y <> a[1]), ' ') AS removed FROM p")
def bitmap_operations(spark, sf_dir):
    p = _set_pairs(spark, sf_dir)
    # flipping [10, 50): what was inside goes, the other 40 - inside come
    return p.select("k", F.array_max("a").alias("largest"), F.array_min("a").alias("smallest"), sets.contains("a", "k").alias("has_k"), sets.select("a", F.lit(3)).alias("fourth"), sets.rank("a", F.lit(100)).alias("rank_100"), F.size(sets.flip("a", 10, 50)).cast("bigint").alias("flipped"), sets.is_subset("a", "b").alias("subset"), _text(sets.add("a", F.lit(7).cast("bigint"))).alias("added"), _text(sets.remove("a", F.get("a", F.lit(0)))).alias("removed"))


# set algebra on packs


@query(f"WITH {_AB}, {_PACK} SELECT v, base, state FROM pa")
def bsr_encode(spark, sf_dir):
    return _packed_sides(spark, sf_dir)[0]


@query(f"WITH {_AB} SELECT v, x FROM a")
def bsr_decode(spark, sf_dir):
    return sets.unpack(_packed_sides(spark, sf_dir)[0])


@query(f"WITH {_AB}, {_PACK} SELECT v, pa.base, pa.state & pb.state AS state FROM pa JOIN pb USING (v, base) WHERE pa.state & pb.state <> 0")
def bsr_intersect(spark, sf_dir):
    return sets.packed_intersect(*_packed_sides(spark, sf_dir), ["v"])


@query(f"WITH {_AB} SELECT v, count(*)::BIGINT AS n FROM a JOIN b USING (v, x) GROUP BY v")
def bsr_intersect_count(spark, sf_dir):
    return sets.packed_size(sets.packed_intersect(*_packed_sides(spark, sf_dir), ["v"]))


@query(f"WITH {_AB}, {_PACK} SELECT v, base, bit_or(state) AS state FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) GROUP BY 1, 2")
def bsr_union(spark, sf_dir):
    return sets.packed_union(*_packed_sides(spark, sf_dir), ["v"])


@query("SELECT s_nationkey, l_partkey // 32 AS base, bit_or(1::BIGINT << (l_partkey % 32)::INT) AS state FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def bsr_fast_union(spark, sf_dir):
    packs = sets.pack(_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("v"), F.col("l_partkey").alias("x")))
    nation = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v"), "s_nationkey")
    return sets.fast_union(packs.join(nation, "v"), ["s_nationkey"])


@query(f"WITH {_AB}, d AS (SELECT * FROM a EXCEPT SELECT * FROM b) SELECT v, x // 32 AS base, bit_or(1::BIGINT << (x % 32)::INT) AS state FROM d GROUP BY 1, 2")
def bsr_subtract(spark, sf_dir):
    return sets.packed_subtract(*_packed_sides(spark, sf_dir), ["v"])


@query(f"WITH {_AB} SELECT v, x // 32 AS base, bit_or(1::BIGINT << (x % 32)::INT) AS state FROM (SELECT * FROM a UNION SELECT v, v FROM a) GROUP BY 1, 2")
def bsr_add_one(spark, sf_dir):
    a, _ = _two_sides(spark, sf_dir)
    return sets.packed_add(sets.pack(a), a.select("v", F.col("v").alias("x")).distinct())


@query(f"WITH {_AB} SELECT v, count(*)::BIGINT AS n FROM a GROUP BY v")
def bsr_degree(spark, sf_dir):
    return sets.packed_size(_packed_sides(spark, sf_dir)[0])


@query(f"WITH {_AB}, w AS (SELECT x FROM b GROUP BY x HAVING count(*) >= 2) SELECT v, x, CASE WHEN x IN (SELECT x FROM w) THEN 'X' ELSE 'P' END AS side FROM a")
def visited_split(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    out, inside = sets.split_visited(a, b.groupBy("x").count().where("count >= 2").select("x"))
    return out.select("v", "x", F.lit("P").alias("side")).union(inside.select("v", "x", F.lit("X").alias("side")))


@query("WITH a AS (SELECT DISTINCT l_suppkey AS v, l_orderkey * 97 AS x FROM lineitem WHERE l_quantity <= 25), b AS (SELECT DISTINCT l_suppkey AS v, l_orderkey * 97 AS x FROM lineitem WHERE l_quantity > 25) SELECT v, x FROM a JOIN b USING (v, x)")
def hierarchical_intersect(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("v"), (F.col("l_orderkey") * 97).alias("x"), "l_quantity")
    a, b = (sets.partition16(li.where(c).select("v", "x").distinct()) for c in ("l_quantity <= 25", "l_quantity > 25"))
    return sets.combine16(sets.intersect16(a, b))


@query(f"WITH {_SETS}, c AS (SELECT least(len(a), len(b)) AS lo, greatest(len(a), len(b)) AS hi, len(list_intersect(a, b)) AS n FROM p) SELECT count(*) AS inter_cnt, count(*) FILTER (WHERE n = 0) AS no_match_cnt, count(*) FILTER (WHERE lo * 32 < hi) AS skew_cnt, count(*) FILTER (WHERE NOT lo * 32 < hi AND (n / lo < 0.3 OR lo < 8)) AS low_select_cnt FROM c")
def pair_counters(spark, sf_dir):
    return stats.pair_counters(_set_pairs(spark, sf_dir))


# large stored sets, filters before the shuffle


@query("SELECT l_suppkey AS v, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1")
def set_probe(spark, sf_dir):
    """A small set of orders against the suppliers' stored sets of orders."""
    stored = probe.store_sets(_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("x")))
    wanted = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("x")).distinct()
    return probe.probe_sets(stored, wanted).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS v, l_partkey AS x FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'")
def bloom_intersect(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "v", "l_partkey": "x"})
    small, large = (li.where(c).select("v", "x") for c in ("l_returnflag = 'R' AND l_quantity > 45", "l_returnflag <> 'R'"))
    return probe.filtered_intersect(small.distinct(), large, "x").distinct()


# bitmaps and runs


@query("SELECT s_nationkey, coalesce(y::VARCHAR, 'all') AS year, count(DISTINCT l_partkey)::BIGINT AS n FROM (SELECT *, year(l_shipdate) AS y FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY GROUPING SETS ((s_nationkey, y), (s_nationkey))")
def bitmap_rollup(spark, sf_dir):
    """Parts by nation and year, and by nation: the latter from the former's bitmaps."""
    nation = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = _table(spark, sf_dir, "lineitem").join(nation, "l_suppkey").select("s_nationkey", F.year("l_shipdate").cast("string").alias("year"), F.col("l_partkey").alias("x"))
    fine = graph.cut(bitmaps.bitmaps(rows, ["s_nationkey", "year"]))
    coarse = bitmaps.bitmap_sizes(bitmaps.bitmap_union(fine, ["s_nationkey"]), ["s_nationkey"])
    return bitmaps.bitmap_sizes(fine, ["s_nationkey", "year"]).unionByName(coarse.withColumn("year", F.lit("all")))


@query("SELECT v, count(*)::BIGINT AS n FROM (SELECT l_suppkey AS v, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 3) GROUP BY 1")
def bitmap_intersect(spark, sf_dir):
    """How many parts each supplier has under all three flags."""
    chunks = bitmaps.bitmaps(_table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey", dealt=["l_suppkey"])
    return bitmaps.bitmap_sizes(bitmaps.bitmap_intersection(chunks, ["l_suppkey"], 3).withColumnRenamed("l_suppkey", "v"), ["v"])


_FLAGGED = "a AS (SELECT DISTINCT l_returnflag AS v, l_orderkey AS x FROM lineitem WHERE l_quantity <= 25), b AS (SELECT DISTINCT l_returnflag AS v, l_orderkey AS x FROM lineitem WHERE l_quantity > 25)"
_ISLANDS = 'SELECT v, min(x) AS "start", max(x) AS "end" FROM (SELECT v, x, x - row_number() OVER (PARTITION BY v ORDER BY x) AS i FROM {0}) GROUP BY v, i'


def _flagged_runs(spark, sf_dir) -> list[DataFrame]:
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("v"), F.col("l_orderkey").alias("x"), "l_quantity")
    return [bitmaps.to_runs(li.where(c).select("v", "x")) for c in ("l_quantity <= 25", "l_quantity > 25")]


@query(f"WITH {_FLAGGED} {_ISLANDS.format('a')}")
def runs_encode(spark, sf_dir):
    return _flagged_runs(spark, sf_dir)[0]


@query(f"WITH {_FLAGGED}, c AS (SELECT * FROM a INTERSECT SELECT * FROM b) {_ISLANDS.format('c')}")
def runs_intersect(spark, sf_dir):
    return bitmaps.runs_intersect(*_flagged_runs(spark, sf_dir))


@query(f"WITH {_FLAGGED}, c AS (SELECT * FROM a UNION SELECT * FROM b) {_ISLANDS.format('c')}")
def runs_union(spark, sf_dir):
    return bitmaps.runs_union(*_flagged_runs(spark, sf_dir))


@query(f"WITH {_FLAGGED}, c AS (SELECT * FROM a UNION SELECT * FROM b), r AS ({_ISLANDS.format('c')}) SELECT v, count(*) AS n_runs, sum(r.end - r.start + 1)::BIGINT AS n FROM r GROUP BY 1")
def runs_size(spark, sf_dir):
    return bitmaps.runs_size(bitmaps.runs_union(*_flagged_runs(spark, sf_dir)))


@query(f"WITH {_FLAGGED} SELECT v, x FROM a")
def runs_decode(spark, sf_dir):
    return bitmaps.from_runs(_flagged_runs(spark, sf_dir)[0])


# cores and cliques

#: Sequential peeling: k grows to the least degree that is left, and what has at most k neighbours left goes, all at once.
_PEEL = f"""WITH RECURSIVE {_PART.replace('g AS (', 'g AS MATERIALIZED (')}, {_SYM.replace('AS (', 'AS MATERIALIZED (')},
z(t, k, v, gone) AS (SELECT 0, 0::BIGINT, v, false FROM (SELECT unnest(range(0, (SELECT max(dst) FROM g) + 1)) AS v) UNION ALL
SELECT t + 1, greatest(k, min(d) OVER ()), v, d <= greatest(k, min(d) OVER ()) FROM (SELECT z.t, z.k, z.v, coalesce(any_value(n.d), 0) AS d FROM z LEFT JOIN (SELECT s.src, count(*) AS d FROM sym s JOIN z y ON y.v = s.dst AND NOT y.gone GROUP BY 1) n ON n.src = z.v WHERE NOT z.gone GROUP BY 1, 2, 3)),
pe AS MATERIALIZED (SELECT v, k AS core, t, row_number() OVER (ORDER BY t, v) - 1 AS rank FROM z WHERE gone)"""


@query(f"{_PEEL} SELECT v, core FROM pe")
def kcore(spark, sf_dir):
    return cores.core_numbers(part_graph(spark, sf_dir))


@query(f"{_PEEL} SELECT max(core) AS degeneracy FROM pe")
def degeneracy(spark, sf_dir):
    return cores.degeneracy(part_graph(spark, sf_dir))


@query(f"{_PEEL} SELECT v, rank FROM pe")
def degeneracy_order(spark, sf_dir):
    return cores.degeneracy_order(part_graph(spark, sf_dir))


@query(f"{_PEEL} SELECT a.v, count(b.v) AS later FROM pe a LEFT JOIN sym s ON s.src = a.v LEFT JOIN pe b ON b.v = s.dst AND b.rank > a.rank GROUP BY 1")
def degeneracy_later(spark, sf_dir):
    """How many neighbours follow each vertex in the degeneracy order; the most is the degeneracy."""
    edges = graph.cut(part_graph(spark, sf_dir))
    return cores.later_neighbours(edges, cores.degeneracy_order(edges))


def _clique_sql(g: str) -> str:
    return f"""WITH RECURSIVE {g}, {_SYM}, adj AS (SELECT src AS v, list(dst) AS n FROM sym GROUP BY src), c(clique, common) AS (
SELECT [g.src, g.dst], list_intersect(a.n, b.n) FROM g JOIN adj a ON a.v = g.src JOIN adj b ON b.v = g.dst
UNION ALL
SELECT list_append(clique, y), list_intersect(common, adj.n) FROM (SELECT clique, common, unnest(list_filter(common, lambda z: z > clique[-1])) AS y FROM c) x JOIN adj ON adj.v = x.y),
m AS (SELECT clique FROM c WHERE len(common) = 0 UNION ALL SELECT [v] FROM (SELECT unnest(range(0, (SELECT max(dst) FROM g) + 1)) AS v) r WHERE v NOT IN (SELECT src FROM sym))"""


@query(_clique_sql(_PART) + " SELECT array_to_string(clique, ' ') AS value FROM m")
def maximal_cliques(spark, sf_dir):
    return text.clique_lines(cliques.maximal_cliques(part_graph(spark, sf_dir)))


@query(_clique_sql(_PART) + " SELECT '{' || array_to_string(clique, ',') || '}' AS value FROM m")
def maximal_cliques_levels(spark, sf_dir):
    return text.clique_lines(cliques.maximal_cliques(part_graph(spark, sf_dir), "levels"), braces=True)


@query(_clique_sql(_PART) + " SELECT max(len(clique))::INT AS maximum_clique_size FROM m")
def maximum_clique_size(spark, sf_dir):
    return cliques.maximum_clique_size(cliques.maximal_cliques(part_graph(spark, sf_dir)))


@query(_clique_sql(_PART) + " SELECT len(clique)::INT AS size, count(*) AS n FROM m GROUP BY 1")
def clique_histogram(spark, sf_dir):
    return cliques.clique_sizes(cliques.maximal_cliques(part_graph(spark, sf_dir)))


# labelled patterns

PATH, TRIANGLE = Pattern((3, 7, 3), ((0, 1), (1, 2))), Pattern((1, 1, 2), ((0, 1), (1, 2), (0, 2)))
SQUARE, STAR = Pattern((0, 1, 2, 3), ((0, 1), (1, 2), (2, 3), (0, 3))), Pattern((5, 6, 6, 8), ((0, 1), (0, 2), (0, 3)))
CLIQUE = Pattern((1, 1, 2, 3), ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)))
SINGLE, APART = Pattern((4,)), Pattern((0, 1, 2, 3), ((0, 1), (2, 3)))


def _match_sql(p: Pattern, g: str = _PART) -> str:
    """One materialised step a pattern edge, in the edges' order, which reaches every vertex from the first; a pattern that isn't so connected matches nothing."""
    labels = p.labels
    if not p.edges:
        return f"WITH {_LABELS} SELECT vertex AS m0 FROM lab WHERE label = {labels[0]}"
    steps = ["le AS MATERIALIZED (SELECT s.src, s.dst, a.label AS ls, b.label AS ld FROM sym s JOIN lab a ON a.vertex = s.src JOIN lab b ON b.vertex = s.dst)"]
    bound: list[int] = []
    for k, (x, y) in enumerate(p.edges):
        if y in bound and x not in bound:
            x, y = y, x
        e = f"(SELECT src AS x, dst AS y FROM le WHERE ls = {labels[x]} AND ld = {labels[y]}) e"
        if not bound:
            steps.append(f"s0 AS MATERIALIZED (SELECT x AS m{x}, y AS m{y} FROM {e})")
            bound += [x, y]
        elif y in bound:
            steps.append(f"s{k} AS MATERIALIZED (SELECT s.* FROM s{k - 1} s JOIN {e} ON e.x = s.m{x} AND e.y = s.m{y})")
        elif x in bound:
            steps.append(f"s{k} AS MATERIALIZED (SELECT s.*, e.y AS m{y} FROM s{k - 1} s JOIN {e} ON e.x = s.m{x} WHERE e.y NOT IN ({', '.join(f's.m{i}' for i in bound)}))")
            bound.append(y)
        else:
            return "SELECT " + ", ".join(f"0::BIGINT AS m{i}" for i in range(len(labels))) + " WHERE false"
    return f"WITH {g}, {_SYM}, {_LABELS}, {', '.join(steps)} SELECT {', '.join(f'm{i}' for i in range(len(labels)))} FROM s{len(p.edges) - 1}"


def _match(spark, sf_dir, p: Pattern, strategy: str = "extend") -> DataFrame:
    return matching.match_patterns(part_graph(spark, sf_dir), brand_labels(spark, sf_dir), [p], strategy)[0]


@query(_match_sql(PATH))
def sm_path(spark, sf_dir):
    return _match(spark, sf_dir, PATH)


@query(_match_sql(TRIANGLE))
def sm_triangle(spark, sf_dir):
    return _match(spark, sf_dir, TRIANGLE)


@query(_match_sql(TRIANGLE))
def sm_triangle_packed(spark, sf_dir):
    return matching.match_packed(part_graph(spark, sf_dir), brand_labels(spark, sf_dir), TRIANGLE)


@query(_match_sql(SQUARE))
def sm_square(spark, sf_dir):
    return _match(spark, sf_dir, SQUARE)


@query(_match_sql(SQUARE))
def sm_square_join(spark, sf_dir):
    return _match(spark, sf_dir, SQUARE, "join")


@query(_match_sql(CLIQUE))
def sm_clique(spark, sf_dir):
    return _match(spark, sf_dir, CLIQUE)


@query(_match_sql(STAR))
def sm_star(spark, sf_dir):
    return _match(spark, sf_dir, STAR)


@query(_match_sql(SINGLE))
def sm_single_vertex(spark, sf_dir):
    return _match(spark, sf_dir, SINGLE)


@query(_match_sql(APART))
def sm_disconnected(spark, sf_dir):
    return _match(spark, sf_dir, APART)


_MULTI = (PATH, TRIANGLE, SINGLE, APART)


@query(" UNION ALL ".join(f"SELECT {i} AS query_id, count(*) AS n FROM ({_match_sql(p)})" for i, p in enumerate(_MULTI)))
def sm_counts(spark, sf_dir):
    return matching.match_counts(part_graph(spark, sf_dir), brand_labels(spark, sf_dir), list(_MULTI))


# orders and statistics

_ORDER = f"WITH {_REPEAT}, {_DEG.format(g='g')}, d AS (SELECT v, out_deg + in_deg AS deg FROM deg)"


@query(f"{_ORDER} SELECT v AS org_id, row_number() OVER (ORDER BY deg DESC, v) - 1 AS new_id FROM d")
def order_degree_desc(spark, sf_dir):
    return reorder.degree_order(repeat_graph(spark, sf_dir))


@query(f"{_ORDER} SELECT v AS org_id, row_number() OVER (ORDER BY deg, v) - 1 AS new_id FROM d")
def order_degree_asc(spark, sf_dir):
    return reorder.degree_order(repeat_graph(spark, sf_dir), descending=False)


@query(f"WITH RECURSIVE {_REPEAT}, {_SYM}, r(v, comp) AS (SELECT src, src FROM sym UNION SELECT s.dst, r.comp FROM r JOIN sym s ON s.src = r.v WHERE r.comp < s.dst), c AS (SELECT v, min(comp) AS root FROM r GROUP BY v), b(v, root, level) AS (SELECT v, root, 0 FROM c WHERE v = root UNION SELECT s.dst, b.root, b.level + 1 FROM b JOIN sym s ON s.src = b.v WHERE b.level < 12), m AS (SELECT v, root, min(level) AS level FROM b GROUP BY 1, 2) SELECT x.v, coalesce(m.root, x.v) AS root, coalesce(m.level, 0)::INT AS level FROM (SELECT unnest(range(0, (SELECT max(dst) FROM g) + 1)) AS v) x LEFT JOIN m ON m.v = x.v")
def bfs_levels(spark, sf_dir):
    return reorder.bfs_levels(repeat_graph(spark, sf_dir))


def _discovery_sql(sources: str, children: str = "v") -> str:
    """o(v, s, level, pos): breadth-first discovery, level by level. Sources and the children of a vertex come by the keys given.

    Levels are those of the least source of a component; a vertex comes by its first parent, then as its child.
    """
    return f"""WITH RECURSIVE {_REPEAT.replace('g AS (', 'g AS MATERIALIZED (')}, {_SYM.replace('AS (', 'AS MATERIALIZED (')}, {_DEG.format(g='g')}, d AS MATERIALIZED (SELECT v, out_deg + in_deg AS deg FROM deg),
k AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY {sources}) AS s, row_number() OVER (ORDER BY {children}) AS c FROM d),
r(v, comp) AS (SELECT v, v FROM d UNION SELECT e.dst, r.comp FROM r JOIN sym e ON e.src = r.v WHERE r.comp < e.dst),
m0 AS MATERIALIZED (SELECT v, min(comp) AS comp FROM r GROUP BY v), root AS MATERIALIZED (SELECT comp, min(s) AS s FROM m0 JOIN k USING (v) GROUP BY comp),
b(v, s, level) AS (SELECT k.v, k.s, 0 FROM k JOIN root USING (s) UNION SELECT e.dst, b.s, b.level + 1 FROM b JOIN sym e ON e.src = b.v WHERE b.level < 30),
m AS MATERIALIZED (SELECT v, min(s) AS s, min(level) AS level FROM b GROUP BY v),
o(v, s, level, pos) AS (SELECT v, s, level, s FROM m WHERE level = 0 UNION ALL
SELECT v, s, level, row_number() OVER (ORDER BY parent, c) FROM (SELECT m.v, m.s, m.level, k.c, min(o.pos) AS parent FROM o JOIN sym e ON e.src = o.v JOIN m ON m.v = e.dst AND m.level = o.level + 1 JOIN k ON k.v = m.v GROUP BY 1, 2, 3, 4))"""


_FOUND = "SELECT v AS org_id, row_number() OVER (ORDER BY s, level, pos) - 1 AS new_id FROM o"
_ORDER_SQL = {
    "bfs": f"{_discovery_sql('v')} {_FOUND}", "bfs_degree": f"{_discovery_sql('deg DESC, v')} {_FOUND}",
    "rcm": f"{_discovery_sql('deg, v', 'deg, v')} SELECT v AS org_id, row_number() OVER (ORDER BY s DESC, level DESC, pos DESC) - 1 AS new_id FROM o",
}
#: On a symmetric graph every list has an equal twin, so a vertex's first list is an out-list of its heaviest neighbour.
_ORDER_SQL["first_touch"] = f"""{_discovery_sql('deg, v', 'deg, v')}, n AS MATERIALIZED (SELECT o.v, row_number() OVER (ORDER BY s DESC, level DESC, pos DESC) AS r, deg FROM o JOIN d USING (v)),
f AS (SELECT e.dst AS v, min([-h.deg, h.r]) AS hub FROM sym e JOIN n h ON h.v = e.src GROUP BY 1) SELECT n.v AS org_id, row_number() OVER (ORDER BY hub[1] NULLS LAST, hub[2], deg DESC, r) - 1 AS new_id FROM n LEFT JOIN f USING (v)"""


@query(f"{_discovery_sql('v')}, f AS ({_FOUND}) SELECT org_id, row_number() OVER (ORDER BY deg DESC, new_id) - 1 AS new_id FROM f JOIN d ON d.v = org_id")
def order_hybrid(spark, sf_dir):
    return reorder.hybrid_order(graph.symmetrise(repeat_graph(spark, sf_dir)))


def _kernel_query(name: str):
    def run(spark, sf_dir):
        return reorder.vertex_order(graph.symmetrise(repeat_graph(spark, sf_dir)), name)

    run.__name__ = f"order_{name}"
    return run


for _name in (*reorder.KERNELS, *_ORDER_SQL):
    query(*([_ORDER_SQL[_name]] if _name in _ORDER_SQL else []))(_kernel_query(_name))

#: Whatever the order, it is a permutation and keeps every edge.
_VALID = f"WITH {_REPEAT} SELECT max(dst) + 1 AS n, 0::BIGINT AS least, max(dst) AS largest, max(dst) + 1 AS n_distinct, 2 * count(*) AS n_edges FROM g"


@query(_VALID)
def order_gro_valid(spark, sf_dir):
    edges = graph.symmetrise(repeat_graph(spark, sf_dir))
    new, mapping = reorder.reorder(edges, "gro")
    a = mapping.agg(F.count(F.lit(1)).alias("n"), F.min("new_id").alias("least"), F.max("new_id").alias("largest"), F.count_distinct("new_id").alias("n_distinct"))
    return a.join(F.broadcast(new.agg(F.count(F.lit(1)).alias("n_edges"))))


_SEDGES = f"{_PART}, {_SYM}"


@query(f"WITH {_SEDGES}, {_DEG.format(g='sym')}, po AS (SELECT src AS v, count(DISTINCT dst // 32) AS p FROM sym GROUP BY 1), pi AS (SELECT dst AS v, count(DISTINCT src // 32) AS p FROM sym GROUP BY 1), r AS (SELECT out_deg AS od, in_deg AS id, coalesce(po.p, 0) AS po, coalesce(pi.p, 0) AS pi FROM deg LEFT JOIN po USING (v) LEFT JOIN pi USING (v)) SELECT round(sum(po) / sum(od), 6) AS out_ratio, round(sum(pi) / sum(od), 6) AS in_ratio, round((sum(po) + sum(pi)) / sum(od) / 2, 6) AS comp_ratio, round(sum(po * sqrt(od) + pi * sqrt(id)) / sum(sqrt(od) + sqrt(id)), 6) AS score, round((sum(po) + sum(pi)) / (2 * count(*)), 6) AS norm, round((2 * sum(od) + 4 * count(*)) * 4.0 / 1024 / 1024, 6) AS plain_mb, round((1.5 * (sum(po) + sum(pi)) + 4 * count(*)) * 4.0 / 1024 / 1024, 6) AS packed_mb FROM r")
def comp_ratio(spark, sf_dir):
    out = stats.comp_ratio(graph.symmetrise(part_graph(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {_PART}, {_DEG.format(g='g')}, d AS (SELECT v, out_deg + in_deg AS deg FROM deg), r AS (SELECT v, deg, sum(deg) OVER (ORDER BY deg DESC, v ROWS UNBOUNDED PRECEDING) AS running, sum(deg) OVER () AS total FROM d) SELECT v, deg, running::BIGINT AS running FROM r WHERE running - deg < 0.2 * total")
def big_nodes(spark, sf_dir):
    return stats.big_nodes(part_graph(spark, sf_dir), 0.2)


@query(f"WITH {_PART}, {_DEG.format(g='g')}, r AS (SELECT v, out_deg, in_deg, out_deg + in_deg AS deg, sum(out_deg + in_deg) OVER (ORDER BY out_deg + in_deg DESC, v ROWS UNBOUNDED PRECEDING) AS running, sum(out_deg + in_deg) OVER () AS total FROM deg) SELECT count(*) AS n, round(count(*) / (SELECT count(*) FROM deg), 6) AS ratio, round(avg(deg), 6) AS avg_deg, round(var_pop(deg), 6) AS var_deg, arg_min(out_deg, running)::BIGINT AS max_out_deg, arg_min(in_deg, running)::BIGINT AS max_in_deg, arg_max(out_deg, running)::BIGINT AS min_out_deg, arg_max(in_deg, running)::BIGINT AS min_in_deg FROM r WHERE running - deg < 0.2 * total")
def big_node_stats(spark, sf_dir):
    out = stats.big_node_stats(part_graph(spark, sf_dir), 0.2)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("ratio", "avg_deg", "var_deg")], *out.columns[4:])


@query(f"WITH {_PART}, {_DEG.format(g='g')} SELECT count(*) AS n FROM deg WHERE out_deg = 1 OR in_deg = 1")
def leaf_count(spark, sf_dir):
    return stats.leaf_count(part_graph(spark, sf_dir))


@query(f"WITH {_PART}, {_DEG.format(g='g')}, t AS (SELECT sum(sqrt(out_deg) + sqrt(in_deg)) AS t FROM deg) SELECT v, round(sqrt(out_deg) / t, 9) AS alpha_out, round(sqrt(in_deg) / t, 9) AS alpha_in FROM deg, t")
def degree_weights(spark, sf_dir):
    return stats.degree_weights(part_graph(spark, sf_dir)).select("v", F.round("alpha_out", 9).alias("alpha_out"), F.round("alpha_in", 9).alias("alpha_in"))


_GIVEN = "w AS (SELECT l_partkey AS v, sum(l_quantity)::DOUBLE AS o, sum(l_linenumber)::DOUBLE AS i FROM lineitem GROUP BY 1)"


@query(f"WITH {_GIVEN}, t AS (SELECT sum(o + i) AS t FROM w) SELECT v, round(o / t, 9) AS alpha_out, round(i / t, 9) AS alpha_in FROM w, t")
def given_weights(spark, sf_dir):
    w = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("v")).agg(F.sum("l_quantity").cast("double").alias("out_weight"), F.sum("l_linenumber").cast("double").alias("in_weight"))
    return stats.given_weights(w).select("v", F.round("alpha_out", 9).alias("alpha_out"), F.round("alpha_in", 9).alias("alpha_in"))


@query(f"WITH {_PART}, {_DEG.format(g='g')}, s AS (SELECT v, 0 AS side, out_deg AS d FROM deg UNION ALL SELECT v, 1, in_deg FROM deg) SELECT v, side, row_number() OVER (ORDER BY d DESC, v, side) - 1 AS position FROM s")
def ranked_sides(spark, sf_dir):
    return stats.ranked_sides(stats.degree_weights(graph.cut(part_graph(spark, sf_dir)))).select("v", "side", "position")


# ids, labels and queries

_RAW = "raw AS (SELECT 'P' || l_partkey AS a, 'S' || l_suppkey AS b, l_orderkey * 10 + l_linenumber AS line FROM lineitem)"
_FIRST = f"{_RAW}, f AS (SELECT id, min(pos) AS pos FROM (SELECT a AS id, 2 * line AS pos FROM raw UNION ALL SELECT b, 2 * line + 1 FROM raw) GROUP BY id), n AS (SELECT id AS raw_id, row_number() OVER (ORDER BY pos, id) - 1 AS new_id FROM f)"


def _raw_edges(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("raw_src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("raw_dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))


@query(f"WITH {_FIRST} SELECT raw_id, new_id FROM n")
def densify_first_seen(spark, sf_dir):
    return ids.densify_first_seen(_raw_edges(spark, sf_dir))


@query(f"WITH {_FIRST}, e AS (SELECT x.new_id AS src, y.new_id AS dst FROM raw JOIN n x ON x.raw_id = a JOIN n y ON y.raw_id = b) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def relabel_raw_edges(spark, sf_dir):
    raw = _raw_edges(spark, sf_dir)
    return ids.relabel_raw(raw, ids.densify_first_seen(raw), both_directions=True)


_SORTED = "n AS (SELECT x AS org_id, row_number() OVER (ORDER BY x) - 1 AS new_id FROM (SELECT src AS x FROM g UNION SELECT dst FROM g))"


@query(f"WITH {_REPEAT}, {_SORTED} SELECT org_id, new_id FROM n")
def densify_sorted(spark, sf_dir):
    return ids.densify_sorted(repeat_graph(spark, sf_dir))


@query(f"WITH {_REPEAT}, {_SORTED} SELECT x.new_id AS src, y.new_id AS dst FROM g JOIN n x ON x.org_id = src JOIN n y ON y.org_id = dst")
def relabel_edges(spark, sf_dir):
    g = graph.cut(repeat_graph(spark, sf_dir))
    return ids.relabel(g, ids.densify_sorted(g))


@query(f"WITH {_REPEAT}, {_SORTED} SELECT org_id, (SELECT max(new_id) FROM n) - new_id AS new_id FROM n")
def compose_mappings(spark, sf_dir):
    one = graph.cut(ids.densify_sorted(repeat_graph(spark, sf_dir)))
    top = one.agg(F.max("new_id").alias("top"))
    two = one.join(F.broadcast(top)).select(F.col("new_id").alias("org_id"), (F.col("top") - F.col("new_id")).alias("new_id"))
    return ids.compose(one, two)


@query(f"WITH {_REPEAT}, {_SORTED}, {_LABELS} SELECT new_id AS vertex, label FROM lab JOIN n ON org_id = vertex")
def relabel_labels(spark, sf_dir):
    return ids.relabel_labels(brand_labels(spark, sf_dir), ids.densify_sorted(repeat_graph(spark, sf_dir)))


@query(f"WITH {_REPEAT}, {_SORTED} SELECT x.new_id * 1000000 + row_number() OVER (PARTITION BY src ORDER BY dst) AS query_id, x.new_id || ' ' || y.new_id AS line FROM g JOIN n x ON x.org_id = src JOIN n y ON y.org_id = dst")
def relabel_queries(spark, sf_dir):
    g = graph.cut(repeat_graph(spark, sf_dir))
    n = graph.cut(ids.densify_sorted(g))
    rows = g.join(n.withColumnRenamed("org_id", "src"), "src").withColumn("query_id", F.col("new_id") * 1_000_000 + F.row_number().over(W.partitionBy("src").orderBy("dst")))
    return ids.relabel_queries(rows.select("query_id", F.concat_ws(" ", "src", "dst").alias("line")), n)


def _lehmer_sql(n: str, seed: int, bound: str) -> str:
    return f"((((({n}) * 40503 + {seed + 1}) % 2147483647 * 48271) % 2147483647 * 48271) % 2147483647) % {bound}"


_PARTS = "(SELECT max(p_partkey) + 1 FROM part)"


def _n_parts(spark, sf_dir) -> int:
    return _table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]


@query(f"SELECT i AS vertex, {_lehmer_sql('i', 0, '100')} AS label FROM range(0, {_PARTS}) t(i)")
def generate_labels(spark, sf_dir):
    return ids.gen_labels(spark, _n_parts(spark, sf_dir))


@query(f"SELECT i AS query_id, {_lehmer_sql('i', 0, _PARTS)} AS vertex FROM range(0, 1000) t(i)")
def generate_vertex_queries(spark, sf_dir):
    return ids.gen_vertex_queries(spark, _n_parts(spark, sf_dir))


@query(f"SELECT i AS query_id, {_lehmer_sql('2 * i', 0, _PARTS)} AS src, {_lehmer_sql('2 * i + 1', 0, _PARTS)} AS dst FROM range(0, 50000) t(i)")
def generate_distance_queries(spark, sf_dir):
    return ids.gen_distance_queries(spark, _n_parts(spark, sf_dir))


_LEN, _SKEW, _SEL, _DENS = 40_000, 4.0, 0.1, 0.01
_NB, _NC = int(_LEN / _SKEW), min(int(_LEN / _SKEW), int(_LEN * _SEL))
_TOTAL = _LEN + _NB - _NC
_FROM = max(_TOTAL + 1, min(int(_TOTAL / _DENS), 2_147_483_647))
_PRIME = f"q AS MATERIALIZED (SELECT min(n) AS q FROM range({_FROM}, {_FROM} + 500) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 46341) d(k) WHERE k * k <= n AND n % k = 0))"


@query(f"WITH {_PRIME}, r AS (SELECT i, ((i + 1) * 48271) % q AS x FROM range(0, {_TOTAL}) t(i), q) SELECT 'a' AS set_id, x FROM r WHERE i < {_LEN} UNION ALL SELECT 'b', x FROM r WHERE i < {_NC} OR i >= {_LEN}")
def generate_set_pair(spark, sf_dir):
    return synth.set_pair(spark, _LEN, _SKEW, _SEL, _DENS)


@query("WITH m AS (SELECT 0.75::DOUBLE * (1 - 16777215.0::DOUBLE / 4294967295.0::DOUBLE) AS s), l AS (SELECT s ** 4 AS n0, 4 * s ** 3 * (1 - s) AS n1 FROM m), q AS (SELECT n0 ** 4 AS none, 1 - (n0 + n1) ** 4 AS several FROM l) SELECT round(none, 9) AS no_match, round(several, 9) AS multi_match, round(4 * none + 12 * (1 - none), 9) AS word_check_cost, round(2 * none + 6 * (1 - none - several) + 8.2 * several, 9) AS byte_filter_cost FROM q")
def filter_cost(spark, sf_dir):
    out = synth.filter_cost(spark)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("WITH a AS (SELECT l_linenumber AS x, sum(l_quantity) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linenumber AS x, sum(l_quantity) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT x, round(b.t / a.t, 6) AS ratio FROM a JOIN b USING (x)")
def relative_speed(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    series = lambda f: li.where(F.col("l_returnflag") == f).groupBy(F.col("l_linenumber").alias("x")).agg(F.sum("l_quantity").alias("t"))
    return synth.relative_speed(series("A"), series("R")).select("x", F.round("ratio", 6).alias("ratio"))


# files


@query(f"WITH {_REPEAT} SELECT src, dst FROM g")
def edge_file_round_trip(spark, sf_dir):
    path = _folder(spark, "edges")
    text.write_edges(repeat_graph(spark, sf_dir), path)
    return text.read_edges(spark, path)


@query(f"WITH {_LABELS} SELECT vertex, label FROM lab")
def label_file_round_trip(spark, sf_dir):
    path = _folder(spark, "labels")
    text.write_lines(brand_labels(spark, sf_dir).select(F.concat_ws(" ", "vertex", "label").alias("value")), path)
    return text.read_labels(spark, path)


def _echo_sql(query_id: int, *lines: str) -> str:
    return f"SELECT {query_id} AS query_id, {' || '.join(f'{x!r} || chr(10)' for x in lines)} AS value"


@query(" UNION ALL ".join((_echo_sql(0, "query: v_num=3 e_num=2", "3 7 3 ", "0 1", "1 2"), _echo_sql(1, "query: v_num=3 e_num=3", "1 1 2 ", "0 1", "0 2", "1 2"), _echo_sql(2, "query: v_num=1 e_num=0", "4 "), _echo_sql(3, "query: v_num=4 e_num=2", "0 1 2 3 ", "0 1", "2 3"))))
def pattern_echo(spark, sf_dir):
    path = _folder(spark, "patterns")
    text.write_lines(spark.createDataFrame([("".join(p.block() for p in _MULTI),)], "value string"), path)
    return spark.createDataFrame([(i, p.echo()) for i, p in enumerate(text.read_patterns(spark, path))], "query_id int, value string")


@query(f"WITH {_REPEAT}, {_SORTED} SELECT org_id, new_id FROM n")
def id_file_round_trip(spark, sf_dir):
    path = _folder(spark, "ids")
    text.write_ids(ids.densify_sorted(repeat_graph(spark, sf_dir)), path)
    return text.read_ids(spark, path)


@query("SELECT coalesce(try_cast(regexp_extract(value, '^(\\d*)(?:.(\\d*))?', 1) AS BIGINT), 0) AS src, coalesce(try_cast(regexp_extract(value, '^(\\d*)(?:.(\\d*))?', 2) AS BIGINT), 0) AS dst FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN l_partkey || ' ' || l_suppkey || ' 9' WHEN 1 THEN l_partkey || chr(9) || l_suppkey ELSE l_partkey || '  ' || l_suppkey END AS value FROM lineitem)")
def parse_edges_strict(spark, sf_dir):
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kind = F.col("l_linenumber") % 3
    line = F.when(kind == 0, F.concat(p, F.lit(" "), s, F.lit(" 9"))).when(kind == 1, F.concat(p, F.lit("\t"), s)).otherwise(F.concat(p, F.lit("  "), s))
    return text.parse_edges(_table(spark, sf_dir, "lineitem").select(line.alias("value")), "strict")


@query(" UNION ALL ".join(f"SELECT 'ans{i}=' || count(*) AS value FROM ({_match_sql(p)})" for i, p in enumerate(_MULTI)))
def match_count_lines(spark, sf_dir):
    path = _folder(spark, "counts")
    text.write_match_counts(sm_counts(spark, sf_dir), path)
    return spark.read.text(path)
