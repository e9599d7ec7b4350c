"""Command line: python -m tessera.cli {tc,mc,sm,reorder,intersect} ...

Counts that are printed are observed on the rows as they are read or written; no job runs for them alone.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sets, synth
from tessera.operators import cliques, graph, reorder, stats, triangles
from tessera.plans import matching
from tessera.sources import text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    tc = sub.add_parser("tc", help="count triangles")
    tc.add_argument("graph")
    tc.add_argument("--strategy", choices=("array", "wedge", "bsr", "grid"), default="array")
    mc = sub.add_parser("mc", help="list maximal cliques")
    mc.add_argument("graph")
    mc.add_argument("out", nargs="?")
    mc.add_argument("--strategy", choices=("search", "levels"), default="search")
    mc.add_argument("--order", choices=("degree", "degeneracy"), default="degree")
    mc.add_argument("--braces", action="store_true")
    sm = sub.add_parser("sm", help="match labelled patterns")
    for name in ("graph", "labels", "patterns"):
        sm.add_argument(name)
    sm.add_argument("out", nargs="?")
    sm.add_argument("--strategy", choices=("extend", "join"), default="extend")
    ro = sub.add_parser("reorder", help="renumber vertices")
    ro.add_argument("graph")
    ro.add_argument("--order", default="gro", help=", ".join([*reorder.PLANS, *reorder.KERNELS]))
    ro.add_argument("--ratio", action="store_true", help="only report the packing ratio")
    it = sub.add_parser("intersect", help="time the set intersection strategies on a random pair")
    it.add_argument("--length", type=int, default=4_000_000)
    it.add_argument("--skew", type=float, default=1.0)
    it.add_argument("--selectivity", type=float, default=0.1)
    it.add_argument("--density", type=float, default=0.01)
    it.add_argument("--repeats", type=int, default=3)
    for x in (tc, mc, sm, ro):
        x.add_argument("--parse", choices=("sane", "strict"), default="sane")
    return p


def _intersections(spark: SparkSession, a) -> dict:
    """Every strategy must find as many common elements as the plain join."""
    pair = graph.cut(synth.set_pair(spark, a.length, a.skew, a.selectivity, a.density).select(F.lit(0).cast("bigint").alias("v"), "x", "set_id"))
    x, y = (pair.where(F.col("set_id") == k).select("v", "x") for k in "ab")
    px, py = graph.cut(sets.pack(x)), graph.cut(sets.pack(y))
    hx, hy = graph.cut(sets.partition16(x)), graph.cut(sets.partition16(y))
    # arrays by high bits: none has more than 65,536 elements
    split = lambda s, name: s.groupBy("v", F.shiftright("x", 16).alias("prefix")).agg(F.sort_array(F.collect_list("x")).alias(name))
    lists = graph.cut(split(x, "a").join(split(y, "b"), ["v", "prefix"]))
    ways = {
        "join": lambda: x.join(y, ["v", "x"]).count(),
        "packed": lambda: sets.packed_size(sets.packed_intersect(px, py, ["v"])).agg(F.sum("n")).first()[0] or 0,
        "hierarchical": lambda: sets.combine16(sets.intersect16(hx, hy)).count(),
        "array": lambda: lists.agg(F.sum(sets.intersect_count("a", "b"))).first()[0] or 0,
    }
    out = {}
    for name, run in ways.items():
        times = []
        for _ in range(a.repeats):
            began = time.time()
            n = run()
            times.append(time.time() - began)
        out[name] = {"n": n, "run_time": round(min(times), 4), "ele_per_usec": round((a.length + a.length / a.skew) / min(times) / 1e6, 3)}
    if len({r["n"] for r in out.values()}) != 1:
        raise RuntimeError(f"the strategies disagree: {out}")
    return out


def _observed(df: DataFrame, **metrics) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), seen


def _run(df: DataFrame) -> None:
    """All rows, to nowhere."""
    df.write.format("noop").mode("overwrite").save()


def main(argv: list[str] | None = None) -> dict:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    began = time.time()
    out: dict = {"command": a.command}
    rows = F.count(F.lit(1))
    if a.command == "intersect":
        out |= _intersections(spark, a)
    else:
        read, seen = _observed(text.read_edges(spark, a.graph, a.parse), edges=rows, largest=F.max(F.greatest("src", "dst")))
        edges = graph.cut(read)
        out["read_s"] = round(time.time() - began, 3)
        out |= {"edges": seen.get["edges"], "vertices": 0 if seen.get["largest"] is None else seen.get["largest"] + 1}
        began = time.time()
    if a.command == "tc":
        out["triangles"] = triangles.triangle_count(edges, a.strategy).first()[0]
    elif a.command == "mc":
        found, seen = _observed(cliques.maximal_cliques(edges, a.strategy, a.order), cliques=rows, maximum_clique_size=F.coalesce(F.max(F.size("clique")), F.lit(0)))
        if a.out:
            text.write_cliques(found, a.out, a.braces)
        else:
            _run(found)
        out |= seen.get
    elif a.command == "sm":
        counts = graph.cut(matching.match_counts(edges, text.read_labels(spark, a.labels), text.read_patterns(spark, a.patterns), a.strategy))
        # a row a pattern
        out["matches"] = {r[0]: r[1] for r in counts.orderBy("query_id").collect()}
        if a.out:
            text.write_match_counts(counts, a.out)
    elif a.command == "reorder":
        if not a.ratio:
            edges, ids = reorder.reorder(edges, a.order)
            name = a.order.upper()
            path = text.output_name(a.graph, name)
            text.write_edges(edges, path)
            text.write_ids(ids, text.output_name(a.graph, name, ids=True))
            edges = text.read_edges(spark, path)
        sides, seen = _observed(stats.packed_sides(edges), **stats.ratio_metrics())
        _run(sides)
        out |= seen.get
    out["query_s"] = round(time.time() - began, 3)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
