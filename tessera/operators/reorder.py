"""Vertex orders: (org_id, new_id), a permutation of 0..V-1.

Degree, hybrid, breadth-first, RCM and first-touch orders are DataFrame plans on
all edges. A breadth-first search writes each level as a part of its own and finds the next one
from it by joins, so it writes every vertex once, however long its paths are. The other orders follow one vertex after another by nature and run as a
kernel that holds the whole graph in one task; a graph of more than MOST_VERTICES vertices or MOST_EDGES edges is an
error there.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.queues import BucketQueue, OrderedPool
from tessera.functions.sets import WIDTH
from tessera.operators.cores import dense_positions
from tessera.operators.graph import Levels, Rounds, components, cut, degrees, is_symmetric, symmetrise, vertices
from tessera.operators.ids import relabel

Lists = list[list[int]]
#: Rows of a level that may be broadcast, and numbered by one window.
BROADCAST_ROWS = 200_000


# DataFrame orders


def degree_order(edges: DataFrame, descending: bool = True) -> DataFrame:
    """By total degree of the bag, ties by id."""
    key = F.desc("deg") if descending else F.asc("deg")
    return dense_positions(degrees(edges), [key, F.col("v")], "new_id").select(F.col("v").alias("org_id"), "new_id")


def bfs_levels(edges: DataFrame) -> DataFrame:
    """(v, root, level): breadth-first levels over edges taken both ways, from the least vertex of each component. Vertices without edges are their own roots."""
    edges = cut(edges.select("src", "dst"))
    comp = cut(components(edges))
    both = cut(symmetrise(edges).where("src <> dst").distinct())
    levels = Levels(edges.sparkSession, "v bigint, root bigint, level int")
    found, at = levels.add(comp.where("v = comp").select("v", F.col("comp").alias("root"), F.lit(0).alias("level"))), 0
    while found:
        at += 1
        reach = both.join(_front(levels.last(1), found).select(F.col("v").alias("src"), "root"), "src").select(F.col("dst").alias("v"), "root").distinct()
        # an edge leads to the level before, the same one or the next
        found = levels.add(reach.join(levels.last(2).select("v"), "v", "left_anti").select("v", "root", F.lit(at).alias("level")))
    alone = vertices(edges).join(comp.select("v"), "v", "left_anti")
    return levels.last().union(alone.select("v", F.col("v").alias("root"), F.lit(0).alias("level")))


def _front(level: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(level) if rows <= BROADCAST_ROWS else level


def _discovery(arcs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(v, position) in order of breadth-first discovery over out-edges, as a queue would find them.

    arcs: each once, materialised. ranks: (v, s, c), each vertex's own places among sources and among the
    children of a vertex. A vertex belongs to the least source that reaches it;
    of a level, vertices come by their first parent, then as its children.
    Vertices without arcs are their own sources and take no part in rounds.
    """
    spark = arcs.sparkSession
    arcs = arcs.where("src <> dst")
    ends = symmetrise(arcs).select(F.col("src").alias("v"), F.lit(True).alias("linked")).distinct()
    ranks = cut(ranks.join(ends, "v", "left").select("v", "s", "c", "linked"))
    rounds = Rounds(spark)
    seen = rounds.cut(ranks.where("linked").select("v", "s", "c", F.col("s").alias("root"), F.col("s").alias("old")))
    while True:
        near = arcs.join(seen.select(F.col("v").alias("src"), "root"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("root").alias("m"))
        step = seen.select("v", "s", "c", F.col("root").alias("old")).join(near, "v", "left").select("v", "s", "c", "old", F.least("old", "m").alias("root"))
        # who reaches a vertex's source reaches the vertex
        jump = step.select(F.col("s").alias("at"), F.col("root").alias("to"))
        seen = rounds.cut(step.join(jump, step["root"] == jump["at"]).select("v", "s", "c", F.col("to").alias("root"), "old"))
        if seen.where("root <> old").isEmpty():
            break
    # an arc inside a source's vertices, with what its target needs to know
    inside = seen.select("v", "c", "root")
    arcs = cut(arcs.join(inside.select(F.col("v").alias("src"), F.col("root").alias("of")), "src").join(inside.select(F.col("v").alias("dst"), "c", "root"), "dst").where("root = of").select("src", "dst", "c", "root"))
    # where every arc has its reverse, it leads to the level before, the same one or the next
    back = 2 if is_symmetric(arcs.select("src", "dst")) else None
    levels = Levels(spark, "v bigint, root bigint, level int, parent bigint, c bigint")
    found, at = levels.add(seen.where("root = s").select("v", "root", F.lit(0).alias("level"), F.col("s").alias("parent"), "c")), 0
    while found:
        at += 1
        front = _numbered(levels.last(1), found)
        reach = arcs.join(_front(front.select(F.col("v").alias("src"), "pos"), found), "src")
        new = reach.groupBy(F.col("dst").alias("v"), "root", "c").agg(F.min("pos").alias("parent")).join(levels.last(back).select("v"), "v", "left_anti")
        found = levels.add(new.select("v", "root", F.lit(at).alias("level"), "parent", "c"))
    alone = ranks.where("linked is null").select("v", F.col("s").alias("root"), F.lit(0).alias("level"), F.col("s").alias("parent"), "c")
    return dense_positions(levels.last().union(alone), ["root", "level", "parent", "c"]).select("v", "position")


def _numbered(level: DataFrame, rows: int) -> DataFrame:
    """(v, pos) of a level: by first parent, then as its child. A window over all of a level only where it is small."""
    if rows <= BROADCAST_ROWS:
        return level.select("v", F.row_number().over(W.orderBy("parent", "c")).cast("bigint").alias("pos"))
    return dense_positions(level, ["parent", "c"], "pos").select("v", "pos")


def _arcs(edges: DataFrame) -> DataFrame:
    """Directed edges, each once. Materialised: what comes after runs through them often."""
    return cut(edges.select("src", "dst").distinct())


def bfs_order(edges: DataFrame) -> DataFrame:
    """Breadth first, sources and children by id."""
    arcs = _arcs(edges)
    ranks = vertices(arcs).select("v", F.col("v").alias("s"), F.col("v").alias("c"))
    return _discovery(arcs, ranks).select(F.col("v").alias("org_id"), F.col("position").alias("new_id"))


def bfs_degree_order(edges: DataFrame) -> DataFrame:
    """Breadth first, sources by falling number of distinct out-neighbours."""
    arcs = _arcs(edges)
    ranks = dense_positions(degrees(arcs), [F.desc("out_deg"), F.col("v")], "s").select("v", "s", F.col("v").alias("c"))
    return _discovery(arcs, ranks).select(F.col("v").alias("org_id"), F.col("position").alias("new_id"))


def rcm_order(edges: DataFrame) -> DataFrame:
    """Reverse Cuthill-McKee: sources and children by rising degree without repeats, numbered from the end."""
    arcs = _arcs(edges)
    ranks = dense_positions(degrees(arcs), ["deg", "v"], "s").select("v", "s", F.col("s").alias("c"))
    found = _discovery(arcs, ranks)
    return dense_positions(found, [F.desc("position")], "new_id").select(F.col("v").alias("org_id"), "new_id")


def first_touch_order(edges: DataFrame) -> DataFrame:
    """Neighbour lists of the heaviest vertices first, heaviest neighbours first, ties in reverse Cuthill-McKee order; a vertex is placed where it is first met.

    Out-lists weigh their vertex by its out-degree and their members by in-degree, in-lists the other way round.
    """
    arcs = _arcs(edges)
    rank = rcm_order(arcs).select(F.col("org_id").alias("v"), F.col("new_id").alias("rank"))
    nodes = cut(degrees(arcs).join(rank, "v"))
    touch = lambda hub, w, side, d: arcs.join(nodes.select(F.col("v").alias(hub), F.col(d).alias("n"), "rank"), hub).select(F.col(w).alias("v"), F.struct((-F.col("n")).alias("n"), F.col("rank").alias("hub"), F.lit(side).alias("side")).alias("list"))
    first = touch("src", "dst", 0, "out_deg").union(touch("dst", "src", 1, "in_deg")).groupBy("v").agg(F.min("list").alias("list"))
    weight = F.when(F.col("list.side") == 0, F.col("in_deg")).otherwise(F.col("out_deg")).alias("weight")
    rows = nodes.join(first, "v", "left").select("v", "rank", weight, "list.n", "list.hub", "list.side")
    return dense_positions(rows, [F.col("n").asc_nulls_last(), "hub", "side", F.desc("weight"), "rank"], "new_id").select(F.col("v").alias("org_id"), "new_id")


def hybrid_order(edges: DataFrame) -> DataFrame:
    """By falling degree; ties by breadth-first discovery."""
    edges = cut(edges.select("src", "dst"))
    found = bfs_order(edges).withColumnsRenamed({"org_id": "v", "new_id": "bfs"})
    rows = degrees(edges).join(found, "v")
    return dense_positions(rows, [F.desc("deg"), F.col("bfs")], "new_id").select(F.col("v").alias("org_id"), "new_id")


# kernels: (out, into) neighbour lists of vertices 0..n-1 to the vertices in their new order


def dfs_kernel(out: Lists, into: Lists) -> list[int]:
    order, seen = [], [False] * len(out)
    for s in range(len(out)):
        stack = [s]
        while stack:
            u = stack.pop()
            if not seen[u]:
                seen[u] = True
                order.append(u)
                stack += [v for v in reversed(out[u]) if not seen[v]]
    return order


def gro_kernel(out: Lists, into: Lists, width: int = WIDTH) -> list[int]:
    """Greedy windows of `width` ids: each opens with the heaviest vertex left, then takes the one that shares most hubs with the window."""
    n = len(out)
    queue = BucketQueue(range(n))
    pool = OrderedPool(sorted(range(n), key=lambda v: (-len(out[v]) - len(into[v]), v)))
    order: list[int] = []
    raised: dict[int, int] = {}
    hubs: set[tuple[int, int]] = set()

    def place(u: int) -> None:
        order.append(u)
        pool.remove(u)
        raised.pop(u, None)
        for side, (near, back) in enumerate(((into, out), (out, into))):
            for hub in near[u]:
                if (side, hub) not in hubs:
                    hubs.add((side, hub))
                    for w in back[hub]:
                        if w in queue:
                            queue.raise_score(w)
                            raised[w] = raised.get(w, 0) + 1

    while len(pool):
        if len(order) % width == 0:
            for w, s in raised.items():
                queue.raise_score(w, -s)
            raised, hubs = {}, set()
            queue._best = 0
        best = queue.top() if raised else None
        u = best[0] if best and best[1] > 0 else pool.head()
        queue.remove(u)
        place(u)
    return order


def slashburn_kernel(out: Lists, into: Lists) -> list[int]:
    """Hubs to the front, what falls off the giant component to the back, again and again; over out-edges.

    A round takes the k vertices with most neighbours that were no hub before,
    larger ids first. What their neighbours reach, breadth first, parts into
    components; all but the largest go to the back by (first hub, size), the
    first of them last. What no hub leads to waits for a later round. Fewer
    than k vertices stay in id order. k is V / 1024, at most 1024, here at least 1.
    """
    k = max(1, min(len(out) // 1024, 1024))
    deg = [len(x) for x in out]
    heap = [(-d, -v) for v, d in enumerate(deg)]
    heapq.heapify(heap)
    left = set(range(len(out)))
    front: list[int] = []
    back: list[int] = []

    def next_hub() -> int:
        while True:
            d, v = heapq.heappop(heap)
            if -v in left and -d == deg[-v]:
                return -v
            if -v in left:
                heapq.heappush(heap, (-deg[-v], v))

    while len(left) >= k:
        hubs = []
        for _ in range(k):
            hubs.append(next_hub())
            left.discard(hubs[-1])
            for v in out[hubs[-1]]:
                deg[v] -= 1
        front += hubs
        free, parts = set(left), []
        for i, s in ((i, s) for i, h in enumerate(hubs) for s in out[h]):
            if s in free:
                part = [s]
                free.discard(s)
                for u in part:  # grows as it is read
                    new = [v for v in out[u] if v in free]
                    free.difference_update(new)
                    part += new
                parts.append((i, len(part), part))
        parts.sort(key=lambda p: p[:2])
        giant = max(parts, key=lambda p: p[1], default=None)
        for p in parts:
            if p is not giant:
                back += p[2]
                left.difference_update(p[2])
    return front + sorted(left) + back[::-1]


def bisection_kernel(out: Lists, into: Lists, width: int = WIDTH, rounds: int = 20, levels: int | None = None) -> list[int]:
    """Recursive bisection that swaps vertices while the modelled log-gap cost of their hubs' lists falls.

    Parts of fewer than `width`, or `levels` deep, stay as they are: by falling gain, then id.
    """
    n = len(out)
    queries = [np.fromiter({*a, *(n + x for x in b)}, np.int64) for a, b in zip(into, out)]
    done: list[int] = []
    stack = [(np.arange(n), 0)]
    while stack:
        part, level = stack.pop()
        if len(part) < width or level == levels:
            done += part.tolist()
            continue
        half = len(part) // 2
        sizes = half, len(part) - half
        lists = [queries[v] for v in part]
        owner = np.repeat(np.arange(len(part)), [len(q) for q in lists])
        # hubs are counted by their place in this part alone
        hubs, hub = np.unique(np.concatenate(lists), return_inverse=True)
        order = np.arange(len(part))
        for _ in range(rounds):
            right = np.zeros(len(part), bool)
            right[order[half:]] = True
            on_right = right[owner]
            counts = [np.bincount(hub[on_right == s], minlength=len(hubs)).astype(float) for s in (False, True)]
            stay = sum(c * np.log2(m / (c + 1)) for c, m in zip(counts, sizes))
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = [stay - (counts[i] - 1) * np.log2(sizes[i] / counts[i]) - (counts[1 - i] + 1) * np.log2(sizes[1 - i] / (counts[1 - i] + 2)) for i in (0, 1)]
            gain = np.bincount(owner, np.where(on_right, leave[1][hub], leave[0][hub]), len(part)).round(9)
            a, b = (s[np.lexsort((part[s], -gain[s]))] for s in (order[:half], order[half:]))
            swaps = int(np.argmin(np.append(gain[a] + gain[b[:half]] > 0, False)))
            order = np.concatenate([b[:swaps], a[swaps:], a[:swaps], b[swaps:]])
            if not swaps:
                break
        stack += [(part[order[half:]], level + 1), (part[order[:half]], level + 1)]
    return done


def level_bisection_kernel(out: Lists, into: Lists, levels: int = 8) -> list[int]:
    """Recursive bisection of so many levels, whatever the parts' size."""
    return bisection_kernel(out, into, 2, levels=levels)


def bfs_bisection_kernel(out: Lists, into: Lists, width: int = WIDTH) -> list[int]:
    """Recursive bisection: breadth first from a far vertex fills the left side, a quarter to three quarters of the part."""
    done: list[int] = []
    stack = [list(range(len(out)))]

    def spread(s: int, free: set[int], found: list[int], enough: int, most: int) -> None:
        """What s reaches of `free` goes to `found`, until enough are found; a list of neighbours stops at `most`."""
        at = len(found)
        free.discard(s)
        found.append(s)
        while at < len(found) < enough:
            new = [v for v in out[found[at]] if v in free][: most - len(found)]
            free.difference_update(new)
            found += new
            at += 1

    while stack:
        part = stack.pop()
        size = len(part)
        if size < width:
            done += part
            continue
        probe: list[int] = []
        spread(part[0], set(part), probe, size + 1, size)
        far = part.index(probe[-1])
        part[0], part[far] = part[far], part[0]
        free, left = set(part), []
        for s in part:
            if len(left) >= size // 4:
                break
            if s in free:
                spread(s, free, left, size // 2, -(-3 * size // 4))
        stack += [[v for v in part if v in free], [v for v in part if v not in free]]
    return done


def partition_kernel(out: Lists, into: Lists, width: int = WIDTH) -> list[int]:
    """Parts of about `width` vertices by recursive bisection, ids ascending within a part (in place of an external partitioner)."""
    order = bisection_kernel(out, into, width)
    parts = [sorted(order[i : i + width]) for i in range(0, len(order), width)]
    return [v for p in parts for v in p]


KERNELS: dict[str, Callable[[Lists, Lists], list[int]]] = {
    "gro": gro_kernel, "dfs": dfs_kernel, "slashburn": slashburn_kernel, "mloggapa": bisection_kernel, "mloggapa_levels": level_bisection_kernel, "bfsr": bfs_bisection_kernel, "metis": partition_kernel,
}


#: Orders that are plans on all edges.
PLANS: dict[str, Callable[[DataFrame], DataFrame]] = {"degree": degree_order, "degree_asc": partial(degree_order, descending=False), "hybrid": hybrid_order, "bfs": bfs_order, "bfs_degree": bfs_degree_order, "rcm": rcm_order, "first_touch": first_touch_order}
#: What a kernel's task holds at most.
MOST_VERTICES, MOST_EDGES = 2_000_000, 10_000_000


def kernel_order(edges: DataFrame, kernel: Callable[[Lists, Lists], list[int]]) -> DataFrame:
    """A kernel's order of the whole graph, in one task; larger graphs than it may hold are an error."""
    arcs = cut(edges.select("src", "dst").distinct())
    place = vertices(arcs)
    for what, n, most in (("vertices", place.count(), MOST_VERTICES), ("edges", arcs.count(), MOST_EDGES)):
        if n > most:
            raise ValueError(f"{n} {what} are more than this order's one task may hold ({most}); {', '.join(PLANS)} take any number")
    rows = arcs.withColumn("one", F.lit(0)).union(place.select("v", F.lit(None).cast("bigint"), F.lit(0)))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["dst"].isna().sum())
        e = pdf.dropna(subset=["dst"])
        out: Lists = [[] for _ in range(n)]
        into: Lists = [[] for _ in range(n)]
        for a, b in sorted(zip(e["src"].astype(int).tolist(), e["dst"].astype(int).tolist())):
            out[a].append(b)
            into[b].append(a)
        return pd.DataFrame({"org_id": np.asarray(kernel(out, into), np.int64), "new_id": np.arange(n)})

    return rows.groupBy("one").applyInPandas(order, "org_id bigint, new_id bigint")


def vertex_order(edges: DataFrame, name: str = "gro") -> DataFrame:
    """The order of that name; unknown names are refused."""
    if name in PLANS:
        return PLANS[name](edges)
    if name not in KERNELS:
        raise ValueError(f"no order {name!r}; there are {', '.join([*PLANS, *KERNELS])}")
    return kernel_order(edges, KERNELS[name])


def reorder(edges: DataFrame, name: str = "gro") -> tuple[DataFrame, DataFrame]:
    """(edges with new ids, mapping)."""
    ids = cut(vertex_order(edges, name))
    return relabel(edges, ids), ids


