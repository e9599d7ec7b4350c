"""Orders that the library finds by plans, one vertex after another."""

from collections import deque

Lists = list[list[int]]


def bfs_kernel(out: Lists, into: Lists, sources: list[int] | None = None) -> list[int]:
    order, seen = [], [False] * len(out)
    for s in sources if sources is not None else range(len(out)):
        if seen[s]:
            continue
        seen[s] = True
        queue = deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in out[u]:
                if not seen[v]:
                    seen[v] = True
                    queue.append(v)
    return order


def bfs_degree_kernel(out: Lists, into: Lists) -> list[int]:
    """Breadth first, sources by falling out-degree."""
    return bfs_kernel(out, into, sorted(range(len(out)), key=lambda v: (-len(out[v]), v)))


def rcm_kernel(out: Lists, into: Lists) -> list[int]:
    """Reverse Cuthill-McKee: sources and children by rising degree, numbered from the end."""
    key = lambda v: (len(out[v]) + len(into[v]), v)
    by_degree = [sorted(x, key=key) for x in out]
    return bfs_kernel(by_degree, into, sorted(range(len(out)), key=key))[::-1]


def first_touch_kernel(out: Lists, into: Lists) -> list[int]:
    """Neighbour lists of the heaviest vertices first, heaviest neighbours first, ties in reverse Cuthill-McKee order; a vertex is placed where it is first met."""
    rank = {v: i for i, v in enumerate(rcm_kernel(out, into))}
    sides = sorted((-len(x[v]), rank[v], s, v) for s, x in enumerate((out, into)) for v in range(len(out)))
    placed = dict.fromkeys(w for _, _, s, v in sides for w in sorted((out, into)[s][v], key=lambda w: (-len((into, out)[s][w]), rank[w])))
    return [*placed, *(v for v in sorted(range(len(out)), key=rank.get) if v not in placed)]


ORDERS = {"bfs": bfs_kernel, "bfs_degree": bfs_degree_kernel, "rcm": rcm_kernel, "first_touch": first_touch_kernel}
