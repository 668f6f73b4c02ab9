"""Measures of small networks (category graphs of at most a few hundred nodes).

They need the whole graph at once, so the edges come to the driver, behind a check of
their number; larger graphs use graph.py's distributed operators.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame

MOST_EDGES = 20_000
Graph = dict[object, dict[object, float]]


def collected(edges: DataFrame) -> Graph:
    """Adjacency of an undirected table (a, b, weight); refuses large ones."""
    rows = edges.limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: use the distributed operators")
    out: Graph = {}
    for r in rows:
        if r["a"] != r["b"]:
            out.setdefault(r["a"], {})[r["b"]] = float(r["weight"])
            out.setdefault(r["b"], {})[r["a"]] = float(r["weight"])
    return out


def components(g: Graph) -> list[set]:
    seen, out = set(), []
    for start in g:
        if start in seen:
            continue
        part, todo = {start}, [start]
        while todo:
            for v in g[todo.pop()]:
                if v not in part:
                    part.add(v)
                    todo.append(v)
        seen |= part
        out.append(part)
    return sorted(out, key=len, reverse=True)


def _shortest(g: Graph, source, weighted: bool):
    """Nodes by distance from a source: (order, distances, path counts, predecessors)."""
    far, paths, before, order = {source: 0.0}, {source: 1.0}, {source: []}, []
    queue, done, tick = [(0.0, 0, source)], set(), 0
    while queue:
        d, _, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in g[u].items():
            step = d + (w if weighted else 1.0)
            if v not in far or step < far[v] - 1e-12:
                far[v], paths[v], before[v] = step, paths[u], [u]
                tick += 1
                heapq.heappush(queue, (step, tick, v))
            elif abs(step - far[v]) <= 1e-12 and v not in done:
                paths[v] += paths[u]
                before[v].append(u)
    return order, far, paths, before


def betweenness(g: Graph, weighted: bool = True) -> dict:
    """Shares of shortest paths through each node; a weight is a distance."""
    out = dict.fromkeys(g, 0.0)
    for s in g:
        order, _, paths, before = _shortest(g, s, weighted)
        flow = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                flow[u] += paths[u] / paths[v] * (1 + flow[v])
            if v != s:
                out[v] += flow[v]
    n = len(g)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {v: x * scale for v, x in out.items()}


def closeness(g: Graph) -> dict:
    """Reached nodes over their summed hops, scaled by the share reached."""
    out = {}
    for s in g:
        _, far, _, _ = _shortest(g, s, False)
        total, reached = sum(far.values()), len(far) - 1
        out[s] = reached / total * reached / (len(g) - 1) if total and len(g) > 1 else 0.0
    return out


def eigenvector(g: Graph, rounds: int = 1000, tolerance: float = 1e-9) -> dict:
    x = dict.fromkeys(g, 1.0)
    for _ in range(rounds):
        y = {v: x[v] + sum(w * x[u] for u, w in g[v].items()) for v in g}
        size = sum(a * a for a in y.values()) ** 0.5 or 1.0
        y = {v: a / size for v, a in y.items()}
        if sum(abs(y[v] - x[v]) for v in g) < tolerance * len(g):
            return y
        x = y
    return x


def clustering_coefficient(g: Graph) -> float:
    """Mean share of a node's neighbour pairs that are linked."""
    shares = []
    for u in g:
        around = [*g[u]]
        k = len(around)
        linked = sum(around[j] in g[around[i]] for i in range(k) for j in range(i))
        shares.append(2 * linked / (k * (k - 1)) if k > 1 else 0.0)
    return sum(shares) / len(shares) if shares else 0.0


def modularity(g: Graph, parts: list[set], resolution: float = 1.0) -> float:
    m = sum(w for u in g for w in g[u].values()) / 2
    if not m:
        return 0.0
    out = 0.0
    for p in parts:
        inner = sum(w for u in p for v, w in g[u].items() if v in p) / 2
        degree = sum(sum(g[u].values()) for u in p)
        out += inner / m - resolution * (degree / (2 * m)) ** 2
    return out


def communities(g: Graph, resolution: float = 1.0) -> list[set]:
    """Louvain: nodes move to the neighbouring part that raises modularity most, then parts become nodes."""
    m = sum(w for u in g for w in g[u].values()) / 2
    if not m:
        return [{u} for u in g]
    members = {u: {u} for u in g}
    now = {u: dict(g[u]) for u in g}
    while True:
        part = {u: u for u in now}
        degree = {u: sum(now[u].values()) for u in now}
        total = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for u in sorted(now, key=str):
                near: dict = {}
                for v, w in now[u].items():
                    if v != u:
                        near[part[v]] = near.get(part[v], 0.0) + w
                total[part[u]] -= degree[u]
                best, gain = part[u], near.get(part[u], 0.0) - resolution * total[part[u]] * degree[u] / (2 * m)
                for p, w in sorted(near.items(), key=lambda x: str(x[0])):
                    value = w - resolution * total[p] * degree[u] / (2 * m)
                    if value > gain + 1e-12:
                        best, gain = p, value
                total[best] += degree[u]
                if best != part[u]:
                    part[u], moved, moved_any = best, True, True
        if not moved_any:
            return sorted(members.values(), key=len, reverse=True)
        grouped: dict = {}
        for u, p in part.items():
            grouped.setdefault(p, set()).update(members[u])
        coarse: Graph = {p: {} for p in grouped}
        for u in now:
            for v, w in now[u].items():
                coarse[part[u]][part[v]] = coarse[part[u]].get(part[v], 0.0) + w
        members, now = grouped, coarse


def _low_points(g: Graph):
    """Depth-first numbers, low points, parents and children, without recursion."""
    number, low, parent, children, clock = {}, {}, {}, {u: [] for u in g}, 0
    for root in g:
        if root in number:
            continue
        parent[root] = None
        number[root] = low[root] = clock
        clock += 1
        stack = [(root, iter(g[root]))]
        while stack:
            u, it = stack[-1]
            for v in it:
                if v not in number:
                    parent[v] = u
                    children[u].append(v)
                    number[v] = low[v] = clock
                    clock += 1
                    stack.append((v, iter(g[v])))
                    break
                if v != parent[u]:
                    low[u] = min(low[u], number[v])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
    return number, low, parent, children


def bridges(g: Graph) -> list[tuple]:
    number, low, parent, _ = _low_points(g)
    return sorted(((u, v) for v, u in parent.items() if u is not None and low[v] > number[u]), key=str)


def cut_nodes(g: Graph) -> list:
    number, low, parent, children = _low_points(g)
    out = []
    for u in g:
        if parent[u] is None:
            if len(children[u]) > 1:
                out.append(u)
        elif any(low[v] >= number[u] for v in children[u]):
            out.append(u)
    return sorted(out, key=str)


def diameter(g: Graph) -> int:
    """Longest shortest path, in hops, of the largest component."""
    if not g:
        return 0
    worst = 0
    for s in components(g)[0]:
        far, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in g[u]:
                if v not in far:
                    far[v] = far[u] + 1
                    todo.append(v)
        worst = max(worst, *far.values())
    return worst


def summary(g: Graph) -> dict:
    n, m = len(g), sum(map(len, g.values())) // 2
    parts = communities(g) if n else []
    return {
        "nodes": n, "edges": m, "density": 2 * m / (n * (n - 1)) if n > 1 else 0.0, "components": len(components(g)),
        "clustering": clustering_coefficient(g), "diameter": diameter(g), "modularity": modularity(g, parts), "communities": len(parts),
    }
