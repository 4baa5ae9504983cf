"""Graph search kernels: plain Python over compressed adjacency, tested without Spark.

A Csr is what one task needs: sorted node ids, offsets, targets, weights and edge
numbers.  Searches return distances and predecessors, visited nodes counted.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np

INF = math.inf


@dataclass
class Csr:
    """Adjacency by local index; ``ids`` maps a local index to its node."""

    ids: list[int]
    offsets: list[int]
    targets: list[int]
    weights: list
    edges: list[int]
    index: dict[int, int] = field(default_factory=dict)

    @classmethod
    def build(cls, src, dst, weight, edge, extra=()) -> Csr:
        src, dst, weight, edge = (np.asarray(x) for x in (src, dst, weight, edge))
        ids = np.unique(np.concatenate([src, dst, np.asarray(list(extra), dtype=np.int64)]).astype(np.int64))
        s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order = np.lexsort((edge, s))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=len(ids)))))
        names = ids.tolist()
        return cls(names, offsets.tolist(), d[order].tolist(), weight[order].tolist(), edge[order].tolist(), {n: i for i, n in enumerate(names)})

    def out(self, u: int):
        return zip(*(x[self.offsets[u] : self.offsets[u + 1]] for x in (self.targets, self.weights, self.edges)))


def dijkstra(g: Csr, seeds: dict[int, float], goals: set[int] | None = None, penalty=None):
    """From weighted seeds (local indices) until all goals are settled.

    Returns (distance by settled node, predecessor (node, edge) by node, visited).
    ``penalty(edge)`` multiplies a weight.
    """
    best = dict(seeds)
    prev: dict[int, tuple[int, int]] = {}
    done: dict[int, float] = {}
    open_goals = set(goals) if goals is not None else None
    heap = [(w, u) for u, w in seeds.items()]
    heapq.heapify(heap)
    while heap:
        cost, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = cost
        if open_goals is not None:
            open_goals.discard(u)
            if not open_goals:
                break
        for v, w, e in g.out(u):
            if v in done:
                continue
            new = cost + (w if penalty is None else w * penalty(e))
            old = best.get(v, INF)
            if new < old:
                best[v], prev[v] = new, (u, e)
                heapq.heappush(heap, (new, v))
            elif new == old and v in prev and (u, e) < prev[v]:  # of equally cheap ways that by the smaller node, then edge
                prev[v] = (u, e)
    return done, prev, len(done)


def astar(g: Csr, s: int, t: int, bound, penalty=None):
    """Goal-directed search; ``bound(node)`` never exceeds the cost left."""
    best, prev, done = {s: 0}, {}, set()
    heap = [(bound(s), s)]
    while heap:
        _, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == t:
            return best[u], prev, len(done)
        for v, w, e in g.out(u):
            new = best[u] + (w if penalty is None else w * penalty(e))
            if new < best.get(v, INF):
                best[v], prev[v] = new, (u, e)
                heapq.heappush(heap, (new + bound(v), v))
    return None, prev, len(done)


def walk_back(prev: dict[int, tuple[int, int]], t: int) -> tuple[int, list[tuple[int, int]]]:
    """(start, [(node, edge into it)]) of the path that ends at ``t``."""
    path = []
    while t in prev:
        u, e = prev[t]
        path.append((t, e))
        t = u
    return t, path[::-1]


def bounded_repair(g: Csr, s: int, t: int, limit: float, hops: int, banned: set[int], outside: set[int] | None = None):
    """Cheapest way round the direct edges s-t: at most ``hops`` edges and cost ``limit``.

    False where it would go on from a node of ``outside``, whose edges aren't known.  Labels are kept per (node, hops), so a dearer but shorter prefix isn't lost.
    """
    layer, best, trail = {s: 0}, None, [{}]
    for depth in range(1, hops + 1):
        following: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        for u, cost in layer.items():
            if u == t:
                continue
            if outside and u in outside:
                return False
            for v, w, e in g.out(u):
                if (u == s and v == t) or e in banned:
                    continue
                new = cost + w
                if new <= limit and new < following.get(v, INF):
                    following[v], back[v] = new, (u, e)
        trail.append(back)
        if t in following and (best is None or following[t] < best[0]):
            best = (following[t], depth)
        layer = following
        if not layer:
            break
    if best is None:
        return None
    cost, depth = best
    path, v = [], t
    for d in range(depth, 0, -1):
        u, e = trail[d][v]
        path.append((v, e))
        v = u
    return cost, path[::-1]


class FlowNet:
    """Maximum flow by level graphs; capacities on residual arcs."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []

    def add(self, u: int, v: int, cap: int, back: int = 0) -> None:
        for a, b, c in ((u, v, cap), (v, u, back)):
            self.head[a].append(len(self.to))
            self.to.append(b)
            self.left.append(c)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.head)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for a in self.head[u]:
                if self.left[a] > 0 and level[self.to[a]] < 0:
                    level[self.to[a]] = level[u] + 1
                    queue.append(self.to[a])
        return level

    def run(self, s: int, t: int) -> int:
        total = 0
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.head)
            while True:  # one augmenting path after the other, without recursion
                path, u = [], s
                while u != t:
                    while at[u] < len(self.head[u]):
                        a = self.head[u][at[u]]
                        if self.left[a] > 0 and level[self.to[a]] == level[u] + 1:
                            break
                        at[u] += 1
                    else:
                        if not path:
                            break
                        u = self.to[path.pop() ^ 1]
                        at[u] += 1
                        continue
                    path.append(self.head[u][at[u]])
                    u = self.to[path[-1]]
                if u != t:
                    break
                push = min(self.left[a] for a in path)
                for a in path:
                    self.left[a] -= push
                    self.left[a ^ 1] += push
                total += push
        return total

    def side(self, s: int) -> set[int]:
        return {i for i, l in enumerate(self.levels(s)) if l >= 0}


def bisect(ids: list[int], xs: list[float], ys: list[float], pairs: list[tuple[int, int]], angle: float) -> tuple[list[int], list[int]]:
    """Split nodes by the smallest cut between the first and last quarter along a direction."""
    order = sorted(range(len(ids)), key=lambda i: (xs[i] * math.cos(angle) + ys[i] * math.sin(angle), ids[i]))
    place = {ids[i]: k for k, i in enumerate(order)}
    n, quarter = len(ids), max(1, len(ids) // 4)
    net = FlowNet(n + 2)
    for k in range(quarter):
        net.add(n, k, n)
        net.add(n - 1 - k, n + 1, n)
    for a, b in pairs:
        if a in place and b in place:
            net.add(place[a], place[b], 1, 1)
    net.run(n, n + 1)
    side = net.side(n)
    ranked = [ids[i] for i in order]
    left, right = [x for k, x in enumerate(ranked) if k in side], [x for k, x in enumerate(ranked) if k not in side]
    return (left, right) if left and right else (ranked[: n // 2], ranked[n // 2 :])


class TwoLevel:
    """Cells, gates and shortcuts: searches touch two cells and the overlay, whose shortcuts are unpacked again."""

    def __init__(self, cell_of: dict[int, int], edges: list[tuple[int, int, float, int]], shortcuts: list[tuple[int, int, float]]):
        """``edges``: (src, dst, weight, edge); ``shortcuts``: (gate, gate, weight) within a cell."""
        self.cell_of = cell_of
        inner = defaultdict(list)
        self.over: list[tuple[int, int, float, int]] = []  # overlay edges; -1 stands for a shortcut
        self.gates = defaultdict(set)
        for s, d, w, e in edges:
            if cell_of[s] == cell_of[d]:
                inner[cell_of[s]].append((s, d, w, e))
            else:
                self.over.append((s, d, w, e))
                self.gates[cell_of[s]].add(s)
                self.gates[cell_of[d]].add(d)
        members = defaultdict(list)
        for n, c in cell_of.items():
            members[c].append(n)
        self.cells = {c: Csr.build(*(zip(*inner[c]) if inner[c] else ([], [], [], [])), extra=ns) for c, ns in members.items()}
        self.over += [(s, d, w, -1) for s, d, w in shortcuts]
        numbered = [(s, d, w, k) for k, (s, d, w, _) in enumerate(self.over)]
        self.overlay = Csr.build(*zip(*numbered)) if numbered else None
        self.unpacked: dict[int, list[tuple[int, int]]] = {}

    def _unpack(self, k: int) -> list[tuple[int, int]]:
        """The steps (node, edge) that overlay edge ``k`` stands for."""
        s, d, _, e = self.over[k]
        if e >= 0:
            return [(d, e)]
        if k not in self.unpacked:
            g = self.cells[self.cell_of[s]]
            _, prev, _ = dijkstra(g, {g.index[s]: 0}, {g.index[d]})
            self.unpacked[k] = self._steps(g, walk_back(prev, g.index[d])[1])
        return self.unpacked[k]

    @staticmethod
    def _steps(g: Csr, path: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(g.ids[v], e) for v, e in path]

    def route(self, s: int, t: int, strict_cell: bool = False, used=frozenset(), crossed=frozenset(), factor: float = 1):
        """(cost or None, steps after the source as (node, edge), overlay edges taken, visited).

        Within one cell the way round through others counts too, unless
        ``strict_cell``.  ``used`` edges and ``crossed`` overlay edges cost ``factor`` times as much.
        """
        base = (lambda e: factor if e in used else 1) if used else None
        across = (lambda k: factor if k in crossed or self.over[k][3] in used else 1) if used or crossed else None
        cs, ct = self.cell_of[s], self.cell_of[t]
        g, h, visited, found = self.cells[cs], self.cells[ct], 0, []
        if cs == ct:
            done, prev, visited = dijkstra(g, {g.index[s]: 0}, {g.index[t]}, base)
            if g.index[t] in done:
                found.append((done[g.index[t]], self._steps(g, walk_back(prev, g.index[t])[1]), []))
        gates = {g.index[x] for x in self.gates[cs]}
        if gates and self.gates[ct] and not (cs == ct and strict_cell):
            out, first, n = dijkstra(g, {g.index[s]: 0}, gates, base)
            visited += n
            o = self.overlay
            seeds = {o.index[g.ids[x]]: out[x] for x in gates if x in out}
            goals = {o.index[x] for x in self.gates[ct]}
            done, middle, n = dijkstra(o, seeds, goals, across) if seeds else ({}, {}, 0)
            visited += n
            entry = {h.index[o.ids[x]]: done[x] for x in goals if x in done}
            last, final, n = dijkstra(h, entry, {h.index[t]}, base) if entry else ({}, {}, 0)
            visited += n
            if h.index[t] in last:
                gate, tail = walk_back(final, h.index[t])
                start, hops = walk_back(middle, o.index[h.ids[gate]])
                head = walk_back(first, g.index[o.ids[start]])[1]
                ks = [k for _, k in hops]
                found.append((last[h.index[t]], self._steps(g, head) + [x for k in ks for x in self._unpack(k)] + self._steps(h, tail), ks))
        return (*min(found, key=lambda f: f[0]), visited) if found else (None, [], [], visited)

    def cost(self, s: int, t: int, strict_cell: bool = False) -> tuple[float | None, int]:
        """(cost or None, visited)."""
        cost, _, _, visited = self.route(s, t, strict_cell)
        return cost, visited
