"""Batches of route requests over the graph.

The adjacency is counted before it is shipped: up to ``SEARCHED_EDGES`` edges it is
broadcast as arrays, requests are spread over all tasks and each is searched by itself.
Beyond that costs come from a tree of ranges of the nodes (``nested``), without any task that
holds the graph; where the numbering doesn't suit that, ``shortest`` relaxes frontiers by joins
(``relaxed``), which needs as many rounds as the longest path has edges.  Modes that have to
hold the graph raise beyond ``SHIPPED_EDGES``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import nested
from tarmac.plans.kernels import Csr, TwoLevel, astar, bounded_repair, dijkstra, walk_back
from tarmac.schema import ALTERNATIVE_PENALTY
from tarmac.sources.shared import kept

#: A graph of more edges isn't collected for broadcast.
SHIPPED_EDGES = 5_000_000
#: Beyond this many edges requests aren't searched one by one, as a search may touch all of them.
SEARCHED_EDGES = 200_000


def shipped(edges: DataFrame, weight: str = "wt"):
    """The edges as columns on the driver, within the bound, for a broadcast.

    They are written once, so that counting them and fetching them don't compute them twice.
    """
    rows = kept(edges.select("src", "dst", F.col(weight).alias("w"), "edge_id"), "shipped")
    n = rows.count()
    if n > SHIPPED_EDGES:
        raise ValueError(f"{n} edges are too many to broadcast; route over the overlay")
    columns = rows.toArrow()
    return edges.sparkSession.sparkContext.broadcast(tuple(columns[c].to_numpy() for c in ("src", "dst", "w", "edge_id")))


def node_columns(nodes: DataFrame, *names: str) -> tuple:
    """Columns of the nodes for a broadcast, under the same bound."""
    rows = kept(nodes.select(*names), "node-columns")
    n = rows.count()
    if n > SHIPPED_EDGES:
        raise ValueError(f"{n} nodes are too many to broadcast")
    columns = rows.toArrow()
    return nodes.sparkSession.sparkContext.broadcast(tuple(columns[c].to_numpy() for c in names))


def _spread(requests: DataFrame) -> DataFrame:
    """Requests from one source meet in one task, so that one search serves them."""
    return requests.select("request_id", "src", "dst").repartition(max(2, requests.sparkSession.sparkContext.defaultParallelism), "src")


def _large(edges: DataFrame) -> bool:
    return edges.count() > min(SEARCHED_EDGES, SHIPPED_EDGES)


def _nested(requests: DataFrame, edges: DataFrame, weight: str, width: int = nested.WIDTH) -> DataFrame:
    found = nested.costs(requests, edges, weight, width)
    if found is None:
        return relaxed(requests, edges, weight)
    return found.withColumn("visited", F.lit(None).cast("long"))


def shortest(requests: DataFrame, edges: DataFrame, weight: str = "wt", width: int = nested.WIDTH) -> DataFrame:
    """Cost and visited nodes per request; no row where there is no route or source and target are equal.

    Visited nodes are null where no search was made, beyond SEARCHED_EDGES.  ``width`` is that of ``nested.costs``.
    """
    edges = kept(edges.select("src", "dst", F.col(weight), "edge_id"), "hops")
    if _large(edges):
        return _nested(requests, edges, weight, width)
    data = shipped(edges, weight)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Csr.build(*data.value)
        for f in frames:
            rows = []
            for s, part in f.groupby("src"):
                if s not in g.index:
                    continue
                goals = {g.index[t] for t in part["dst"] if t in g.index}
                done, _, visited = dijkstra(g, {g.index[s]: 0}, goals)
                rows += [(r, s, t, int(done[g.index[t]]), visited) for r, t in zip(part["request_id"], part["dst"]) if t != s and g.index.get(t) in done]
            yield pd.DataFrame(rows, columns=["request_id", "src", "dst", "cost", "visited"]).astype("int64")

    return _spread(requests).mapInPandas(run, "request_id long, src long, dst long, cost long, visited long")


def relaxed(requests: DataFrame, edges: DataFrame, weight: str = "wt") -> DataFrame:
    """As ``shortest``, by distributed relaxation: each round joins the improved labels with
    the edges and keeps the cheaper label per (source, node).  Labels are kept as tables."""
    hops = kept(edges.groupBy(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst")).agg(F.min(weight).alias("hop_w")), "hops")
    labels = kept(requests.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(True).alias("fresh")), "labels")
    while not (front := labels.where("fresh")).isEmpty():
        reached = front.join(hops, F.col("node") == F.col("hop_src")).select("root", F.col("hop_dst").alias("node"), (F.col("cost") + F.col("hop_w")).alias("cost"), F.lit(True).alias("fresh"))
        # the cheaper label wins; of equal ones the old, which isn't fresh
        best = F.min(F.struct("cost", "fresh")).alias("b")
        labels = kept(labels.withColumn("fresh", F.lit(False)).unionByName(reached).groupBy("root", "node").agg(best).select("root", "node", "b.cost", "b.fresh"), "labels")
    seen = labels.groupBy(F.col("root").alias("src")).agg(F.count(F.lit(1)).alias("visited"))
    found = requests.where("src <> dst").join(labels, (F.col("src") == F.col("root")) & (F.col("dst") == F.col("node")))
    return found.select("request_id", "src", "dst", "cost").join(seen, "src").select("request_id", "src", "dst", F.col("cost").cast("long").alias("cost"), "visited")


#: Nodes' ids to a region at first, and how many times wider the next try is.
REGION, WIDER = 4096, 8


def in_regions(jobs: DataFrame, edges: DataFrame, weight: str, search, schema: str) -> tuple[DataFrame, DataFrame]:
    """Jobs (``src, dst`` and more) searched in a part of the graph: the region of ids that the source is in and those beside it.

    ``search(g, rows, low, high)`` yields per row None, where it would go on from a node outside
    ``low <= id < high``, or the row's result rows.  What isn't settled is tried in wider
    regions while these don't hold the graph.  Returns (results, jobs that need all of it).
    """
    edges = kept(edges.select("src", "dst", F.col(weight).alias("w"), "edge_id"), "hops")
    ends = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    todo, found, width, tasks = kept(jobs, "jobs"), None, REGION, max(2, edges.sparkSession.sparkContext.defaultParallelism) * 4
    names = todo.columns
    fields = [f.split()[0] for f in schema.split(", ")]
    out_schema = schema + ", " + ", ".join(f"_{f.name} {f.dataType.simpleString()}" for f in todo.schema)

    def region(c):
        return F.floor(F.col(c) / width).cast("long")

    while ends[0] is not None and 2 * width < ends[1] - ends[0] + 1 and not todo.isEmpty():
        near = todo.withColumn("_region", region("src")).where(F.abs(region("dst") - F.col("_region")) <= 1)
        own = edges.withColumn("_region", F.explode(F.array(*[region("src") + k for k in (-1, 0, 1)])))
        own = own.join(F.broadcast(near.select("_region").distinct()), "_region", "left_semi")

        def searcher(width: int):
            def run(key: tuple, js: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
                low, high = (key[0] - 1) * width, (key[0] + 2) * width
                rows = []
                for job, results in zip(js[names].itertuples(index=False), search(es, js, low, high)):
                    rows += [(*[None] * len(fields), *job)] if results is None else [(*r, *[None] * len(names)) for r in results]
                return pd.DataFrame(rows, columns=fields + [f"_{c}" for c in names]).astype("Int64")

            return run

        both = near.repartition(tasks, "_region").groupBy("_region").cogroup(own.repartition(tasks, "_region").groupBy("_region"))
        done = kept(both.applyInPandas(searcher(width), out_schema), "searched")
        settled = done.where(F.col(fields[0]).isNotNull()).select(*fields)
        found = settled if found is None else found.unionByName(settled)
        far = todo.where(F.abs(region("dst") - region("src")) > 1)
        todo = kept(far.unionByName(done.where(F.col(f"_{names[0]}").isNotNull()).select(*[F.col(f"_{c}").alias(c) for c in names])), "jobs")
        width *= WIDER
    return edges.sparkSession.createDataFrame([], schema) if found is None else found, todo


def goal_directed(requests: DataFrame, edges: DataFrame, nodes: DataFrame, weight: str = "wt", per_metre: float = 0.0, counted: bool = False) -> DataFrame:
    """As ``shortest``, by A* with ``per_metre`` times the straight distance as bound.  ``counted``: visited nodes are wanted, so each is searched."""
    edges = kept(edges.select("src", "dst", F.col(weight), "edge_id"), "hops")
    if not counted and _large(edges):
        return _nested(requests, edges, weight)
    data = shipped(edges, weight)
    where = node_columns(nodes, "id", "lat", "lon")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, at = Csr.build(*data.value), {n: (lat, lon) for n, lat, lon in zip(*(c.tolist() for c in where.value))}
        for f in frames:
            rows = []
            for r, s, t in f[["request_id", "src", "dst"]].itertuples(index=False):
                if s == t or s not in g.index or t not in g.index:
                    continue
                lat2, lon2 = at[t]
                scale = math.cos(math.radians(lat2))

                def bound(u: int) -> float:
                    lat, lon = at[g.ids[u]]
                    return per_metre * 6_371_000.0 * math.hypot(math.radians(lon2 - lon) * scale, math.radians(lat2 - lat))

                cost, _, visited = astar(g, g.index[s], g.index[t], bound)
                if cost is not None:
                    rows.append((r, s, t, int(cost), visited))
            yield pd.DataFrame(rows, columns=["request_id", "src", "dst", "cost", "visited"]).astype("int64")

    return _spread(requests).mapInPandas(run, "request_id long, src long, dst long, cost long, visited long")


def paths(requests: DataFrame, edges: DataFrame, weight: str = "wt", alternatives: int = 0) -> DataFrame:
    """Routes edge by edge: request, alternative, step, node, edge (null at the source).

    Each alternative searches again with the edges of the earlier ones at
    ALTERNATIVE_PENALTY times their weight; the first failure ends them.  Beyond
    SEARCHED_EDGES routes between near nodes are searched in regions; the others need the graph.
    """
    schema = "request_id long, alternative long, step_idx long, node_idx long, edge_id long"

    def routes(g: Csr, r: int, s: int, t: int, low: float = -math.inf, high: float = math.inf) -> list[tuple] | None:
        """None where a search leaves the ids from ``low`` to ``high``."""
        if s == t or s not in g.index or t not in g.index:
            return []
        rows, used = [], set()
        for k in range(alternatives + 1):
            done, prev, _ = dijkstra(g, {g.index[s]: 0}, {g.index[t]}, (lambda e: ALTERNATIVE_PENALTY if e in used else 1) if used else None)
            if not all(low <= g.ids[u] < high for u in done):
                return None
            if g.index[t] not in done:
                break
            _, steps = walk_back(prev, g.index[t])
            rows += [(r, k, 0, s, None)] + [(r, k, i + 1, g.ids[v], e) for i, (v, e) in enumerate(steps)]
            used |= {e for _, e in steps}
        return rows

    def within(es: pd.DataFrame, js: pd.DataFrame, low: int, high: int):
        g = Csr.build(es["src"], es["dst"], es["w"], es["edge_id"])
        return [routes(g, r, s, t, low, high) for r, s, t in js[["request_id", "src", "dst"]].itertuples(index=False)]

    edges = kept(edges.select("src", "dst", F.col(weight), "edge_id"), "hops")
    if _large(edges):
        near, far = in_regions(requests.select("request_id", "src", "dst"), edges, weight, within, schema)
        return near if far.isEmpty() else near.unionByName(_searched_paths(far, edges, weight, routes, schema))
    return _searched_paths(requests, edges, weight, routes, schema)


def _searched_paths(requests: DataFrame, edges: DataFrame, weight: str, routes, schema: str) -> DataFrame:
    data = shipped(edges, weight)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Csr.build(*data.value)
        for f in frames:
            rows = [x for r, s, t in f[["request_id", "src", "dst"]].itertuples(index=False) for x in routes(g, r, s, t)]
            yield pd.DataFrame(rows, columns=["request_id", "alternative", "step_idx", "node_idx", "edge_id"]).astype({c: "Int64" for c in ("request_id", "alternative", "step_idx", "node_idx", "edge_id")})

    return _spread(requests).mapInPandas(run, schema)


def _two_level_net(edges: DataFrame, nodes: DataFrame, shortcut_rows: DataFrame, weight: str):
    data, shorts = shipped(edges, weight), shipped(shortcut_rows.select("src", "dst", F.col("weight").alias(weight), F.lit(-1).alias("edge_id")), weight)
    cells = node_columns(nodes, "id", "cell")
    return lambda: TwoLevel(dict(zip(*(c.tolist() for c in cells.value))), list(zip(*(c.tolist() for c in data.value))), list(zip(*(c.tolist() for c in shorts.value[:3]))))


def two_level(requests: DataFrame, edges: DataFrame, nodes: DataFrame, shortcut_rows: DataFrame, weight: str = "wt", strict_cell: bool = False, counted: bool = False) -> DataFrame:
    """Cost and visited nodes by source cell, overlay and target cell.

    Beyond SEARCHED_EDGES the overlay is one of many levels (``nested``), unless the visited nodes are ``counted``;
    with ``strict_cell`` requests within a cell are then searched in its own task.
    """
    if not counted and _large(edges):
        if not strict_cell:
            return _nested(requests, edges, weight)
        at = lambda end: nodes.select(F.col("id").alias(end), F.col("cell").alias(f"_{end}"))
        placed = kept(requests.select("request_id", "src", "dst").join(at("src"), "src").join(at("dst"), "dst"), "placed")
        within = cell_costs(placed.where("_src = _dst").select("request_id", "src", "dst", F.col("_src").alias("cell")), edges, weight)
        return within.unionByName(_nested(placed.where("_src <> _dst").drop("_src", "_dst"), edges, weight))
    build = _two_level_net(edges, nodes, shortcut_rows, weight)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = build()
        for f in frames:
            rows = []
            for r, s, t in f[["request_id", "src", "dst"]].itertuples(index=False):
                if s != t and s in net.cell_of and t in net.cell_of:
                    cost, visited = net.cost(s, t, strict_cell)
                    if cost is not None:
                        rows.append((r, s, t, int(cost), visited))
            yield pd.DataFrame(rows, columns=["request_id", "src", "dst", "cost", "visited"]).astype("int64")

    return _spread(requests).mapInPandas(run, "request_id long, src long, dst long, cost long, visited long")


def two_level_paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame, shortcut_rows: DataFrame, weight: str = "wt", alternatives: int = 0, strict_cell: bool = False) -> DataFrame:
    """As ``paths``, by the two-level search: shortcuts unpacked to edges.

    Each alternative searches again with the edges and the overlay edges of the
    earlier ones at ALTERNATIVE_PENALTY times their weight.
    """
    build = _two_level_net(edges, nodes, shortcut_rows, weight)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = build()
        for f in frames:
            rows = []
            for r, s, t in f[["request_id", "src", "dst"]].itertuples(index=False):
                if s == t or s not in net.cell_of or t not in net.cell_of:
                    continue
                used, crossed = set(), set()
                for k in range(alternatives + 1):
                    cost, steps, hops, _ = net.route(s, t, strict_cell, used, crossed, ALTERNATIVE_PENALTY)
                    if cost is None:
                        break
                    rows += [(r, k, 0, s, None)] + [(r, k, i + 1, v, e) for i, (v, e) in enumerate(steps)]
                    used |= {e for _, e in steps}
                    crossed |= set(hops)
            yield pd.DataFrame(rows, columns=["request_id", "alternative", "step_idx", "node_idx", "edge_id"]).astype("Int64")

    return _spread(requests).mapInPandas(run, "request_id long, alternative long, step_idx long, node_idx long, edge_id long")


def seeded(seeds: DataFrame, goals: DataFrame, edges: DataFrame, weight: str = "wt", penalties: DataFrame | None = None) -> DataFrame:
    """Cost from each group's weighted seeds to each of its goals: ``group, node_idx, cost``.

    ``seeds``: group, node_idx, cost; ``goals``: group, node_idx; ``penalties``: group,
    edge_id, factor.  A group's rows, all small, meet in one task; its search stops
    when its last goal is settled.
    """
    data = shipped(edges, weight)
    none = F.lit(None)
    rows = seeds.select("group", "node_idx", F.col("cost").cast("double").alias("value"), F.lit(0).alias("kind"))
    rows = rows.unionByName(goals.select("group", "node_idx", none.cast("double").alias("value"), F.lit(1).alias("kind")))
    if penalties is not None:
        rows = rows.unionByName(penalties.select("group", F.col("edge_id").alias("node_idx"), F.col("factor").cast("double").alias("value"), F.lit(2).alias("kind")))
    rows = rows.repartition(max(2, edges.sparkSession.sparkContext.defaultParallelism), "group").sortWithinPartitions("group")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Csr.build(*data.value)
        whole = pd.concat(list(frames) or [pd.DataFrame(columns=["group", "node_idx", "value", "kind"])])
        out = []
        for group, part in whole.groupby("group"):
            start: dict[int, float] = {}
            for n, c in part[part["kind"] == 0][["node_idx", "value"]].itertuples(index=False):
                if n in g.index:
                    start[g.index[n]] = min(c, start.get(g.index[n], c))
            wanted = {g.index[n] for n in part[part["kind"] == 1]["node_idx"] if n in g.index}
            dear = dict(part[part["kind"] == 2][["node_idx", "value"]].itertuples(index=False, name=None))
            if start and wanted:
                done, _, _ = dijkstra(g, start, wanted, (lambda e: dear.get(e, 1)) if dear else None)
                out += [(group, g.ids[t], int(done[t])) for t in wanted if t in done]
        yield pd.DataFrame(out, columns=["group", "node_idx", "cost"]).astype("int64")

    return rows.mapInPandas(run, "group long, node_idx long, cost long")


def cell_distances(edges: DataFrame, seeds: DataFrame, weight: str = "wt") -> DataFrame:
    """From weighted seeds (``group, cell, node_idx, cost``) to all nodes of their cell, never leaving it."""
    inner = edges.where("cell_src = cell_dst").select(F.col("cell_src").alias("cell"), "src", "dst", F.col(weight).alias("w"), "edge_id")

    def run(es: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        rows = []
        g = Csr.build(es["src"], es["dst"], es["w"], es["edge_id"], extra=ss["node_idx"].tolist())
        for group, part in ss.groupby("group"):
            seeds: dict[int, float] = {}
            for n, c in zip(part["node_idx"], part["cost"]):
                seeds[g.index[n]] = min(c, seeds.get(g.index[n], c))
            done, _, _ = dijkstra(g, seeds)
            rows += [(group, g.ids[u], int(c)) for u, c in done.items()]
        return pd.DataFrame(rows, columns=["group", "node_idx", "cost"]).astype("int64")

    return inner.groupBy("cell").cogroup(seeds.groupBy("cell")).applyInPandas(run, "group long, node_idx long, cost long")


def cell_costs(requests: DataFrame, edges: DataFrame, weight: str = "wt") -> DataFrame:
    """As ``shortest`` for requests within one ``cell`` each, never leaving it; a cell is one task's."""
    inner = edges.where("cell_src = cell_dst").select(F.col("cell_src").alias("cell"), "src", "dst", F.col(weight).alias("w"), "edge_id")

    def run(es: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        g = Csr.build(es["src"], es["dst"], es["w"], es["edge_id"])
        for s, part in rs.groupby("src"):
            goals = {g.index[t] for t in part["dst"] if t in g.index}
            if s in g.index and goals:
                done, _, visited = dijkstra(g, {g.index[s]: 0}, goals)
                rows += [(r, s, t, int(done[g.index[t]]), visited) for r, t in zip(part["request_id"], part["dst"]) if t != s and g.index.get(t) in done]
        return pd.DataFrame(rows, columns=["request_id", "src", "dst", "cost", "visited"]).astype("int64")

    return inner.groupBy("cell").cogroup(requests.groupBy("cell")).applyInPandas(run, "request_id long, src long, dst long, cost long, visited long")


def repairs(jobs: DataFrame, edges: DataFrame, hops: int, weight: str = "wt") -> DataFrame:
    """Ways round a congested edge: jobs ``job, src, dst, budget`` -> job, cost, hops.

    Beyond SEARCHED_EDGES jobs are searched in regions.
    """
    schema = "job long, cost long, hops long"

    def found(g: Csr, j: int, s: int, t: int, budget, outside=None) -> list[tuple] | None:
        if s not in g.index or t not in g.index:
            return []
        best = bounded_repair(g, g.index[s], g.index[t], budget, hops, set(), outside)
        return None if best is False else [(j, int(best[0]), len(best[1]))] if best else []

    def within(es: pd.DataFrame, js: pd.DataFrame, low: int, high: int):
        es = es[es["w"] <= js["budget"].max()]  # no dearer edge is part of a repair
        g = Csr.build(es["src"], es["dst"], es["w"], es["edge_id"])
        outside = {i for i, n in enumerate(g.ids) if not low <= n < high}
        return [found(g, j, s, t, b, outside) for j, s, t, b in js[["job", "src", "dst", "budget"]].itertuples(index=False)]

    edges = kept(edges.select("src", "dst", F.col(weight), "edge_id"), "hops")
    near = None
    if _large(edges):
        near, jobs = in_regions(jobs.select("job", "src", "dst", "budget"), edges, weight, within, schema)
        if jobs.isEmpty():
            return near
    data = shipped(edges, weight)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Csr.build(*data.value)
        for f in frames:
            rows = [x for j, s, t, b in f[["job", "src", "dst", "budget"]].itertuples(index=False) for x in found(g, j, s, t, b)]
            yield pd.DataFrame(rows, columns=["job", "cost", "hops"]).astype("int64")

    rest = jobs.repartition(max(2, jobs.sparkSession.sparkContext.defaultParallelism), "job").mapInPandas(run, schema)
    return rest if near is None else near.unionByName(rest)
