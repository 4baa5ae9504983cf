"""Costs of cheapest routes over graphs of any size, by a tree of ranges of node ids.

Ranges of ``width`` ids are the leaves; two neighbouring ranges make one of the next
level.  A range's gates are its nodes with an edge that leaves it, and all it needs to
show to others is the cost from gate to gate within it.  A request keeps the costs from
its source to the gates of the range around it, and from those to its target; both are
carried upwards, and wherever both ends lie in one range the ways through it compete.
A way that leaves a range and comes back competes further up, so costs are exact for
any numbering.  Work and memory follow the number of gates, so numbers should be near where nodes are.

Several levels are one task's; a task holds one range's gates and ``CHUNK`` requests at most.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.sources.shared import kept

#: Ids to a leaf, levels to a task, requests to a task.
WIDTH, TIER, CHUNK = 64, 5, 4096
#: Beyond this many gates of one range its numbering is too far from its neighbourhoods.
MOST_GATES = 3000


def closed(m: np.ndarray, through) -> np.ndarray:
    """Cheapest costs by way of the nodes in ``through``, in place."""
    for k in through:
        np.minimum(m, m[:, k, None] + m[k], out=m)
    return m


def min_plus(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """out[i, j] = min over k of v[i, k] + m[k, j]."""
    out = np.full((len(v), m.shape[1]), np.inf)
    for low in range(0, len(v), 128):
        part, o = v[low : low + 128], out[low : low + 128]
        for k in range(m.shape[0]):
            np.minimum(o, part[:, k, None] + m[k], out=o)
    return out


class Part:
    """A range's gates (sorted), how many levels each is a gate of, and the costs between them within the range."""

    def __init__(self, gates: np.ndarray, tops: np.ndarray, costs: np.ndarray):
        self.gates, self.tops, self.costs = gates, tops, costs


class Ends:
    """Requests' ends in one range: request numbers, and per request the costs to (or from) its gates."""

    def __init__(self, rows: np.ndarray, costs: np.ndarray):
        self.rows, self.costs = rows, costs


def joined(parts: list[Part], src: np.ndarray, dst: np.ndarray, w: np.ndarray, level: int, ends: list[tuple[Ends, Ends]] | None = None, best: np.ndarray | None = None):
    """The range of ``level`` that ``parts`` and the edges between them make, and its requests' ends carried up.

    ``best`` takes the cheaper cost of the requests with both ends inside.
    """
    gates = np.concatenate([p.gates for p in parts])
    order = np.argsort(gates)
    ids, tops = gates[order], np.concatenate([p.tops for p in parts])[order]
    m = np.full((len(ids), len(ids)), np.inf)
    at = [np.searchsorted(ids, p.gates) for p in parts]
    for p, i in zip(parts, at):
        m[np.ix_(i, i)] = p.costs
    np.fill_diagonal(m, 0.0)
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    np.minimum.at(m, (s, d), w)
    closed(m, np.unique(np.concatenate([s, d])))
    keep = np.flatnonzero(tops > level)
    part = Part(ids[keep], tops[keep], m[np.ix_(keep, keep)])
    if ends is None:
        return part, None
    starts = [(o.rows, min_plus(o.costs, m[i])) for (o, _), i in zip(ends, at)]
    goals = [(t.rows, t.costs, i) for (_, t), i in zip(ends, at)]
    place = np.full(len(best), -1)
    for rows, far in starts:
        place[:] = -1
        place[rows] = np.arange(len(rows))
        for trows, near, i in goals:
            both = place[trows] >= 0
            if both.any():
                r = trows[both]
                best[r] = np.minimum(best[r], (far[place[r]][:, i] + near[both]).min(axis=1, initial=np.inf))
    up = Ends(np.concatenate([r for r, _ in starts]), np.concatenate([f[:, keep] for _, f in starts]))
    down = Ends(np.concatenate([t.rows for _, t in ends]), np.concatenate([min_plus(t.costs, m[np.ix_(keep, i)].T) for (_, t), i in zip(ends, at)]))
    return part, (up, down)


def raised(parts: dict[int, Part], edges, low: int, high: int, width: int, ends=None, best=None):
    """``parts`` (by range number at level ``low``) joined to the one range at ``high``; ``edges``: those between them."""
    src, dst, w = edges
    leaf_s, leaf_d = src // width, dst // width
    for level in range(low + 1, high + 1):
        inner = ((leaf_s >> level) == (leaf_d >> level)) & ((leaf_s >> (level - 1)) != (leaf_d >> (level - 1)))
        own = leaf_s[inner] >> level
        order = np.argsort(own, kind="stable")
        own, es, ed, ew = own[order], src[inner][order], dst[inner][order], w[inner][order]
        following, carried = {}, {}
        for cell in sorted({c >> 1 for c in parts}):
            kids = [c for c in (2 * cell, 2 * cell + 1) if c in parts]
            a, b = np.searchsorted(own, cell), np.searchsorted(own, cell, "right")
            following[cell], up = joined([parts[k] for k in kids], es[a:b], ed[a:b], ew[a:b], level, [ends[k] for k in kids] if ends is not None else None, best)
            carried[cell] = up
        parts, ends = following, carried if ends is not None else None
    ((_, part),) = parts.items()
    return part, None if ends is None else next(iter(ends.values()))


def leaves(src, dst, w, nodes, tops, width: int, requests=None, best=None):
    """The leaves of a task's range, from the edges within them; ``requests``: (rows, ids) of sources and of targets."""
    parts, ends = {}, {}
    ls, ln = src // width, nodes // width
    inner = ls == dst // width
    order = np.argsort(ls[inner], kind="stable")
    es, ed, ew, own = src[inner][order], dst[inner][order], w[inner][order], ls[inner][order]
    for cell in np.unique(ln).tolist():
        here = slice(np.searchsorted(ln, cell), np.searchsorted(ln, cell, "right"))
        ids, top = nodes[here], tops[here]
        a, b = np.searchsorted(own, cell), np.searchsorted(own, cell, "right")
        m = np.full((len(ids), len(ids)), np.inf)
        np.fill_diagonal(m, 0.0)
        np.minimum.at(m, (np.searchsorted(ids, es[a:b]), np.searchsorted(ids, ed[a:b])), ew[a:b])
        closed(m, range(len(ids)))
        keep = np.flatnonzero(top > 0)
        parts[cell] = Part(ids[keep], top[keep], m[np.ix_(keep, keep)])
        if requests is not None:
            sides = []
            for rows, at in requests:
                mine = (at // width == cell) & np.isin(at, ids)
                sides.append((rows[mine], np.searchsorted(ids, at[mine])))
            (sr, si), (tr, ti) = sides
            place = np.full(len(best), -1)
            place[sr] = si
            both = place[tr] >= 0
            r = tr[both]
            best[r] = np.minimum(best[r], m[place[r], ti[both]])
            ends[cell] = (Ends(sr, m[si][:, keep]), Ends(tr, m[:, ti].T[:, keep]))
    return parts, ends if requests is not None else None


def _levels(width: int):
    """Up to which level the edge's ends lie in different ranges."""
    apart = F.floor(F.col("src") / width).bitwiseXOR(F.floor(F.col("dst") / width))
    return F.when(apart == 0, 0).otherwise(F.length(F.bin(apart))).cast("int")


def _builder(low: int, up: int, first: bool, width: int):
    """A range of level ``up`` from its nodes (``first``) or the ranges of level ``low``, and what it was made of."""

    def build(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        here = int((left if len(left) else right)["cell"].iloc[0])
        between = tuple(right[c].to_numpy() for c in ("src", "dst", "w"))
        if first:
            left = left.sort_values("node")
            kit = (left["node"].to_numpy(), left["top"].to_numpy())
            kids, _ = leaves(*between, *kit, width)
        else:
            kit = [(int(c), *pickle.loads(p)) for c, p in zip(left["child"], left["part"])]
            kids = {c: Part(*p) for c, *p in kit}
        part, _ = raised(kids, between, low, up, width)
        return pd.DataFrame([(here, pickle.dumps((part.gates, part.tops, part.costs)), pickle.dumps((kit, between)))], columns=["cell", "part", "kit"])

    return build


def _carrier(low: int, up: int, first: bool, last: bool, width: int):
    """Requests' ends carried from level ``low`` to ``up``."""

    def carry(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["request_id", "side", "node", "costs", "best"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        kit, between = pickle.loads(right["kit"].iloc[0])
        numbers, row = np.unique(left["request_id"].to_numpy(), return_inverse=True)
        best, is_t, at = np.full(len(numbers), np.inf), left["side"].to_numpy() == 1, left["node"].to_numpy()
        np.minimum.at(best, row, left["best"].to_numpy())
        if first:
            kids, ends = leaves(*between, *kit, width, [(row[~is_t], at[~is_t]), (row[is_t], at[is_t])], best)
        else:
            kids, ends, child = {c: Part(*p) for c, *p in kit}, {}, (at // width) >> low
            for c, p in kids.items():
                sides = []
                for k in (False, True):
                    mine = np.flatnonzero((child == c) & (is_t == k))
                    sides.append(Ends(row[mine], np.frombuffer(b"".join(left["costs"].iloc[mine]), dtype=np.float64).reshape(len(mine), len(p.gates))))
                ends[c] = tuple(sides)
        _, (s, t) = raised(kids, between, low, up, width, ends, best)
        out = []
        for k, e in ((0, s), (1, t)):
            where = np.full(len(numbers), -1)
            where[row[is_t == bool(k)]] = at[is_t == bool(k)]
            if not (last and k):
                out.append(pd.DataFrame({"request_id": numbers[e.rows], "side": k, "node": where[e.rows], "costs": [b"" if last else c.tobytes() for c in e.costs], "best": best[e.rows]}))
        return pd.concat(out)[names]

    return carry


def costs(requests: DataFrame, edges: DataFrame, weight: str = "wt", width: int = WIDTH) -> DataFrame | None:
    """``request_id, src, dst, cost`` of every request that has a route; none for equal ends.

    None where the numbering puts more than MOST_GATES gates on one range.
    """
    spark = edges.sparkSession
    tasks = max(2, spark.sparkContext.defaultParallelism) * 4
    rows = kept(edges.select("src", "dst", F.col(weight).cast("double").alias("w")).withColumn("lv", _levels(width)), "levels")
    nodes = kept(rows.select(F.col("src").alias("node"), "lv").unionByName(rows.select(F.col("dst").alias("node"), "lv")).groupBy("node").agg(F.max("lv").alias("top")), "tops")
    high = rows.agg(F.max("lv")).first()[0] or 0
    gates = nodes.where("top > 0").select(F.floor(F.col("node") / width).alias("leaf"), F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("lv"))
    if high and gates.groupBy("lv", F.expr("shiftright(leaf, lv)")).count().agg(F.max("count")).first()[0] > MOST_GATES:
        return None

    def cell(c: str, level: int):
        return F.shiftright(F.floor(F.col(c) / width).cast("long"), level)

    asked = requests.where("src <> dst").select("request_id", "src", "dst")
    todo = kept(asked.select("src", "dst").distinct().select(F.monotonically_increasing_id().alias("request_id"), "src", "dst"), "pairs")
    side = lambda end, k: todo.select("request_id", F.lit(k).alias("side"), F.col(end).alias("node"), F.lit(None).cast("binary").alias("costs"), F.lit(float("inf")).alias("best"))
    records = kept(side("src", 0).unionByName(side("dst", 1)), "ends")
    below, parts = 0, None
    while True:
        above = min(below + TIER, max(high, 1)) if parts is not None else min(TIER, high)
        own = rows.where(f"lv <= {above} AND lv > {below if parts is not None else -1}").select(cell("src", above).alias("cell"), "src", "dst", "w")

        left = nodes.select(cell("node", above).alias("cell"), "node", "top") if parts is None else parts.select(F.shiftright("cell", above - below).alias("cell"), F.col("cell").alias("child"), "part")
        both = left.repartition(tasks, "cell").groupBy("cell").cogroup(own.repartition(tasks, "cell").groupBy("cell"))
        made = kept(both.applyInPandas(_builder(below, above, parts is None, width), "cell long, part binary, kit binary"), "ranges")

        named = records.withColumn("cell", cell("node", above))
        sizes = named.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CHUNK)).alias("chunks"))
        dealt = named.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("request_id"), F.col("chunks")))
        kits = made.join(F.broadcast(sizes), "cell").select("cell", "kit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
        both = dealt.repartition(tasks, "cell", "chunk").groupBy("cell", "chunk").cogroup(kits.repartition(tasks, "cell", "chunk").groupBy("cell", "chunk"))
        records = kept(both.applyInPandas(_carrier(below, above, parts is None, above >= high, width), "request_id long, side int, node long, costs binary, best double"), "ends")
        below, parts = above, made.select("cell", "part")
        if above >= high:
            break
    found = records.where("side = 0 AND best < double('inf')").select("request_id", F.col("best").cast("long").alias("cost"))
    return asked.join(todo.join(found, "request_id").select("src", "dst", "cost"), ["src", "dst"]).select("request_id", "src", "dst", "cost")
