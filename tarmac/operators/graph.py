"""Cells, gates and the overlay of shortcuts."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.etl import dense_ids
from tarmac.operators.nested import closed
from tarmac.plans.kernels import Csr, bisect, dijkstra
from tarmac.schema import PARTITION_SEED
from tarmac.sources.shared import kept


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


#: Costs within a cell of up to this many nodes are worked out for all pairs at once.
CLOSED_NODES = 400

#: A larger part isn't cut by one task's maximum flow.
FLOW_NODES = 100_000


def partition(nodes: DataFrame, edges: DataFrame, max_cell: int, seed: int = PARTITION_SEED, flow_nodes: int = FLOW_NODES) -> DataFrame:
    """Recursive inertial-flow bisection until no cell has more than ``max_cell`` nodes.

    Level by level: all parts that are too large are split at once, one task each,
    with a direction drawn from the part's own path, so retries agree.  Parts of more
    than FLOW_NODES nodes are no one task's: they are halved along their longer
    side first, by an approximate median and a join.  Each
    level is kept as a table, which cuts its lineage.  Cells are numbered by their
    smallest node.
    """
    parts = kept(nodes.select("id", "x", "y", F.lit("r").alias("part")), "parts")
    pairs = kept(undirected_pairs(edges), "pairs")
    total = parts.count()
    for _ in range(max(0, math.ceil(math.log2(max(1.0, total / flow_nodes))) + 1)):
        wide = F.max("x") - F.min("x") >= F.max("y") - F.min("y")
        halves = parts.groupBy(F.col("part").alias("hp")).agg(F.count(F.lit(1)).alias("n"), wide.alias("wide"), F.percentile_approx("x", 0.5).alias("mx"), F.percentile_approx("y", 0.5).alias("my"))
        halves = kept(halves.where((F.col("n") > flow_nodes) & (F.col("n") > max_cell)), "halves")
        if halves.isEmpty():
            break
        low = F.when(F.col("wide"), F.col("x") <= F.col("mx")).otherwise(F.col("y") <= F.col("my"))
        named = parts.join(F.broadcast(halves), F.col("part") == F.col("hp"), "left")  # at most one row per flow_nodes nodes
        parts = kept(named.select("id", "x", "y", F.when(F.col("hp").isNull(), F.col("part")).otherwise(F.concat("part", F.when(low, "0").otherwise("1"))).alias("part")), "parts")
    rounds = max(1, math.ceil(math.log(max(2.0, total / max_cell), 4 / 3)) + 1)

    def split(key: tuple, ns: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        angle = random.Random(f"{seed}/{key[0]}").random() * 2 * math.pi
        left, _ = bisect(ns["id"].tolist(), ns["x"].tolist(), ns["y"].tolist(), list(zip(ps["a"].tolist(), ps["b"].tolist())), angle)
        left = set(left)
        return ns.assign(part=[key[0] + ("0" if i in left else "1") for i in ns["id"]])[["id", "x", "y", "part"]]

    for _ in range(rounds):
        large = parts.groupBy(F.col("part").alias("lp")).count().where(F.col("count") > max_cell).select("lp")
        if large.isEmpty():
            break
        todo = parts.join(large, parts["part"] == large["lp"], "left_semi")
        rest = parts.join(large, parts["part"] == large["lp"], "left_anti")
        at = lambda end: parts.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}"))
        # nodes are never sent to the driver to be broadcast
        inner = pairs.join(at("a").hint("merge"), "a").join(at("b").hint("merge"), "b").where("part_a = part_b").select("a", "b", F.col("part_a").alias("part"))
        done = todo.groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(lambda k, n, p: split(k, n, p) if len(n) else n[["id", "x", "y", "part"]], "id long, x double, y double, part string")
        parts = kept(rest.unionByName(done), "parts")
    number = parts.groupBy("part").agg(F.min("id").alias("cell"))
    return parts.join(number.hint("merge"), "part").select("id", "cell")


def gates(edges: DataFrame) -> DataFrame:
    """Both ends of every edge that leaves its cell, with dense gate ids in node order."""
    crossing = edges.where("cell_src <> cell_dst")
    ends = crossing.select(F.col("src").alias("node_idx"), F.col("cell_src").alias("cell")).union(crossing.select("dst", "cell_dst")).distinct()
    return dense_ids(ends, "gate_id", "node_idx").select("gate_id", "node_idx", "cell")


def cross_edges(edges: DataFrame) -> DataFrame:
    return edges.where("cell_src <> cell_dst").select("src", "dst", "base_weight", F.col("edge_id").alias("store_idx"))


def shortcuts(edges: DataFrame, gate_nodes: DataFrame, weight: str = "wt") -> DataFrame:
    """Per cell: cheapest way inside the cell from each gate to each other one it reaches.

    One task holds one cell, whose size the partition bounds.
    """
    inner = edges.where("cell_src = cell_dst").select(F.col("cell_src").alias("cell"), "src", "dst", F.col(weight).cast("double").alias("w"), "edge_id")
    own = gate_nodes.select("cell", "node_idx")

    def run(es: pd.DataFrame, gs: pd.DataFrame) -> pd.DataFrame:
        cell = int((gs if len(gs) else es)["cell"].iloc[0])
        wanted = np.unique(gs["node_idx"].to_numpy(dtype=np.int64))
        ids = np.unique(np.concatenate([es["src"], es["dst"], wanted]).astype(np.int64))
        at = np.searchsorted(ids, wanted)
        if len(ids) <= CLOSED_NODES:
            m = np.full((len(ids), len(ids)), np.inf)
            np.minimum.at(m, (np.searchsorted(ids, es["src"]), np.searchsorted(ids, es["dst"])), es["w"].to_numpy())
            far = closed(m, range(len(ids)))[np.ix_(at, at)]
        else:
            g, goals = Csr.build(es["src"], es["dst"], es["w"], es["edge_id"], extra=wanted), set(at.tolist())
            found = [dijkstra(g, {s: 0.0}, goals)[0] for s in at.tolist()]
            far = np.array([[done.get(t, np.inf) for t in at.tolist()] for done in found]).reshape(len(at), len(at))
        np.fill_diagonal(far, np.inf)
        s, t = np.nonzero(far < np.inf)
        return pd.DataFrame({"cell": np.full(len(s), cell), "src": wanted[s], "dst": wanted[t], "weight": far[s, t]})

    return inner.groupBy("cell").cogroup(own.groupBy("cell")).applyInPandas(run, "cell long, src long, dst long, weight double")


def overlay_edges(edges: DataFrame, shortcut_rows: DataFrame, weight: str = "wt") -> DataFrame:
    """Cross-cell edges and shortcuts, with dense ids by (src, kind, dst, store)."""
    crossing = edges.where("cell_src <> cell_dst").select("src", "dst", F.col(weight).cast("double").alias("weight"), F.lit(True).alias("is_cross_cell"), F.col("edge_id").alias("store_idx"))
    inner = dense_ids(shortcut_rows, "store_idx", "src", "dst").select("src", "dst", "weight", F.lit(False).alias("is_cross_cell"), "store_idx")
    both = crossing.unionByName(inner)
    return dense_ids(both.withColumn("_kind", F.col("is_cross_cell").cast("int")), "overlay_id", "src", "_kind", "dst", "store_idx").drop("_kind")


def stats(nodes: DataFrame, edges: DataFrame, gate_nodes: DataFrame, shortcut_rows: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = {"nodes": nodes, "edges": edges, "cross_edges": edges.where("cell_src <> cell_dst"), "cells": nodes.select("cell").distinct(), "gates": gate_nodes, "shortcuts": shortcut_rows}
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
