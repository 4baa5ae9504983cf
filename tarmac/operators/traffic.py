"""Per-edge traffic state, in batch form.

Ordered folds gather one edge's rows of (time, id, value); aggregation by edge is
the only shuffle.  ``tarmac.streaming`` holds the same folds as keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.functions import speeds
from tarmac.operators.graph import shortcuts


def _ordered(*value: str):
    return F.array_sort(F.collect_list(F.struct("us", "event_id", *value)))


def multipliers(events: DataFrame) -> DataFrame:
    """EWMA multiplier per edge of its valid observations: ``edge_id, weight, samples``."""
    valid = events.where((F.col("ratio") > 0) & F.col("ratio").isNotNull())
    return valid.groupBy("edge_id").agg(_ordered("ratio", "alpha").alias("s")).select("edge_id", speeds.ewma(F.col("s")).alias("weight"), F.size("s").cast("long").alias("samples"))


def multipliers_in_parts(events: DataFrame, part_sec: int = 3600) -> DataFrame:
    """As ``multipliers``, an edge's rows gathered by ``part_sec`` of time only, so that a very busy edge is no one group.

    Each observation maps a weight w to max(1, alpha r + (1 - alpha) w), and maps of the form
    max(c, a w + b) follow one another as another such map: parts are folded to (a, b, c), and an edge's few parts in order.
    """
    valid = events.where((F.col("ratio") > 0) & F.col("ratio").isNotNull()).withColumn("part", F.floor(F.col("us") / (part_sec * 1_000_000)))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("c"))

    def step(m, x):
        keep, pull = 1 - x["alpha"], x["alpha"] * F.greatest(F.lit(1.0), x["ratio"])
        return F.struct((keep * m["a"]).alias("a"), (keep * m["b"] + pull).alias("b"), F.greatest(F.lit(1.0), keep * m["c"] + pull).alias("c"))

    parts = valid.groupBy("edge_id", "part").agg(_ordered("ratio", "alpha").alias("s")).select("edge_id", "part", F.aggregate("s", start, step).alias("m"), F.size("s").cast("long").alias("n"))
    whole = parts.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("ms"), F.sum("n").alias("samples"))
    weight = F.aggregate("ms", F.lit(1.0), lambda w, x: F.greatest(x["m"]["c"], x["m"]["a"] * w + x["m"]["b"]))
    return whole.select("edge_id", weight.alias("weight"), "samples")


def densities(events: DataFrame) -> DataFrame:
    """Vehicles per edge from enter (+1) and leave (-1) rows, never below zero."""
    moves = events.where("delta IS NOT NULL")
    return moves.groupBy("edge_id").agg(_ordered("delta").alias("s")).select("edge_id", speeds.density(F.transform("s", lambda x: x["delta"])).alias("density"))


def state(events: DataFrame) -> DataFrame:
    """Both of them per edge, with defaults 1.0 and 0."""
    both = multipliers(events).select("edge_id", "weight").join(densities(events), "edge_id", "full")
    return both.select("edge_id", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("density", F.lit(0).cast("long")).alias("density"))


def at_rest(events: DataFrame, now_us: DataFrame) -> DataFrame:
    """Multiplier per edge at ``now_us`` (one row), decayed since its last observation as well, and whether the edge is
    still dirty: one that has come to rest at 1 isn't."""
    rows = replayed(events, True).crossJoin(F.broadcast(now_us))
    ticks = F.least(F.lit(64).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("now_us") - F.col("us")) / int(S.DECAY_EVERY_SEC * 1_000_000))))
    return rows.select("edge_id", speeds.decayed(F.col("weight"), ticks).alias("weight")).withColumn("dirty", F.col("weight") != 1.0)


def replayed(events: DataFrame, when: bool = False) -> DataFrame:
    """Multiplier per edge with decay every DECAY_EVERY_SEC between its observations (event time); ``when`` adds the last one's time."""
    every = int(S.DECAY_EVERY_SEC * 1_000_000)
    valid = events.where("ratio > 0")
    rows = valid.groupBy("edge_id").agg(_ordered("ratio", "alpha").alias("s"))

    def step(acc, x):
        # after this many ticks any multiplier is exactly 1
        ticks = F.least(F.lit(64).cast("long"), F.floor((x["us"] - acc["us"]) / every))
        before = F.when(acc["us"].isNull(), F.lit(1.0)).otherwise(speeds.decayed(acc["w"], ticks))
        w = F.greatest(F.lit(1.0), x["alpha"] * F.greatest(F.lit(1.0), x["ratio"]) + (1 - x["alpha"]) * before)
        return F.struct(x["us"].alias("us"), w.alias("w"))

    start = F.struct(F.lit(None).cast("long").alias("us"), F.lit(1.0).alias("w"))
    out = rows.select("edge_id", F.aggregate("s", start, step).alias("f"))
    return out.select("edge_id", F.col("f.w").alias("weight"), *([F.col("f.us").alias("us")] if when else []))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges whose multiplier moved by SIGNIFICANT_SHIFT or whose density changed between two states."""
    b = before.select("edge_id", F.col("weight").alias("_w"), F.col("density").alias("_d"))
    both = after.join(b, "edge_id", "full")
    old, new = F.coalesce("_w", F.lit(1.0)), F.coalesce("weight", F.lit(1.0))
    moved = (F.abs(new - old) >= S.SIGNIFICANT_SHIFT) | (F.coalesce("density", F.lit(0)) != F.coalesce("_d", F.lit(0)))
    return both.where(moved).select("edge_id", old.alias("old_multiplier"), new.alias("new_multiplier"))


def improved(changed: DataFrame) -> DataFrame:
    return changed.where(F.col("old_multiplier") - F.col("new_multiplier") >= S.SIGNIFICANT_SHIFT)


def dense_multipliers(edges: DataFrame, states: DataFrame) -> DataFrame:
    return edges.select("edge_id").join(states, "edge_id", "left").select("edge_id", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("density", F.lit(0).cast("long")).alias("density"))


def recommended(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Speed per edge at its density."""
    rows = edges.join(states.select("edge_id", "density"), "edge_id", "left")
    veh = F.coalesce("density", F.lit(0))
    return rows.select("edge_id", F.col("speed_kmh").alias("limit_kmh"), veh.alias("density"), speeds.recommended_kmh(F.col("speed_kmh"), veh, F.col("length_m")).alias("recommended_kmh"))


def affected_cells(edges: DataFrame, pending: DataFrame) -> DataFrame:
    """Cells to customise: all if the pending edges are DIRTY_COVERAGE of all edges, else those with a pending inner edge."""
    share = pending.select("edge_id").distinct().agg(F.count(F.lit(1)).alias("_p")).crossJoin(edges.agg(F.count(F.lit(1)).alias("_e")))
    inner = edges.where("cell_src = cell_dst")
    hit = inner.join(pending.select("edge_id").distinct(), "edge_id", "left_semi").select(F.col("cell_src").alias("cell")).distinct().withColumn("_hit", F.lit(True))
    every = inner.select(F.col("cell_src").alias("cell")).distinct()
    return every.join(hit, "cell", "left").crossJoin(F.broadcast(share)).where(F.col("_hit") | (F.col("_p") >= S.DIRTY_COVERAGE * F.col("_e"))).select("cell")


def customised(edges: DataFrame, gate_nodes: DataFrame, live: DataFrame, cells: DataFrame, weight: str = "live_wt") -> DataFrame:
    """Shortcuts of the given cells under live weights."""
    chosen = live.join(cells.withColumnRenamed("cell", "cell_src"), "cell_src", "left_semi")
    return shortcuts(chosen, gate_nodes.join(cells, "cell", "left_semi"), weight)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
