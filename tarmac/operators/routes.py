"""Operators on routes, exploded to one row per step (or leg).

Steps: ``route_id, step_idx, node_idx, edge_id`` and per-leg ``leg_m, leg_sec``;
cumulated: ``distance_m, time_sec``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac import schema as S
from tarmac.functions import geo


def _along():
    return W.partitionBy("route_id").orderBy("step_idx")


def _so_far():
    return _along().rowsBetween(W.unboundedPreceding, 0)


def cumulated(steps: DataFrame) -> DataFrame:
    return steps.withColumn("distance_m", F.sum("leg_m").over(_so_far())).withColumn("time_sec", F.sum("leg_sec").over(_so_far()))


def edge_sequences(steps: DataFrame) -> DataFrame:
    """Edge ids of each route in order, nulls left out, with initial step, step count and last node."""
    ordered = F.array_sort(F.collect_list(F.struct("step_idx", "edge_id", "node_idx")))
    rows = steps.groupBy("route_id").agg(ordered.alias("s"))
    ids = F.filter(F.transform("s", lambda x: x["edge_id"]), lambda e: e.isNotNull())
    n = F.size("s")
    return rows.select("route_id", ids.alias("edge_ids"), F.when(n <= 1, 0).otherwise(1).cast("long").alias("initial_step"), n.cast("long").alias("steps"), F.element_at("s", -1)["node_idx"].alias("destination"))


def current_edge(steps: DataFrame, cursor: Column) -> DataFrame:
    """The edge at a cursor per route: at 0 that of step 1; null out of range."""
    at = F.when(cursor == 0, F.lit(1)).otherwise(cursor)
    rows = steps.select("route_id", cursor.alias("cursor"), "step_idx", "edge_id", at.alias("_at"))
    return rows.groupBy("route_id", "cursor").agg(F.max(F.when(F.col("step_idx") == F.col("_at"), F.col("edge_id"))).alias("edge_id"))


def same_remaining(remaining: Column, candidate: Column) -> Column:
    """Whether a candidate's edges are the tail of the remaining ones, at most SUFFIX_OFFSET shorter."""
    a, b = F.size(remaining), F.size(candidate)
    tail = F.slice(remaining, F.greatest(a - b, F.lit(0)) + 1, b)
    return F.when(b == 0, True).otherwise((a >= b) & (a - b <= S.SUFFIX_OFFSET) & (tail == candidate))


def patched(steps: DataFrame, at: Column, patch: DataFrame) -> DataFrame:
    """Each route with the step at ``at`` replaced by the patch's steps, cumulated anew."""
    kept = steps.where(F.col("step_idx") != at).select("route_id", "step_idx", F.lit(0).cast("long").alias("part"), "node_idx", "leg_m", "leg_sec")
    both = kept.unionByName(patch.select("route_id", "step_idx", "part", "node_idx", "leg_m", "leg_sec"))
    order = W.partitionBy("route_id").orderBy("step_idx", "part")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    return both.select("route_id", (F.row_number().over(order) - 1).cast("long").alias("step_idx"), "node_idx", F.sum("leg_m").over(so_far).alias("distance_m"), F.sum("leg_sec").over(so_far).alias("time_sec"))


def legs(steps: DataFrame) -> DataFrame:
    """Legs of cumulated steps: length, time, and whole km/h (default where the time is 0)."""
    dist = F.greatest(F.lit(0.0), F.col("distance_m") - F.lag("distance_m").over(_along()))
    time = F.greatest(F.lit(0.0), F.col("time_sec") - F.lag("time_sec").over(_along()))
    rows = steps.select("route_id", "step_idx", F.lag("node_idx").over(_along()).alias("from_node"), F.col("node_idx").alias("to_node"), "edge_id", dist.alias("leg_m"), time.alias("leg_sec")).where("step_idx > 0")
    speed = F.when(F.col("leg_sec") > 0, F.floor(F.col("leg_m") / F.col("leg_sec") * S.KMH_PER_MPS + 0.5)).otherwise(F.floor(F.lit(S.DEFAULT_LEG_MPS * S.KMH_PER_MPS) + 0.5))
    return rows.withColumn("speed_kmh", speed.cast("double"))


def congestion(steps: DataFrame, live: DataFrame, *keys: str) -> DataFrame:
    """Congested edges on each route: live weight at least CONGESTED times the base."""
    on = steps.join(live.select("edge_id", "base_weight", "live_weight"), "edge_id")
    slow = F.count_if(F.col("live_weight") >= S.CONGESTED * F.col("base_weight"))
    return on.groupBy(*keys).agg(slow.alias("congested_edges")).withColumn("congestion_ahead", F.col("congested_edges") > 0)


def eta(steps: DataFrame, live: DataFrame, position: DataFrame) -> DataFrame:
    """Live time left: the current edge by the share of it still ahead, the rest whole.

    ``position``: route_id, cursor, lat, lon.
    """
    on = steps.join(position.select("route_id", "cursor", F.col("lat").alias("plat"), F.col("lon").alias("plon")), "route_id").where("step_idx >= cursor")
    on = on.join(live.select("edge_id", "live_weight", "length_m"), "edge_id")
    share = F.least(F.lit(1.0), geo.haversine_m(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")) / F.col("length_m"))
    share = F.when((F.col("step_idx") == F.col("cursor")) & (F.col("cursor") > 0) & (F.col("length_m") > 0), share).otherwise(F.lit(1.0))
    return on.groupBy("route_id").agg(F.sum(F.col("live_weight") * share).alias("eta_sec"))


def off_route(points: DataFrame, steps: DataFrame) -> DataFrame:
    """Distance of points from their route: segments near the cursor first, all if those are far.

    ``points``: point_id, route_id, cursor, x, y; ``steps``: route_id, step_idx, x, y.
    """
    segs = steps.select("route_id", "step_idx", F.col("x").alias("bx"), F.col("y").alias("by"), F.lag("x").over(_along()).alias("ax"), F.lag("y").over(_along()).alias("ay"), F.count(F.lit(1)).over(W.partitionBy("route_id")).alias("n"))
    both = points.join(segs, "route_id")
    to_segment = geo.point_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    to_node = geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    window = F.abs(F.col("step_idx") - F.col("cursor")) <= S.OFF_ROUTE_WINDOW
    inside = F.col("cursor").between(0, F.col("n") - 1) & (F.col("n") > 1)
    node = F.least(F.greatest(F.col("cursor"), F.lit(0)), F.col("n") - 1) == F.col("step_idx")
    rows = both.groupBy("point_id").agg(
        F.min(F.when(window & F.col("ax").isNotNull(), to_segment)).alias("near"), F.min(F.when(F.col("ax").isNotNull(), to_segment)).alias("all"), F.min(F.when(node, to_node)).alias("node"), F.bool_and(inside).alias("inside")
    )
    best = F.when(F.col("near") <= S.OFF_ROUTE_M, F.col("near")).otherwise(F.coalesce(F.least("all", "near"), F.lit(0.0)))
    return rows.select("point_id", F.when(F.col("inside"), best).otherwise(F.col("node")).alias("off_m"))


def off_route_by_degrees(points: DataFrame, steps: DataFrame, ref_lat: float = S.REFERENCE_LATITUDE) -> DataFrame:
    """As ``off_route`` for points in degrees (``lat, lon``); where the latitude is out of range
    the two may be swapped, and the nearer reading counts.  ``steps``: lat, lon."""
    at = lambda df, lat, lon: df.select("*", *[c.alias(n) for c, n in zip(geo.project(F.col(lat), F.col(lon), F.lit(ref_lat)), ("x", "y"))])
    placed = at(steps, "lat", "lon")
    stated = off_route(at(points, "lat", "lon"), placed)
    swapped = off_route(at(points.where("lat < -90 OR lat > 90"), "lon", "lat"), placed).select("point_id", F.col("off_m").alias("_other"))
    return stated.join(swapped, "point_id", "left").select("point_id", F.least("off_m", "_other").alias("off_m"))


def turns(leg_rows: DataFrame) -> DataFrame:
    """Angle and side of the turn after each leg; null angle after the last one."""
    walk = W.partitionBy("route_id").orderBy("leg_idx")
    vx, vy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    rows = leg_rows.withColumn("_ax", vx).withColumn("_ay", vy)
    rows = rows.withColumn("_bx", F.lead("_ax").over(walk)).withColumn("_by", F.lead("_ay").over(walk))
    side = F.when(F.col("_bx").isNull(), F.lit(None).cast("int")).otherwise(geo.turn_side(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")))
    return rows.withColumn("angle", F.when(F.col("_bx").isNotNull(), geo.turn_angle(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")))).withColumn("side", side).drop("_ax", "_ay", "_bx", "_by")
