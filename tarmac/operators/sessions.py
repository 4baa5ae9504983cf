"""Navigation sessions in batch form: pings folded per session in event order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac import schema as S


def _time():
    return W.partitionBy("session_id").orderBy("us", "event_id")


def advanced(pings: DataFrame) -> DataFrame:
    """Monotone step of each ping (never back, never past the last), the step before, and whether it moved on."""
    capped = F.least("reported", "last_step")
    step = F.max(capped).over(_time().rowsBetween(W.unboundedPreceding, 0))
    rows = pings.withColumn("step_idx", step)
    return rows.withColumn("prev_step", F.coalesce(F.lag("step_idx").over(_time()), F.lit(0))).withColumn("moved", F.col("step_idx") > F.col("prev_step"))


def edge_deltas(moves: DataFrame, steps: DataFrame) -> DataFrame:
    """Leave (-1) rows for every edge passed and enter (+1) for the one reached."""
    passed = moves.where("moved").join(steps, "route_id")
    left = (F.col("s_idx") >= F.col("prev_step")) & (F.col("s_idx") < F.col("step_idx"))
    rows = passed.where(F.col("edge_id").isNotNull() & (left | (F.col("s_idx") == F.col("step_idx"))))
    return rows.select("session_id", "event_id", "edge_id", F.when(F.col("s_idx") == F.col("step_idx"), 1).otherwise(-1).cast("long").alias("delta"))


def partial_samples(moves: DataFrame) -> DataFrame:
    """Pings that count as a speed sample of the current edge: on it for PARTIAL_EDGE_AGE_SEC, and moving."""
    run = F.sum(F.col("moved").cast("int")).over(_time().rowsBetween(W.unboundedPreceding, 0))
    rows = moves.withColumn("_run", run)
    since = F.min("us").over(W.partitionBy("session_id", "_run"))
    return rows.withColumn("age_sec", (F.col("us") - since) / 1_000_000.0).where((F.col("age_sec") >= S.PARTIAL_EDGE_AGE_SEC) & (F.col("speed_kmh") > 0)).drop("_run")


def throttled(pings: DataFrame, every_sec: float = S.ETA_THROTTLE_SEC) -> DataFrame:
    """Which pings push an ETA: the first, then each at least ``every_sec`` after the last push.

    Sequential by nature: a fold over one session's ordered pings.
    """
    us = int(every_sec * 1_000_000)
    rows = pings.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_id"))).alias("s"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("ids"))

    def step(acc, x):
        due = acc["last"].isNull() | (x["us"] - acc["last"] >= us)
        return F.when(due, F.struct(x["us"].alias("last"), F.array_append(acc["ids"], x["event_id"]).alias("ids"))).otherwise(acc)

    return rows.select("session_id", F.explode(F.aggregate("s", start, step)["ids"]).alias("event_id"))


def strikes(pings: DataFrame, off: str = "off_m") -> DataFrame:
    """Consecutive off-route pings so far: between OFF_ROUTE_M and OFF_ROUTE_SANITY_M; anything else starts anew."""
    hit = (F.col(off) > S.OFF_ROUTE_M) & (F.col(off) <= S.OFF_ROUTE_SANITY_M)
    run = F.sum(F.when(hit, 0).otherwise(1)).over(_time().rowsBetween(W.unboundedPreceding, 0))
    rows = pings.withColumn("_hit", hit).withColumn("_run", run)
    count = F.sum(F.col("_hit").cast("long")).over(W.partitionBy("session_id", "_run").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("strikes", count).withColumn("off_route", F.col("_hit") & (F.col("strikes") >= S.OFF_ROUTE_STRIKES)).drop("_hit", "_run")


def decisions(pings: DataFrame) -> DataFrame:
    """Reroute decisions in order: nothing within the cooldown of the last reroute (or the start), then
    off-route, then congestion.  A fold, since each decision moves the cooldown."""
    cool = int(S.REROUTE_COOLDOWN_SEC * 1_000_000)
    rows = pings.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "off_route", "congested"))).alias("s"))
    empty = F.array().cast("array<struct<event_id:long,reason:string>>")
    start = F.struct(F.col("s")[0]["us"].alias("last"), empty.alias("out"))

    def step(acc, x):
        reason = F.when(x["us"] - acc["last"] < cool, F.lit(None)).when(x["off_route"], "off_route").when(x["congested"], "congestion")
        row = F.struct(x["event_id"].alias("event_id"), reason.alias("reason"))
        return F.when(reason.isNull(), acc).otherwise(F.struct(x["us"].alias("last"), F.array_append(acc["out"], row).alias("out")))

    return rows.select("session_id", F.explode(F.aggregate("s", start, step)["out"]).alias("d")).select("session_id", "d.event_id", "d.reason")


def repair_triggers(remaining: DataFrame, live: DataFrame) -> DataFrame:
    """First remaining step that is severely slow: SEVERE_RATIO times its base and SEVERE_DELAY_SEC late."""
    rows = remaining.join(live.select("edge_id", "base_weight", "live_weight", (F.col("cell_src") != F.col("cell_dst")).alias("is_cross")), "edge_id")
    severe = rows.where((F.col("live_weight") >= S.SEVERE_RATIO * F.col("base_weight")) & (F.col("live_weight") - F.col("base_weight") >= S.SEVERE_DELAY_SEC))
    return severe.groupBy("route_id").agg(F.min(F.struct("step_idx", "edge_id", "is_cross")).alias("t")).select("route_id", "t.step_idx", "t.edge_id", "t.is_cross")


def current_versions(decided: DataFrame, sessions: DataFrame) -> DataFrame:
    """Decisions whose session still has the step and route revision they were made for."""
    return decided.join(sessions, ["session_id", "step_idx", "revision"], "left_semi")


def speed_hints(remaining: DataFrame, speeds_by_edge: DataFrame) -> DataFrame:
    """Hints for edges ahead, none where the road is free at its limit."""
    rows = remaining.join(speeds_by_edge, "edge_id")
    return rows.where(~((F.col("recommended_kmh") == F.col("limit_kmh")) & (F.col("density") == 0)))


def expired(pings: DataFrame, now_us, after_sec: int = S.SESSION_EXPIRY_SEC) -> DataFrame:
    """Sessions whose last ping is older than ``after_sec`` before ``now_us`` (a one-row frame with that column)."""
    last = pings.groupBy("session_id").agg(F.max("us").alias("last_us"))
    return last.crossJoin(F.broadcast(now_us)).where(F.col("now_us") - F.col("last_us") > after_sec * 1_000_000).select("session_id", "last_us")


def subscribers(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Which sessions have which edges ahead: edge_id, session_id."""
    rows = sessions.join(steps, "route_id")
    return rows.where(F.col("edge_id").isNotNull() & (F.col("s_idx") >= F.col("step_idx"))).select("edge_id", "session_id").distinct()
