"""Vehicles on routes: spawning, advancing, and the client's driver model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac import schema as S
from tarmac.functions import speeds


def hash_unit(*parts: Column | int) -> Column:
    """A pseudo-random number in [0, 1) from ids: the same everywhere, no generator."""
    text = F.concat_ws("/", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def spawn_starts(cars: DataFrame, legs: DataFrame) -> DataFrame:
    """Start step per car, drawn in proportion to leg length by the inverse of the running sum.

    ``cars``: car_id, route_id, u; ``legs``: route_id, leg_idx, leg_m.
    """
    rows = cars.join(legs, "route_id")
    length = F.when(F.col("leg_m") > 0, F.col("leg_m")).otherwise(S.MIN_LEG_M)
    rows = rows.withColumn("_run", F.sum(length).over(W.partitionBy("car_id").orderBy("leg_idx"))).withColumn("_all", F.sum(length).over(W.partitionBy("car_id")))
    return rows.where(F.col("_run") >= F.col("u") * F.col("_all")).groupBy("car_id", "route_id").agg(F.min("leg_idx").alias("start_step"))


def random_pairs(ids: DataFrame, box: DataFrame) -> DataFrame:
    """Origins in the box and destinations within COMMUTE_DEG of them, far enough apart; the first of six tries.

    ``ids``: car_id; ``box``: one row min_lat, max_lat, min_lon, max_lon.
    """
    u = lambda *k: hash_unit(F.col("car_id"), *k)
    between = lambda lo, hi, x: lo + (hi - lo) * x
    rows = ids.crossJoin(F.broadcast(box)).select("*", between(F.col("min_lat"), F.col("max_lat"), u(1)).alias("src_lat"), between(F.col("min_lon"), F.col("max_lon"), u(2)).alias("src_lon"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt"))

    def near(axis: str, k: int) -> Column:
        lo = F.greatest(F.col(f"min_{axis}"), F.col(f"src_{axis}") - S.COMMUTE_DEG)
        hi = F.least(F.col(f"max_{axis}"), F.col(f"src_{axis}") + S.COMMUTE_DEG)
        return between(lo, hi, hash_unit(F.col("car_id"), F.lit(k), F.col("attempt")))

    rows = rows.select("*", near("lat", 3).alias("dst_lat"), near("lon", 4).alias("dst_lon"))
    far = (F.col("src_lat") - F.col("dst_lat")) * (F.col("src_lat") - F.col("dst_lat")) + (F.col("src_lon") - F.col("dst_lon")) * (F.col("src_lon") - F.col("dst_lon"))
    first = rows.where(far >= S.MIN_OD_SQUARED).groupBy("car_id").agg(F.min(F.struct("attempt", "src_lat", "src_lon", "dst_lat", "dst_lon")).alias("t"))
    return first.select("car_id", F.col("t.attempt").cast("long").alias("attempt"), "t.src_lat", "t.src_lon", "t.dst_lat", "t.dst_lon")


def leg_speeds(legs: DataFrame, advice: DataFrame) -> DataFrame:
    """Road speed of each leg: advised, else the edge's limit, else length over time, else the default."""
    rows = legs.join(advice.select("edge_id", "recommended_kmh", "limit_kmh"), "edge_id", "left")
    own = F.when((F.col("leg_m") > 0) & (F.col("leg_sec") > 0), F.col("leg_m") / F.col("leg_sec") * S.KMH_PER_MPS).otherwise(S.DEFAULT_LEG_KMH)
    base = F.when(F.col("recommended_kmh") > 0, F.col("recommended_kmh")).when(F.col("limit_kmh") > 0, F.col("limit_kmh")).otherwise(own)
    return rows.withColumn("base_kmh", base).drop("recommended_kmh", "limit_kmh")


def advanced(cars: DataFrame, legs: DataFrame, elapsed_sec: Column) -> DataFrame:
    """Where each car is after ``elapsed_sec`` at its legs' speeds (constant density has a closed form).

    ``cars``: car_id, route_id, start_step, pace; ``legs``: route_id, leg_idx,
    leg_m, base_kmh.  Gives the leg, metres along it and whether the route is done.
    """
    length = F.when(F.col("leg_m") > 0, F.col("leg_m")).otherwise(S.MIN_LEG_M)
    rows = cars.join(legs, "route_id").where("leg_idx >= start_step")
    rows = rows.withColumn("_mps", speeds.car_kmh(F.col("base_kmh"), F.col("pace")) / S.KMH_PER_MPS).withColumn("_len", length).withColumn("_t", elapsed_sec)
    order = W.partitionBy("car_id").orderBy("leg_idx")
    rows = rows.withColumn("_end", F.sum(F.col("_len") / F.col("_mps")).over(order))
    rows = rows.withColumn("_begin", F.coalesce(F.lag("_end").over(order), F.lit(0.0)))
    now = F.min(F.when(F.col("_end") > F.col("_t"), F.struct("leg_idx", ((F.col("_t") - F.col("_begin")) * F.col("_mps")).alias("m"))))
    passed = F.count_if(F.col("_end") <= F.col("_t"))
    out = rows.groupBy("car_id").agg(now.alias("now"), passed.alias("legs_done"))
    return out.select("car_id", F.col("now.leg_idx").alias("leg_idx"), F.col("now.m").alias("progress_m"), "legs_done", F.col("now").isNull().alias("finished"))


def positions(cars: DataFrame, legs: DataFrame) -> DataFrame:
    """Interpolated coordinates of cars under way."""
    rows = cars.where("NOT finished").join(legs, ["route_id", "leg_idx"])
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("progress_m") / F.when(F.col("leg_m") > 0, F.col("leg_m")).otherwise(S.MIN_LEG_M)))
    return rows.select("car_id", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * f).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * f).alias("lon"))


def following(me: DataFrame, others: DataFrame) -> DataFrame:
    """Metres a car may move given the cars ahead on its route.

    ``me``: point_id, route_id, progress_m, speed_kmh, want_m; ``others``:
    route_id, other_id, other_progress_m, offset_m.
    """
    gap = F.col("other_progress_m") - F.col("progress_m")
    room = F.when((F.col("offset_m") <= S.CAPTURE_M) & (gap > 0) & (gap <= S.TRACKED_GAP_M), F.greatest(F.lit(0.0), gap - speeds.safety_gap_m(F.col("speed_kmh"))))
    return me.join(others, "route_id", "left").groupBy("point_id").agg(F.greatest(F.lit(0.0), F.least(F.max("want_m"), F.min(room))).alias("allowed_m"))


def traffic_level(legs: DataFrame, advice: DataFrame) -> DataFrame:
    """Level of the six legs from each leg on: heavy if the worst ratio is at most 0.6 or two are slow."""
    rows = legs.join(advice.select("edge_id", "recommended_kmh", "limit_kmh"), "edge_id", "left")
    ratio = F.when(F.col("limit_kmh") > 0, F.col("recommended_kmh") / F.col("limit_kmh"))
    ahead = W.partitionBy("route_id").orderBy("leg_idx").rowsBetween(0, 5)
    slow = F.sum(F.when(ratio < 0.95, 1).otherwise(0)).over(ahead)
    worst = F.least(F.lit(1.0), F.min(F.when(ratio < 0.95, ratio)).over(ahead))
    rows = rows.withColumn("slow_edges", slow.cast("long")).withColumn("worst", worst)
    level = F.when(F.col("slow_edges") == 0, "normal").when((F.col("worst") <= 0.6) | (F.col("slow_edges") >= 2), "heavy").otherwise("congested")
    return rows.select("route_id", "leg_idx", "slow_edges", level.alias("level"))


def ticks(pauses: DataFrame, tick_ms: int = int(S.TICK_SEC * 1000), most: int = S.CATCH_UP_TICKS) -> DataFrame:
    """Fixed steps run at each wake-up of a clock: ``key, seq, pause_ms`` -> steps run and whether it fell behind.

    Time is gathered until it makes a tick; at most ``most`` ticks are caught up at
    once, and what is left beyond them is cut to one tick.
    """
    rows = pauses.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "pause_ms"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("overloads"))

    def step(acc, x):
        held = acc["held"] + x["pause_ms"]
        run = F.least(F.lit(most).cast("long"), F.floor(held / tick_ms))
        left = held - run * tick_ms
        return F.struct(F.least(left, F.lit(tick_ms)).cast("long").alias("held"), (acc["steps"] + run).alias("steps"), (acc["overloads"] + (left >= tick_ms).cast("long")).alias("overloads"))

    return rows.select("key", F.aggregate("s", start, step).alias("t")).select("key", "t.steps", "t.overloads")


def sampled(ridden: DataFrame) -> DataFrame:
    """Speed samples that a car without a session takes on each leg (``sec`` on it, ``kmh``): after
    SAMPLE_WARMUP_SEC one every SAMPLE_EVERY_SEC, at whole ticks."""
    whole = F.floor(F.col("sec") / S.TICK_SEC + 1e-9) * S.TICK_SEC
    n = F.when((F.col("kmh") > 0) & F.col("edge_id").isNotNull() & (whole >= S.SAMPLE_WARMUP_SEC), F.floor((whole - S.SAMPLE_WARMUP_SEC) / S.SAMPLE_EVERY_SEC) + 1).otherwise(0)
    return ridden.withColumn("samples", n.cast("long"))


def adopted(cars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cars (``car_id, session_id, revision, step_idx, progress_m``) after a look at their sessions (``revision,
    step_idx, lat, lon``): another revision brings its route's step and starts the leg anew; the
    position is the session's."""
    s = sessions.select("session_id", F.col("revision").alias("_rev"), F.col("step_idx").alias("_step"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rows = cars.join(s, "session_id", "left")
    new = F.coalesce((F.col("_rev") != 0) & (F.col("_rev") != F.col("revision")), F.lit(False))
    pick = lambda a, b: F.when(new, a).otherwise(b)
    return rows.select("car_id", pick(F.col("_rev"), F.col("revision")).alias("revision"), pick(F.col("_step"), F.col("step_idx")).alias("step_idx"), pick(F.lit(0.0), F.col("progress_m")).alias("progress_m"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), new.alias("adopted"))


def client_advanced(cars: DataFrame, legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The client's advance by ``move_m`` metres in ``elapsed_ms``: (cars, events of edges passed).

    ``cars``: car_id, route_id, leg_idx, progress_m, edge_ms (time on the edge so far,
    this advance included), move_m, elapsed_ms.  Time spills over in
    proportion to distance, so what is left at the end of a leg has a closed
    form: elapsed * (move - distance to the leg's end) / move.  ``legs``: route_id, leg_idx, leg_m, edge_id, lat1, lon1, lat2, lon2.
    """
    length = F.when(F.col("leg_m") > 0, F.col("leg_m")).otherwise(S.MIN_LEG_M)
    at = legs.select("route_id", F.col("leg_idx").alias("at"), length.alias("len"), "edge_id", "lat1", "lon1", "lat2", "lon2")
    order = W.partitionBy("car_id").orderBy("at")
    rows = cars.join(at, "route_id").where("at >= leg_idx")
    rows = rows.withColumn("_end", F.sum("len").over(order) - F.col("progress_m")).withColumn("_begin", F.coalesce(F.lag("_end").over(order), F.lit(0.0)))
    # the leg ends if its end is reached while there is something left to move
    rows = rows.withColumn("_done", (F.col("_end") <= F.col("move_m")) & (F.col("_begin") < F.col("move_m")))
    spill = F.try_divide(F.col("elapsed_ms") * (F.col("move_m") - F.col("_end")), F.col("move_m"))
    rows = rows.withColumn("_spill", spill).withColumn("_held", F.when(F.col("at") == F.col("leg_idx"), F.col("edge_ms")).otherwise(F.lag(spill).over(order)))
    observed = F.greatest(F.lit(0.0), F.col("_held") - F.col("_spill")) / 1000.0
    events = rows.where("_done AND edge_id IS NOT NULL").select("car_id", F.col("at").alias("leg_idx"), "edge_id", observed.alias("observed_sec")).where("observed_sec > 0")
    now = rows.where("NOT _done").groupBy("car_id").agg(F.min_by(F.struct("at", "_begin", "len", "progress_m", "leg_idx", "move_m", "lat1", "lon1", "lat2", "lon2"), "at").alias("n"))
    gone = rows.groupBy("car_id").agg(F.count_if("_done").alias("legs_done"), F.max_by(F.struct("lat2", "lon2"), "at").alias("e"))
    out = gone.join(now, "car_id", "left")
    moved = F.when(F.col("n.at") == F.col("n.leg_idx"), F.col("n.progress_m")).otherwise(0.0) + F.greatest(F.lit(0.0), F.col("n.move_m") - F.greatest(F.col("n._begin"), F.lit(0.0)))
    f = moved / F.col("n.len")
    place = lambda axis: F.coalesce(F.col(f"n.{axis}1") + (F.col(f"n.{axis}2") - F.col(f"n.{axis}1")) * f, F.col(f"e.{axis}2")).alias(axis)
    return out.select("car_id", "legs_done", F.col("n.at").alias("leg_idx"), moved.alias("progress_m"), place("lat"), place("lon")), events
