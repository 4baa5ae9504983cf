"""Traffic and tag formulas on single values."""

import pytest
from pyspark.sql import functions as F

from tarmac.functions import geo, speeds, tags
from tarmac.operators import reports, routes, sessions


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def samples(*pairs):
    return F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.lit(a).alias("alpha")) for r, a in pairs])


def test_ewma(spark):
    once, floor, many, bad = one(spark, speeds.ewma(samples((2, 0.15))), speeds.ewma(samples((0.3, 0.15))), speeds.ewma(samples(*[(3, 0.15)] * 100)), speeds.ewma(samples((-1, 0.15), (0, 0.15))))
    assert abs(once - 1.15) < 1e-9 and floor == 1.0 and abs(many - 3.0) < 0.01 and bad == 1.0


def test_density_never_negative(spark):
    assert one(spark, speeds.density(F.array(*[F.lit(x).cast("long") for x in (-1, 1, -1, -1, 1, 1)]))) == (2,)


def test_decay(spark):
    once, far, none = one(spark, speeds.decayed(F.lit(2.0), F.lit(1)), speeds.decayed(F.lit(2.0), F.lit(5)), speeds.decayed(F.lit(2.0), F.lit(0)))
    assert once == 1.5 and far == 1.0 and none == 2.0


def test_recommended_speed(spark):
    free, jam, some = one(spark, speeds.recommended_kmh(F.lit(50.0), F.lit(1), F.lit(100.0)), speeds.recommended_kmh(F.lit(50.0), F.lit(50), F.lit(100.0)), speeds.recommended_kmh(F.lit(50.0), F.lit(6), F.lit(100.0)))
    assert free == 50.0 and jam == 1.0 and abs(some - 25.5) < 1e-9


def test_car_speed_order(spark):
    slow, fast = one(spark, speeds.car_kmh(F.lit(5.0), F.lit(1.0)), speeds.car_kmh(F.lit(50.0), F.lit(1.15)))
    assert abs(slow - 5.5) < 1e-9 and abs(fast - 55.0) < 1e-9


def test_geometry(spark):
    lit = [F.lit(x) for x in (32.0, 34.0, 33.0, 34.0)]
    deg, tri, zero = one(spark, geo.haversine_m(*lit), geo.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)), geo.point_segment(*[F.lit(x) for x in (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)]))
    assert abs(deg - 111_195) < 100 and tri == 5.0 and zero == 5.0


@pytest.mark.parametrize(("tag", "want"), [("50", 50.0), ("50 mph", 50.0), ("none", 0.0), (None, 0.0), (" 7.5", 7.5), ("-3", 0.0), ("", 0.0), (".5", 0.5)])
def test_max_speed(spark, tag, want):
    assert one(spark, tags.max_speed(F.lit(tag).cast("string"))) == (want,)


@pytest.mark.parametrize(("way", "junction", "want"), [(" YES", None, (True, False)), ("-1", None, (True, True)), ("reverse", None, (True, True)), ("no", "roundabout", (False, False)), (None, "Roundabout", (True, False)), ("odd", None, (False, False))])
def test_one_way(spark, way, junction, want):
    assert one(spark, *tags.one_way(F.lit(way).cast("string"), F.lit(junction).cast("string"))) == want


def test_request_errors(spark):
    lit = lambda *v: [F.lit(x).cast("double") for x in v]
    got = one(spark, tags.request_error(*lit(None, None, 1, 1)), tags.request_error(*lit(95, 0, 0, 0)), tags.request_error(*lit(0, 0, 0, 181)), tags.request_error(*lit(1, 2, 3, 4)))
    assert got == ("missing required field src_lat", "latitude must be between -90 and 90", "longitude must be between -180 and 180", None)


@pytest.mark.parametrize("path", ["/session", "/session/", "/session/test", "/session/test/ws", "/session/test/ws/extra", None, "x"])
def test_session_path(spark, path):
    want = {"/session/test": ("test", ""), "/session/test/ws": ("test", "ws"), "/session/test/ws/extra": ("test", "ws/extra")}.get(path, ("", ""))
    assert one(spark, *tags.session_path(F.lit(path).cast("string"))) == want


def test_texts(spark):
    got = one(spark, tags.duration_text(F.lit(0.0)), tags.duration_text(F.lit(3700.0)), tags.duration_text(F.lit(59.0)), tags.gain_text(F.lit(100.0), F.lit(10.0)), tags.gain_text(F.lit(10.0), F.lit(10.0)), tags.routing_mode(F.lit(" ")), tags.routing_mode(F.lit("car")))
    assert got == ("--", "1h 1m", "0 min", "New path saves about 2 min.", "Route updated", "hierarchical", None)


def test_same_remaining(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    cur = arr(1, 2, 3, 4)
    assert one(spark, *[routes.same_remaining(cur, c) for c in (arr(3, 4), arr(4), arr(2, 3), arr(), arr(1, 2, 3, 4))]) == (True, False, False, True, True)


def test_percentiles_floor(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2, 3)] + [("b", 7.0), ("c", None)], "k string, v double")
    assert {r.k: (r.n, r.p50, r.p95, r.p99) for r in reports.percentile_rows(df, "v", "k").collect()} == {"a": (5, 3.0, 4.0, 4.0), "b": (1, 7.0, 7.0, 7.0)}


def test_report_parsing(spark):
    lines = spark.createDataFrame([("BenchmarkRoute/hierarchical-8   100   250000 ns/op   512 visited_nodes/op",), ("ok  pkg 1s",)], "value string")
    assert [tuple(r) for r in reports.parse_bench_lines(lines).collect()] == [("BenchmarkRoute/hierarchical", 100, 250000.0, 512.0)]
    assert one(spark, *[reports.parse_duration_ms(F.lit(t)) for t in ("1m2.5s", "350ms", "80µs", "1h")]) == (62500.0, 350.0, 0.08, 3600000.0)


def test_strikes_start_anew(spark):
    rows = [(1, k, k, off) for k, off in enumerate([60.0, 70.0, 10.0, 60.0, 9000.0, 51.0, 52.0])]
    got = sessions.strikes(spark.createDataFrame(rows, "session_id long, us long, event_id long, off_m double")).orderBy("us").collect()
    assert [r.strikes for r in got] == [1, 2, 0, 1, 0, 1, 2] and [r.off_route for r in got] == [False, True, False, False, False, False, True]


def test_gain(spark):
    args = lambda o, n, same, patch: speeds.gain_accepted(F.lit(o), F.lit(n), F.lit(same), F.lit(patch))
    assert one(spark, args(100.0, 92.0, False, False), args(100.0, 95.0, False, False), args(1000.0, 984.0, False, False), args(100.0, 50.0, True, False), args(0.0, 0.0, True, True)) == (True, False, True, False, True)
