"""One query per analytic operator, over the network derived from the star-schema tables.

Each callable takes (spark, sf_dir); ``tarmac.oracles`` has the same results in
DuckDB's SQL.  Doubles are rounded, so that engines agree to the last digit shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac import schema as S
from tarmac.functions import geo, speeds, tags
from tarmac.operators import etl, graph, joins, lifecycle, reports, routes, routing, sessions, simulation, traffic
from tarmac.operators.etl import with_one
from tarmac.plans import derived as D
from tarmac.sources import graphs, pbf
from tarmac.sources.shared import kept, shared_folder
from tarmac.streaming import replay

#: Nodes of one JSON document.
DOCUMENT_NODES = 20_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or (c if isinstance(c, str) else "value"))


# ---- sources and graph building ------------------------------------------------


@query
def s01_referenced_nodes(spark, sf):
    return etl.referenced_nodes(D.nodes(spark, sf), D.long_ways(spark, sf)).select("id", r6("lat"), r6("lon"))


@query
def s01_extract(spark, sf):
    """The derived map written as extracts and read back: nodes that some highway refers to."""
    n, w = D.nodes(spark, sf), D.raw_ways(spark, sf).where("way_id % 3 = 0")
    files = [r["path"] for r in pbf.write_pbf(n, w, shared_folder(spark, "extract")).select("path").collect()]  # one per partition
    nodes, _ = pbf.read_pbf(spark, *files)
    return nodes.select("id", r6("lat"), r6("lon"))


@query
def s02_extract_ways(spark, sf):
    """The ways of the same extracts, with the tags that routing needs."""
    w = D.raw_ways(spark, sf).where("way_id % 3 = 0")
    files = [r["path"] for r in pbf.write_pbf(D.nodes(spark, sf), w, shared_folder(spark, "extract")).where("rows > 0").select("path").collect()]
    _, ways = pbf.read_pbf(spark, *files)
    return ways.select("way_id", F.col("node_refs")[0].alias("a"), F.col("node_refs")[1].alias("b"), "highway", "oneway", "maxspeed", "junction")


@query
def s04_stored_graph(spark, sf):
    """A graph saved without its gates and loaded again: the gates that follow from its edges."""
    folder = shared_folder(spark, "graph")
    graphs.save_graph(folder, nodes=D.nodes(spark, sf), edges=D.edges(spark, sf))
    return graphs.complete_graph(graphs.load_graph(spark, folder))["gates"].select("gate_id", "node_idx", "cell")


@query
def s06_json_graph(spark, sf):
    """The derived map as JSON documents, as fixtures are, read back: ways with class, speed and direction.  A document holds the nodes and ways of one range of ids."""
    n = D.nodes(spark, sf).select(F.floor(F.col("id") / DOCUMENT_NODES).alias("k"), F.struct("id", "lat", "lon").alias("n")).groupBy("k").agg(F.collect_list("n").alias("nodes"))
    w = D.ways(spark, sf).select(F.floor(F.col("way_id") / (2 * DOCUMENT_NODES)).alias("k"), F.struct(F.col("way_id").alias("id"), "node_refs", "road_class", "is_one_way", F.when(F.col("way_id") % 2 == 0, F.col("speed_kmh")).alias("max_speed")).alias("w")).groupBy("k").agg(F.collect_list("w").alias("ways"))
    folder = shared_folder(spark, "fixture")
    graphs.write_graph_json(n.join(w, "k", "full"), folder)
    _, ways = graphs.read_graph_json(spark, folder)
    return ways.select("way_id", F.size("node_refs").cast("long").alias("refs"), F.col("road_class").cast("long").alias("road_class"), "speed_kmh", "is_one_way")


@query
def s10_search(spark, sf):
    """Places by name, of which some have coordinates that are no numbers, within a viewbox."""
    k = F.col("c_custkey")
    places = D.table(spark, sf, "customer").select(F.col("c_name").alias("display_name"), F.when(k % 9 == 0, "?").otherwise((k % 80).cast("string")).alias("lat"), (k % 170).cast("string").alias("lon"))
    return graphs.search_places(places, " 0000001 ", 50, viewbox="10,70,160,5")


@query
def s07_region_tree(spark, sf):
    top = D.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    leaf = D.table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 9 == 8, F.lit(" ")).otherwise(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return graphs.region_tree(top.unionByName(leaf)).select("id", "name", "parent", F.array_join("children", ",").alias("children"))


@query
def s08_ready_regions(spark, sf):
    s = D.table(spark, sf, "supplier")
    place = F.concat(F.lit("maps/n"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("/sub")).otherwise(F.lit("")))
    files = s.select(place.alias("dir"), F.concat(F.lit("part"), (F.col("s_suppkey") % 3).cast("string")).alias("file"))
    return graphs.ready_regions(files, ("part0", "part1", "part2"))


@query
def s11_parse_latlon(spark, sf):
    s = D.table(spark, sf, "supplier")
    text = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name")).otherwise(F.concat((F.col("s_suppkey") % 120).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(" , ")).otherwise(F.lit(",")), F.lit("-"), (F.col("s_suppkey") % 200).cast("string"), F.lit(".25")))
    lat, lon = tags.lat_lon(F.col("q"))
    rows = s.select("s_suppkey", text.alias("q")).select("s_suppkey", lat.alias("lat"), lon.alias("lon"))
    return rows.withColumn("label", F.when(F.col("lat").isNotNull(), F.format_string("%.5f, %.5f", "lat", "lon")))


@query
def s12_parse_pings(spark, sf):
    ev = D.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "noise").otherwise("ping")
    body = F.concat(F.lit('{"type":"'), kind, F.lit('","lat":32.5,"lon":34.5,"speed_kmh":'), F.floor("value").cast("string"), F.lit(',"step_index":'), (F.col("event_id") % 9).cast("string"), F.lit(',"edge_events":[{"edge_id":'), F.col("user_id").cast("string"), F.lit(',"observed_sec":'), (F.col("event_id") % 60).cast("string"), F.lit(".5}]}"))
    text = F.when(F.col("event_id") % 17 == 0, F.lit("not json")).otherwise(body)
    parsed = graphs.parse_pings(ev.select("event_id", text.alias("value")))
    return parsed.select("event_id", "speed_kmh", F.col("step_index").cast("long").alias("step_index"), F.col("edge_events")[0]["edge_id"].alias("edge_id"), F.col("edge_events")[0]["observed_sec"].alias("observed_sec"))


@query
def s15_route_cache(spark, sf):
    """Cached routes: made when a user first appears; wanted by suppliers; now is the time of the last event."""
    ev = D.table(spark, sf, "events")
    cache = ev.groupBy(F.col("user_id").alias("route_id")).agg(F.max("ts").alias("created_at"))
    now = ev.agg(F.max("ts").alias("_now"))
    wanted = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("route_id"))
    return graphs.cached_routes(with_one(cache, now), wanted, F.col("_now"), 60 * 24).select("route_id", "created_at")


@query
def s16_system_info(spark, sf):
    return etl.bbox(D.nodes(spark, sf)).select(*[r6(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon", "center_lat", "center_lon")])


@query
def p01_highway_class(spark, sf):
    return D.raw_ways(spark, sf).select("way_id", tags.road_class(F.col("highway")).cast("long").alias("road_class")).where("road_class IS NOT NULL")


@query
def p02_default_speed(spark, sf):
    w = D.raw_ways(spark, sf)
    return w.select("way_id", tags.default_speed(tags.road_class(F.col("highway"))).alias("default_kmh"))


@query
def p03_oneway(spark, sf):
    one, back = tags.one_way(F.col("oneway"), F.col("junction"))
    return D.raw_ways(spark, sf).select("way_id", one.alias("is_one_way"), back.alias("is_reverse"))


@query
def p04_maxspeed(spark, sf):
    return D.raw_ways(spark, sf).select("way_id", tags.max_speed(F.col("maxspeed")).alias("kmh"))


@query
def p05_way_segments(spark, sf):
    """Pairs of neighbours on long ways; pairs with a node that isn't there go."""
    segs, n = etl.segments(D.long_ways(spark, sf)), D.nodes(spark, sf).select("id")
    return segs.join(n.withColumnRenamed("id", "n1"), "n1", "left_semi").join(n.withColumnRenamed("id", "n2"), "n2", "left_semi").select("way_id", "seq", "n1", "n2")


@query
def p06_directed_edges(spark, sf):
    return etl.directed(etl.segments(D.ways(spark, sf), "is_one_way", "is_reverse")).select("way_id", "src", "dst")


@query
def p07_edge_metrics(spark, sf):
    return D.edges(spark, sf).select("way_id", "src", "dst", "length_m", "base_weight")


@query
def p08_flags(spark, sf):
    return D.edges(spark, sf).groupBy((F.col("flags").bitwiseAND(S.FLAG_ONE_WAY) != 0).alias("is_one_way")).agg(F.count(F.lit(1)).alias("edges"))


@query
def p09_edge_ids(spark, sf):
    return D.edges(spark, sf).select("edge_id", "src", "dst", "way_id")


@query
def p10_csr_offsets(spark, sf):
    return etl.csr_offsets(D.edges(spark, sf), D.nodes(spark, sf))


@query
def p11_reorder_by_cell(spark, sf):
    _, moved = etl.reordered(D.nodes(spark, sf), D.edges(spark, sf))
    return moved


@query
def p12_bbox_viewbox(spark, sf):
    return etl.bbox(D.nodes(spark, sf)).select("viewbox")


@query
def p13_projection(spark, sf):
    return etl.projected(D.nodes(spark, sf)).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def p14_validate_requests(spark, sf):
    s = D.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    cols = [F.when(k % 6 != 1, k % 200 - 100.0), F.when(k % 6 != 2, k % 400 - 200.0), F.when(k % 6 != 3, k % 90 * 1.0), F.when(k % 6 != 4, k % 180 * 1.0)]
    return s.select("s_suppkey", tags.request_error(*cols).alias("error"))


@query
def p15_route_count(spark, sf):
    k = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select("s_suppkey", tags.route_count(k % 11 - 3).cast("long").alias("routes"), tags.spawn_count(k * 400 - 900).cast("long").alias("cars"))


@query
def p17_session_path(spark, sf):
    k = F.col("s_suppkey")
    path = F.when(k % 5 == 0, "/session").when(k % 5 == 1, "/session/").when(k % 5 == 2, F.concat(F.lit("/session/s"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("/session/s"), k.cast("string"), F.lit("/ws"))).otherwise(F.concat(F.lit("/session/s"), k.cast("string"), F.lit("/ws/extra")))
    sid, rest = tags.session_path(F.col("path"))
    return D.table(spark, sf, "supplier").select("s_suppkey", path.alias("path")).select("s_suppkey", sid.alias("session"), rest.alias("rest"))


@query
def p18_routing_mode(spark, sf):
    k = F.col("s_suppkey") % 5
    text = F.when(k == 0, "").when(k == 1, " Hierarchical ").when(k == 2, "BASE-ASTAR").when(k == 3, "base-dijkstra").otherwise("fastest")
    return D.table(spark, sf, "supplier").select("s_suppkey", tags.routing_mode(text).alias("mode"))


# ---- geometry ------------------------------------------------------------------


def _ends(spark, sf):
    return D.requests(spark, sf)


@query
def m01_haversine(spark, sf):
    c = [F.col(x) for x in ("src_lat", "src_lon", "dst_lat", "dst_lon")]
    return _ends(spark, sf).select("request_id", F.round(geo.haversine_m(*c), 3).alias("metres"))


@query
def m03_heuristic(spark, sf):
    c = [F.col(x) for x in ("src_lat", "src_lon", "dst_lat", "dst_lon")]
    return _ends(spark, sf).select("request_id", F.round(geo.heuristic_m(*c), 3).alias("metres"))


def _offset_points(spark, sf):
    """A point off each edge of the network."""
    n = D.nodes(spark, sf).select("id", "lat", "lon")
    e = D.edges(spark, sf).select("edge_id", "src", "dst")
    e = e.join(n.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "src").join(n.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "dst")
    return e.select("*", (F.col("lat1") + (F.col("edge_id") % 7 - 3) * 0.0004).alias("plat"), (F.col("lon1") + (F.col("edge_id") % 5 - 2) * 0.0005).alias("plon"))


@query
def m05_point_segment(spark, sf):
    xy = lambda p: geo.project(F.col(f"{p[0]}"), F.col(f"{p[1]}"), F.lit(S.REFERENCE_LATITUDE))
    (px, py), (ax, ay), (bx, by) = xy(("plat", "plon")), xy(("lat1", "lon1")), xy(("lat2", "lon2"))
    return _offset_points(spark, sf).select("edge_id", F.round(geo.point_segment(px, py, ax, ay, bx, by), 3).alias("metres"))


@query
def m06_local_distance(spark, sf):
    return _offset_points(spark, sf).select("edge_id", F.round(geo.local_distance_m(F.col("plat"), F.col("plon"), F.col("lat2"), F.col("lon2")), 3).alias("metres"))


@query
def m07_interpolate(spark, sf):
    f = geo.unit_clamp((F.col("edge_id") % 13 - 1) / 10.0)
    return _offset_points(spark, sf).select("edge_id", r6(F.col("lat1") + (F.col("lat2") - F.col("lat1")) * f, "lat"), r6(F.col("lon1") + (F.col("lon2") - F.col("lon1")) * f, "lon"))


def _legs_xy(spark, sf):
    """Legs with both ends; every 4th node is moved, so that turns differ."""
    rows = D.route_legs(spark, sf)
    walk = W.partitionBy("route_id").orderBy("step_idx")
    lat, lon = F.col("lat") + (F.col("node_idx") % 4) * 0.0003, F.col("lon") + (F.col("node_idx") % 3) * 0.0004
    rows = rows.withColumn("lat2", lat).withColumn("lon2", lon)
    rows = rows.withColumn("lat1", F.lag("lat2").over(walk)).withColumn("lon1", F.lag("lon2").over(walk))
    return rows.where("step_idx > 0").withColumn("leg_idx", F.col("step_idx") - 1)


@query
def m08_turn_info(spark, sf):
    return routes.turns(_legs_xy(spark, sf)).select("route_id", "leg_idx", F.round("angle", 4).alias("angle"), F.col("side").cast("long").alias("side"))


@query
def m09_turn_instruction(spark, sf):
    return routes.turns(_legs_xy(spark, sf)).select("route_id", "leg_idx", tags.turn_text(F.round("angle", 6), F.col("side")).alias("instruction"))


@query
def m10_bearing(spark, sf):
    return _legs_xy(spark, sf).select("route_id", "leg_idx", F.round(geo.bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 4).alias("bearing"))


@query
def m11_bearing_cap(spark, sf):
    walk = W.partitionBy("route_id").orderBy("leg_idx")
    rows = _legs_xy(spark, sf).withColumn("b", F.round(geo.bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6))
    gap = geo.bearing_gap(F.lead("b").over(walk), F.col("b"))
    return rows.select("route_id", "leg_idx", F.round(gap, 4).alias("gap"), F.coalesce(gap > 25, F.lit(False)).alias("capped"))


@query
def m12_format_eta(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", tags.duration_text(F.col("o_totalprice") / 7 - 300).alias("duration"), F.format_string("%.1f km", F.floor(F.floor("o_totalprice") / 100 + 0.5) / 10).alias("distance"))


@query
def m13_grid_bucket(spark, sf):
    rows = with_one(_offset_points(spark, sf), _offset_points(spark, sf).agg(F.round(F.avg("plat"), 6).alias("_mean")))
    r, c = geo.grid_bucket(F.col("plat"), F.col("plon"), F.col("_mean"))
    return rows.select("edge_id", F.concat_ws(":", r.cast("string"), c.cast("string")).alias("bucket"))


# ---- joins ---------------------------------------------------------------------


@query
def j03_snap(spark, sf):
    points = D.requests(spark, sf).select(F.col("request_id").alias("point_id"), (F.col("src_lat") + 0.00011).alias("lat"), (F.col("src_lon") + F.col("request_id") % 3 * 0.0007 + 0.00007).alias("lon"))
    return joins.snap(points, D.nodes(spark, sf)).select("point_id", "node_idx", F.round("dist_m", 3).alias("dist_m"))


def _net(spark, sf):
    """The edges as a table, for queries that use them more than once."""
    return kept(D.edges(spark, sf), "net")


def _state(spark, sf, e=None):
    return traffic.state(D.events(spark, sf, e))


def _live(spark, sf, e=None):
    e = _net(spark, sf) if e is None else e
    return joins.live_weights(e, _state(spark, sf, e))


def _live_net(spark, sf, e):
    """The edges with their live weight in hundredths of a second, as a table."""
    return kept(_live(spark, sf, e).withColumn("live_wt", F.round(F.round("live_weight", 6) * 100).cast("long")), "live-net")


@query
def j05_live_weight(spark, sf):
    return _live(spark, sf).select("edge_id", r6("multiplier"), r6("live_weight"))


def _overlay(spark, sf, e=None):
    e = _net(spark, sf) if e is None else e
    return graph.overlay_edges(e, graph.shortcuts(e, graph.gates(e)))


@query
def j06_overlay_weight(spark, sf):
    over = _overlay(spark, sf)
    fresh = over.where("NOT is_cross_cell AND store_idx % 5 = 0").select("src", "dst", (F.col("weight") * 2).alias("weight"))
    return joins.overlay_weights(over, _state(spark, sf), fresh).select("overlay_id", "src", "dst", "is_cross_cell", F.round("live_weight", 4).alias("live_weight"))


def _halves(spark, sf, e=None):
    """State at the middle of the events' ids and at their end."""
    ev = kept(D.events(spark, sf, e), "events")
    middle = ev.agg((F.max("event_id") / 2).alias("_mid"))
    return traffic.state(with_one(ev, middle).where("event_id <= _mid").drop("_mid")), traffic.state(ev)


def _changed(spark, sf, e=None):
    return traffic.changes(*_halves(spark, sf, e))


def _positions(spark, sf):
    """Last step of each session: session, route, step; connected unless its id divides by 5."""
    moves = sessions.advanced(D.pings(spark, sf))
    last = moves.groupBy("session_id", "route_id").agg(F.max("step_idx").alias("step_idx"), F.max("us").alias("us"))
    return last.withColumn("connected", F.col("session_id") % 5 != 0)


def _steps(spark, sf):
    return D.route_legs(spark, sf).select("route_id", F.col("step_idx").alias("s_idx"), "edge_id")


def _remaining(spark, sf):
    s = _positions(spark, sf)
    return s.join(_steps(spark, sf), "route_id").where("s_idx >= step_idx AND edge_id IS NOT NULL")


@query
def j07_speed_fanout(spark, sf):
    return joins.speed_fanout(_changed(spark, sf), _remaining(spark, sf)).select("session_id", "edge_id", r6("old_multiplier"), r6("new_multiplier"))


@query
def j08_better_route(spark, sf):
    """Requests as sessions whose ETA is the straight time at 60 km/h; improved edges with their ends."""
    req = D.requests(spark, sf)
    eta = F.round(geo.haversine_m(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")) / (30 / 3.6), 3)
    s = req.select("request_id", F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon"), F.col("dst_lat").alias("goal_lat"), F.col("dst_lon").alias("goal_lon"), eta.alias("eta_sec"))
    e = _net(spark, sf)
    before, after = _halves(spark, sf, e)
    imp = kept(traffic.improved(traffic.changes(after, before)).select("edge_id", F.col("new_multiplier").alias("weight")), "improved")
    at = lambda end: D.nodes(spark, sf).select(F.col("id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    improved = joins.live_weights(e, imp).join(imp.select("edge_id"), "edge_id", "left_semi").join(at("src"), "src").join(at("dst"), "dst")
    return joins.better_routes(s, improved).select("request_id", "eta_sec")


@query
def j11_step_edge(spark, sf):
    e = D.edges(spark, sf)
    stated = F.when(F.col("route_id") % 3 == 0, F.col("edge_id")).when(F.col("route_id") % 3 == 1, F.lit(-5).cast("long"))
    steps = D.route_legs(spark, sf).where("prev IS NOT NULL").select("route_id", "step_idx", "prev", "node_idx", stated.alias("stated"))
    return joins.step_edges(steps, e, D.first_edges(e)).select("route_id", "step_idx", "resolved")


@query
def j10_first_edge(spark, sf):
    return D.first_edges(D.edges(spark, sf))


def _cars(spark, sf):
    return _offset_points(spark, sf).select(F.col("edge_id").alias("car_id"), F.col("plat").alias("lat"), F.col("plon").alias("lon"))


@query
def j12_nearby_cars(spark, sf):
    cars = _cars(spark, sf)
    points = D.requests(spark, sf).select(F.col("request_id").alias("point_id"), F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon"))
    found = joins.nearby(points, cars, F.lit(32.02))
    return found.groupBy("point_id").agg(F.count(F.lit(1)).alias("cars"), F.min("car_id").alias("first_car"))


def _route_legs_m(spark, sf):
    rows = routes.cumulated(D.route_legs(spark, sf))
    walk = W.partitionBy("route_id").orderBy("step_idx")
    rows = rows.select("*", F.lag("lat").over(walk).alias("lat1"), F.lag("lon").over(walk).alias("lon1"), F.lag("distance_m").over(walk).alias("start_m"), F.max("distance_m").over(W.partitionBy("route_id")).alias("total_m"))
    return rows.where("step_idx > 0").select("route_id", (F.col("step_idx") - 1).alias("leg_idx"), "lat1", "lon1", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "leg_m", "leg_sec", "edge_id", "start_m", "total_m")


def _ping_points(spark, sf):
    """Where each ping is: its route's step, some way off."""
    moves = sessions.advanced(D.pings(spark, sf))
    at = D.route_legs(spark, sf).select("route_id", "step_idx", "lat", "lon")
    rows = moves.join(at, ["route_id", "step_idx"])
    return rows.select("event_id", "us", "session_id", "route_id", "step_idx", "speed_kmh", (F.col("lat") + F.col("off")).alias("lat"), (F.col("lon") - F.col("off") / 3).alias("lon"))


@query
def j13_map_match(spark, sf):
    points = _ping_points(spark, sf).select(F.col("event_id").alias("point_id"), "route_id", "lat", "lon")
    found = joins.map_match(points, _route_legs_m(spark, sf))
    return found.select("point_id", "leg_idx", *[F.round(c, 3).alias(c) for c in ("offset_m", "progress_m", "distance_left_m")])


# ---- partition and overlay -----------------------------------------------------


@query
def g01_partition(spark, sf):
    """Invariants of the inertial-flow partition: every node once, no cell too large, enough cells."""
    n = etl.projected(D.nodes(spark, sf))
    cells = graph.partition(n, D.edges(spark, sf), 500)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    return sizes.agg(F.sum("n").alias("nodes"), (F.max("n") <= 500).alias("within"), (F.count(F.lit(1)) >= F.ceil(F.sum("n") / 500)).alias("enough"), F.bool_and(F.col("low") == F.col("cell")).alias("named_by_first"))


@query
def g02_undirected_pairs(spark, sf):
    return graph.undirected_pairs(D.edges(spark, sf))


@query
def g04_gates(spark, sf):
    return graph.gates(D.edges(spark, sf))


@query
def g05_cross_edges(spark, sf):
    return graph.cross_edges(D.edges(spark, sf))


def _shortcuts(spark, sf, e=None):
    e = _net(spark, sf) if e is None else e
    return graph.shortcuts(e, graph.gates(e))


@query
def g06_shortcuts(spark, sf):
    return _shortcuts(spark, sf).select("cell", "src", "dst", F.col("weight").cast("long").alias("weight"))


@query
def g07_overlay_edges(spark, sf):
    return _overlay(spark, sf).select("overlay_id", "src", "dst", F.col("weight").cast("long").alias("weight"), "is_cross_cell", "store_idx")


@query
def g08_graph_stats(spark, sf):
    e = _net(spark, sf)
    return graph.stats(D.nodes(spark, sf), e, graph.gates(e), _shortcuts(spark, sf, e))


# ---- routing -------------------------------------------------------------------


@query
def r01_dijkstra(spark, sf):
    return routing.shortest(D.requests(spark, sf), D.edges(spark, sf)).select("request_id", "src", "dst", "cost")


@query
def r02_astar(spark, sf):
    return routing.goal_directed(D.requests(spark, sf), D.edges(spark, sf), D.nodes(spark, sf), per_metre=0.9 * 100 / (S.ASTAR_KMH / 3.6)).select("request_id", "src", "dst", "cost")


def _seeds(spark, sf, both: bool):
    """Each request's source in its cell; with ``both`` a second, dearer seed beside it."""
    n = D.nodes(spark, sf).select(F.col("id").alias("src"), "cell", "c")
    rows = D.requests(spark, sf).select(F.col("request_id").alias("group"), "src").join(n, "src")
    one = rows.select("group", "cell", F.col("src").alias("node_idx"), F.lit(0).cast("long").alias("cost"))
    if not both:
        return one
    two = rows.where("c % 10 < 9").select("group", "cell", (F.col("src") + 1).alias("node_idx"), F.lit(150).cast("long").alias("cost"))
    last = D.nodes(spark, sf).agg(F.max("id").alias("_last"))
    return one.unionByName(with_one(two, last).where("node_idx <= _last").drop("_last"))


@query
def r03_cell_dijkstra(spark, sf):
    return routing.cell_distances(D.edges(spark, sf), _seeds(spark, sf, False)).withColumnRenamed("group", "request_id")


@query
def r05_multi_source(spark, sf):
    return routing.cell_distances(D.edges(spark, sf), _seeds(spark, sf, True)).withColumnRenamed("group", "request_id")


@query
def r06_overlay_search(spark, sf):
    """Between gates over the overlay alone: the first gates of the requests' cells."""
    g = graph.gates(D.edges(spark, sf)).groupBy("cell").agg(F.min("node_idx").alias("gate"))
    n = D.nodes(spark, sf)
    cell = lambda end: n.select(F.col("id").alias(end), F.col("cell").alias(f"{end}_cell"))
    req = D.requests(spark, sf).select("request_id", "src", "dst").join(cell("src"), "src").join(cell("dst"), "dst").select("request_id", "src_cell", "dst_cell")
    req = req.join(g.select(F.col("cell").alias("src_cell"), F.col("gate").alias("src")), "src_cell").join(g.select(F.col("cell").alias("dst_cell"), F.col("gate").alias("dst")), "dst_cell")
    over = _overlay(spark, sf).select("src", "dst", F.col("weight").cast("long").alias("wt"), F.col("overlay_id").alias("edge_id"))
    return routing.shortest(req, over, width=10 * D.COLUMNS).select("request_id", "src", "dst", "cost")  # no cell spans two such ranges


@query
def r07_crp(spark, sf):
    e = _net(spark, sf)
    return routing.two_level(D.requests(spark, sf), e, D.nodes(spark, sf), _shortcuts(spark, sf, e)).select("request_id", "src", "dst", "cost")


@query
def r08_route_steps(spark, sf):
    """Paths checked edge by edge: ends, hops that don't join, and cost."""
    e = _net(spark, sf)
    return _checked_steps(routing.paths(D.requests(spark, sf), e), e)


def _checked_steps(steps, e):
    walk = W.partitionBy("request_id").orderBy("step_idx")
    rows = steps.withColumn("prev", F.lag("node_idx").over(walk)).join(e.select("edge_id", F.col("src").alias("es"), F.col("dst").alias("ed"), "wt"), "edge_id", "left")
    broken = F.count_if((F.col("step_idx") > 0) & ((F.col("es") != F.col("prev")) | (F.col("ed") != F.col("node_idx")) | F.col("es").isNull()))
    return rows.groupBy("request_id").agg(F.min_by("node_idx", "step_idx").alias("src"), F.max_by("node_idx", "step_idx").alias("dst"), F.sum("wt").alias("cost"), broken.alias("broken_hops"))


@query
def flagship_routes(spark, sf):
    """Snap requests, route them, and follow every step: free and live time so far, congestion on the whole route."""
    e = _net(spark, sf)
    live, req = kept(_live(spark, sf, e), "live"), D.requests(spark, sf)
    n = D.nodes(spark, sf)
    both = F.array(*[F.struct((F.col("request_id") * 2 + k).alias("point_id"), F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lon").alias("lon")) for k, end in enumerate(("src", "dst"))])
    at = joins.snap(req.select(F.explode(both).alias("p")).select("p.*"), n)
    end = lambda k: F.max(F.when(F.col("point_id") % 2 == k, F.col("node_idx")))
    ends = kept(at.groupBy(F.floor(F.col("point_id") / 2).alias("request_id")).agg(end(0).alias("src"), end(1).alias("dst")), "ends")
    steps = routing.paths(ends, e).join(live.select("edge_id", "length_m", "base_weight", "live_weight"), "edge_id", "left")
    walk = W.partitionBy("request_id").orderBy("step_idx").rowsBetween(W.unboundedPreceding, 0)
    so_far = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0.0))).over(walk), 3)
    slow = F.count_if(F.col("live_weight") >= S.CONGESTED * F.col("base_weight")).over(W.partitionBy("request_id"))
    return steps.select("request_id", "step_idx", "node_idx", "edge_id", so_far("length_m").alias("distance_m"), so_far("base_weight").alias("time_sec"), so_far("live_weight").alias("live_sec"), slow.alias("congested_edges"))


@query
def r10_cumulative(spark, sf):
    return routes.cumulated(D.route_legs(spark, sf)).select("route_id", "step_idx", "node_idx", "edge_id", F.round("distance_m", 3).alias("distance_m"), F.round("time_sec", 3).alias("time_sec"))


@query
def r11_alternatives(spark, sf):
    """Invariants of three alternatives: the first costs no more than any other, and all end where they should."""
    e = _net(spark, sf)
    steps = routing.paths(D.requests(spark, sf), e, alternatives=2).join(e.select("edge_id", "wt"), "edge_id", "left")
    per = steps.groupBy("request_id", "alternative").agg(F.sum("wt").alias("cost"), F.max_by("node_idx", "step_idx").alias("goal"))
    out = per.groupBy("request_id").agg(F.count(F.lit(1)).alias("routes"), F.min("cost").alias("best"), F.max(F.when(F.col("alternative") == 0, F.col("cost"))).alias("first"), F.count_distinct("goal").alias("goals"))
    return out.select("request_id", "routes", (F.col("best") == F.col("first")).alias("first_is_best"), "goals", F.col("first").alias("cost"))


@query
def r13_visited_nodes(spark, sf):
    """Nodes visited per request by the three modes, as in a speed-up table."""
    req, e, n = D.requests(spark, sf), _net(spark, sf), D.nodes(spark, sf)
    a = routing.goal_directed(req, e, n, per_metre=0.9 * 100 / (S.ASTAR_KMH / 3.6), counted=True).select("request_id", F.col("visited").alias("astar"))
    d = routing.goal_directed(req, e, n, counted=True).select("request_id", F.col("visited").alias("dijkstra"))
    h = routing.two_level(req, e, n, _shortcuts(spark, sf, e), counted=True).select("request_id", F.col("visited").alias("two_level"))
    return d.join(a, "request_id").join(h, "request_id")


def _repair_jobs(spark, sf, firsts):
    e = D.edges(spark, sf)
    jobs = D.requests(spark, sf).select(F.col("request_id").alias("job"), "src").join(firsts, "src")
    return jobs.groupBy("job", "src").agg(F.min("dst").alias("dst")).select("job", "src", "dst", F.lit(4000).cast("long").alias("budget")), e


@query
def r15_repair_overlay(spark, sf):
    """Round a crossing edge: at most five overlay hops within the budget."""
    e = _net(spark, sf)
    over = _overlay(spark, sf, e).select("src", "dst", F.col("weight").cast("long").alias("wt"), F.col("overlay_id").alias("edge_id"))
    crossing = graph.cross_edges(e)
    jobs = crossing.select(F.col("store_idx").alias("job"), "src", "dst", F.lit(3000).cast("long").alias("budget"))
    return routing.repairs(jobs, over, S.OVERLAY_REPAIR_HOPS).select("job", "cost")


@query
def r16_repair_base(spark, sf):
    jobs, e = _repair_jobs(spark, sf, D.edges(spark, sf).select("src", "dst"))
    return routing.repairs(jobs, e, S.BASE_REPAIR_HOPS).select("job", "cost")


@query
def r04_same_cell(spark, sf):
    """From each request's source to the node beside it, where that is in the same cell, never leaving it."""
    e, n = _net(spark, sf), D.nodes(spark, sf)
    at = n.select(F.col("id").alias("src"), F.col("cell").alias("sc"))
    to = n.select(F.col("id").alias("dst"), F.col("cell").alias("dc"))
    req = D.requests(spark, sf).select("request_id", "src", (F.col("src") + 2).alias("dst")).join(at, "src").join(to, "dst").where("sc = dc").select("request_id", "src", "dst")
    return routing.two_level(req, e, n, _shortcuts(spark, sf, e), strict_cell=True).select("request_id", "src", "dst", "cost")


@query
def r06_many_gates(spark, sf):
    """From all gates of the source's cell, at their distance from the source, to all gates of the target's, some overlay edges dearer."""
    e, n = _net(spark, sf), D.nodes(spark, sf)
    g = kept(graph.gates(e), "gates")
    seeds = routing.cell_distances(e, _seeds(spark, sf, False)).join(g.select("node_idx"), "node_idx", "left_semi")
    ends = D.requests(spark, sf).select(F.col("request_id").alias("group"), "dst").join(n.select(F.col("id").alias("dst"), "cell"), "dst")
    goals = ends.join(g.select("cell", "node_idx"), "cell").select("group", "node_idx")
    over = kept(_overlay(spark, sf, e).select("src", "dst", F.col("weight").cast("long").alias("wt"), F.col("overlay_id").alias("edge_id")), "overlay")
    dear = D.requests(spark, sf).select(F.col("request_id").alias("group")).where("group % 3 = 0").join(over.where("edge_id % 10 = 0").select("edge_id"), F.col("edge_id") % 50 == F.col("group") % 5 * 10).select("group", "edge_id", F.lit(S.ALTERNATIVE_PENALTY).alias("factor"))
    return routing.seeded(seeds, goals, over, penalties=dear).select(F.col("group").alias("request_id"), "node_idx", "cost")


@query
def r07_crp_steps(spark, sf):
    """Two-level routes with their shortcuts unpacked, checked edge by edge."""
    e = _net(spark, sf)
    steps = routing.two_level_paths(D.requests(spark, sf), e, D.nodes(spark, sf), _shortcuts(spark, sf, e))
    return _checked_steps(steps, e)


@query
def r07_own_cells(spark, sf):
    """The same on the cells of the inertial-flow partition, with gates and shortcuts of these."""
    n = etl.projected(D.nodes(spark, sf))
    cells = kept(graph.partition(n, D.edges(spark, sf), 120), "cells")
    at = lambda end: cells.select(F.col("id").alias(end), F.col("cell").alias(f"cell_{end}"))
    e = kept(D.edges(spark, sf).drop("cell_src", "cell_dst").join(at("src"), "src").join(at("dst"), "dst"), "net")
    steps = routing.two_level_paths(D.requests(spark, sf), e, cells, graph.shortcuts(e, graph.gates(e)))
    return _checked_steps(steps, e)


@query
def r08_paths(spark, sf):
    """Every step of the cheapest path; of equally cheap ways into a node that from the smaller node, then by the smaller edge."""
    return routing.paths(D.requests(spark, sf), _net(spark, sf)).select("request_id", "step_idx", "node_idx", "edge_id")


@query
def r11_routes(spark, sf):
    """All five routes, step by step."""
    return routing.paths(D.requests(spark, sf), _net(spark, sf), alternatives=S.MAX_ROUTES - 1).select("request_id", "alternative", "step_idx", "node_idx", "edge_id")


# ---- routes --------------------------------------------------------------------


@query
def o01_edge_ids(spark, sf):
    return routes.edge_sequences(D.route_legs(spark, sf)).select("route_id", F.array_join(F.transform("edge_ids", lambda x: x.cast("string")), ",").alias("edge_ids"))


@query
def o02_initial_step(spark, sf):
    return routes.edge_sequences(D.route_legs(spark, sf)).select("route_id", "initial_step", "steps")


@query
def o03_current_edge(spark, sf):
    return routes.current_edge(D.route_legs(spark, sf), F.col("route_id") % 15)


@query
def o04_destination(spark, sf):
    return routes.edge_sequences(D.route_legs(spark, sf)).select("route_id", "destination")


@query
def o05_same_remaining(spark, sf):
    ids = routes.edge_sequences(D.route_legs(spark, sf)).select("route_id", "edge_ids")
    k = (F.col("route_id") % 5).cast("int")
    candidate = F.when(F.col("route_id") % 7 == 0, F.reverse("edge_ids")).otherwise(F.slice("edge_ids", k + 1, F.greatest(F.size("edge_ids"), F.lit(1))))
    return ids.select("route_id", routes.same_remaining(F.col("edge_ids"), candidate).alias("same"))


@query
def o06_patched(spark, sf):
    """Step 3 replaced by two half steps of 60 m and 5 s."""
    steps = D.route_legs(spark, sf)
    third = steps.where("step_idx = 3")
    patch = third.select("route_id", "step_idx", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("part"), "node_idx").select("*", F.lit(60.0).alias("leg_m"), F.lit(5.0).alias("leg_sec"))
    return routes.patched(steps, F.lit(3), patch).select("route_id", "step_idx", "node_idx", F.round("distance_m", 3).alias("distance_m"), F.round("time_sec", 3).alias("time_sec"))


@query
def o07_remaining_steps(spark, sf):
    return D.route_legs(spark, sf).where(F.col("step_idx") >= F.col("route_id") % 6).groupBy("route_id").agg(F.count(F.lit(1)).alias("steps_left"))


@query
def o08_legs(spark, sf):
    return routes.legs(routes.cumulated(D.route_legs(spark, sf))).select("route_id", "step_idx", "from_node", "to_node", F.round("leg_m", 3).alias("leg_m"), F.round("leg_sec", 3).alias("leg_sec"), "speed_kmh")


@query
def o09_congestion(spark, sf):
    e = _net(spark, sf)
    return routes.congestion(D.route_legs(spark, sf, e).select("route_id", "edge_id"), _live(spark, sf, e), "route_id")


def _cursors(spark, sf, e=None):
    at = D.route_legs(spark, sf, e).select("route_id", "step_idx", "lat", "lon")
    return at.where(F.col("step_idx") == F.col("route_id") % 7).select("route_id", F.col("step_idx").alias("cursor"), (F.col("lat") - 0.0004).alias("lat"), (F.col("lon") - 0.0002).alias("lon"))


@query
def o10_eta(spark, sf):
    e = _net(spark, sf)
    return routes.eta(D.route_legs(spark, sf, e).select("route_id", "step_idx", "edge_id", "lat", "lon"), _live(spark, sf, e), _cursors(spark, sf, e)).select("route_id", F.round("eta_sec", 3).alias("eta_sec"))


def _off_route(spark, sf):
    x, y = geo.project(F.col("lat"), F.col("lon"), F.lit(S.REFERENCE_LATITUDE))
    points = _ping_points(spark, sf).select(F.col("event_id").alias("point_id"), "route_id", F.col("step_idx").alias("cursor"), x.alias("x"), y.alias("y"))
    steps = D.route_legs(spark, sf).select("route_id", "step_idx", x.alias("x"), y.alias("y"))
    return routes.off_route(points, steps)


@query
def o11_off_route(spark, sf):
    return _off_route(spark, sf).select("point_id", F.round("off_m", 3).alias("off_m"))


@query
def o12_debug_snapshot(spark, sf):
    p = _positions(spark, sf)
    return p.join(routes.congestion(D.route_legs(spark, sf).select("route_id", "edge_id"), _live(spark, sf), "route_id"), "route_id").select("session_id", "route_id", "step_idx", "congested_edges", "congestion_ahead", "connected")


@query
def o11_swapped(spark, sf):
    """Off-route distance of pings of which every third has its coordinates swapped and its latitude out of range."""
    far = F.col("event_id") % 3 == 0
    # 32 is a latitude, and so is 34; what is swapped is moved by 90 degrees with its route
    shift = lambda c, by: (F.col(c) + F.when(far, by).otherwise(0.0)).alias(c)
    p = _ping_points(spark, sf).select(F.col("event_id"), F.col("event_id").alias("point_id"), "route_id", F.col("step_idx").alias("cursor"), "lat", shift("lon", 90.0))
    p = p.select("point_id", "cursor", F.when(far, F.col("lon")).otherwise(F.col("lat")).alias("lat"), F.when(far, F.col("lat")).otherwise(F.col("lon")).alias("lon"), F.concat_ws("/", F.col("route_id").cast("string"), far.cast("string")).alias("route_id"))
    legs = D.route_legs(spark, sf).select("route_id", "step_idx", "lat", "lon")
    steps = legs.select(F.concat_ws("/", F.col("route_id").cast("string"), F.lit("false")).alias("route_id"), "step_idx", "lat", "lon").unionByName(legs.select(F.concat_ws("/", F.col("route_id").cast("string"), F.lit("true")).alias("route_id"), "step_idx", "lat", (F.col("lon") + 90.0).alias("lon")))
    return routes.off_route_by_degrees(p, steps).select("point_id", F.round("off_m", 3).alias("off_m"))


# ---- traffic -------------------------------------------------------------------


@query
def t01_ewma(spark, sf):
    return traffic.multipliers(D.events(spark, sf).where("event_type IN ('purchase', 'signup', 'error')")).select("edge_id", r6("weight"), "samples")


@query
def t02_speed_sample(spark, sf):
    return traffic.multipliers(D.events(spark, sf).where("event_type IN ('click', 'view')")).select("edge_id", r6("weight"), "samples")


@query
def t03_density(spark, sf):
    return traffic.densities(D.events(spark, sf))


@query
def t05_point_reads(spark, sf):
    return traffic.dense_multipliers(D.edges(spark, sf), _state(spark, sf)).select("edge_id", r6("weight"), "density")


@query
def t06_congested(spark, sf):
    return _state(spark, sf).where(F.col("weight") > S.CONGESTED).select("edge_id")


@query
def t07_recommended_speed(spark, sf):
    return traffic.recommended(D.edges(spark, sf), _state(spark, sf)).select("edge_id", "limit_kmh", "density", r6("recommended_kmh"))


@query
def t08_decay(spark, sf):
    return traffic.replayed(D.events(spark, sf)).select("edge_id", r6("weight"))


@query
def t08_at_rest(spark, sf):
    """Multipliers two ticks after the last event of all, and which edges are still dirty."""
    ev = D.events(spark, sf)
    return traffic.at_rest(ev, ev.agg((F.max("us") + 4_000_000).alias("now_us"))).select("edge_id", r6("weight"), "dirty")


@query
def t01_in_parts(spark, sf):
    return traffic.multipliers_in_parts(D.events(spark, sf).where("event_type IN ('purchase', 'signup', 'error')")).select("edge_id", r6("weight"), "samples")


@query
def t09_cdc_snapshot(spark, sf):
    return _changed(spark, sf).select("edge_id", r6("old_multiplier"), r6("new_multiplier"))


@query
def t11_multipliers(spark, sf):
    return traffic.dense_multipliers(D.edges(spark, sf), _state(spark, sf)).select("edge_id", r6("weight"))


@query
def t13_affected_cells(spark, sf):
    return traffic.affected_cells(D.edges(spark, sf), traffic.multipliers(D.events(spark, sf)))


@query
def t13_customise(spark, sf):
    """Shortcuts of affected cells under live weights in hundredths of a second."""
    e = _net(spark, sf)
    live = _live_net(spark, sf, e)
    cells = traffic.affected_cells(e, traffic.multipliers(D.events(spark, sf, e)))
    return traffic.customised(e, graph.gates(e), live, cells).select("cell", "src", "dst", F.col("weight").cast("long").alias("weight"))


@query
def t14_upsert(spark, sf):
    old = graph.cross_edges(D.edges(spark, sf)).select("src", "dst", F.col("store_idx"), r6("base_weight", "weight"))
    new = old.where("store_idx % 4 = 0").withColumn("weight", F.round(F.col("weight") * 2, 6))
    return traffic.upserted(old, new, "src", "dst", "store_idx")


@query
def t17_improved(spark, sf):
    before, after = _halves(spark, sf, _net(spark, sf))
    return traffic.improved(traffic.changes(after, before)).select("edge_id", r6("old_multiplier"), r6("new_multiplier"))


@query
def t18_speed_updates(spark, sf):
    e = _net(spark, sf)
    advice = traffic.recommended(e, _state(spark, sf, e)).where("limit_kmh > 0")
    return advice.join(_changed(spark, sf, e).select("edge_id"), "edge_id", "left_semi").select("edge_id", r6("recommended_kmh"))


@query
def t16_refill(spark, sf):
    """Pending edges refilled with all dirty ones: those of the second half and all that aren't at rest."""
    ev = D.events(spark, sf)
    pending = with_one(ev, ev.agg((F.max("event_id") / 2).alias("_mid"))).where("event_id > _mid AND ratio > 0").select("edge_id")
    return pending.unionByName(_state(spark, sf).where(F.abs(F.col("weight") - 1) >= S.DECAY_TOLERANCE).select("edge_id")).distinct()


# ---- sessions ------------------------------------------------------------------


def _wanted_sessions(spark, sf):
    k = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select(k.alias("session_id"), k.alias("route_id"), (k % 17 - 2).alias("step"), (k * 1000).alias("us"))


@query
def n01_create(spark, sf):
    return lifecycle.created(_wanted_sessions(spark, sf), _steps(spark, sf)).select("session_id", "step_idx", "revision", "last_ping_us", "last_reroute_us", "edge_id", "subscribed")


@query
def n02_delete(spark, sf):
    """Subscriptions that end when every fourth session is deleted."""
    pos = _positions(spark, sf)
    return lifecycle.deleted(pos, pos.where("session_id % 4 = 0"), _steps(spark, sf))


@query
def n03_presence(spark, sf):
    """Density changes as all new sessions start and every third one is destroyed again."""
    born = lifecycle.created(_wanted_sessions(spark, sf), _steps(spark, sf))
    return lifecycle.presence_deltas(born, born.where("session_id % 3 = 0"))


def _reroute_jobs(legs):
    """From the node that each route's cursor is at to its end."""
    goal = legs.groupBy(F.col("route_id").alias("job")).agg(F.max_by("node_idx", "step_idx").alias("dst"))
    at = legs.where(F.col("step_idx") == F.col("route_id") % 7).select(F.col("route_id").alias("job"), F.col("step_idx").alias("cursor"), F.col("node_idx").alias("src"))
    return at.join(goal, "job")


@query
def n12_candidates(spark, sf):
    """A way round the first severely slow edge ahead - over the overlay where it crosses cells - else the whole route anew."""
    e = _net(spark, sf)
    live, legs = _live_net(spark, sf, e), kept(D.route_legs(spark, sf, e), "legs")
    ahead = legs.where((F.col("step_idx") >= F.col("route_id") % 7) & F.col("edge_id").isNotNull()).select("route_id", "step_idx", "edge_id")
    slow = sessions.repair_triggers(ahead, live).join(live.select("edge_id", "src", "dst", F.col("live_wt").alias("budget")), "edge_id")
    jobs = kept(slow.select(F.col("route_id").alias("job"), "src", "dst", "budget", "is_cross"), "jobs")
    over = graph.overlay_edges(live, graph.shortcuts(live, graph.gates(live), "live_wt"), "live_wt").select("src", "dst", F.col("weight").cast("long").alias("live_wt"), F.col("overlay_id").alias("edge_id"))
    patches = routing.repairs(jobs.where("is_cross"), over, S.OVERLAY_REPAIR_HOPS, "live_wt").unionByName(routing.repairs(jobs.where("NOT is_cross"), live, S.BASE_REPAIR_HOPS, "live_wt"))
    whole = _reroute_jobs(legs).join(jobs.select("job"), "job", "left_semi").withColumnRenamed("job", "request_id")
    full = routing.shortest(whole, live, "live_wt").select(F.col("request_id").alias("job"), "cost")
    return lifecycle.candidates(jobs, patches, full).select(F.col("job").alias("route_id"), "kind", "cost")


def _updates(spark, sf):
    """(sessions, their edges ahead, updates, edges of the new routes): every second session gets the live path from its
    node to its end; every fourth one was decided for a revision that is no longer its own."""
    e = _net(spark, sf)
    live, legs = _live_net(spark, sf, e), kept(D.route_legs(spark, sf, e), "legs")
    jobs = _reroute_jobs(legs)
    now = jobs.select(F.col("job").alias("session_id"), F.col("job").alias("route_id"), F.col("cursor").alias("step_idx"), F.lit(1).cast("long").alias("revision"), F.lit(0).cast("long").alias("last_reroute_us"))
    fresh = kept(routing.paths(jobs.where("job % 2 = 0").withColumnRenamed("job", "request_id"), live, "live_wt"), "fresh")
    eta = fresh.join(live.select("edge_id", "live_wt"), "edge_id").groupBy(F.col("request_id").alias("session_id")).agg((F.sum("live_wt") / 100.0).alias("eta_sec"))
    wish = eta.join(now.select("session_id", "step_idx"), "session_id")
    wish = wish.select("session_id", (-F.col("session_id")).alias("new_route_id"), F.lit(1).cast("long").alias("new_step"), F.col("step_idx").alias("expected_step"), F.when(F.col("session_id") % 4 == 0, 2).otherwise(1).alias("expected_revision"), "eta_sec")
    return now, legs, wish, fresh


@query
def n15_apply(spark, sf):
    now, _, wish, _ = _updates(spark, sf)
    return lifecycle.applied(now, wish, F.lit(7_000_000).cast("long")).select("session_id", "route_id", "step_idx", "revision", "last_reroute_us", "rerouted", F.round("eta_sec", 3).alias("eta_sec"))


@query
def n15_subscriptions(spark, sf):
    """Edges that sessions drop and take up as the updates are applied."""
    now, legs, wish, fresh = _updates(spark, sf)
    steps = legs.select("route_id", F.col("step_idx").alias("s_idx"), "edge_id")
    steps = steps.unionByName(fresh.select((-F.col("request_id")).alias("route_id"), F.col("step_idx").alias("s_idx"), "edge_id"))
    after = lifecycle.applied(now, wish, F.lit(7_000_000).cast("long"))
    return lifecycle.subscription_changes(lifecycle.remaining(now, steps), lifecycle.remaining(after, steps))


@query
def n17_off_route_reroute(spark, sf):
    """Each session's last off-route ping: the node it is nearest to, and the live cost from there to its route's end."""
    e = _net(spark, sf)
    last = kept(_struck(spark, sf).where("off_route").groupBy("session_id").agg(F.max_by(F.struct("route_id", "lat", "lon"), F.struct("us", "event_id")).alias("p")).select("session_id", "p.*"), "off-route")
    at = joins.snap(last.select(F.col("session_id").alias("point_id"), "lat", "lon"), D.nodes(spark, sf)).select(F.col("point_id").alias("request_id"), F.col("node_idx").alias("src"))
    goal = D.route_legs(spark, sf, e).groupBy("route_id").agg(F.max_by("node_idx", "step_idx").alias("dst"))
    jobs = kept(last.select(F.col("session_id").alias("request_id"), "route_id").join(goal, "route_id").join(at, "request_id").select("request_id", "src", "dst"), "jobs")
    return routing.shortest(jobs, _live_net(spark, sf, e), "live_wt").select(F.col("request_id").alias("session_id"), "src", "dst", "cost")


@query
def n19_sweep(spark, sf):
    """Flagged sessions against the live route from where they are."""
    e = _net(spark, sf)
    fresh = routing.shortest(D.requests(spark, sf), _live_net(spark, sf, e), "live_wt").select("request_id", (F.col("cost") / 100.0).alias("new_eta"))
    k = F.col("request_id")
    rows = j08_better_route(spark, sf).select("request_id", F.col("eta_sec").alias("old_eta"), (k % 20).alias("since_sec"), (k % 7 == 0).alias("stale"), (k % 5 == 0).alias("same")).join(fresh, "request_id")
    return lifecycle.swept(rows).select("request_id", "old_eta", "new_eta", "reason")


@query
def n20_propagate(spark, sf):
    """One round: changed edges; improved ones flag sessions; speeds of all of them go to their subscribers."""
    flags = j08_better_route(spark, sf).select(F.lit("flag").alias("kind"), F.col("request_id").alias("session_id"), F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("double").alias("recommended_kmh"))
    told = lifecycle.pushed_speed(t18_speed_updates(spark, sf), _remaining(spark, sf))
    return flags.unionByName(told.select(F.lit("speed").alias("kind"), "session_id", "edge_id", "recommended_kmh"))


@query
def n04_advance(spark, sf):
    return sessions.advanced(D.pings(spark, sf)).select("session_id", "event_id", "step_idx", "prev_step", "moved")


@query
def n05_edge_events(spark, sf):
    """Observations carried by pings: valid ids and times only, folded per edge."""
    e = D.edges(spark, sf)
    ev = D.table(spark, sf, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), (F.col("user_id") * 11 - 40).alias("edge_id"), (F.col("value") / 20 - 1).alias("observed_sec"))
    rows = ev.join(e.select("edge_id", "base_weight"), "edge_id").where("observed_sec > 0 AND base_weight > 0")
    return traffic.multipliers(rows.select("event_id", "us", "edge_id", (F.col("observed_sec") / F.col("base_weight")).alias("ratio"), F.lit(S.EWMA_ALPHA).alias("alpha"))).select("edge_id", r6("weight"), "samples")


@query
def n06_partial_sample(spark, sf):
    return sessions.partial_samples(sessions.advanced(D.pings(spark, sf))).select("session_id", "event_id", F.round("age_sec", 3).alias("age_sec"))


@query
def n07_release(spark, sf):
    d = sessions.edge_deltas(sessions.advanced(D.pings(spark, sf)), _steps(spark, sf))
    return d.groupBy("edge_id").agg(F.count_if(F.col("delta") > 0).alias("entered"), F.count_if(F.col("delta") < 0).alias("released"))


@query
def n08_eta_throttle(spark, sf):
    return sessions.throttled(D.pings(spark, sf), 3600.0)


def _struck(spark, sf):
    off = _off_route(spark, sf).select(F.col("point_id").alias("event_id"), F.round("off_m", 6).alias("off_m"))
    return sessions.strikes(_ping_points(spark, sf).join(off, "event_id"))


@query
def n09_strikes(spark, sf):
    return _struck(spark, sf).select("session_id", "event_id", "strikes", "off_route")


@query
def n10_decision(spark, sf):
    rows = _struck(spark, sf).withColumn("congested", F.col("event_id") % 4 == 0)
    return sessions.decisions(rows)


@query
def n10_live_decision(spark, sf):
    """The same where congestion is what the live weights say of the session's route."""
    e = _net(spark, sf)
    jam = routes.congestion(D.route_legs(spark, sf, e).select("route_id", "edge_id"), _live(spark, sf, e), "route_id")
    rows = _struck(spark, sf).join(jam.select("route_id", "congestion_ahead"), "route_id", "left")
    return sessions.decisions(rows.withColumn("congested", F.coalesce("congestion_ahead", F.lit(False))))


@query
def n11_repair_trigger(spark, sf):
    e = _net(spark, sf)
    live = _live(spark, sf, e)
    return sessions.repair_triggers(D.route_legs(spark, sf, e).where("edge_id IS NOT NULL").select("route_id", "step_idx", "edge_id"), live)


@query
def n13_accept(spark, sf):
    o = D.table(spark, sf, "orders")
    old, new = F.col("o_totalprice") / 1000 - 20, (F.col("o_totalprice") / 1000 - 20) * (0.85 + F.col("o_orderkey") % 30 / 100.0)
    return o.select("o_orderkey", speeds.gain_accepted(old, new, F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 11 == 0).alias("accepted"))


@query
def n14_version_check(spark, sf):
    pos = _positions(spark, sf)
    current = pos.select("session_id", "step_idx", (F.col("session_id") % 3 + 1).alias("revision"))
    decided = sessions.advanced(D.pings(spark, sf)).select("event_id", "session_id", "step_idx", (F.col("event_id") % 3 + 1).alias("revision"))
    return sessions.current_versions(decided, current).select("event_id", "session_id")


@query
def n16_speed_hints(spark, sf):
    advice = traffic.recommended(D.edges(spark, sf), _state(spark, sf))
    return sessions.speed_hints(_remaining(spark, sf).select("session_id", "edge_id"), advice).select("session_id", "edge_id", r6("recommended_kmh"))


@query
def n18_better_flag(spark, sf):
    return j08_better_route(spark, sf).agg(F.count(F.lit(1)).alias("flagged"))


@query
def n21_expiry(spark, sf):
    p = D.pings(spark, sf)
    return sessions.expired(p, p.agg(F.max("us").alias("now_us")), 6 * 3600)


@query
def n22_subscribers(spark, sf):
    return sessions.subscribers(_positions(spark, sf).select("session_id", "route_id", "step_idx"), _steps(spark, sf))


@query
def n23_unsubscribed(spark, sf):
    """Edges that each session no longer follows: those before its step."""
    rows = _positions(spark, sf).join(_steps(spark, sf), "route_id").where("s_idx < step_idx AND edge_id IS NOT NULL")
    return rows.select("session_id", "edge_id")


# ---- simulation ----------------------------------------------------------------


def _sim_legs(spark, sf):
    e = _net(spark, sf)
    advice = traffic.recommended(e, _state(spark, sf, e))
    return simulation.leg_speeds(_route_legs_m(spark, sf), advice)


def _sim_cars(spark, sf):
    pace = S.PACE_LOW + S.PACE_SPAN * (F.col("s_suppkey") % 10) / 10.0
    return D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("car_id"), F.col("s_suppkey").alias("route_id"), (F.col("s_suppkey") % 3).alias("start_step"), pace.alias("pace"))


@query
def v02_car_advance(spark, sf):
    rows = simulation.advanced(_sim_cars(spark, sf), _sim_legs(spark, sf), F.lit(45.0))
    return rows.select("car_id", "leg_idx", F.round("progress_m", 3).alias("progress_m"), "legs_done", "finished")


@query
def v03_car_speed(spark, sf):
    cars = _sim_cars(spark, sf).join(_sim_legs(spark, sf), "route_id")
    return cars.select("car_id", "leg_idx", r6(speeds.car_kmh(F.col("base_kmh"), F.col("pace")), "kmh"))


@query
def v05_spawn_start(spark, sf):
    cars = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("car_id"), F.col("s_suppkey").alias("route_id")).withColumn("u", simulation.hash_unit(F.col("car_id")))
    return simulation.spawn_starts(cars, _route_legs_m(spark, sf))


@query
def v06_random_od(spark, sf):
    ids = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("car_id"))
    box = D.nodes(spark, sf).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return simulation.random_pairs(ids, box).select("car_id", "attempt", *[r6(c) for c in ("src_lat", "src_lon", "dst_lat", "dst_lon")])


@query
def v08_snapshot(spark, sf):
    legs, cars = _sim_legs(spark, sf), _sim_cars(spark, sf)
    moved = simulation.advanced(cars, legs, F.lit(45.0)).join(cars.select("car_id", "route_id"), "car_id")
    return simulation.positions(moved, legs).select("car_id", r6("lat"), r6("lon"))


@query
def v09_driver_profile(spark, sf):
    seed = F.col("s_suppkey") / 100.0
    return D.table(spark, sf, "supplier").select("s_suppkey", *[r6(speeds.profile_value(seed, n), n) for n in S.PROFILE_SEEDS])


@query
def v10_target_speed(spark, sf):
    return _sim_cars(spark, sf).join(_sim_legs(spark, sf), "route_id").select("car_id", "leg_idx", r6(speeds.target_kmh(F.col("base_kmh"), F.col("pace")), "target_kmh"))


@query
def v11_accel(spark, sf):
    """Speed after each leg's half second, from rest: a fold over the route's targets."""
    legs = _sim_legs(spark, sf).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("leg_idx", "base_kmh"))).alias("s"))
    step = lambda v, x: speeds.next_kmh(v, speeds.target_kmh(x["base_kmh"], F.lit(1.1)), F.lit(500.0), F.lit(2.0), F.lit(3.0))
    return legs.select("route_id", r6(F.aggregate("s", F.lit(0.0), step), "kmh"))


@query
def v12_intersection_delay(spark, sf):
    walk = W.partitionBy("route_id").orderBy("leg_idx")
    rows = routes.turns(_legs_xy(spark, sf)).withColumn("next_kmh", F.coalesce(F.lead("speed_kmh").over(walk), F.col("speed_kmh"), F.lit(50.0))).withColumn("next_m", F.lead("leg_m").over(walk))
    delay = speeds.intersection_delay_ms(F.round("angle", 6), F.col("next_kmh"), F.col("leg_m"), F.col("next_m"), F.lit(1.1))
    return rows.select("route_id", "leg_idx", delay.alias("delay_ms"))


@query
def v14_following(spark, sf):
    me = _sim_cars(spark, sf).select(F.col("car_id").alias("point_id"), "route_id", (F.col("car_id") % 10 * 20.0).alias("progress_m"), (F.col("car_id") % 60 * 1.0).alias("speed_kmh"), F.lit(25.0).alias("want_m"))
    others = _sim_cars(spark, sf).select("route_id", F.explode(F.array(F.lit(30.0), F.lit(90.0), F.lit(150.0))).alias("other_progress_m")).withColumn("offset_m", F.col("route_id") % 25 * 1.0)
    return simulation.following(me, others).select("point_id", r6("allowed_m"))


@query
def v15_traffic_level(spark, sf):
    advice = traffic.recommended(D.edges(spark, sf), _state(spark, sf))
    return simulation.traffic_level(_route_legs_m(spark, sf), advice.withColumn("recommended_kmh", F.round("recommended_kmh", 6)))


@query
def v16_ping_throttle(spark, sf):
    """One ping per session and hour: the first."""
    p = D.pings(spark, sf)
    return p.groupBy("session_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.min(F.struct("us", "event_id")).alias("f")).select("session_id", "hour", F.col("f.event_id").alias("event_id"))


@query
def v17_gain_text(spark, sf):
    old, new = F.col("o_totalprice") / 1000, (F.col("o_orderkey") % 400) * 1.0
    return D.table(spark, sf, "orders").select("o_orderkey", tags.gain_text(F.when(F.col("o_orderkey") % 9 != 0, old), new, tags.UPDATED_TEXT).alias("text"))


@query
def v18_trip_inset(spark, sf):
    box = D.nodes(spark, sf).agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    f = 0.08
    return box.select(r6(F.col("a") + (F.col("b") - F.col("a")) * f, "min_lat"), r6(F.col("b") - (F.col("b") - F.col("a")) * f, "max_lat"), r6(F.col("c") + (F.col("d") - F.col("c")) * f, "min_lon"), r6(F.col("d") - (F.col("d") - F.col("c")) * f, "max_lon"))


@query
def v01_ticks(spark, sf):
    """Ticks run per clock (a user) that wakes up at odd times."""
    ev = D.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 1700).alias("pause_ms"))
    return simulation.ticks(ev)


@query
def v04_samples(spark, sf):
    """Speed samples on the legs that cars without a session pass in their first 45 seconds."""
    legs = _sim_cars(spark, sf).join(_sim_legs(spark, sf), "route_id").where("leg_idx >= start_step")
    kmh = speeds.car_kmh(F.col("base_kmh"), F.col("pace"))
    length = F.when(F.col("leg_m") > 0, F.col("leg_m")).otherwise(S.MIN_LEG_M)
    return simulation.sampled(legs.select("car_id", "leg_idx", "edge_id", kmh.alias("kmh"), F.round(length / (kmh / S.KMH_PER_MPS), 6).alias("sec"))).select("car_id", "leg_idx", "edge_id", r6("kmh"), "samples")


@query
def v07_adopt(spark, sf):
    k = F.col("s_suppkey")
    s = D.table(spark, sf, "supplier")
    cars = s.select(k.alias("car_id"), (k - 1).alias("session_id"), (k % 3).alias("revision"), (k % 9).alias("step_idx"), (k * 1.5).alias("progress_m"))
    return simulation.adopted(cars, s.select(k.alias("session_id"), (k % 4).alias("revision"), (k % 5).alias("step_idx"), (32 + k * 0.001).alias("lat"), (34 + k * 0.002).alias("lon"))).select("car_id", "revision", "step_idx", "progress_m", r6("lat"), r6("lon"), "adopted")


def _client_cars(spark, sf):
    k = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select(k.alias("car_id"), k.alias("route_id"), (k % 4).alias("leg_idx"), (k % 9 * 5.0).alias("progress_m"), (k % 6 * 700.0 + 2500).alias("edge_ms"), (k % 13 * 35.0).alias("move_m"), F.lit(2500.0).alias("elapsed_ms"))


@query
def v13_client_advance(spark, sf):
    cars, _ = simulation.client_advanced(_client_cars(spark, sf), _route_legs_m(spark, sf))
    return cars.select("car_id", "legs_done", "leg_idx", F.round("progress_m", 3).alias("progress_m"), r6("lat"), r6("lon"))


@query
def v13_edge_events(spark, sf):
    _, events = simulation.client_advanced(_client_cars(spark, sf), _route_legs_m(spark, sf))
    return events.select("car_id", "leg_idx", "edge_id", r6("observed_sec"))


@query
def s13_outbox(spark, sf):
    """Messages to sessions by the hour: the first ones fit the buffer."""
    p = D.pings(spark, sf).select("session_id", F.col("event_id").alias("seq"))
    return lifecycle.outbox(p, 4).groupBy("session_id").agg(F.count_if(~F.col("dropped")).alias("sent"), F.count_if("dropped").alias("lost"))


@query
def s14_latest(spark, sf):
    """The newest ping of each session, as a feed with room for one snapshot."""
    return lifecycle.latest(D.pings(spark, sf).select("session_id", "event_id", "route_id", "reported"), "session_id", "event_id")


@query
def p18_mode_error(spark, sf):
    k = F.col("s_suppkey") % 5
    text = F.when(k == 0, "").when(k == 1, " Hierarchical ").when(k == 2, "BASE-ASTAR").when(k == 3, "base-dijkstra").otherwise(" fastest ")
    return D.table(spark, sf, "supplier").select("s_suppkey", tags.routing_mode_error(text).alias("error"))


@query
def p19_default_viewbox(spark, sf):
    box = etl.bbox(D.nodes(spark, sf)).select("viewbox")
    asked = F.when(F.col("s_suppkey") % 3 == 0, " 1,2,3,4 ").when(F.col("s_suppkey") % 3 == 1, "  ")
    return with_one(D.table(spark, sf, "supplier"), box).select("s_suppkey", tags.default_viewbox(asked, F.col("viewbox")).alias("viewbox"))


@query
def j12_nearby_or_all(spark, sf):
    """Points of which some have no coordinates: those get all cars."""
    points = D.requests(spark, sf).select(F.col("request_id").alias("point_id"), F.when(F.col("request_id") % 10 != 0, F.col("src_lat")).otherwise(F.lit(float("nan"))).alias("lat"), F.col("src_lon").alias("lon"))
    return joins.count_nearby_or_all(points, _cars(spark, sf), F.lit(32.02))


# ---- reports -------------------------------------------------------------------


@query
def a06_percentiles(spark, sf):
    return reports.percentile_rows(D.table(spark, sf, "events"), "value", "event_type")


@query
def a07_speedup_report(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_custkey") % 4 + 1).alias("workers"), "o_totalprice")
    return reports.speedups(rows, "o_orderpriority", "workers", "o_totalprice").select("o_orderpriority", "workers", "runs", F.round("mean_value", 3).alias("mean_value"), "speedup")


@query
def s17_bench_metrics(spark, sf):
    """Every metric of benchmark lines, some of which are short or hold what is no number."""
    o = D.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    number = F.when(k % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    line = F.when(k % 5 == 0, F.format_string("BenchmarkRoute/%d-8 %d", k, k)).when(k % 5 == 1, F.lit("ok done 1 s")).otherwise(F.format_string("  BenchmarkRoute/%d-8 \t %d  %s ns/op %d.5 visited_nodes/op", k, k % 100, number, k))
    return reports.bench_metrics(o.select(line.alias("value")))


@query
def u03_od_corpus(spark, sf):
    """Pairs far enough apart that have a route."""
    corpus = reports.od_corpus(D.requests(spark, sf), 50, 500.0, 5000.0)
    return corpus.join(routing.shortest(corpus, D.edges(spark, sf)).select("request_id"), "request_id", "left_semi").select("request_id", "src", "dst", F.round("distance_m", 3).alias("distance_m"))


# ---- streaming twins -----------------------------------------------------------


@query
def stream_t01(spark, sf):
    return replay.multipliers(spark, D.events(spark, sf)).select("edge_id", r6("weight"))


@query
def stream_t03(spark, sf):
    return replay.densities(spark, D.events(spark, sf))


@query
def stream_t09(spark, sf):
    """Changes that each of four micro-batches reports: a baseline moves only when its edge is reported."""
    return replay.changes(spark, D.events(spark, sf)).select("batch", "edge_id", r6("old_multiplier"), r6("new_multiplier"))


@query
def stream_t10(spark, sf):
    """How often each edge is handed over as pending, once per micro-batch that observes it."""
    return replay.pending(spark, D.events(spark, sf)).groupBy("edge_id").agg(F.count(F.lit(1)).alias("handed_over"))


@query
def stream_s12(spark, sf):
    """Pings parsed as they arrive: what is malformed or no ping goes."""
    ev = D.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "noise").otherwise("ping")
    text = F.when(F.col("event_id") % 17 == 0, F.lit("not json")).otherwise(F.format_string('{"type":"%s","step_index":%d,"speed_kmh":%d.5}', kind, F.col("event_id"), F.col("user_id")))
    return replay.pings(spark, ev.select("event_id", text.alias("value"))).select(F.col("step_index").cast("long").alias("step_index"), "speed_kmh")


@query
def stream_n04(spark, sf):
    return replay.last_steps(spark, D.pings(spark, sf))


@query
def stream_n09(spark, sf):
    return replay.strikes(spark, _struck_input(spark, sf))


def _struck_input(spark, sf):
    off = _off_route(spark, sf).select(F.col("point_id").alias("event_id"), F.round("off_m", 6).alias("off_m"))
    return _ping_points(spark, sf).select("session_id", "us", "event_id").join(off, "event_id")
