"""Steps that must not hold the whole graph, or all pairs, in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.operators import graph, joins, nested, routing
from tarmac.plans.kernels import Csr, dijkstra

REQUESTS, EDGES = "request_id long, src long, dst long", "src long, dst long, wt long, edge_id long"


def net(seed, n=120, columns=6):
    """A grid with one-way and missing edges, a few far ones, and parallel ones."""
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in (a + 1, a + columns) if b < n and (b != a + 1 or b % columns)]
    rows = [(s, d, rng.randrange(1, 9)) for a, b in pairs for s, d in ((a, b), (b, a)) if rng.random() < 0.85]
    rows += [(rng.randrange(n), rng.randrange(n), rng.randrange(5, 40)) for _ in range(6)] + rows[:5]
    return [(s, d, w, k) for k, (s, d, w) in enumerate(rows)]


def true_costs(rows, pairs):
    g, out = Csr.build(*zip(*rows)), {}
    for k, s, t in pairs:
        if s != t and s in g.index and t in g.index:
            done, _, _ = dijkstra(g, {g.index[s]: 0}, {g.index[t]})
            if g.index[t] in done:
                out[k] = done[g.index[t]]
    return out


@pytest.fixture
def small(monkeypatch):
    """Ranges of few nodes, and no search that holds the graph."""
    monkeypatch.setattr(nested, "TIER", 2)
    monkeypatch.setattr(nested, "CHUNK", 20)
    monkeypatch.setattr(routing, "SEARCHED_EDGES", 0)
    monkeypatch.setattr(routing, "shipped", lambda *_: pytest.fail("the graph was shipped"))
    monkeypatch.setattr(routing, "relaxed", lambda *_: pytest.fail("labels were relaxed"))


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_costs_by_ranges(spark, small, width):
    rows = net(width)
    rng = random.Random(0)
    pairs = [(k, rng.randrange(125), rng.randrange(125)) for k in range(150)] + [(500, 3, 3), (501, 3, 90), (502, 3, 90)]
    edges, asked = spark.createDataFrame(rows, EDGES), spark.createDataFrame(pairs, REQUESTS)
    assert {r.request_id: r.cost for r in routing.shortest(asked, edges, width=width).collect()} == true_costs(rows, pairs)


def test_other_modes_by_ranges(spark, small):
    rows = net(5)
    pairs = [(k, k * 7 % 120, k * 31 % 120) for k in range(60)]
    edges, asked = spark.createDataFrame(rows, EDGES), spark.createDataFrame(pairs, REQUESTS)
    nodes = spark.range(120).withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0)).withColumn("cell", F.expr("id div 30"))
    celled = edges.withColumn("cell_src", F.expr("src div 30")).withColumn("cell_dst", F.expr("dst div 30"))
    want = true_costs(rows, pairs)
    assert {r.request_id: r.cost for r in routing.goal_directed(asked, edges, nodes).collect()} == want
    assert {r.request_id: r.cost for r in routing.two_level(asked, celled, nodes, None).collect()} == want
    inner = true_costs([r for r in rows if r[0] // 30 == r[1] // 30], [p for p in pairs if p[1] // 30 == p[2] // 30])
    strict = {r.request_id: r.cost for r in routing.two_level(asked, celled, nodes, None, strict_cell=True).collect()}
    assert strict == {k: c for k, c in want.items() if pairs[k][1] // 30 != pairs[k][2] // 30} | inner


def test_wild_numbering_is_relaxed(spark, monkeypatch):
    rows, pairs = net(7), [(k, k * 7 % 120, k * 31 % 120) for k in range(40)]
    monkeypatch.setattr(nested, "MOST_GATES", 2)
    monkeypatch.setattr(routing, "SEARCHED_EDGES", 0)
    edges, asked = spark.createDataFrame(rows, EDGES), spark.createDataFrame(pairs, REQUESTS)
    assert {r.request_id: r.cost for r in routing.shortest(asked, edges).collect()} == true_costs(rows, pairs)


def test_all_cars_are_counted_once(spark):
    points = spark.createDataFrame([(1, 32.0, 34.0), (2, float("nan"), 34.0), (3, 32.0, None), (4, 50.0, 34.0)], "point_id long, lat double, lon double")
    cars = spark.createDataFrame([(k, 32.0 + k * 0.0005, 34.0) for k in range(5, 30)], "car_id long, lat double, lon double")
    got = joins.count_nearby_or_all(points, cars, F.lit(32.0))
    pairs = joins.nearby_or_all(points, cars, F.lit(32.0)).groupBy("point_id").agg(F.count("*"), F.min("car_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.where("cars = 25").count() == 2
    assert joins.count_nearby_or_all(points, cars.where("car_id < 0"), F.lit(32.0)).count() == 0


def test_better_routes_without_all_pairs(spark):
    rng = random.Random(3)
    at = lambda: (32 + rng.random() * 0.5, 34 + rng.random() * 0.3)
    rows = [(k, *at(), *at(), rng.random() * 3000 - 50) for k in range(300)] + [(900, float("nan"), 34.0, 32.0, 34.0, 10.0), (901, 32.0, None, 32.0, 34.0, 10.0), (902, *at(), *at(), float("inf"))]
    sessions = spark.createDataFrame(rows, "request_id long, lat double, lon double, goal_lat double, goal_lon double, eta_sec double")
    found = spark.createDataFrame([(*at(), *at(), rng.random() * 900) for _ in range(40)], "src_lat double, src_lon double, dst_lat double, dst_lon double, live_weight double")
    col, per = F.col, 3.6 / 120.0
    bound = geo.heuristic_m(col("lat"), col("lon"), col("src_lat"), col("src_lon")) * per + col("live_weight") + geo.heuristic_m(col("dst_lat"), col("dst_lon"), col("goal_lat"), col("goal_lon")) * per
    want = {r.request_id for r in sessions.crossJoin(found).where(bound < col("eta_sec")).select("request_id").distinct().collect()}
    got = joins.better_routes(sessions, found)
    assert sorted(r.request_id for r in got.collect()) == sorted(want) and 30 < len(want) < 290 and 902 in want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and joins.better_routes(sessions, found.where("false")).count() == 0


@pytest.mark.parametrize("columns", [2, 400])
def test_snap_on_a_long_strip(spark, monkeypatch, columns):
    """Buckets are square on a strip too, so no point meets more than a few nodes."""
    from tarmac.sources import shared

    met = []

    def kept(df, tag="step"):
        if tag == "nearest":
            met.append(df)
        return shared.kept(df, tag)

    monkeypatch.setattr(joins, "kept", kept)
    nodes = spark.range(4000).select("id", (32 + F.expr(f"id div {columns}") * 0.001).alias("lat"), (34 + F.expr(f"id % {columns}") * 0.001).alias("lon"))
    rng = random.Random(columns)
    lat, lon = 4000 // columns * 0.001, columns * 0.001
    points = [(k, 32 + rng.random() * lat, 34 + rng.random() * lon) for k in range(200)]
    points = spark.createDataFrame(points, "point_id long, lat double, lon double")
    at = lambda la, lo: geo.project(F.col(la), F.col(lo), F.lit(32 + (4000 // columns - 1) * 0.0005))
    both = points.crossJoin(nodes.select(F.col("id").alias("node"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")))
    (px, py), (nx, ny) = at("lat", "lon"), at("nlat", "nlon")
    far = (px - nx) * (px - nx) + (py - ny) * (py - ny)
    want = both.groupBy("point_id").agg(F.min(F.struct(far.alias("d"), "node")).alias("b")).select("point_id", "b.node")
    assert {r.point_id: r.node_idx for r in joins.snap(points, nodes).collect()} == {r.point_id: r.node for r in want.collect()}
    assert len(met) <= 2


def test_stream_batches_of_several_files(spark, monkeypatch):
    """A micro-batch isn't gathered in one task, and the batches are those of event ids all the same."""
    from tarmac.streaming import replay

    read = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("edge_id"), F.lit(2.0).alias("ratio"))
    made = F.udf(lambda x: (read.add(1), x)[1], "long").asNondeterministic()
    got = replay.pending(spark, rows.withColumn("edge_id", made("edge_id")))
    assert read.value == 400  # not made again for each batch
    assert got.groupBy("edge_id").count().where("count = 4").count() == 7
    folder = replay.shared_folder(spark, "stream")
    seen = []
    for k in replay.in_batches(rows.repartition(3), folder):
        seen.append(len(spark.read.parquet(folder).inputFiles()))
        assert spark.read.parquet(folder).count() == 100 * (k + 1)
    assert seen[0] > 1


def test_json_graph_in_documents(spark, tmp_path):
    from tarmac.sources import graphs

    parts = spark.range(3).select(F.col("id").alias("k"), F.expr("array(named_struct('id', id, 'lat', 32D, 'lon', 34D))").alias("nodes"), F.expr("if(id = 2, null, array(named_struct('id', id, 'node_refs', array(id, id + 1), 'road_class', 6, 'is_one_way', false, 'max_speed', 50D)))").alias("ways"))
    graphs.write_graph_json(parts, f"{tmp_path}/g")
    nodes, ways = graphs.read_graph_json(spark, f"{tmp_path}/g")
    assert sorted(r.id for r in nodes.collect()) == [0, 1, 2] and sorted(r.way_id for r in ways.collect()) == [0, 1]
    assert len(list((tmp_path / "g").glob("k=*"))) == 3


def test_shortcuts_of_a_cell_at_once(spark, monkeypatch):
    """All pairs of a small cell at once and one search per gate of a large one agree."""
    rows = [(s, d, w, k, s // 30, d // 30) for s, d, w, k in net(11)]
    edges = spark.createDataFrame(rows, EDGES + ", cell_src long, cell_dst long")
    got = lambda: sorted(map(tuple, graph.shortcuts(edges, graph.gates(edges)).collect()))
    monkeypatch.setattr(graph, "dijkstra", lambda *_: pytest.fail("a search per gate"))
    at_once = got()
    monkeypatch.setattr(graph, "dijkstra", dijkstra)
    monkeypatch.setattr(graph, "CLOSED_NODES", 0)
    assert at_once == got() and len(at_once) > 100


def test_paths_and_repairs_in_regions(spark, monkeypatch):
    """Near routes and repairs don't ship the graph, and those that leave their region are found all the same."""
    rows = net(13, n=240)
    edges = spark.createDataFrame(rows, EDGES)
    near = spark.createDataFrame([(k, k * 7 % 240, min(239, k * 7 % 240 + k % 15)) for k in range(60)], REQUESTS)
    asked = near.unionByName(spark.createDataFrame([(100 + k, k * 11 % 240, k * 53 % 240) for k in range(30)], REQUESTS))
    jobs = edges.select(F.col("edge_id").alias("job"), "src", "dst", F.lit(30).cast("long").alias("budget"))
    plain = lambda df: sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())
    want, round_ = plain(routing.paths(asked, edges, alternatives=2)), plain(routing.repairs(jobs, edges, 6))
    ship, sent = routing.shipped, []
    monkeypatch.setattr(routing, "SEARCHED_EDGES", 0)
    monkeypatch.setattr(routing, "REGION", 20)
    monkeypatch.setattr(routing, "WIDER", 2)
    monkeypatch.setattr(routing, "shipped", lambda *a: (sent.append(1), ship(*a))[1])
    assert plain(routing.paths(asked, edges, alternatives=2)) == want and sent and len(round_) > 100
    assert plain(routing.repairs(jobs, edges, 6)) == round_
    monkeypatch.setattr(routing, "REGION", 60)
    monkeypatch.setattr(routing, "shipped", lambda *_: pytest.fail("the graph was shipped"))
    few = near.where("src BETWEEN 100 AND 140 AND dst < src + 4")
    assert few.count() > 3 and plain(routing.paths(few, edges)) == [r for r in want if r[1] == 0 and r[0] in {x.request_id for x in few.collect()}]
