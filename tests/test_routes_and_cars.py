"""Two-level paths, tiles, several gates, and the clients' advance against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import graph, joins, lifecycle, routes, routing, simulation
from tarmac.plans.kernels import INF, Csr, TwoLevel, dijkstra, walk_back
from tests.test_network import floyd, random_net


def two_level(seed, n=30, cells=4):
    edges = random_net(seed, n)
    cell = {k: k % cells for k in range(n)}
    crossing = {x for a, b, *_ in edges if cell[a] != cell[b] for x in (a, b)}
    inner = floyd([e for e in edges if cell[e[0]] == cell[e[1]]], n)
    shortcuts = [(a, b, inner[a][b]) for a in crossing for b in crossing if a != b and cell[a] == cell[b] and inner[a][b] < INF]
    return edges, inner, TwoLevel(cell, edges, shortcuts)


@pytest.mark.parametrize("seed", [3, 17, 41])
def test_two_level_paths_are_whole(seed):
    n = 30
    edges, inner, net = two_level(seed, n)
    d = floyd(edges, n)
    for s, t in itertools.permutations(range(n), 2):
        cost, steps, _, _ = net.route(s, t)
        assert cost == (d[s][t] if d[s][t] < INF else None)
        if cost is not None:
            assert [edges[e][0] for _, e in steps] == [s] + [v for v, _ in steps[:-1]] and all(edges[e][1] == v for v, e in steps)
            assert steps[-1][0] == t and sum(edges[e][2] for _, e in steps) == cost
        if s % 4 == t % 4:
            strict = net.route(s, t, strict_cell=True)
            assert strict[0] == (inner[s][t] if inner[s][t] < INF else None) and all(v % 4 == s % 4 for v, _ in strict[1])


def test_penalties_turn_a_route_aside():
    edges, _, net = two_level(5)
    turned = 0
    for s, t in itertools.permutations(range(30), 2):
        cost, steps, hops, _ = net.route(s, t)
        if cost is None:
            continue
        used = {e for _, e in steps}
        other = net.route(s, t, False, used, set(hops), 5)
        own = sum(edges[e][2] for _, e in other[1])
        assert own >= cost and other[1][-1][0] == t
        turned += {e for _, e in other[1]} != used
    assert turned > 100


def test_equal_ways_go_by_the_smaller_node_and_edge():
    for order in itertools.permutations([(0, 2, 1, 3), (0, 1, 1, 4), (2, 3, 1, 1), (1, 3, 1, 2), (1, 3, 1, 0)]):
        g = Csr.build(*zip(*order))
        _, prev, _ = dijkstra(g, {g.index[0]: 0}, {g.index[3]})
        assert walk_back(prev, g.index[3])[1] == [(g.index[1], 4), (g.index[3], 0)]


def test_tiles_before_flows(spark):
    ids = [(k, float(k % 40), float(k // 40)) for k in range(800)]
    nodes = spark.createDataFrame(ids, "id long, x double, y double")
    edges = spark.createDataFrame([(a, b) for a in range(800) for b in (a + 1, a + 40) if b < 800 and (b != a + 1 or a % 40 < 39)], "src long, dst long")
    cells = graph.partition(nodes, edges, 60, flow_nodes=200).collect()
    sizes = {}
    for r in cells:
        sizes[r.cell] = sizes.get(r.cell, 0) + 1
    assert sorted(r.id for r in cells) == list(range(800)) and max(sizes.values()) <= 60 and all(min(r.id for r in cells if r.cell == c) == c for c in sizes)


def test_seeded_search_is_brute_force(spark):
    edges = random_net(8)
    frame = spark.createDataFrame(edges, "src long, dst long, wt long, edge_id long")
    rng = random.Random(2)
    seeds = [(k, rng.randrange(30), rng.randrange(40)) for k in range(6) for _ in range(3)]
    goals = [(k, rng.randrange(30)) for k in range(6) for _ in range(4)]
    dear = [(k, e, 5.0) for k in range(0, 6, 2) for *_, e in edges[::3]]
    got = {(r.group, r.node_idx): r.cost for r in routing.seeded(spark.createDataFrame(seeds, "group long, node_idx long, cost long"), spark.createDataFrame(goals, "group long, node_idx long"), frame, penalties=spark.createDataFrame(dear, "group long, edge_id long, factor double")).collect()}
    want = {}
    for k in range(6):
        own = {e for g, e, _ in dear if g == k}
        d = floyd([(a, b, w * (5 if e in own else 1), e) for a, b, w, e in edges], 30)
        for g, t in goals:
            cost = min(c + d[s][t] for q, s, c in seeds if q == k)
            if g == k and cost < INF:
                want[k, t] = cost
    assert got == want


def client(legs, leg, progress, held, move, elapsed):
    """One advance, leg by leg."""
    events, left, time, done = [], move, elapsed, 0
    while left > 0 and leg < len(legs):
        length = legs[leg][0] or 0.1
        rest = length - progress
        if rest <= left:
            spill = time * ((left - rest) / left)
            if legs[leg][1] is not None and held - spill > 0:
                events.append((leg, legs[leg][1], (held - spill) / 1000))
            left, time, held, leg, progress, done = left - rest, spill, spill, leg + 1, 0.0, done + 1
        else:
            progress, left = progress + left, 0
    return (leg if leg < len(legs) else None), progress, done, events


def test_client_advance_is_the_loop(spark):
    rng = random.Random(6)
    roads = {r: [(rng.choice([0.0, 3.0, 20.0, 55.5, 90.0]), rng.choice([None, 100 * r + k])) for k in range(8)] for r in range(5)}
    legs = [(r, k, m, e, 32.0 + k, 34.0, 33.0 + k, 34.0) for r, own in roads.items() for k, (m, e) in enumerate(own)]
    cars = [(c, c % 5, rng.randrange(8), 0.0, rng.choice([0.0, 900.0, 4000.0]), rng.choice([0.0, 5.0, 60.0, 120.0, 900.0]), 2500.0) for c in range(120)]
    cars = [(c, r, k, min(p, roads[r][k][0] / 2) if roads[r][k][0] else 0.0, h, m, e) for c, r, k, p, h, m, e in cars]
    frame = spark.createDataFrame(cars, "car_id long, route_id long, leg_idx long, progress_m double, edge_ms double, move_m double, elapsed_ms double")
    out, events = simulation.client_advanced(frame, spark.createDataFrame(legs, "route_id long, leg_idx long, leg_m double, edge_id long, lat1 double, lon1 double, lat2 double, lon2 double"))
    got = {r.car_id: r for r in out.collect()}
    seen = {}
    for r in events.collect():
        seen.setdefault(r.car_id, []).append((r.leg_idx, r.edge_id, r.observed_sec))
    for c, r, k, p, h, m, e in cars:
        leg, progress, done, said = client(roads[r], k, p, h, m, e)
        assert (got[c].leg_idx, got[c].legs_done) == (leg, done)
        assert leg is None or abs(got[c].progress_m - progress) < 1e-6
        assert [(a, b) for a, b, _ in sorted(seen.get(c, []))] == [(a, b) for a, b, _ in said]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(sorted(seen.get(c, [])), said))


def test_catch_up_is_cut(spark):
    pauses = [100, 100, 100, 2000, 0, 0, 250, 1300]
    rows = spark.createDataFrame([("k", i, p) for i, p in enumerate(pauses)], "key string, seq long, pause_ms long")
    held = steps = overloads = 0
    for p in pauses:
        held += p
        run = min(4, held // 250)
        held, steps = held - run * 250, steps + run
        if held >= 250:
            held, overloads = 250, overloads + 1
    got = simulation.ticks(rows).first()
    assert (got.steps, got.overloads) == (steps, overloads) and overloads > 0


def test_points_without_coordinates_see_all_cars(spark):
    cars = spark.createDataFrame([(1, 32.0, 34.0), (2, 40.0, 40.0)], "car_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 32.0, 34.0), (2, float("nan"), 34.0), (3, None, 1.0), (4, float("inf"), 1.0), (5, 10.0, 10.0)], "point_id long, lat double, lon double")
    got = {}
    for r in joins.nearby_or_all(points, cars, F.lit(32.0)).collect():
        got.setdefault(r.point_id, set()).add(r.car_id)
    assert got == {1: {1}, 2: {1, 2}, 3: {1, 2}, 4: {1, 2}}


def test_swapped_coordinates(spark):
    steps = spark.createDataFrame([(1, 0, 10.0, 120.0), (1, 1, 10.0, 120.01)], "route_id long, step_idx long, lat double, lon double")
    points = spark.createDataFrame([(1, 1, 1, 10.0, 120.005), (2, 1, 1, 120.005, 10.0), (3, 1, 1, 10.001, 120.005)], "point_id long, route_id long, cursor long, lat double, lon double")
    got = {r.point_id: r.off_m for r in routes.off_route_by_degrees(points, steps).collect()}
    assert got[1] < 0.01 and got[2] < 0.01 and 100 < got[3] < 120


def test_stale_updates_are_not_applied(spark):
    now = spark.createDataFrame([(1, 1, 3, 1, 0), (2, 2, 3, 2, 0), (3, 3, 3, 1, 0)], "session_id long, route_id long, step_idx long, revision long, last_reroute_us long")
    wish = spark.createDataFrame([(1, 9, 1, 3, 1, 5.0), (2, 9, 1, 3, 1, 5.0)], "session_id long, new_route_id long, new_step long, expected_step long, expected_revision long, eta_sec double")
    got = {r.session_id: (r.route_id, r.step_idx, r.revision, r.last_reroute_us, r.rerouted) for r in lifecycle.applied(now, wish, F.lit(7)).collect()}
    assert got == {1: (9, 1, 2, 7, True), 2: (2, 3, 2, 0, False), 3: (3, 3, 1, 0, False)}


def test_outbox_drops_what_does_not_fit(spark):
    rows = lifecycle.outbox(spark.createDataFrame([(1, k) for k in range(300)] + [(2, 1)], "session_id long, seq long"))
    assert {r.session_id: (r.kept, r.lost) for r in rows.groupBy("session_id").agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("lost")).collect()} == {1: (256, 44), 2: (1, 0)}
