"""Graph building and routing on four small maps, and kernels against brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import etl, graph, joins, routing
from tarmac.plans.kernels import INF, Csr, FlowNet, TwoLevel, astar, bisect, bounded_repair, dijkstra, walk_back
from tarmac.sources import graphs


def way(i, refs, klass=6, one=False, speed=0.0):
    return {"id": i, "node_refs": refs, "road_class": klass, "is_one_way": one, "max_speed": speed}


def node(i, lat, lon):
    return {"id": i, "lat": lat, "lon": lon}


#: Maps: diamond, 3 x 3 grid, one-way detour, two unconnected clusters.
MAPS = {
    "diamond": {"nodes": [node(1, 32.0, 34.0), node(2, 32.001, 34.001), node(3, 31.999, 34.001), node(4, 32.0, 34.002)], "ways": [way(101, [1, 2, 4], speed=60), way(102, [1, 3, 4], speed=30)]},
    "grid": {
        "nodes": [node(3 * r + c + 1, 32 + 0.001 * r, 34 + 0.001 * c) for r in range(3) for c in range(3)],
        "ways": [way(201, [1, 2, 3], speed=50), way(202, [4, 5, 6], speed=45), way(203, [7, 8, 9], speed=50), way(204, [1, 4, 7], speed=50), way(205, [2, 5, 8], speed=55), way(206, [3, 6, 9], speed=50)],
    },
    "oneway": {
        "nodes": [node(k + 1, 32 + 0.001 * (k // 3), 34 + 0.001 * (k % 3)) for k in range(6)],
        "ways": [way(301, [1, 2, 3], one=True, speed=60), way(302, [6, 5, 4], one=True, speed=50), way(303, [1, 4], 5, speed=30), way(304, [2, 5], 5, speed=20), way(305, [3, 6], 5, speed=30)],
    },
    "apart": {"nodes": [node(k + 1, 32 + 0.0005 * k, 34 + 0.0005 * k) for k in range(3)] + [node(k + 4, 32.01 + 0.0005 * k, 34.01 + 0.0005 * k) for k in range(3)], "ways": [way(401, [1, 2, 3], speed=40), way(402, [4, 5, 6], speed=40)]},
}
#: map, source, target -> seconds, path; from an independent calculation.
CASES = [
    ("diamond", 1, 4, 17.496, [1, 2, 4]), ("grid", 1, 9, 28.135, [1, 2, 5, 8, 9]), ("grid", 4, 6, 15.088, [4, 5, 6]), ("grid", 2, 8, 14.556, [2, 5, 8]), ("oneway", 1, 3, 11.316, [1, 2, 3]),
    ("oneway", 3, 1, 40.266, [3, 6, 5, 4, 1]), ("oneway", 4, 6, 38.003, [4, 1, 2, 3, 6]), ("oneway", 1, 6, 24.659, [1, 2, 3, 6]), ("apart", 1, 3, 13.122, [1, 2, 3]), ("apart", 4, 6, 13.121, [4, 5, 6]), ("apart", 1, 6, None, None), ("diamond", 1, 1, None, None),
]


@pytest.fixture(scope="module")
def maps(spark, tmp_path_factory):
    out = {}
    for name, doc in MAPS.items():
        path = tmp_path_factory.mktemp("maps") / f"{name}.json"
        path.write_text(json.dumps(doc))
        nodes, ways = graphs.read_graph_json(spark, str(path))
        out[name] = (nodes.cache(), etl.build_edges(nodes, ways).cache())
    return out


def test_edge_counts(maps):
    assert {k: e.count() for k, (_, e) in maps.items()} == {"diamond": 8, "grid": 24, "oneway": 10, "apart": 8}


@pytest.mark.parametrize("name", MAPS)
def test_cases(spark, maps, name):
    nodes, edges = maps[name]
    cases = [(k, s, t, sec, path) for k, (m, s, t, sec, path) in enumerate(CASES) if m == name]
    req = spark.createDataFrame([(k, s, t) for k, s, t, *_ in cases], "request_id long, src long, dst long")
    steps = {}
    for r in routing.paths(req, edges, "base_weight").orderBy("request_id", "step_idx").collect():
        steps.setdefault(r.request_id, []).append((r.node_idx, r.edge_id))
    cost = {r["edge_id"]: r["base_weight"] for r in edges.collect()}
    for k, _, _, sec, path in cases:
        if sec is None:
            assert k not in steps
        else:
            assert [n for n, _ in steps[k]] == path
            assert abs(sum(cost[e] for _, e in steps[k] if e is not None) - sec) < 2e-3


def test_congestion_diverts(spark, maps):
    _, edges = maps["diamond"]
    slow = edges.where("src = 2 AND dst = 4").select("edge_id", F.lit(1 + 0.15 * 39).alias("weight"))
    live = joins.live_weights(edges, slow)
    req = spark.createDataFrame([(1, 1, 4)], "request_id long, src long, dst long")
    assert [r.node_idx for r in routing.paths(req, live, "live_weight").orderBy("step_idx").collect()] == [1, 3, 4]


def test_snap_is_brute_force(spark, maps):
    nodes, _ = maps["grid"]
    rng = random.Random(1)
    points = [(k, 31.99 + rng.random() * 0.03, 33.99 + rng.random() * 0.03) for k in range(60)] + [(99, 40.0, 50.0)]
    got = {r.point_id: r.node_idx for r in joins.snap(spark.createDataFrame(points, "point_id long, lat double, lon double"), nodes).collect()}
    import math

    def d2(lat, lon, n):
        k = math.cos(math.radians(32.001))
        return (lat - n["lat"]) ** 2 + ((lon - n["lon"]) * k) ** 2

    assert got == {k: min(MAPS["grid"]["nodes"], key=lambda n: (d2(lat, lon, n), n["id"]))["id"] for k, lat, lon in points}


def test_relaxation_beyond_the_bound(spark, maps, monkeypatch):
    nodes, edges = maps["oneway"]
    req = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(itertools.product(range(1, 7), repeat=2))], "request_id long, src long, dst long")
    whole = edges.withColumn("wt", F.round(F.col("base_weight") * 100).cast("long"))
    want = {r.request_id: r.cost for r in routing.shortest(req, whole).collect()}
    monkeypatch.setattr(routing, "SHIPPED_EDGES", 3)
    assert {r.request_id: r.cost for r in routing.shortest(req, whole).collect()} == want and len(want) == 30


def test_alternatives_differ(spark, maps):
    _, edges = maps["diamond"]
    req = spark.createDataFrame([(1, 1, 4)], "request_id long, src long, dst long")
    rows = routing.paths(req, edges, "base_weight", alternatives=1).orderBy("alternative", "step_idx").collect()
    assert [[r.node_idx for r in rows if r.alternative == k] for k in (0, 1)] == [[1, 2, 4], [1, 3, 4]]


def test_partition_limits(spark):
    ids = [(k, float(k % 20), float(k // 20)) for k in range(400)]
    nodes = spark.createDataFrame(ids, "id long, x double, y double")
    pairs = [(a, b) for a in range(400) for b in (a + 1, a + 20) if b < 400 and (b != a + 1 or a % 20 < 19)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    cells = graph.partition(nodes, edges, 60).collect()
    sizes = {}
    for r in cells:
        sizes[r.cell] = sizes.get(r.cell, 0) + 1
    assert sorted(r.id for r in cells) == list(range(400)) and max(sizes.values()) <= 60 and len(sizes) >= 7
    assert sorted(map(str, cells)) == sorted(map(str, graph.partition(nodes, edges, 60).collect()))


def random_net(seed, n=30):
    rng = random.Random(seed)
    edges = [(a, b, rng.randrange(1, 50), k) for k, (a, b) in enumerate((rng.randrange(n), rng.randrange(n)) for _ in range(4 * n)) if a != b]
    return [(a, b, w, k) for k, (a, b, w, _) in enumerate(edges)]


def floyd(edges, n):
    d = [[0 if i == j else INF for j in range(n)] for i in range(n)]
    for a, b, w, _ in edges:
        d[a][b] = min(d[a][b], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


@pytest.mark.parametrize("seed", [11, 29, 57])
def test_searches_agree(seed):
    n, edges = 30, random_net(seed)
    d = floyd(edges, n)
    g = Csr.build(*zip(*edges), extra=range(n))
    cell = {k: k % 4 for k in range(n)}
    crossing = {x for a, b, *_ in edges if cell[a] != cell[b] for x in (a, b)}
    inner = [e for e in edges if cell[e[0]] == cell[e[1]]]
    di = floyd(inner, n)
    shortcuts = [(a, b, di[a][b]) for a in crossing for b in crossing if a != b and cell[a] == cell[b] and di[a][b] < INF]
    net = TwoLevel(cell, edges, shortcuts)
    for s, t in itertools.permutations(range(n), 2):
        done, prev, _ = dijkstra(g, {g.index[s]: 0}, {g.index[t]})
        want = d[s][t] if d[s][t] < INF else None
        assert done.get(g.index[t]) == want
        assert astar(g, g.index[s], g.index[t], lambda u: 0)[0] == want
        assert net.cost(s, t)[0] == want
        if want is not None:
            start, path = walk_back(prev, g.index[t])
            assert g.ids[start] == s and sum(edges[e][2] for _, e in path) == want


def test_repair_is_bounded():
    edges = [(0, 1, 1, 0), (0, 2, 2, 1), (2, 1, 2, 2), (2, 3, 1, 3), (3, 4, 1, 4), (4, 1, 0.5, 5)]
    g = Csr.build(*zip(*edges))
    assert bounded_repair(g, 0, 1, 10, 2, set())[0] == 4
    assert bounded_repair(g, 0, 1, 10, 5, set())[0] == 4  # 2 + 2, as 2 + 1 + 1 + 0.5 is dearer
    assert bounded_repair(g, 0, 1, 3, 5, set()) is None and bounded_repair(g, 0, 1, 10, 1, set()) is None


def test_flow_is_the_smallest_cut():
    rng = random.Random(9)
    for _ in range(20):
        n = 7
        pairs = [(a, b, rng.randrange(1, 5)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        net = FlowNet(n)
        for a, b, c in pairs:
            net.add(a, b, c)
        cuts = [sum(c for a, b, c in pairs if a in side and b not in side) for k in range(n - 1) for rest in itertools.combinations(range(1, n - 1), k) for side in [{0, *rest}]]
        assert net.run(0, n - 1) == min(cuts)
        side = net.side(0)
        assert sum(c for a, b, c in pairs if a in side and b not in side) == min(cuts)


def test_bisect_takes_both_sides():
    left, right = bisect([1, 2], [0.0, 0.0], [0.0, 0.0], [], 0.0)
    assert len(left) == len(right) == 1


def test_save_and_load(spark, maps, tmp_path):
    nodes, edges = maps["grid"]
    path = str(tmp_path / "g")
    graphs.save_graph(path, nodes=nodes, edges=edges)
    back = graphs.load_graph(spark, path)
    assert sorted(map(str, back["edges"].collect())) == sorted(map(str, edges.collect())) and back["nodes"].count() == 9
    spark.createDataFrame([("tarmac-graph", 99, ["nodes"])], "format string, version int, tables array<string>").write.mode("overwrite").json(f"{path}/meta")
    with pytest.raises(ValueError, match="version"):
        graphs.load_graph(spark, path)
    with pytest.raises(ValueError, match="unknown"):
        graphs.save_graph(path, other=nodes)


def test_catalogue_and_search(spark):
    doc = json.dumps({"features": [{"properties": {"id": "eu", "name": "Europe"}}, {"properties": {"id": "se", "name": "Sweden", "parent": "eu", "urls": {"pbf": "u"}}}, {"properties": {"id": " ", "name": "x"}}]})
    rows = graphs.parse_catalogue(spark.createDataFrame([(doc,)], "value string"))
    assert {r.id: r.children for r in graphs.region_tree(rows).collect()} == {"eu": ["se"], "se": []}
    places = spark.createDataFrame([("Main Street", "32.1", "34.2"), ("Mainz", "x", "8.2"), ("Other", "1", "2")], "display_name string, lat string, lon string")
    assert [r.displayName for r in graphs.search_places(places, " main ").collect()] == ["Main Street"]
    assert graphs.search_places(places, "  ").count() == 0
