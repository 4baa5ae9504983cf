"""The map reader on extracts encoded here, loaded graphs, the route cache, and streams that are stopped and go on."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tarmac.operators import etl, graph
from tarmac.sources import graphs, pbf
from tarmac.sources.shared import shared_folder
from tarmac.streaming import edges, replay


def number(n):
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(n, value):
    return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value


def deltas(values):
    return b"".join(number(zigzag(b - a)) for a, b in zip([0, *values], values))


def blob(kind, data, deflate=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if deflate else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def block(groups, strings=(b"",), granularity=100, lat0=0, lon0=0):
    table = b"".join(field(1, x) for x in strings)
    return field(1, table) + b"".join(field(2, g) for g in groups) + field(17, granularity) + field(19, lat0 & (1 << 64) - 1) + field(20, lon0)


def dense(nodes):
    return field(2, field(1, deltas([n for n, _, _ in nodes])) + field(8, deltas([a for _, a, _ in nodes])) + field(9, deltas([o for _, _, o in nodes])))


def way(wid, refs, tags, strings):
    keys = b"".join(number(strings.index(k)) for k in tags)
    values = b"".join(number(strings.index(v)) for v in tags.values())
    return field(3, field(1, wid) + field(2, keys) + field(3, values) + field(8, deltas(refs)))


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    strings = [b"", b"highway", b"primary", b"name", "Straße".encode(), b"oneway", b"yes", b"building", b"maxspeed", b"50"]
    nodes = [(10, 320000000, 340000000), (11, 320010000, 340010000), (7, 320020000, -340020000), (99, 1, 1)]
    single = field(1, field(1, zigzag(1 << 40)) + field(8, zigzag(-100)) + field(9, zigzag(200)))
    relation = field(4, field(1, 5))
    ways = way(1, [10, 11, 7], {b"highway": b"primary", b"name": "Straße".encode(), b"oneway": b"yes"}, strings) + way(2, [7, 1 << 40], {b"highway": b"primary", b"maxspeed": b"50"}, strings) + way(3, [10, 99], {b"building": b"yes"}, strings)
    path = tmp_path_factory.mktemp("pbf") / "x.osm.pbf"
    path.write_bytes(
        blob("OSMHeader", field(4, b"OsmSchema-V0.6")) + blob("OSMData", block([dense(nodes)])) + blob("OSMData", block([single], granularity=1000, lat0=-5_000, lon0=7_000), deflate=False)
        + blob("OSMData", block([ways, relation], strings)) + blob("OSMData", block([]))
    )
    return path


def test_pbf(spark, extract):
    nodes, ways = pbf.read_pbf(spark, f"file://{extract}")
    got = {r.id: (round(r.lat, 7), round(r.lon, 7)) for r in nodes.collect()}
    assert got == {10: (32.0, 34.0), 11: (32.001, 34.001), 7: (32.002, -34.002), 1 << 40: (-0.000105, 0.000207)}
    rows = {r.way_id: (list(r.node_refs), r.highway, r.oneway, r.maxspeed, r.junction) for r in ways.collect()}
    assert rows == {1: ([10, 11, 7], "primary", "yes", None, None), 2: ([7, 1 << 40], "primary", None, "50", None)}
    every, _ = pbf.read_pbf(spark, f"file://{extract}", every_node=True)
    assert {r.id for r in every.collect()} == {10, 11, 7, 99, 1 << 40}
    built = etl.build_edges(nodes, etl.classified(ways)).collect()
    assert {(r.src, r.dst) for r in built} == {(10, 11), (11, 7), (7, 1 << 40), (1 << 40, 7)}


def test_pbf_in_several_files(spark, extract, tmp_path):
    (tmp_path / "y.pbf").write_bytes(extract.read_bytes())
    nodes, ways = pbf.read_pbf(spark, f"file://{extract}", f"file://{tmp_path}/y.pbf")
    assert ways.count() == 4 and nodes.count() == 8


@pytest.mark.parametrize("cut", [3, 60, -1])
def test_damaged_pbf_raises(spark, extract, tmp_path, cut):
    (tmp_path / "z.pbf").write_bytes(extract.read_bytes()[:cut])
    with pytest.raises(Exception, match="cut short|no blob header|no end"):
        pbf.read_pbf(spark, f"file://{tmp_path}/z.pbf")


def test_varints():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    assert pbf.packed(memoryview(b"".join(map(number, values)))).tolist() == values
    signed = [0, -1, 1, -2, 2**40, -(2**40), 2**62]
    assert pbf.signed(pbf.packed(memoryview(b"".join(number(zigzag(v)) for v in signed)))).tolist() == signed


def test_loaded_graph_is_completed(spark, tmp_path):
    nodes = spark.createDataFrame([(k, 32 + k * 0.001, 34.0, k // 2) for k in range(6)], "id long, lat double, lon double, cell long")
    e = spark.createDataFrame([(k, k, k + 1, k // 2, (k + 1) // 2) for k in range(5)], "edge_id long, src long, dst long, cell_src long, cell_dst long")
    graphs.save_graph(str(tmp_path / "g"), nodes=nodes, edges=e)
    whole = graphs.complete_graph(graphs.load_graph(spark, str(tmp_path / "g")))
    assert {tuple(r) for r in whole["gates"].collect()} == {tuple(r) for r in graph.gates(e).collect()}
    box = whole["bbox"].first()
    assert abs(box.min_lat - 32) < 1e-9 and abs(box.max_lat - 32.005) < 1e-9
    assert {"x", "y"} <= set(whole["nodes"].columns) and whole["nodes"].where("x IS NULL").isEmpty()


def test_route_cache_store(spark):
    cache = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "route_id string, created_at long, body string")
    new = spark.createDataFrame([("a", 2, "new"), ("", 2, "blank"), (None, 2, "blank"), ("  ", 3, "other")], "route_id string, created_at long, body string")
    once = graphs.store_routes(cache, new)
    rows = {r.route_id: r.body for r in once.collect()}
    assert rows["a"] == "new" and rows["b"] == "old" and sorted(rows.values()) == ["blank", "new", "old", "other"]
    assert {r.route_id for r in graphs.store_routes(once, new).collect()} == set(rows)


def test_stream_goes_on_after_a_stop(spark):
    """State carried over micro-batches, and over a restart from the checkpoint."""
    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 10).alias("us"), (F.col("id") % 7).alias("edge_id"), (F.col("id") % 5 + 0.5).alias("ratio"), F.lit(0.15).alias("alpha"))
    folder = shared_folder(spark, "stopped")
    replay.in_files(rows.where("event_id < 200"), f"{folder}/in", 2)
    fold = lambda s: edges.folded(s, "edge_id", edges.Multiplier())
    first = replay.streamed(spark, folder, rows.schema, fold)
    assert first.select("batch").distinct().count() == 2
    replay.in_files(rows.where("event_id >= 200"), f"{folder}/in", 4)
    out = replay.streamed(spark, folder, rows.schema, fold)
    got = {r.edge_id: r.weight for r in replay.newest(out, "edge_id").collect()}
    want = dict.fromkeys(range(7), 1.0)
    for k in range(400):
        want[k % 7] = max(1.0, 0.15 * max(1.0, k % 5 + 0.5) + 0.85 * want[k % 7])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ping_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"type":"ping","step_index":3}\nnonsense\n{"type":"other","step_index":4}\n')
    run = graphs.ping_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.step_index for r in spark.table("arrived").collect()] == [3]
