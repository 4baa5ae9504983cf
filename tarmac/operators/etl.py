"""From raw nodes and ways to a directed, weighted graph.

Raw nodes: ``id, lat, lon``.  Raw ways: ``way_id, node_refs`` and tags.  Every
step is a projection, an equi-join or an aggregation; ids are dense through
counts per range of the sort key, so no step sorts the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.functions import geo, tags
from tarmac.schema import EARTH_RADIUS_M, FLAG_ONE_WAY

#: Keys of this many consecutive nodes share a range of dense ids.
RANGE = 4096


def dense_ids(df: DataFrame, name: str, key: str, *ties: str) -> DataFrame:
    """Zero-based ids in order of ``key`` (a long), then ``ties``.

    Rows are numbered within ranges of the key; the ranges' offsets are running
    sums over one pre-aggregated row per range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / RANGE))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("_range").alias("_r"), (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(key, *ties)) - 1
    return ranged.join(offsets, F.col("_range") == F.col("_r")).withColumn(name, (F.col("_offset") + place).cast("long")).drop("_range", "_r", "_offset")


def referenced_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The nodes that some way refers to."""
    refs = ways.select(F.explode("node_refs").alias("ref")).distinct()
    return nodes.join(refs, nodes["id"] == refs["ref"], "left_semi")


def classified(ways: DataFrame) -> DataFrame:
    """Roads among the ways: class, speed, direction from their tags.  Others, and ways of fewer than two nodes, go."""
    oneway, reverse = tags.one_way(F.col("oneway"), F.col("junction"))
    roads = ways.withColumn("road_class", tags.road_class(F.col("highway"))).where(F.col("road_class").isNotNull() & (F.size("node_refs") >= 2))
    stated = tags.max_speed(F.col("maxspeed"))
    speed = F.when(stated > 0, stated).otherwise(tags.default_speed(F.col("road_class")))
    return roads.select("way_id", "node_refs", "road_class", speed.alias("speed_kmh"), oneway.alias("is_one_way"), reverse.alias("is_reverse"))


def segments(ways: DataFrame, *keep: str) -> DataFrame:
    """Consecutive node pairs of each way: ``way_id, seq, n1, n2``."""
    pairs = F.arrays_zip(F.slice("node_refs", F.lit(1), F.greatest(F.size("node_refs") - 1, F.lit(0))).alias("n1"), F.slice("node_refs", F.lit(2), F.size("node_refs")).alias("n2"))
    out = ways.where(F.size("node_refs") >= 2).select("way_id", *keep, F.posexplode(pairs).alias("seq", "pair"))
    return out.select("way_id", *keep, F.col("seq").cast("long").alias("seq"), F.col("pair.n1").alias("n1"), F.col("pair.n2").alias("n2"))


def directed(segs: DataFrame) -> DataFrame:
    """Both directions of two-way segments, the allowed one of others: adds ``src, dst``."""
    there = F.struct(F.col("n1").alias("src"), F.col("n2").alias("dst"))
    back = F.struct(F.col("n2").alias("src"), F.col("n1").alias("dst"))
    ends = F.when(~F.col("is_one_way"), F.array(there, back)).when(F.col("is_reverse"), F.array(back)).otherwise(F.array(there))
    return segs.withColumn("_end", F.explode(ends)).select(*[c for c in segs.columns if c not in ("n1", "n2")], "_end.src", "_end.dst")


def measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length and free travel time; pairs with an unknown node go."""
    a = nodes.select(F.col("id").alias("src"), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"))
    joined = pairs.join(a, "src").join(b, "dst")
    joined = joined.withColumn("length_m", F.round(geo.haversine_m(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2")), 3))
    return joined.withColumn("base_weight", F.round(geo.travel_sec(F.col("length_m"), F.col("speed_kmh")), 6)).drop("_lat1", "_lon1", "_lat2", "_lon2")


def build_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The directed edges of classified ways, with dense ids by (src, dst, way, position)."""
    pairs = directed(segments(ways, "road_class", "speed_kmh", "is_one_way", "is_reverse"))
    edges = dense_ids(measured(pairs, nodes), "edge_id", "src", "dst", "way_id", "seq")
    return edges.select("edge_id", "src", "dst", "way_id", "road_class", "speed_kmh", "length_m", "base_weight", F.when(F.col("is_one_way"), FLAG_ONE_WAY).otherwise(0).alias("flags"))


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: edges out, and the index of the first in edge-id order."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select("id").join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"), F.floor(F.col("id") / RANGE).alias("_range"))
    ranges = rows.groupBy("_range").agg(F.sum("degree").alias("_n"))
    before = ranges.select(F.col("_range").alias("_r"), (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.sum("degree").over(W.partitionBy("_range").orderBy("id")) - F.col("degree")
    return rows.join(before, F.col("_range") == F.col("_r")).select("id", "degree", (F.col("_before") + within).alias("first_edge"))


def reordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes renumbered by (cell, id) so that a cell is contiguous; edges follow and are renumbered."""
    new = dense_ids(nodes.select("id", "cell"), "new_id", "cell", "id").select(F.col("id").alias("_old"), "new_id", F.col("cell").alias("_cell"))
    src, dst = new.select(F.col("_old").alias("src"), F.col("new_id").alias("new_src")), new.select(F.col("_old").alias("dst"), F.col("new_id").alias("new_dst"))
    moved = edges.join(src, "src").join(dst, "dst")
    moved = dense_ids(moved, "new_edge_id", "new_src", "new_dst", "way_id", "edge_id")
    return new.select(F.col("_old").alias("id"), F.col("_cell").alias("cell"), "new_id"), moved.select("edge_id", "new_edge_id", "new_src", "new_dst")


def bbox(nodes: DataFrame) -> DataFrame:
    """Extent, centre and viewbox text (left, top, right, bottom)."""
    box = nodes.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return box.select("*", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("center_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("center_lon"), F.format_string("%.6f,%.6f,%.6f,%.6f", "min_lon", "max_lat", "max_lon", "min_lat").alias("viewbox"))


def with_one(df: DataFrame, single: DataFrame) -> DataFrame:
    """Every row beside the one row of ``single`` (an aggregate without keys)."""
    return df.crossJoin(F.broadcast(single))


def projected(nodes: DataFrame) -> DataFrame:
    """x, y about the centre latitude of the nodes' extent."""
    ref = bbox(nodes).select(F.col("center_lat").alias("_ref"))
    x, y = geo.project(F.col("lat"), F.col("lon"), F.col("_ref"))
    return with_one(nodes, ref).select(*nodes.columns, x.alias("x"), y.alias("y"))


def edges_with_cells(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    cell = lambda end: nodes.select(F.col("id").alias(end), F.col("cell").alias(f"cell_{end}"))
    return edges.join(cell("src"), "src").join(cell("dst"), "dst")


def latitude_metres(lat: Column) -> Column:
    return F.radians(lat) * EARTH_RADIUS_M
