"""A road network and its traffic derived from the star-schema tables.

``part`` gives the nodes of a grid of 50 columns, its sizes the tags of the ways;
``events`` are observations, pings and density changes; ``supplier`` rows are
route requests, and fixed staircases from each request's source are routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import etl
from tarmac.operators.etl import with_one
from tarmac.schema import EWMA_ALPHA, SAMPLE_ALPHA

COLUMNS = 50
ROUTE_STEPS = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    rows = part.select("*", F.expr(f"id div {COLUMNS}").alias("r"), (F.col("id") % COLUMNS).alias("c"))
    return rows.select("id", "size", "r", "c", (32.0 + F.col("r") * 0.001).alias("lat"), (34.0 + F.col("c") * 0.001).alias("lon"), F.expr("(id div 500) * 5 + c div 10").alias("cell"))


def raw_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way per neighbouring pair, tagged as in a map extract."""
    n = nodes(spark, sf_dir)
    rows = with_one(n, n.agg(F.count(F.lit(1)).alias("_n")))
    across = rows.where((F.col("c") < COLUMNS - 1) & (F.col("id") + 1 < F.col("_n"))).select(
        (F.col("id") * 2).alias("way_id"), F.array(F.col("id"), F.col("id") + 1).alias("node_refs"), F.when((F.col("r") + F.col("c")) % 3 == 0, "primary").otherwise("secondary").alias("highway"),
        F.when(F.col("size") % 16 == 0, "-1").when(F.col("size") % 8 == 0, " Yes").otherwise("no").alias("oneway"),
        F.when(F.col("size") % 10 != 7, (35 + (F.col("r") + F.col("c")) % 4 * 10).cast("string")).alias("maxspeed"), F.lit(None).cast("string").alias("junction"),
    )
    down = rows.where(F.col("id") + COLUMNS < F.col("_n")).select(
        (F.col("id") * 2 + 1).alias("way_id"), F.array(F.col("id"), F.col("id") + COLUMNS).alias("node_refs"), F.when((F.col("r") + F.col("c")) % 2 == 0, "residential").otherwise("tertiary").alias("highway"),
        F.when(F.col("size") % 18 == 0, "reverse").when(F.col("size") % 9 == 0, "1").alias("oneway"),
        F.when(F.col("size") % 10 != 3, F.concat((30 + (2 * F.col("r") + F.col("c")) % 4 * 8).cast("string"), F.lit(" km/h"))).alias("maxspeed"), F.when(F.col("size") % 25 == 0, "Roundabout").alias("junction"),
    )
    return across.unionByName(down)


def long_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of up to six nodes along a row of the grid; every 11th row's first way also names a node that isn't there."""
    n = nodes(spark, sf_dir)
    rows = n.groupBy("r", F.expr("c div 5").alias("k")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    refs = F.when((F.col("r") % 11 == 0) & (F.col("k") == 0), F.concat("ids", F.array(F.lit(-1).cast("long")))).otherwise(F.col("ids"))
    return rows.select((F.col("r") * 10 + F.col("k")).alias("way_id"), refs.alias("node_refs"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.classified(raw_ways(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their cells and an integer weight in hundredths of a second."""
    n = nodes(spark, sf_dir)
    found = etl.edges_with_cells(etl.build_edges(n, ways(spark, sf_dir)), n)
    return found.withColumn("wt", F.round(F.col("base_weight") * 100).cast("long"))


def events(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """Events by edge: ``ts`` in seconds, ratio and alpha of observations, density change.  ``e``: the edges, where they are at hand."""
    e = edges(spark, sf_dir) if e is None else e
    count = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("_nodes"))
    ev = with_one(table(spark, sf_dir, "events"), count)
    rows = ev.select(
        "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), F.col("user_id"), "event_type", "value",
        F.expr("(user_id * 7 + event_id % 3) % _nodes").alias("edge_id"),
    )
    rows = rows.join(e.select("edge_id", "length_m", "base_weight", "speed_kmh"), "edge_id")
    full = F.col("event_type").isin("purchase", "signup")
    sample = F.col("event_type").isin("click", "view") & (F.col("value") > 0)  # a speed of zero is no sample
    ratio = F.when(full, 0.5 + F.col("value") / 50).when(sample, F.col("length_m") / (F.col("value") / 3.6) / F.col("base_weight")).otherwise(-1.0)
    return rows.select("*", ratio.alias("ratio"), F.when(full, F.lit(EWMA_ALPHA)).otherwise(F.lit(SAMPLE_ALPHA)).alias("alpha"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).cast("long").alias("delta"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route requests: node ends, and coordinates a little off them."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"))
    n = nodes(spark, sf_dir)
    rows = with_one(s, n.agg(F.count(F.lit(1)).alias("_n"))).select("request_id", F.expr("(request_id * 13) % _n").alias("src"), F.expr("(request_id * 37 + 11) % _n").alias("dst"))
    at = lambda end: n.select(F.col("id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    off = (F.col("request_id") % 5 - 2) * 0.00013
    rows = rows.join(at("src"), "src").join(at("dst"), "dst")
    return rows.select("request_id", "src", "dst", *[(F.col(c) + off).alias(c) for c in ("src_lat", "src_lon", "dst_lat", "dst_lon")])


def first_edges(e: DataFrame) -> DataFrame:
    """The first edge between each pair of nodes."""
    return e.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))


def route_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staircases: right and down in turn, up to ROUTE_STEPS nodes within the grid."""
    n = nodes(spark, sf_dir)
    req = with_one(requests(spark, sf_dir).select("request_id", "src"), n.agg(F.count(F.lit(1)).alias("_n")))
    rows = req.select(F.col("request_id").alias("route_id"), F.expr("src div 50").alias("r0"), F.expr("src % 50").alias("c0"), "_n", F.explode(F.sequence(F.lit(0), F.lit(ROUTE_STEPS - 1))).alias("k"))
    rows = rows.select("route_id", "_n", F.col("k").cast("long").alias("step_idx"), F.expr("r0 + k div 2").alias("r"), F.expr("c0 + (k + 1) div 2").alias("c"))
    rows = rows.where((F.col("c") < COLUMNS) & (F.col("r") * COLUMNS + F.col("c") < F.col("_n")))
    return rows.select("route_id", "step_idx", (F.col("r") * COLUMNS + F.col("c")).cast("long").alias("node_idx"))


def route_legs(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """The legs between consecutive nodes: end node, edge (null where the road doesn't lead there), length, time."""
    from pyspark.sql import Window as W

    e = edges(spark, sf_dir) if e is None else e
    walk = W.partitionBy("route_id").orderBy("step_idx")
    pairs = route_nodes(spark, sf_dir).withColumn("prev", F.lag("node_idx").over(walk))
    named = pairs.join(first_edges(e).select(F.col("src").alias("prev"), F.col("dst").alias("node_idx"), "edge_id"), ["prev", "node_idx"], "left")
    by_id = e.select("edge_id", "length_m", "base_weight", "speed_kmh")
    legs = named.join(by_id, "edge_id", "left")
    ends = nodes(spark, sf_dir).select(F.col("id").alias("node_idx"), "lat", "lon", "cell")
    legs = legs.join(ends, "node_idx")
    length = F.when(F.col("prev").isNull(), 0.0).otherwise(F.coalesce("length_m", F.lit(100.0)))
    time = F.when(F.col("prev").isNull(), 0.0).otherwise(F.coalesce("base_weight", F.lit(8.0)))
    return legs.select("route_id", "step_idx", "node_idx", "prev", "lat", "lon", "cell", "edge_id", length.alias("leg_m"), time.alias("leg_sec"), "speed_kmh")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings of sessions (users) on their routes: reported step, position off the route, speed."""
    s = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("_s"))
    ev = with_one(table(spark, sf_dir, "events"), s)
    rows = ev.select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), F.col("user_id").alias("session_id"), F.expr("user_id % _s + 1").alias("route_id"), F.expr("event_id % 13").alias("reported"), (F.col("value") / 5).alias("speed_kmh"), (F.col("value") / 490 * 0.0012).alias("off"))
    last = route_nodes(spark, sf_dir).groupBy("route_id").agg(F.max("step_idx").alias("last_step"))
    return rows.join(last, "route_id")


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)
