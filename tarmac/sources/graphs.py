"""Graph sources and sinks: JSON fixtures, map catalogues, Parquet stores with a format guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import GRAPH_JSON, PING

FORMAT, VERSION = "tarmac-graph", 1
TABLES = ("nodes", "edges", "gates", "overlay")


def write_graph_json(parts: DataFrame, folder: str) -> None:
    """A JSON graph in documents, each a file of its own: ``k`` and the ``nodes`` and ``ways`` of part k (null: none)."""
    parts.select("k", F.to_json(F.struct(*[F.coalesce(c, F.array()).alias(c) for c in ("nodes", "ways")])).alias("value")).write.partitionBy("k").text(folder)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raw nodes, ways) of a JSON graph.  Ways carry class, speed and direction as ``etl.build_edges`` takes them."""
    from tarmac.functions.tags import default_speed

    doc = spark.read.schema(GRAPH_JSON).option("multiLine", True).json(path)  # a document per file
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", "n.lat", "n.lon")
    ways = doc.select(F.explode("ways").alias("w")).select("w.*").where(F.size("node_refs") >= 2)
    speed = F.when(F.col("max_speed") > 0, F.col("max_speed")).otherwise(default_speed(F.col("road_class")))
    return nodes, ways.select(F.col("id").alias("way_id"), "node_refs", "road_class", speed.alias("speed_kmh"), F.coalesce("is_one_way", F.lit(False)).alias("is_one_way"), F.lit(False).alias("is_reverse"))


def region_tree(features: DataFrame) -> DataFrame:
    """Catalogue features (``id, name, parent``): blank ids go, children gathered by parent."""
    rows = features.where(F.trim(F.coalesce("id", F.lit(""))) != "")
    children = rows.groupBy(F.col("parent").alias("_p")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    return rows.join(children, F.col("id") == F.col("_p"), "left").select("id", "name", "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def parse_catalogue(lines: DataFrame, col: str = "value") -> DataFrame:
    """GeoJSON-like text with ``features[].properties{id, name, parent, urls.pbf}``."""
    kind = "features array<struct<properties:struct<id:string,name:string,parent:string,urls:struct<pbf:string>>>>"
    return lines.select(F.explode(F.from_json(col, kind)["features"]).alias("f")).select("f.properties.id", "f.properties.name", "f.properties.parent", F.col("f.properties.urls.pbf").alias("pbf_url")).where(F.trim(F.coalesce("id", F.lit(""))) != "")


def ready_regions(files: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """Folders (``dir``) that hold every needed ``file`` and lie in no other ready folder, sorted."""
    ready = files.where(F.col("file").isin(*needed)).groupBy("dir").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(needed)).select("dir")
    parts = F.split("dir", "/")
    above = ready.select(F.col("dir").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).where("inner <> dir")
    nested = above.join(ready, "dir", "left_semi").select(F.col("inner").alias("dir")).distinct()
    return ready.join(nested, "dir", "left_anti").orderBy("dir")


def region_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root`` as ``dir, file``, listed without being read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    return found.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("file"))


def parse_pings(lines: DataFrame, col: str = "value") -> DataFrame:
    """Ping messages of JSON text; malformed ones and other types go."""
    return lines.select(*[c for c in lines.columns if c != col], F.from_json(col, PING).alias("p")).where("p.type = 'ping'").select(*[c for c in lines.columns if c != col], "p.*")


def cached_routes(cache: DataFrame, wanted: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Wanted routes that are in the cache and not older than ``minutes``; missing ids are ignored."""
    fresh = cache.where(F.col("created_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return fresh.join(wanted.select("route_id").distinct(), "route_id", "left_semi")


def search_places(places: DataFrame, query: str, limit: int = 5, viewbox: str | None = None, countries: str | None = None) -> DataFrame:
    """Offline search: blank finds nothing; names that contain the query and whose coordinates parse.

    With a ``viewbox`` ("minLon,maxLat,maxLon,minLat") only what lies in it; with ``countries``
    ("de,se") only places of those (column ``country``).
    """
    q = (query or "").strip()
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    if countries:
        places = places.where(F.lower("country").isin([c.strip().lower() for c in countries.split(",")]))
    rows = places.select(F.col("display_name").alias("displayName"), lat.alias("lat"), lon.alias("lng")).where("lat IS NOT NULL AND lng IS NOT NULL")
    if viewbox:
        west, north, east, south = (float(x) for x in viewbox.split(","))
        rows = rows.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))
    hit = F.lit(bool(q)) & F.contains(F.lower("displayName"), F.lit(q.lower()))
    return rows.where(hit).orderBy("displayName", "lat", "lng").limit(limit)


def save_graph(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet, edges in order of their source's cell so that a cell's rows lie together."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        key = next((c for c in ("cell_src", "cell", "src") if c in df.columns), None)
        (df.repartitionByRange(key).sortWithinPartitions(key) if key else df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(FORMAT, VERSION, sorted(tables))], "format string, version int, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved graph; raises ValueError on another format or version."""
    meta = spark.read.schema("format string, version int, tables array<string>").json(f"{path}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError(f"{path} is no {FORMAT}")
    if meta["version"] != VERSION:
        raise ValueError(f"version {meta['version']} of {path} isn't {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


def complete_graph(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A loaded graph with all that follows from its nodes and edges: gates where none are
    stored, projected coordinates at the reference latitude, and the bounding box (``bbox``, one row)."""
    from tarmac.operators import etl, graph

    out = dict(tables)
    if "gates" not in out and {"cell_src", "cell_dst"} <= set(out["edges"].columns):
        out["gates"] = graph.gates(out["edges"])
    out["nodes"] = etl.projected(out["nodes"].drop("x", "y"))
    out["bbox"] = etl.bbox(out["nodes"])
    return out


def ping_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Ping messages as a stream: one JSON text per line of the files that arrive in ``folder``."""
    return parse_pings(spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder))


def store_routes(cache: DataFrame, routes: DataFrame) -> DataFrame:
    """``cache`` with ``routes`` (route_id, created_at, ...) put in, replacing those of the same id; a blank id gets one
    from the row's own content, so that storing it again changes nothing."""
    blank = F.trim(F.coalesce(F.col("route_id").cast("string"), F.lit(""))) == ""
    named = routes.withColumn("route_id", F.when(blank, F.md5(F.to_json(F.struct(*[c for c in routes.columns if c != "route_id"])))).otherwise(F.col("route_id").cast("string")))
    named = named.dropDuplicates(["route_id"])
    return cache.withColumn("route_id", F.col("route_id").cast("string")).join(named.select("route_id"), "route_id", "left_anti").unionByName(named)
