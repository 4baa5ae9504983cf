"""Benchmark analytics: exact percentiles, speed-up tables, corpora, log parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.functions import geo


def percentile_rows(df: DataFrame, value: str, *keys: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Exact percentiles: the value at index floor((n - 1) p / 100) in order.

    Rows are ranked within their key and only the wanted ranks are kept, so no
    key's values are gathered into an array.
    """
    order = W.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(order) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_n"))
    at = lambda p: F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * p / 100), F.col(value)))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[at(p).alias(f"p{p}") for p in percents])


def speedup_text(base: Column, value: Column) -> Column:
    return F.when((base > 0) & (value > 0), F.format_string("%.2fx", base / value)).otherwise("-")


def speedups(rows: DataFrame, group: str, workers: str, value: str) -> DataFrame:
    """Means per (group, workers) against the group's baseline: one worker, else the fewest."""
    mean = rows.groupBy(group, workers).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("runs"))
    base = F.first("mean_value").over(W.partitionBy(group).orderBy((F.col(workers) != 1).cast("int"), F.col(workers)))
    return mean.withColumn("_base", base).select(group, workers, "runs", "mean_value", speedup_text(F.col("_base"), F.col("mean_value")).alias("speedup"))


def od_corpus(pairs: DataFrame, min_gap: int, min_m: float, max_m: float) -> DataFrame:
    """Distinct pairs at least ``min_gap`` ids apart and within a range of distances."""
    distance = geo.haversine_m(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    rows = pairs.withColumn("distance_m", distance)
    return rows.where((F.abs(F.col("src") - F.col("dst")) >= min_gap) & F.col("distance_m").between(min_m, max_m)).dropDuplicates(["src", "dst"])


def parse_bench_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """``BenchmarkName/mode-8  N  x ns/op  y visited_nodes/op`` lines as rows."""
    c = F.col(col)
    name = F.regexp_extract(c, r"^(Benchmark[^\s]*?)(?:-\d+)?\s", 1)
    number = lambda unit: F.regexp_extract(c, rf"([0-9.]+)\s+{unit}", 1).try_cast("double")
    return lines.where(c.rlike(r"^Benchmark\S+\s+\d+\s")).select(name.alias("name"), F.regexp_extract(c, r"^\S+\s+(\d+)", 1).cast("long").alias("iterations"), number("ns/op").alias("ns_per_op"), number("visited_nodes/op").alias("visited_per_op"))


def parse_duration_ms(text: Column) -> Column:
    """``1m2.5s``, ``350ms``, ``80µs`` as milliseconds."""
    part = lambda pattern, factor: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(0.0)) * factor
    return part(r"(\d+)h", 3_600_000.0) + part(r"(\d+)m(?!s)", 60_000.0) + part(r"([0-9.]+)s$", 1000.0) + part(r"([0-9.]+)ms", 1.0) + part(r"([0-9.]+)(?:µs|us)", 0.001)


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 by its mark, UTF-16 without one if it holds a zero byte, else UTF-8."""
    mark, rest = F.hex(F.substring(content, 1, 2)), F.substring(content, 3, (1 << 31) - 1)
    even = lambda c: F.substring(c, F.lit(1), (F.octet_length(c) - F.octet_length(c) % 2).cast("int"))
    return (
        F.when(mark == "FFFE", F.decode(even(rest), "UTF-16LE")).when(mark == "FEFF", F.decode(even(rest), "UTF-16BE"))
        .when(F.contains(content, F.unhex(F.lit("00"))), F.decode(even(content), "UTF-16LE")).otherwise(F.decode(content, "UTF-8"))
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, text``."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def text_lines(texts: DataFrame) -> DataFrame:
    """Lines of texts, bare: ``path, line_no, value``."""
    return texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "value")).withColumn("value", F.trim("value"))


def bench_metrics(lines: DataFrame, *keep: str, col: str = "value") -> DataFrame:
    """Every metric of benchmark lines: ``name, unit, value``; what is no number is left out.

    Lines need a name, a count and one pair of value and unit at least.
    """
    parts = F.split(F.trim(F.col(col)), r"\s+")
    rows = lines.where(F.startswith(F.trim(F.col(col)), F.lit("Benchmark"))).select(*keep, parts.alias("_p")).where(F.size("_p") >= 4)
    pairs = F.transform(F.sequence(F.lit(2), F.size("_p") - 2, F.lit(2)), lambda i: F.struct(F.get(F.col("_p"), i + 1).alias("unit"), F.get(F.col("_p"), i).try_cast("double").alias("value")))
    return rows.select(*keep, F.regexp_replace(F.get("_p", F.lit(0)), r"-\d+$", "").alias("name"), F.explode(pairs).alias("m")).select(*keep, "name", "m.unit", "m.value").where("value IS NOT NULL")


def pivoted(metrics: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """One row per name with a column per unit."""
    return metrics.groupBy("name").pivot("unit", list(units)).agg(F.first("value"))


def bench_setting(lines: DataFrame, col: str = "value") -> DataFrame:
    """The machine that benchmark lines name: ``key, value`` of goos, goarch and cpu."""
    key = F.regexp_extract(F.col(col), r"^(goos|goarch|cpu):", 1)
    return lines.where(key != "").select(key.alias("key"), F.trim(F.regexp_replace(F.col(col), r"^\w+:", "")).alias("value"))


def workers_of_path(path: Column) -> Column:
    """The digits of a file's name, as a number; 0 without any."""
    return F.coalesce(F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def build_summaries(texts: DataFrame) -> DataFrame:
    """``path, workers, overlay_ms, total_ms`` of build logs that tell both."""
    after = lambda marker: F.regexp_extract("text", rf"{marker} (\S+)", 1)
    rows = texts.select("path", workers_of_path(F.col("path")).alias("workers"), after("overlay ready in").alias("o"), after("build complete in").alias("t")).where("o <> '' AND t <> ''")
    return rows.select("path", "workers", parse_duration_ms(F.col("o")).alias("overlay_ms"), parse_duration_ms(F.col("t")).alias("total_ms"))


def run_summaries(texts: DataFrame, prefix: str) -> DataFrame:
    """``path, workers, avg_ms, runs`` of the log lines that begin with ``prefix`` and tell an average."""
    field = lambda name: F.regexp_extract("value", rf"(?:^|\s){name}=(\S+)", 1)
    rows = text_lines(texts).where(F.startswith("value", F.lit(f"{prefix} workers=")) & F.contains("value", F.lit(" avg=")))
    return rows.select("path", F.coalesce(field("workers").try_cast("long"), workers_of_path(F.col("path"))).alias("workers"), parse_duration_ms(field("avg")).alias("avg_ms"), F.coalesce(field("runs").try_cast("long"), F.lit(0).cast("long")).alias("runs"))


def load_summaries(texts: DataFrame, schema: str) -> DataFrame:
    """JSON summaries of load runs, one per file."""
    return texts.select("path", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("s")).select("path", "s.*")
