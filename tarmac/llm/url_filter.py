"""URL filters: a temporal join of captures with dated list entries.

List entries are dated events: from its date on, a key (a domain or a path
prefix of a host) is blocked, allowed, or removed from the list.  Events of a
key become validity intervals [date, next date).  Every capture looks up the
suffixes of its host and its beginnings (host and path) of every length that a prefix
of the list has, so prefixes may be of any depth and end anywhere, and an as-of condition keeps
the entries that were active at fetch time.  The longest key decides; of equally
long ones blocking wins.

Only keys and dates travel, never page bodies; the list is broadcast if it has at
most BROADCAST_ROWS rows and shuffled with the captures beyond that.

Defined cases: captures with a null or unparsable URL or a null time match
nothing and aren't blocked; of several events of one key on one date the
strictest counts; repeated captures are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.llm.common import small, written

#: The dated list in production: (date, kind, key, action).  Fixed values.
ENTRIES = (
    ("2024-01-01", "domain", "casino-win.example.com", "block"),
    ("2024-01-01", "domain", "free-bets.example.com", "block"),
    ("2024-02-15", "domain", "cheap-pills.example.com", "block"),
    ("2024-03-01", "domain", "ads-track.example.com", "block"),
    ("2024-03-10", "prefix", "m.ads-track.example.com/de/", "allow"),
    ("2024-05-20", "domain", "free-bets.example.com", "remove"),
    ("2024-06-01", "prefix", "blog.tionsh.example.com/fr/", "block"),
    ("2024-07-01", "domain", "casino-win.example.com", "allow"),
    ("2024-08-01", "prefix", "blog.tionsh.example.com/fr/", "remove"),
    ("2024-09-01", "domain", "casino-win.example.com", "block"),
    ("2024-10-01", "domain", "example.net", "block"),
    ("2024-11-01", "domain", "tiontion.example.net", "allow"),
)


def list_entries(spark: SparkSession, entries: tuple = ENTRIES) -> DataFrame:
    return spark.createDataFrame([Row(day=d, kind=k, key=key, action=a) for d, k, key, a in entries], "day string, kind string, key string, action string").withColumn("day", F.to_date("day"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals: ``_kind``, ``_key``, ``_block``, ``_from``, ``_to`` (null: still valid)."""
    rank = F.when(F.col("action") == "remove", 0).when(F.col("action") == "allow", 1).otherwise(2)
    day = entries.where("day IS NOT NULL AND key IS NOT NULL").groupBy(F.col("kind").alias("_kind"), F.lower("key").alias("_key"), F.col("day").alias("_from")).agg(F.max(rank).alias("_rank"))
    to = F.lead("_from").over(W.partitionBy("_kind", "_key").orderBy("_from"))
    return day.withColumn("_to", to).where("_rank > 0").select("_kind", "_key", (F.col("_rank") == 2).alias("_block"), "_from", "_to")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user and port; empty if there is none."""
    return F.lower(F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), F.lit(".")))


def lookup_keys(url: Column, lengths: list[int]) -> Column:
    """All (kind, key) pairs under which a list may hold the URL; ``lengths``: those of its prefixes."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key")))
    if not lengths:
        return F.when(host != "", domains)
    whole = F.concat(host, F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(whole))
    prefixes = F.transform(fitting, lambda n: F.struct(F.lit("prefix").alias("kind"), F.substring(whole, F.lit(1), n).alias("key")))
    return F.when(host != "", F.concat(domains, prefixes))


def url_verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Per capture: id, host, fetch date, ``blocked``, and the deciding rule with its start."""
    base = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).cast("date").alias("_day"))
    rules = written(intervals(entries), "intervals")
    lengths = sorted(r["n"] for r in rules.where("_kind = 'prefix'").select(F.length("_key").alias("n")).distinct().collect())
    rules = small(rules)
    keys = base.select("_id", "_url", "_day", F.explode(lookup_keys(F.col("_url"), lengths)).alias("_k")).select("_id", "_url", "_day", F.col("_k.kind").alias("_lk"), F.col("_k.key").alias("_lv"))
    active = (F.col("_from") <= F.col("_day")) & (F.col("_to").isNull() | (F.col("_day") < F.col("_to")))
    hits = keys.join(rules, (F.col("_lk") == F.col("_kind")) & (F.col("_lv") == F.col("_key")) & active)
    best = F.max(F.struct(F.length("_key").alias("len"), "_block", "_key", "_from")).alias("_best")
    won = hits.groupBy(F.col("_id").alias("_wid"), F.col("_url").alias("_wurl"), F.col("_day").alias("_wday")).agg(best)
    same = F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_url") == F.col("_wurl")) & (F.col("_day") == F.col("_wday"))
    return base.join(won, same, "left").select(
        F.col("_id").alias(id_col), host_of(F.col("_url")).alias("host"), F.col("_day").alias("fetched"), F.coalesce(F.col("_best._block"), F.lit(False)).alias("blocked"), F.col("_best._key").alias("rule"), F.col("_best._from").alias("rule_since")
    )


def page_report(pages: DataFrame) -> DataFrame:
    """All pages against the production list.  The table has no fetch time; captures are
    spread over 2024 by page id, one day each in turn."""
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    return url_verdicts(captures, list_entries(pages.sparkSession))


URL_SQL = (
    "WITH entries(day, kind, key, action) AS (VALUES "
    + ", ".join(f"(DATE '{d}', '{k}', '{key}', '{a}')" for d, k, key, a in ENTRIES)
    + r"""), rules AS (
  SELECT kind, key, action = 'block' AS block, day AS since, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS until, action FROM entries
), captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host,
         lower(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1)) AS path FROM pages
), hits AS (
  SELECT c.page_id, r.key, r.block, r.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.key) DESC, r.block DESC) AS place
  FROM captures c JOIN rules r ON r.action <> 'remove' AND r.since <= c.fetched AND (r.until IS NULL OR c.fetched < r.until)
   AND CASE r.kind WHEN 'domain' THEN c.host = r.key OR ends_with(c.host, '.' || r.key) ELSE starts_with(c.host || c.path, r.key) END
)
SELECT c.page_id, c.host, c.fetched, coalesce(h.block, false) AS blocked, h.key AS rule, h.since AS rule_since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1
"""
)
