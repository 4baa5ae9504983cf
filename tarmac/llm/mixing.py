"""Mixing sources to target weights along a time-varying curriculum.

1. Per document: its size in words.  Only (id, source, size) is carried on.
2. Per source (map-side partial aggregation): rows and words; targets by
   water-filling under a cap per source.
3. Each source's documents are put in a fixed pseudo-random order (MD5 of the
   id).  Running word counts come from two levels of sums: within narrow hash
   ranges (a source has as many as its rows need, so a source with a third of
   all rows is spread over many tasks) and over the ranges of a source.
4. A document whose words lie at cumulative demand q of its source gets the
   training position t with W(t) = q, where W is the integral of the source's
   weight schedule; schedules are linear, so W is quadratic and inverts exactly.
5. Documents are range-sorted by position.

A document that the mix reaches twice has one entry for each pass; the document
at which a source's demand ends is taken as far as the demand goes.

Defined cases: a null text has size 0; sources rank by code point, null last;
a source without words has target 0 and its documents are never taken; repeated
rows and null ids are documents each, ordered by their size where ids tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.llm.common import small, written

#: Weights of the sources in rank order, repeating.
WEIGHTS = (5, 2, 1)
#: Slope of each source's weight over training time, in rank order, repeating:
#: weight(t) = 1 + slope * (2 t - 1).  Heavy sources come early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
#: The mix takes this share of all words; a source is used at most CAP times.
SHARE, CAP = 1.5, 2.0
ROWS_PER_RANGE = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.pmod(rank, F.lit(len(values))).cast("int") + 1)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: ``_source``, rows, words, target, slope.

    Water-filling: with sources in order of cap/weight, the level of those not
    capped is (total - caps before) / (weights left), and a source is capped if
    its cap lies below the level it would see.  The windows run over one
    pre-aggregated row per source.
    """
    per = sizes.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_words"))
    ranked = per.withColumn("_rank", F.row_number().over(W.orderBy(F.col("_source").isNull(), F.col("_source"))) - 1)
    ranked = ranked.select("*", _pick(weights, F.col("_rank")).alias("_weight"), _pick(slopes, F.col("_rank")).alias("_slope"), (F.col("_words") * F.lit(cap)).alias("_cap"))
    order = W.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_rank"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    filled = ranked.withColumn("_all", F.sum("_words").over(W.partitionBy()) * F.lit(share))
    filled = filled.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
    filled = filled.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    level = F.min(F.when(~F.col("_full"), F.struct("_cap_rank", "_level"))).over(W.partitionBy())["_level"]
    filled = filled.withColumn("_cap_rank", F.row_number().over(order)).withColumn("_open", level)
    target = F.when(F.col("_full") | F.col("_open").isNull(), F.col("_cap")).otherwise(F.col("_open") * F.col("_weight"))
    return filled.select("_source", "_rank", "_rows", "_words", target.alias("_target"), "_slope")


def curriculum_position(share: Column, slope: Column) -> Column:
    """t in [0, 1] at which the integral of 1 + slope (2 t - 1) reaches ``share``."""
    low = 1 - slope
    root = F.sqrt(low * low + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - low) / (2 * slope))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: ``_id``, ``_th``, sizes, target, words taken and the
    positions of its first and second pass (null where that pass doesn't reach it)."""
    text = F.col(text_col)
    sizes = written(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_order")), "sizes")
    targets = written(source_targets(sizes, **how).withColumnRenamed("_source", "_s"), "targets")
    rows = sizes.join(small(targets), F.col("_source").eqNullSafe(F.col("_s")))
    ranges = F.ceil(F.col("_rows") / F.lit(ROWS_PER_RANGE))
    rows = rows.withColumn("_range", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)))
    totals = rows.groupBy("_rank", "_range").agg(F.sum("_size").alias("_sum"))
    offset = F.sum("_sum").over(W.partitionBy("_rank").orderBy("_range")) - F.col("_sum")
    totals = written(totals.select(F.col("_rank").alias("_r"), F.col("_range").alias("_g"), offset.alias("_offset")), "ranges")
    rows = rows.join(small(totals), (F.col("_rank") == F.col("_r")) & (F.col("_range") == F.col("_g")))
    inner = F.sum("_size").over(W.partitionBy("_rank", "_range").orderBy("_order", "_id", "_size", "_th").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    rows = rows.withColumn("_before", F.col("_offset") + inner)
    demand = F.round("_target").cast("long")
    first = F.greatest(F.lit(0), F.least(F.col("_size"), demand - F.col("_before")))
    second = F.greatest(F.lit(0), F.least(F.col("_size"), demand - F.col("_words") - F.col("_before")))
    at = lambda q: curriculum_position(q / demand, F.col("_slope"))
    return rows.select(
        "_id", "_th", "_source", "_size", F.col("_words").alias("_source_size"), "_target", first.alias("_first"), second.alias("_second"),
        F.when(first > 0, at(F.col("_before"))).alias("_at_first"), F.when(second > 0, at(F.col("_before") + F.col("_words"))).alias("_at_second"),
    )


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and its first training position."""
    s = schedule(docs, **how)
    return s.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_first") + F.col("_second")).alias("taken"), F.round("_at_first", 6).alias("position"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix in training order, once for each pass that takes them.

    Columns of ``docs`` first, then ``mix_pass``, ``mix_words`` and ``mix_position``,
    which replace columns of those names.
    """
    docs = docs.drop("mix_pass", "mix_words", "mix_position")
    s = schedule(docs, id_col, text_col, source_col, **how)
    # equal rows hold equal places in turn, so that a repeated row is neither lost nor multiplied
    keys = lambda c, th: (F.coalesce(F.col(c), F.lit(0)), F.col(c).isNull(), F.col(th))
    named = ("_k0", "_k1", "_k2")
    s = s.select("*", *[k.alias(n) for k, n in zip(keys("_id", "_th"), named)]).withColumn("_turn", F.row_number().over(W.partitionBy(*named).orderBy("_at_first", "_at_second")))
    twice = F.array(F.struct(F.lit(1).alias("p"), F.col("_first").alias("w"), F.col("_at_first").alias("t")), F.struct(F.lit(2).alias("p"), F.col("_second").alias("w"), F.col("_at_second").alias("t")))
    takes = s.select(*named, "_turn", F.explode(twice).alias("_take")).where("_take.w > 0")
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_did"), F.xxhash64(F.col(text_col)).alias("_dth"), F.col(source_col).alias("_dsource"))
    # the window and the join deal texts out by the same keys, so they travel once;
    # turns are compared by their difference, lest they become a key of the join
    inner = inner.select("_doc", "_dsource", *[k.alias(n.replace("k", "d")) for k, n in zip(keys("_did", "_dth"), named)])
    inner = inner.withColumn("_dturn", F.row_number().over(W.partitionBy("_d0", "_d1", "_d2").orderBy("_dsource")))
    out = inner.join(takes, (F.col("_d0") == F.col("_k0")) & (F.col("_d1") == F.col("_k1")) & (F.col("_d2") == F.col("_k2")) & (F.col("_dturn") - F.col("_turn") == 0))
    out = out.select(*[F.col("_doc")[c].alias(c) for c in docs.columns], F.col("_take.p").alias("mix_pass"), F.col("_take.w").alias("mix_words"), F.col("_take.t").alias("mix_position"))
    return out.sort("mix_position", *([id_col] if docs.columns.count(id_col) == 1 else []))


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[rank % 3 + 1] AS weight, ([-0.5, 0.0, 0.5]::DOUBLE[])[rank % 3 + 1] AS slope, words * 2.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, (sum(words) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, rank) AS place FROM weighed
), opened AS (
  SELECT *, (SELECT arg_min(level, place) FROM levels WHERE cap > level * weight) AS open FROM levels
), targets AS (
  SELECT source, words, slope, CASE WHEN cap <= level * weight OR open IS NULL THEN cap ELSE open * weight END AS target FROM opened
), ordered AS (
  SELECT s.doc_id, s.size, t.words, t.target, t.slope, round(t.target)::BIGINT AS demand,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(size, demand - before)) AS first, greatest(0, least(size, demand - words - before)) AS second, before / demand AS q FROM ordered
)
SELECT doc_id, size, words AS source_size, target, (first + second)::BIGINT AS taken,
       CASE WHEN first > 0 THEN round(CASE WHEN slope = 0 THEN q ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * q) - (1 - slope)) / (2 * slope) END, 6) + 0.0::DOUBLE END AS position
FROM taken
"""
