"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick five of six tokens in a row and ignore one.  The hashes
of all masked windows of the documents are joined with those of the benchmark
items; each hit names a diagonal (document position minus item position).  Along
every diagonal with a hit the tokens are compared one by one, and an item is
found where a window of ``WINDOW`` of its words (all of them, if it has fewer)
agrees in at least 80 % of its places.  The masks miss no pattern of two
substitutions in 13 words; shorter items have masks of four words of their own, which
miss no pattern that the threshold allows.  The tests go through them one by one.
Items of fewer than ``shortest`` words are left out: a phrase of few words is in many
clean documents.  Where ``shortest`` lets them in, items of up to four words are
sought word for word and those of five with any four.  Documents are hashed under
the shorter masks only where the benchmark has such items.

Hashes are computed inside array functions and exploded as plain longs.  The
diagonals that are hit are written first, a few narrow rows; up to a measured number
of them they are broadcast, as is the benchmark, and no text is shuffled; beyond it
both are shuffle joins.

Defined cases: null texts match nothing; items with equal words are found together;
repeated rows are found alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small, text_of, words, written

#: Token positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 5))
#: Those of items with fewer words than a window.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
#: Those of items of up to five words.
TINY_MASKS = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 3), (0, 2, 3))}
ALL_MASKS = tuple(dict.fromkeys([*MASKS, *SHORT_MASKS, *(m for masks in TINY_MASKS.values() for m in masks)]))
SHORTEST_ITEM = 6
WINDOW = 13
AGREE = 0.8


def token_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(tokens: Column, masks: tuple = MASKS) -> Column:
    """The hash of every mask at every position, masks innermost.

    ``tokens`` must be a column of its own; masks that overhang the end are null.
    """
    spans = [1 + m[-1] for m in masks]

    def one(mask: tuple[int, ...], span: int, i: Column) -> Column:
        h = F.xxhash64(F.lit(ALL_MASKS.index(mask)), *[F.get(tokens, i + o) for o in mask])
        return h if span == min(spans) else F.when(i + span <= F.size(tokens), h)

    last = F.size(tokens) - min(spans)
    at = lambda i: F.array(*[one(mask, span, i) for mask, span in zip(masks, spans)])
    return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)))


def _placed(df: DataFrame, *keep: str, masks: tuple = MASKS) -> DataFrame:
    """One row per seed: the columns ``keep``, ``_pos`` and ``_seed``."""
    # the outer form keeps Spark from deriving a filter that would compute the array twice
    out = df.select(*keep, F.posexplode_outer(seeds(F.col("_tokens"), masks)).alias("_k", "_seed")).where("_seed IS NOT NULL")
    return out.select(*keep, F.floor(F.col("_k") / F.lit(len(masks))).cast("int").alias("_pos"), "_seed")


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per different token sequence: ``_item``, ``_items`` (ids), ``_words``."""
    rows = benchmark.select(F.col(item_col).alias("_id"), token_hashes(text_of(text_col)).alias("_words"))
    return rows.groupBy("_words").agg(F.array_sort(F.collect_set("_id")).alias("_items")).withColumn("_item", F.xxhash64("_words"))


def masks_for(size: int) -> tuple:
    """The masks for items of ``size`` words (WINDOW stands for more, too)."""
    return MASKS if size >= WINDOW else TINY_MASKS.get(size, SHORT_MASKS)


def matched_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, agree: float = AGREE, shortest: int = SHORTEST_ITEM) -> DataFrame:
    """One row per document and found item: ``_id``, ``_th``, ``_items``, best window, agreeing words, position."""
    items = written(benchmark_items(benchmark), "items")
    tokens = items.withColumnRenamed("_words", "_tokens")
    size = F.least(F.size("_tokens"), F.lit(WINDOW))
    sizes = [r[0] for r in tokens.where(size >= max(1, shortest)).select(size).distinct().collect()]  # at most WINDOW rows
    by_masks: dict[tuple, list[int]] = {MASKS: [WINDOW]}
    for n in sorted(sizes):
        by_masks.setdefault(masks_for(n), []).append(n)
    theirs = [_placed(tokens.where(size.isin(ns)), "_item", masks=masks) for masks, ns in by_masks.items()]
    masks = tuple(dict.fromkeys(m for group in by_masks for m in group))
    theirs = reduce(DataFrame.unionByName, theirs)
    theirs = written(theirs.withColumnsRenamed({"_pos": "_at", "_seed": "_theirs"}), "seeds")
    text = text_of(text_col)
    ours = _placed(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), token_hashes(text).alias("_tokens")), "_id", "_th", masks=masks)
    hits = ours.join(small(theirs), F.col("_seed") == F.col("_theirs"))
    diagonals = hits.select(F.col("_id").alias("_hid"), F.col("_th").alias("_hth"), F.col("_item").alias("_hitem"), (F.col("_pos") - F.col("_at")).alias("_diagonal")).distinct()
    named = written(diagonals, "diagonals")
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text"))
    pairs = texts.join(small(named), F.col("_hid").eqNullSafe(F.col("_id")) & (F.col("_hth") == F.col("_th")))
    pairs = pairs.join(small(items), F.col("_hitem") == F.col("_item"))
    pairs = pairs.select("_id", "_th", "_item", "_items", "_diagonal", "_words", token_hashes(F.col("_text")).alias("_tokens"))
    place = F.when(F.col("_diagonal") >= 0, F.col("_diagonal")).otherwise(0)
    # agreement word by word along the diagonal; overhanging words disagree
    over = F.greatest(-F.col("_diagonal"), F.lit(0))
    ours_there = F.slice("_tokens", F.greatest(F.col("_diagonal"), F.lit(0)) + 1, F.size("_words") - over)
    theirs_there = F.slice("_words", over + 1, F.size("_words"))
    agreeing = F.zip_with(ours_there, theirs_there, lambda a, b: F.when(a.eqNullSafe(b), 1).otherwise(0))
    same = F.concat(F.array_repeat(F.lit(0), over), agreeing)
    pairs = pairs.select("_id", "_th", "_item", "_items", place.cast("long").alias("_place"), same.alias("_same"))
    size = F.least(F.size("_same"), F.lit(window))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(1), F.size("_same") - size + 1), lambda s: total(F.slice("_same", s, size)))
    pairs = pairs.select("_id", "_th", "_item", "_items", "_place", total("_same").alias("_agree"), F.size("_same").alias("_length"), size.alias("_window"), F.array_max(sums).alias("_best"))
    found = pairs.where(F.col("_best") >= F.col("_window") * F.lit(agree))
    best = F.max(F.struct("_agree", "_best", F.negate("_place").alias("p"), "_length")).alias("_b")
    return found.groupBy("_id", "_th", "_item").agg(F.first("_items").alias("_items"), best)


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document and benchmark item found in it."""
    found = matched_windows(docs, benchmark, **how)
    return found.select(
        F.col("_id").alias("doc_id"), F.explode("_items").alias("item_id"), F.col("_b._agree").cast("long").alias("words_matched"), F.col("_b._length").cast("long").alias("item_words"),
        F.col("_b._best").cast("long").alias("best_window"), (-F.col("_b.p")).alias("doc_position"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those in which a benchmark item is found."""
    found = matched_windows(docs, benchmark, id_col, text_col, **how).select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth")).distinct()
    found = small(written(found, "contaminated"))
    return docs.join(found, docs[id_col].eqNullSafe(found["_fid"]) & (F.xxhash64(text_of(docs[text_col])) == found["_fth"]), "left_anti")


#: Brute force, without seeds: every pair of equal tokens votes for its diagonal.
DECONTAM_SQL = r"""
WITH ours AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
              FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents)),
theirs AS (SELECT item_id, len(t) AS n, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
           FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM benchmark)),
agree AS (SELECT doc_id, item_id, n, o.pos - t.pos AS diagonal, t.pos FROM ours o JOIN theirs t ON o.tok = t.tok),
windows AS (SELECT doc_id, item_id, n, diagonal, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS best FROM agree),
diagonals AS (SELECT doc_id, item_id, n, diagonal, max(best) AS best, count(*) AS matched FROM windows GROUP BY ALL HAVING max(best) >= 0.8 * least(n, 13)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, best DESC, greatest(diagonal, 0)) AS place FROM diagonals)
SELECT doc_id, item_id, matched AS words_matched, n::BIGINT AS item_words, best AS best_window, greatest(diagonal, 0)::BIGINT AS doc_position
FROM placed WHERE place = 1
"""
