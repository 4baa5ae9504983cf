"""Line dedup: drop lines that many documents share.

Normalised lines are exploded and hashed to 128 bits, documents are counted per
hash with map-side partial aggregation, and lines of frequent hashes lose their
place in every document but the one with the largest id.  Only the
places of lines (id, position, hash), written once as a table, travel to the
counting and deciding steps; the text itself is shuffled
once, for the reassembly by position.  A line that a third of all documents
share is one row per map task in the count; the frequent hashes, or where they are
too many those that occur most often, are broadcast in the join that finds
their places, so no task gets all of one.

Defined cases: a null or empty text is one empty line; a null id counts as a
document and is smaller than any id, so it never holds the surviving copy unless
all ids of that line are null (then all of them do); rows that repeat an id and
a text are documents each, and share their fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import digest, join_counted, text_of, written

#: Characters stripped from both ends of a line (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (other letters kept)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _marks(text: Column, min_chars: int) -> Column:
    """(hash, position) of each line long enough to count, in order of hash."""

    def one(line: Column, pos: Column) -> Column:
        key = line_key(line)
        return F.struct(F.when(F.length(key) >= min_chars, digest(key)).alias("h"), pos.alias("pos"))

    return F.array_sort(F.filter(F.transform(F.split(text, "\n"), one), lambda x: x["h"].isNotNull()))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document that loses lines: ``_id``, ``_th`` (text hash), ``_drop`` (sorted positions)."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), _marks(text, min_chars).alias("_marks"))
    # a document counts once for a hash: at the first of its equal neighbours
    first = lambda x, i: F.struct(x["h"].alias("h"), x["pos"].alias("pos"), ((i == 0) | (F.get(F.col("_marks"), i - 1)["h"] != x["h"])).alias("first"))
    # the outer explode keeps Spark from deriving a filter that would compute the array twice
    places = base.select("_id", "_th", F.explode_outer(F.transform("_marks", first)).alias("_m")).where("_m IS NOT NULL")
    places = written(places.select("_id", "_th", F.col("_m.h").alias("_h"), F.col("_m.pos").alias("_pos"), F.col("_m.first").alias("_first")), "lines")
    frequent = places.where("_first").groupBy(F.col("_h").alias("_fh")).agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).where(F.col("_n") >= min_docs)
    lost = join_counted(places, written(frequent, "frequent"), {"_h": "_fh"}, "_n").where(~F.col("_id").eqNullSafe(F.col("_keep")))
    return lost.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))


def without(lines: Column, drop: Column) -> Column:
    """``lines`` less the sorted zero-based positions ``drop``: the runs between them, in order."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    ends = F.concat(drop, F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.flatten(runs)


def _joined(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, Column]:
    lost = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    same = docs[id_col].eqNullSafe(lost["_id"]) & (F.xxhash64(text_of(docs[text_col])) == lost["_th"])
    return docs.join(lost, same, "left"), lost["_drop"]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its own columns; texts without their repeated lines."""
    joined, drop = _joined(docs, id_col, text_col, min_chars, min_docs)
    cut = F.when(drop.isNotNull(), F.split(text_of(docs[text_col]), "\n"))
    # a column of its own, else it would be split anew for every run of lines
    rows = joined.select(*[docs[c].alias(f"_d{i}") for i, c in enumerate(docs.columns)], drop.alias("_drop"), cut.alias("_lines"))
    at = f"_d{docs.columns.index(text_col)}"
    kept = F.when(F.col("_drop").isNull(), F.col(at)).otherwise(F.array_join(without(F.col("_lines"), F.col("_drop")), "\n"))
    return rows.select(*[(kept if c == text_col else F.col(f"_d{i}")).alias(c) for i, c in enumerate(docs.columns)])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: id, ``n_lines``, ``n_dropped`` and ``kept_sha256`` of the text left."""
    joined, drop = _joined(docs, id_col, text_col, min_chars, min_docs)
    text = text_of(docs[text_col])
    left = joined.select(docs[id_col].alias("doc_id"), text.alias("_text"), drop.alias("_drop"), F.split(text, "\n").alias("_lines"))
    lines = F.col("_lines")
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(without(lines, F.col("_drop")), "\n"))
    return left.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND l.doc_id <> f.keep) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (f.key IS NULL OR l.doc_id = f.keep), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY l.doc_id
"""
