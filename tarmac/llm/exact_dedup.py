"""Exact dedup with an extendible-hash index kept in shared files.

Build: texts are hashed to 64 bits; the directory starts with one bucket and is
doubled until no bucket holds more than ``capacity`` distinct hashes, so its depth
follows the number of documents and an owner's share doesn't grow with them (beyond
2**MAX_DEPTH slots, which is some 10**10 documents, the capacity grows instead).  Map tasks first fold their own copies into one row, so a
text that a third of all rows hold leaves each task once.  Owner tasks then take
one bucket each - a range of hash prefixes - in hash order, compare the bytes of
texts that collide, and chain different ones under the same hash.  The index
entries are written as Parquet files by bucket in the shared folder.

Probe: every document looks its entry up by hash and chain member (SHA-256, set
apart by the byte comparison of the build); only keys travel.

Defined cases: null counts as empty text; of rows with a null id none is kept
unless the whole group's ids are null; rows that repeat both id and text count
each and are kept alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import shared_path, text_of, written

#: The directory, which the driver builds and every task reads, has at most 2**MAX_DEPTH slots.
MAX_DEPTH = 20
#: A map task folds copies within this many bytes of text at a time.
FOLD_BYTES = 32 << 20


class Directory:
    """Extendible-hash directory over the top bits of a 64-bit hash."""

    def __init__(self, counts: dict[int, int], capacity: int, max_depth: int = 12):
        """``counts``: keys per prefix of ``max_depth`` bits."""
        self.max_depth = max_depth
        sums = [0]
        for prefix in range(1 << max_depth):
            sums.append(sums[-1] + counts.get(prefix, 0))
        self.depth = 0
        self.buckets: list[tuple[int, int]] = []  # (local depth, prefix)
        todo = [(0, 0)]
        while todo:
            local, prefix = todo.pop()
            width = max_depth - local
            held = sums[(prefix + 1) << width] - sums[prefix << width]
            if held > capacity and local < max_depth:  # overfull: split, doubling the directory where it has no spare bit
                self.depth = max(self.depth, local + 1)
                todo += [(local + 1, prefix << 1 | 1), (local + 1, prefix << 1)]
            else:
                self.buckets.append((local, prefix))
        self.slots = [0] * (1 << self.depth)
        for bucket, (local, prefix) in enumerate(self.buckets):
            spare = self.depth - local
            for slot in range(prefix << spare, (prefix + 1) << spare):
                self.slots[slot] = bucket

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``bucket`` of their hash ``h``; each bucket is a partition of its own."""
        slots = rows.sparkSession.createDataFrame(pa.table({"slot": pa.array(range(len(self.slots)), pa.int32()), "bucket": pa.array(self.slots, pa.int32())}))
        top = F.shiftrightunsigned("h", 64 - self.depth).cast("int") if self.depth else F.lit(0)
        named = rows.withColumn("top", top).join(F.broadcast(slots), F.col("top") == F.col("slot")).drop("top", "slot")
        return named.repartitionById(len(self.buckets), "bucket")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in ("h", "sha", "body", "last", "n")])


def _emit(entries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*entries), schema)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all copies that a task meets within FOLD_BYTES of distinct text."""
    schema = pa.schema([("h", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("last", pa.int64()), ("n", pa.int64())])
    seen: dict[tuple, list] = {}
    held = 0
    for batch in batches:
        for h, sha, body, last, n in _rows(batch):
            entry = seen.get((h, body))
            if entry is None:
                seen[h, body] = [sha, last, n]
                held += len(body) + 200
            else:
                entry[1] = last if entry[1] is None or last is not None and last > entry[1] else entry[1]
                entry[2] += n
            if held > FOLD_BYTES:
                yield _emit([(k[0], v[0], k[1], v[1], v[2]) for k, v in seen.items()], schema)
                seen, held = {}, 0
    if seen:
        yield _emit([(k[0], v[0], k[1], v[1], v[2]) for k, v in seen.items()], schema)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in hash order: chain the different texts of a hash, comparing bytes."""
    schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("slot", pa.int32()), ("sha", pa.string()), ("last", pa.int64()), ("n", pa.int64())])
    now, bucket, chain, out = None, 0, [], []
    for batch in batches:
        for (h, sha, body, last, n), b in zip(_rows(batch), batch.column("bucket").to_pylist()):
            if h != now:
                out += [(bucket, now, slot, e[1], e[2], e[3]) for slot, e in enumerate(chain)]
                now, bucket, chain = h, b, []
            entry = next((e for e in chain if e[0] == body), None)
            if entry is None:
                chain.append([body, sha, last, n])
            else:
                entry[2] = last if entry[2] is None or last is not None and last > entry[2] else entry[2]
                entry[3] += n
        if len(out) >= 10_000:
            yield _emit(out, schema)
            out = []
    out += [(bucket, now, slot, e[1], e[2], e[3]) for slot, e in enumerate(chain)]
    if out:
        yield _emit(out, schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000, hasher: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, Directory]:
    """(keys of all documents, index entries, directory).

    ``hasher`` gives 64-bit hashes; a weaker one lengthens the chains but changes no result.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("_text")).select("id", hasher(F.col("_text")).alias("h"), F.sha2("_text", 256).alias("sha"), F.col("_text").cast("binary").alias("body"))
    keys = written(base.select("id", "h", "sha"), "keys")
    bits = min(MAX_DEPTH, math.ceil(math.log2(max(1.0, keys.count() / capacity))) + 3)
    prefix = F.shiftrightunsigned("h", 64 - bits).cast("int")
    counted = keys.select("h").distinct().groupBy(prefix.alias("p")).count().collect()  # at most 2**bits rows
    counts = {r["p"]: r["count"] for r in counted}
    directory = Directory(counts, max(capacity, 4 * sum(counts.values()) >> MAX_DEPTH), bits)
    rows = base.select("h", "sha", "body", F.col("id").alias("last"), F.lit(1).cast("long").alias("n"))
    folded = rows.mapInArrow(_fold, "h long, sha string, body binary, last long, n long")
    owned = directory.placed(folded).sortWithinPartitions("h")
    path = shared_path(spark, "index")
    owned.mapInArrow(_chain, "bucket int, h long, slot int, sha string, last long, n long").write.partitionBy("bucket").parquet(path)
    entries = spark.read.schema("h long, slot int, sha string, last long, n long, bucket int").parquet(path)
    return keys, entries, directory


def exact_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, and its index bucket."""
    keys, entries, _ = build_index(docs, **how)
    entries = entries.select(F.col("h").alias("eh"), F.col("sha").alias("esha"), "last", "n", "bucket")
    found = keys.join(entries, (keys["h"] == entries["eh"]) & (keys["sha"] == entries["esha"]))
    return found.select(F.col("id").alias("doc_id"), F.col("last").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("last")).alias("kept"), F.col("sha").alias("text_sha256"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
