"""Near-duplicate classes by BagMinHash.

Texts are multisets of five-word shingles.  Their weighted Jaccard similarity is
estimated by BagMinHash signatures: every shingle carries Poisson processes over
its discretised weight, split into dyadic blocks [0,1), [1,2), [2,4), ... whose
points are thinned by their place in the block; each point names one of
``REGISTERS`` registers, a register keeps its earliest point, and a process stops
when its time passes the latest register.  Two signatures agree in a register
with probability equal to the similarity.

Signatures are cut into bands.  Texts that share a band meet at a leader of that
band's bucket (one row per member, never all pairs), and the pair's multiset
overlap is verified exactly.  Verified links form connected components by
alternating large-star and small-star steps.  A second round chooses other
leaders for buckets that still hold more than one component.  What that leaves
open is settled exactly, so that a link between two followers isn't lost: texts
of open buckets are joined on the rarest fifth of their shingles, of which two
texts at similarity 0.8 must share one: with a leader of each shingle first, then
with one another, and the pairs of different components are verified like the
others.  Equal texts are folded before, so a group of
copies is one row here.

With 24 bands of 4 rows a pair at similarity 0.8 shares no band with probability
(1 - 0.8^4)^24 = 3e-6.

Defined cases: texts of fewer than five words have one shingle of all their
words; texts without words are duplicates only of identical texts; rows with a
null id are a class of their own (class id null); rows that share an id share a
class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import in_batches, small, text_of, words, written

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
SHINGLE = 5
SIMILAR = 0.8
ROUNDS = 2
#: Tokens that a Python worker handles at a time (a longer text is a slice of its own).
SLICE_TOKENS = 100_000
#: What Spark hands a Python worker at a time.
BATCH_BYTES = 4 << 20

_U = np.uint64
_MULTIPLIER, _GOLDEN = _U(0x9E3779B97F4A7C15 | 1), _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (its fixed multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingle_counts(tokens: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of token lists given by ``offsets``."""
    lengths = np.diff(offsets)
    windows = np.where(lengths > 0, np.maximum(lengths - (k - 1), 1), 0)
    doc = np.repeat(np.arange(len(lengths)), windows)
    start = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
    end = offsets[1:][doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    if len(doc):
        values = tokens.astype(np.int64).view(np.uint64)
        for o in range(k):
            at = start + o
            h = mix64(h * _MULTIPLIER + np.where(at < end, values[np.minimum(at, len(values) - 1)], _U(0)) + _U(1))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate((at, [len(doc)])))


def bag_min_hash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs x registers); rows of empty documents stay infinite."""
    blocks = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    rate = np.where(block == 0, 1.0, 2.0 ** np.maximum(block - 1, 0))
    low = np.where(block == 0, 0.0, rate)
    limit = count[which].astype(np.float64)
    seed = mix64(h[which] + (block.astype(np.uint64) + _U(1)) * _GOLDEN)
    owner, time = doc[which], np.zeros(len(which))
    signature = np.full(n_docs * registers, np.inf)
    step = 0
    while len(owner):
        step += 1
        draw = mix64(seed + _U(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(_unit(draw)) / rate
        draw = mix64(draw + _GOLDEN)
        register = (draw >> _U(32)).astype(np.int64) % registers
        level = low + rate * (mix64(draw + _GOLDEN) >> _U(11)).astype(np.float64) * 2.0**-53
        inside = level < limit
        np.minimum.at(signature, (owner * registers + register)[inside], time[inside])
        latest = np.full(n_docs, -1.0)
        present = np.unique(owner)
        latest[present] = signature.reshape(n_docs, registers)[present].max(axis=1)
        on = time < latest[owner]
        owner, time, seed, rate, low, limit = owner[on], time[on], seed[on], rate[on], low[on], limit[on]
    return signature.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.view(np.uint64).reshape(len(signature), bands, -1)
    h = np.arange(bands, dtype=np.uint64)[None, :] + _U(1)
    for r in range(parts.shape[2]):
        h = mix64(h * _MULTIPLIER + parts[:, :, r])
    return h.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact multiset similarity of two token lists' shingles."""
    doc, h, n = shingle_counts(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    left, right = doc == 0, doc == 1
    _, ia, ib = np.intersect1d(h[left], h[right], assume_unique=True, return_indices=True)
    both = np.minimum(n[left][ia], n[right][ib]).sum()
    return float(both / (n.sum() - both)) if len(n) else 0.0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their tokens, offsets of these) in slices of at most SLICE_TOKENS tokens, or one text."""
    for batch in batches:
        tokens = batch.column("tokens")
        offsets, values = tokens.offsets.to_numpy().astype(np.int64), tokens.values.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_TOKENS, side="right")) - 1)
            yield batch.slice(at, to - at), values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, tokens, own in _slices(batches):
        hashes = band_hashes(bag_min_hash(*shingle_counts(tokens, own), len(rows)))
        empty = np.diff(own) == 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(empty, 0, BANDS)))), type=pa.int32()), pa.array(hashes[~empty].ravel(), type=pa.int64()))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "k1", "k2")), lists], names=["id", "k1", "k2", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle occurrence; the n-th occurrence is an element of its own, so multiset overlap is set overlap."""
    for rows, tokens, own in _slices(batches):
        doc, h, n = shingle_counts(tokens, own)
        which = np.repeat(np.arange(len(doc)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        element = mix64(h[which] + nth.astype(np.uint64) * _GOLDEN).view(np.int64)
        owner = doc[which]
        sizes = np.bincount(owner, minlength=len(rows))
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays([rows.column("id").take(at), rows.column("root").take(at), pa.array(sizes[owner]), pa.array(element)], names=["id", "root", "size", "element"])


def open_pairs(shared: DataFrame, roots: DataFrame, tokens: DataFrame, similar: float, settle: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame | None:
    """(``id``, ``leader``) of every pair in different components that can be similar, of texts in buckets with several components.

    Prefix filter: a text of n elements overlaps a similar one in ``similar`` * n of
    them or more, so the pair shares one of the rarest n - ceil(similar * n) + 1.
    Elements of one text alone only use up places of that prefix.  The first element
    that a pair shares must also leave enough behind it in both texts.

    Many texts that are alike share many elements, so all their pairs at once would grow with the
    square of the group.  Members of each element therefore meet one leader first, a
    row per member; ``settle`` verifies these pairs and gives the roots that follow (None: as before).
    What is paired at last are members that even so lie in different components.
    """
    held = shared.join(roots, F.col("id") == F.col("node"), "left").select("id", "bucket", F.coalesce("root", "id").alias("root"))
    several = held.groupBy(F.col("bucket").alias("b")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("b")
    unsettled = written(held.join(several, F.col("bucket") == F.col("b"), "left_semi").select("id", "root").distinct(), "open")
    if unsettled.isEmpty():
        return None
    rest = tokens.join(unsettled, F.col("tid") == F.col("id")).select("id", "root", "tokens")
    with in_batches(rest.sparkSession, BATCH_BYTES):
        elements = written(rest.mapInArrow(_elements, "id long, root long, size long, element long"), "elements")
    frequent = elements.groupBy(F.col("element").alias("common")).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    known = elements.join(frequent, F.col("element") == F.col("common")).select("id", "root", "size", "element", "texts")
    of_text = Window.partitionBy("id")
    ranked = known.select("*", F.count(F.lit(1)).over(of_text).alias("shared"), F.row_number().over(of_text.orderBy("texts", "element")).alias("place"))
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(similar) - F.lit(1e-9)) + 1
    placed = ranked.withColumn("at", F.col("place") + F.col("size") - F.col("shared")).where(F.col("at") <= prefix)
    prefixes = written(placed.select("id", "size", "element", "at"), "prefixes")

    def rooted() -> DataFrame:
        of = roots.select(F.col("node").alias("rn"), F.col("root").alias("rr"))
        return prefixes.join(of, F.col("id") == F.col("rn"), "left").select("id", F.coalesce("rr", "id").alias("root"), "size", "element", "at")

    def enough(size: Column, at: Column, osize: Column, oat: Column) -> Column:
        """Whether two texts can be similar whose first shared element is at these places: no more can be shared than what follows it in either."""
        return F.least(size - at, osize - oat) + 1 >= F.ceil((size + osize) * F.lit(similar / (1 + similar)) - F.lit(1e-9))

    for turn in range(ROUNDS if settle else 0):
        held = rooted()
        rank = F.xxhash64(F.lit(ROUNDS + turn), "id").alias("rank")
        lead = held.groupBy(F.col("element").alias("e")).agg(F.min(F.struct(rank, "id", "root", "size", "at")).alias("lead"))
        near = held.join(lead, F.col("element") == F.col("e")).where(F.col("root") != F.col("lead.root"))
        near = near.where(enough(F.col("size"), F.col("at"), F.col("lead.size"), F.col("lead.at")))
        now = settle(near.select(F.greatest("id", "lead.id").alias("id"), F.least("id", "lead.id").alias("leader")).distinct())
        if now is None:
            break
        roots = now
    kept = written(rooted(), "open-prefixes")
    # of two members in different components one at least is outside the element's largest component
    per_root = kept.groupBy(F.col("element").alias("e"), F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    largest = per_root.groupBy("e").agg(F.max(F.struct("n", "r")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1").select("e", F.col("top.r").alias("r"))
    crossing = kept.join(largest, F.col("element") == F.col("e"))
    outside = crossing.where("root <> r").select(F.col("id").alias("oid"), F.col("root").alias("oroot"), F.col("size").alias("osize"), F.col("element").alias("oe"), F.col("at").alias("oat"))
    close = enough(F.col("size"), F.col("at"), F.col("osize"), F.col("oat"))
    both = crossing.select("id", "root", "size", "element", "at").join(outside, (F.col("element") == F.col("oe")) & (F.col("root") != F.col("oroot")) & close)
    return both.select(F.greatest("id", "oid").alias("id"), F.least("id", "oid").alias("leader")).distinct()


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaders = batch.column("id"), batch.column("leader")
            a, b = batch.column("ours"), batch.column("theirs")
            ao, av, bo, bv = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False), b.offsets.to_numpy(), b.values.to_numpy(zero_copy_only=False)
            score = np.array([weighted_jaccard(av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]) for i in range(len(batch))])
            yield pa.RecordBatch.from_arrays([ids, leaders, pa.array(score >= similar)], names=["id", "leader", "linked"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node in ``links`` (``u``, ``v``); the root is the smallest node.

    Alternating star contraction, each step a table in the shared folder.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, F.col("u") == F.col("c"))
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select("v", "m").union(least.select(F.col("c").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()

    def stars(edges: DataFrame) -> bool:
        """Whether every component is a star by now: no node has two neighbours below it, or one below and one above."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("n"))
        return seen.where("ups > 1 OR (ups > 0 AND n > ups)").isEmpty()

    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not stars(edges):
        edges = written(star(star(edges, True), False), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with the components that ``links`` (``u``, ``v``) join made one: only roots meet, not their members."""
    root = lambda c: roots.select(F.col("node").alias(f"{c}n"), F.col("root").alias(f"{c}r"))
    between = links.join(root("u"), F.col("u") == F.col("un"), "left").join(root("v"), F.col("v") == F.col("vn"), "left")
    joined = written(components(between.select(F.coalesce("ur", "u").alias("u"), F.coalesce("vr", "v").alias("v"))), "joined")
    new = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return moved.unionByName(joined.join(roots.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of its class), ``text_id`` (smallest id with equal words)."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("_text"), F.transform(words(text), lambda w: F.xxhash64(w)).alias("tokens"))
    key = lambda salt: F.when(F.size("tokens") > 0, F.xxhash64(F.lit(salt), "tokens")).otherwise(F.xxhash64(F.lit(salt + 10), "_text"))
    signed = base.select("id", key(1).alias("k1"), key(2).alias("k2"), "tokens").mapInArrow(_sign, "id long, k1 long, k2 long, bands array<long>")
    with in_batches(docs.sparkSession, BATCH_BYTES):
        members = written(signed, "signatures")
    named = members.where("id IS NOT NULL")
    texts = written(named.groupBy("k1", "k2").agg(F.min("id").alias("text_id")), "texts")
    heads = named.join(texts.select(F.col("text_id").alias("tid"), F.col("k1").alias("t1"), F.col("k2").alias("t2")), (F.col("id") == F.col("tid")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left_semi")
    buckets = heads.select("id", F.posexplode("bands").alias("band", "h"))
    counted = buckets.groupBy(F.col("band").alias("cb"), F.col("h").alias("ch")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = written(buckets.join(counted, (F.col("band") == F.col("cb")) & (F.col("h") == F.col("ch"))).select("id", F.xxhash64("band", "h").alias("bucket")), "buckets")
    tokens = written(docs.select(F.col(id_col).cast("long").alias("tid"), F.transform(words(text), lambda w: F.hash(w)).alias("tokens")).join(shared.select("id").distinct(), F.col("tid") == F.col("id"), "left_semi"), "tokens")

    tested = roots = None

    def verified(pairs: DataFrame) -> DataFrame:
        if tested is not None:
            done = tested.select(F.col("id").alias("did"), F.col("leader").alias("dleader"))
            pairs = pairs.join(done, (F.col("id") == F.col("did")) & (F.col("leader") == F.col("dleader")), "left_anti")
        ours = pairs.join(tokens.withColumnRenamed("tokens", "ours"), F.col("id") == F.col("tid")).drop("tid")
        both = ours.join(tokens.withColumnRenamed("tokens", "theirs"), F.col("leader") == F.col("tid")).drop("tid")
        with in_batches(docs.sparkSession, BATCH_BYTES):
            return written(both.select("id", "leader", "ours", "theirs").mapInArrow(_verify(similar), "id long, leader long, linked boolean"), "verified")

    for turn in range(ROUNDS):
        # each round has leaders of its own
        rank = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
        if roots is None:
            held = shared.select("id", "bucket", F.col("id").alias("root"))
        else:
            held = shared.join(roots, F.col("id") == F.col("node"), "left").select("id", "bucket", F.coalesce("root", "id").alias("root"))
        lead = held.groupBy(F.col("bucket").alias("b")).agg(F.min(F.struct(rank.alias("rank"), F.col("id").alias("id"), F.col("root").alias("root"))).alias("lead"))
        pairs = held.join(lead, F.col("bucket") == F.col("b")).where(F.col("root") != F.col("lead.root"))
        pairs = pairs.select(F.greatest("id", "lead.id").alias("id"), F.least("id", "lead.id").alias("leader")).distinct()
        result = verified(pairs)
        tested = result if tested is None else tested.unionByName(result)
        new = result.where("linked").select(F.col("id").alias("u"), F.col("leader").alias("v"))
        if turn and new.isEmpty():
            break
        roots = written(components(new) if roots is None else merged(roots, new), "roots")

    def settle(pairs: DataFrame) -> DataFrame | None:
        nonlocal tested, roots
        result = verified(pairs)
        tested = tested.unionByName(result)
        new = result.where("linked").select(F.col("id").alias("u"), F.col("leader").alias("v"))
        if new.isEmpty():
            return None
        roots = written(merged(roots, new), "roots")
        return roots

    if (pairs := open_pairs(shared, roots, tokens, similar, settle)) is not None:
        settle(pairs)
    by_text = texts.join(roots, F.col("text_id") == F.col("node"), "left").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "text_id", F.coalesce("root", "text_id").alias("class_id"))
    found = named.join(by_text, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))).select(F.col("id").alias("doc_id"), "class_id", "text_id")
    alone = members.where("id IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("text_id"))
    return found.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id, once (of rows
    that share this id, one by its text's hash); rows with a null id all stay."""
    classes = near_classes(docs, id_col, text_col, similar)
    classes = written(classes, "classes")
    gone = small(written(classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    left = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    heads = classes.where(F.col("doc_id") == F.col("class_id")).groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("_times"))
    again = written(heads.where("_times > 1").select("_again"), "again")
    if again.isEmpty():
        return left
    # only rows of repeated ids are numbered, so null ids and other texts travel no further
    rows = left.join(again, docs[id_col] == again["_again"], "left_semi")
    rows = rows.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[id_col].alias("_did"), text_of(docs[text_col]).alias("_dtext"))
    turn = F.row_number().over(Window.partitionBy("_did").orderBy(F.xxhash64("_dtext"), "_dtext"))
    one = rows.withColumn("_dturn", turn).where("_dturn = 1").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
    return left.join(again, docs[id_col] == again["_again"], "left_anti").unionByName(one)
