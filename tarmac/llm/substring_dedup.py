"""Substring dedup over sliding spans of sentences.

Texts are cut into sentences; those of more than ``LONG_SENTENCE`` words are cut after
the word of the least hash in every window of as many words (winnowing), so that no
piece is longer and equal passages are cut alike wherever they stand.  Of 50 words that
two texts share, with their sentence ends and line breaks, at most 15 at either end lie
in pieces that differ; the 20 or more between them are whole pieces, at least two, and
so hold a span.  From every sentence the shortest run of at least
``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words is hashed to 96 bits.  All
occurrences of a hash meet in a grouped aggregation that keeps the smallest
document and the count; sentences covered by any other occurrence (in another
document, or later in the same one) are removed.

The spans, one narrow row per sentence of fixed-width columns, are written once; a
span that a third of all documents share is one row per map task in the
aggregation, and the spans that occur most often are broadcast in the join that
finds their places, so no task gets all of one.

Defined cases: null and empty texts have no sentence; texts shorter than a run
lose nothing; words are what stands between blanks and holds a letter or digit; of equal
hashes in a window the last one cuts; passages whose line breaks or sentence ends differ
meet only between these; a null id comes after all ids; rows that share an id, and rows
without one, count as one document: a span's copies in them are all first (exact
dedup is another operator's task).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import join_counted, text_of, written

MIN_SENTENCES = 2
MIN_WORDS = 20
#: Sentences of more words are cut, after the least hash of every window of as many words.
#: Any 50 shared words hold a span while twice this and MIN_WORDS are at most 50.
LONG_SENTENCE = 15

_WORD = re.compile(r"\S+")
_NOISE = re.compile(r"[\W_]+")


class _Kinds(dict):
    """What a lower-cased character counts as: letters and digits stay, ``.`` is an end of
    a sentence, a line break stays, other blanks are a space and all else is ``_``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = c if c == "\n" or not _NOISE.match(c) else "." if c in ".!?" else " " if c.isspace() else "_"
        return kind


_KINDS = _Kinds()


def _least(ranks: list[int], window: int) -> list[int]:
    """Places of the least rank in every window, in order; of equal ones the last."""
    places, low = [], -1
    for end in range(window - 1, len(ranks)):
        start = end - window + 1
        if low < start:
            part = ranks[start : end + 1]
            low = end - part[::-1].index(min(part))
        elif ranks[end] <= ranks[low]:
            low = end
        else:
            continue
        places.append(low)
    return places


def _winnowed(part: str, tokens: list[str]) -> list[tuple[int, list[str]]]:
    """(words before it, tokens) of each piece of a sentence; words without a letter or digit don't count."""
    ranks = [zlib.crc32(w) for w in part.replace("_", "").replace(".", "").encode().split()]
    cuts = [k + 1 for k in _least(ranks, LONG_SENTENCE)] if len(ranks) > LONG_SENTENCE else []
    if len(ranks) < len(tokens):  # some word holds several tokens
        held = [t for w in part.split() if (t := w.replace("_", " ").replace(".", " ").split())]
        pieces = [(a, list(chain.from_iterable(held[a:b]))) for a, b in zip([0, *cuts], [*cuts, None])]
    else:
        pieces = [(a, tokens[a:b]) for a, b in zip([0, *cuts], [*cuts, None])]
    return pieces if pieces[-1][1] else pieces[:-1]


def _pieces(text: str) -> tuple[list[str], list[int], list[str], list[tuple[int, int]]]:
    """Normalised texts and numbers of words of the pieces, in order; the parts of the text
    between sentence ends, by their kinds; and (part, words before it there) of each piece."""
    marked = text.lower().translate(_KINDS).replace(". ", ".\n")
    parts = marked.split("\n")
    norms: list[str] = []
    counts: list[int] = []
    where: list[tuple[int, int]] = []
    for k, plain in enumerate(marked.replace("_", " ").replace(".", " ").split("\n")):
        tokens = plain.split()
        if len(tokens) > LONG_SENTENCE:
            for before, piece in _winnowed(parts[k], tokens):
                norms.append(" ".join(piece))
                counts.append(len(piece))
                where.append((k, before))
        elif tokens:
            norms.append(" ".join(tokens))
            counts.append(len(tokens))
            where.append((k, 0))
    return norms, counts, parts, where


class _Places:
    """Where the pieces of a text lie in it."""

    def __init__(self, text: str, parts: list[str], where: list[tuple[int, int]]):
        if "\u0130" in text:  # the one character that grows when lower-cased
            parts = text.replace("\u0130", "i").lower().translate(_KINDS).replace(". ", ".\n").split("\n")
        self.text, self.parts, self.where = text, parts, where
        self.at = [0, *accumulate(len(p) + 1 for p in parts)]
        self.cut: tuple[int, list[int]] = (-1, [])

    def _ends(self, k: int) -> list[int]:
        """Ends of the words with a letter or digit in part ``k``."""
        if self.cut[0] != k:
            at = self.at[k]
            self.cut = (k, [m.end() for m in _WORD.finditer(self.text, at, at + len(self.parts[k])) if not _NOISE.fullmatch(m[0])])
        return self.cut[1]

    def start(self, i: int) -> int:
        k, before = self.where[i]
        if before:
            return self._ends(k)[before - 1]
        part, last = self.parts[k], k - 1
        while last >= 0 and not self.parts[last].strip():
            last -= 1
        blanks = len(part) - len(part.lstrip()) if last >= 0 and self.parts[last][-1] == "." else 0
        return self.at[k] + blanks

    def stop(self, i: int) -> int:
        k, _ = self.where[i]
        if i + 1 < len(self.where) and self.where[i + 1][0] == k:
            return self._ends(k)[self.where[i + 1][1] - 1]
        return self.at[k] + len(self.parts[k])


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised, words) of each sentence, in order."""
    norms, counts, parts, where = _pieces(text)
    lie = _Places(text, parts, where)
    return [(lie.start(i), lie.stop(i), norm, n) for i, (norm, n) in enumerate(zip(norms, counts))]


def _runs(counts: list[int], min_sentences: int, min_words: int) -> list[int]:
    """Ends of the shortest runs that are long enough, from each sentence that begins one."""
    ends, end, words = [], 0, 0
    for i, own in enumerate(counts):
        while end - i < min_sentences or words < min_words:
            if end == len(counts):
                return ends
            words += counts[end]
            end += 1
        ends.append(end)
        words -= own
    return ends


def _hashed(norms: list[str], ends: list[int]) -> list[bytes]:
    """Hashes of the runs that begin at each sentence in turn and end before ``ends``."""
    whole, at = " ".join(norms), [0, *accumulate(len(n) + 1 for n in norms)]
    return [xxhash.xxh3_128_digest(whole[a : at[end] - 1])[:12] for a, end in zip(at, ends)]


def spans(found: list[tuple[int, int, str, int]], min_sentences: int, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentences, hash) of the shortest run from each sentence that is long enough."""
    ends = _runs([f[3] for f in found], min_sentences, min_words)
    for i, (end, h) in enumerate(zip(ends, _hashed([f[2] for f in found], ends))):
        yield i, end - i, h


_SPANS = "id long, th int, at int, n int, again boolean, h1 long, h2 int"


def _spans(min_sentences: int, min_words: int):
    def pack(batch: pa.RecordBatch, rows: list[int], ends: list[list[int]], hashes: list[bytes], again: list[bool]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(hashes), dtype=[("h1", "<i8"), ("h2", "<i4")])
        sizes = np.array([len(e) for e in ends])
        at = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        n = np.fromiter(chain.from_iterable(ends), np.int32, len(at)) - at
        row = pa.array(np.repeat(rows, sizes))
        columns = [batch.column("id").take(row), batch.column("th").take(row), at, n, again, np.ascontiguousarray(h["h1"]), np.ascontiguousarray(h["h2"])]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "th", "at", "n", "again", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            ends: list[list[int]] = []
            hashes: list[bytes] = []
            again: list[bool] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                norms, counts, _, _ = _pieces(text)
                if not (found := _runs(counts, min_sentences, min_words)):
                    continue
                own = _hashed(norms, found)
                if len(seen := set(own)) < len(own):
                    seen.clear()
                    again += [h in seen or seen.add(h) is not None for h in own]
                else:
                    again += [False] * len(own)
                rows.append(row)
                ends.append(found)
                hashes += own
                if len(hashes) > 50_000:
                    yield pack(batch, rows, ends, hashes, again)
                    rows, ends, hashes, again = [], [], [], []
            if rows:
                yield pack(batch, rows, ends, hashes, again)

    return run


def _cut(text: str, places: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(sentences, removed, text left) when the runs ``places`` go."""
    norms, _, parts, where = _pieces(text)
    gone = [False] * len(norms)
    for at, n in places:
        gone[at : at + n] = [True] * n
    lie, left, pos = _Places(text, parts, where), [], 0
    for i, out in enumerate(gone):
        if out:  # goes with the blanks after it
            if not (i and gone[i - 1]):
                left.append(text[pos : lie.start(i)])
            if i + 1 == len(gone) or not gone[i + 1]:
                pos = lie.start(i + 1) if i + 1 < len(gone) else len(text)
    left.append(text[pos:])
    return len(norms), sum(gone), "".join(left)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = batch.column("places")
        bounds, runs = places.offsets.to_pylist(), list(zip(*[places.values.field(n).to_pylist() for n in ("at", "n")]))
        rows = [_cut(t, runs[a:b]) for t, a, b in zip(batch.column("text").to_pylist(), bounds, bounds[1:])]
        total, gone, left = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), batch.column("first_ids"), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(left, type=pa.string())], names=["id", "th", "first_ids", "n_sentences", "n_removed", "kept_text"])


def substring_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document that loses sentences: id, th (text hash), ids of the
    documents that keep the first copies, sentences, removed ones, and the text left."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("th"), text.alias("text"))
    found = written(base.mapInArrow(_spans(min_sentences, min_words), _SPANS), "spans")
    # fixed-width keys and buffers keep this a hash aggregation
    first = found.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = written(first, "firsts")
    later = join_counted(found, first, {"h1": "f1", "h2": "f2"}, "times").where(F.col("again") | ~F.col("id").eqNullSafe(F.col("first")))
    runs = later.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("places"), F.array_sort(F.collect_set("first")).alias("first_ids"))
    return base.join(runs, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("id", "th", "text", "places", "first_ids").mapInArrow(_edit, "id long, th int, first_ids array<long>, n_sentences long, n_removed long, kept_text string")


def repeat_report(docs: DataFrame, **how) -> DataFrame:
    """The edit of every document that loses sentences; documents not listed stay as they are."""
    return substring_edits(docs, **how).select(F.col("id").alias("doc_id"), "first_ids", "n_sentences", "n_removed", "kept_text")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its own columns; texts without their repeated spans."""
    edits = substring_edits(docs, id_col, text_col, **how).select(F.col("id").alias("_eid"), F.col("th").alias("_eth"), F.col("kept_text").alias("_kept")).dropDuplicates(["_eid", "_eth"])
    joined = docs.join(edits, docs[id_col].eqNullSafe(edits["_eid"]) & (F.hash(text_of(docs[text_col])) == edits["_eth"]), "left")
    return joined.select(*[F.coalesce(edits["_kept"], docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])
