"""Language identification by Bayesian fusion of evidence.

log P(l | all) = log P(l | host) + log P(declared | l) + log P(suffix | l) + text

* text: tempered log likelihood of the text's character trigrams under a model per
  language, fitted on a bounded sample of labelled rows, and under a flat model
  for text in none of them ("und");
* declared: the language that the markup declares; its reliability is estimated
  from all rows by counting how often each language goes with each declaration;
* suffix: the last label of the host name, in the same way;
* host: a prior smoothed over levels, host -> registered domain -> all rows,
  from grouped aggregation of the languages that the texts alone suggest.

Texts are read once, by one task each; what is aggregated and joined after that is
one narrow row per document, and counts are aggregated map-side.

Defined cases: null or empty text, and text without letters, has no text evidence
and is rejected; a null host falls back on the prior of all rows; evidence that is
null is left out; repeated rows count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small, text_of, written

#: Documented bounds: text models are fitted on at most this many labelled rows, of texts of at most this many bytes.
TRAIN_DOCUMENTS = 3000
TRAIN_BYTES = 1 << 20
BUCKETS = 1 << 15
#: Text evidence counts as this many independent trigrams at most.
INDEPENDENT = 60
#: Strength of each level's prior, in rows.
SMOOTH = 20.0
UNKNOWN = "und"
KEEP_ABOVE = 0.5

_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_ENTITY = re.compile(r"&#?\w+;")


def plain(text: str) -> str:
    """Text without markup, lower-cased."""
    if "<" in text and ">" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return text.lower()


_LETTER = np.array([c.isalpha() for c in map(chr, range(0x10000))])


def trigrams(text: str) -> np.ndarray:
    """Buckets of all character trigrams that hold a letter; other characters count as one blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letters = np.where(points < 0x10000, _LETTER[np.minimum(points, 0xFFFF)], True)
    points = np.concatenate(([32], np.where(letters, points, 32), [32]))
    blank = points == 32
    keep = ~(blank & np.concatenate(([False], blank[:-1])))  # runs of blanks count once
    points = points[keep]
    if len(points) < 3 or not letters.any():
        return np.zeros(0, dtype=np.int64)
    h = (points[:-2] * 0x9E3779B1 + points[1:-1]) * 0x85EBCA6B + points[2:]
    return ((h ^ (h >> 15)) * 0xC2B2AE35 >> 12) & (BUCKETS - 1)


class TextModel:
    def __init__(self, languages: list[str], table: np.ndarray):
        """``table``: log probability of each bucket, one column per language, the last for UNKNOWN."""
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        languages = sorted({lang for _, lang in rows})
        counts = np.zeros((len(languages), BUCKETS))
        for text, lang in rows:
            counts[languages.index(lang)] += np.bincount(trigrams(plain(text)), minlength=BUCKETS)
        smooth = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True) if len(languages) else counts
        flat = np.full((1, BUCKETS), 1 / BUCKETS)
        return cls([*languages, UNKNOWN], np.log(np.vstack((smooth, flat))).T.copy())

    def evidence(self, text: str) -> list[float] | None:
        found = trigrams(plain(text))
        if not len(found):
            return None
        total = self.table[found].sum(axis=0)
        total = total * (min(INDEPENDENT, len(found)) / len(found))
        return (total - total.max()).tolist()


def training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = TRAIN_DOCUMENTS) -> list[tuple[str, str]]:
    """At most ``limit`` labelled rows, chosen by the hash of their id, one of each id; a quarter of all ids is held out."""
    usable = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_of(text_col)) <= TRAIN_BYTES)).where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2)
    chosen = usable.select(F.col(id_col).alias("_cid")).distinct().orderBy(F.xxhash64("_cid"), "_cid").limit(limit)
    rows = usable.join(F.broadcast(chosen), F.col(id_col) == F.col("_cid")).select("_cid", text_of(text_col).alias("_text"), F.lower(F.col(label_col).cast("string")).alias("_lang"))
    rows = rows.groupBy("_cid").agg(F.min(F.struct("_lang", "_text")).alias("_row")).select("_cid", "_row.*").collect()
    return [(r["_text"], r["_lang"]) for r in sorted(rows, key=lambda r: (r["_cid"], r["_lang"], r["_text"]))]


def declared_language(markup: Column) -> Column:
    """Primary tag of the first ``lang`` attribute of an html element, null without one."""
    tag = F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(tag != "", tag)


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain, suffix) of an absolute URL; null where there is no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    parts = F.split(host, r"\.")
    return host, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."), F.element_at(parts, -1)


def _score(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            scores = pa.array([model.evidence(t.as_py()) for t in texts], type=pa.list_(pa.float64()))
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], scores], names=[*keep, "score"])

    return run


def identify(docs: DataFrame, model: TextModel, id_col: str, text_col: str, host: Column, domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None) -> DataFrame:
    """Per row: ``_id``, ``_th`` (text hash), language, probability, text_language, declared, suffix, host."""
    none = F.lit(None).cast("string")
    part = [c if c is not None else none for c in (host, domain, suffix, declared)]
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), *[c.cast("string").alias(n) for c, n in zip(part, ("host", "domain", "suffix", "declared"))], text.alias("text"))
    scored = rows.mapInArrow(_score(model), "id long, th long, host string, domain string, suffix string, declared string, score array<double>")
    n = len(model.languages)
    scored = written(scored, "language").withColumn("best", F.when(F.col("score").isNotNull(), F.array_position("score", F.array_max("score")).cast("int") - 1))
    counts = [F.count_if(F.col("best") == k).alias(f"n{k}") for k in range(n)]
    vector = F.array(*[F.col(f"n{k}").cast("double") for k in range(n)])

    def counted(*keys: str) -> DataFrame:
        return scored.where("best IS NOT NULL").groupBy(*keys).agg(*counts)

    def smoothed(held: Column, prior: Column) -> Column:
        total = F.aggregate(held, F.lit(0.0), lambda a, b: a + b)
        return F.transform(held, lambda c, i: (c + SMOOTH * F.get(prior, i)) / (total + SMOOTH))

    every = counted().first()  # one row
    totals = [float(every[f"n{k}"] or 0) for k in range(n)]
    overall = [(c + 1) / (sum(totals) + n) for c in totals]
    flat = F.array(*[F.lit(p) for p in overall])
    of_host = counted("host", "domain").where("host IS NOT NULL").select("host", "domain", vector.alias("held"))
    if domain is None:  # one level less
        of_host = of_host.withColumn("upper", flat)
    else:
        of_domain = counted("domain").select(F.col("domain").alias("d"), vector.alias("held")).select("d", F.when(F.col("d").isNull(), flat).otherwise(smoothed(F.col("held"), flat)).alias("upper"))
        of_host = of_host.join(small(written(of_domain, "domains")), F.col("domain").eqNullSafe(F.col("d")))
    of_host = of_host.select(F.col("host").alias("h"), F.col("domain").alias("hd"), F.col("held"), "upper")
    priors = written(of_host.select("h", "hd", smoothed(F.col("held"), F.col("upper")).alias("prior")), "priors")

    def reliability(key: str) -> DataFrame:
        """log P(value | language) of each value of ``key``, smoothed by the value's share of all rows."""
        found = counted(key).where(F.col(key).isNotNull())
        share = F.lit(1.0) + F.aggregate(F.col("held"), F.lit(0.0), lambda a, b: a + b)
        table = found.select(F.col(key).alias("v"), vector.alias("held"))
        per = F.array(*[F.lit(t) for t in totals])
        total = max(1.0, sum(totals))
        return written(table.select(F.col("v").alias(f"{key}_v"), F.transform("held", lambda c, i: F.log((c + SMOOTH * share / (total + 1)) / (F.get(per, i) + SMOOTH))).alias(f"{key}_log")), key)

    out = scored.join(small(priors), (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("hd")), "left")
    log_prior = F.transform(F.coalesce("prior", flat), lambda p: F.log(p))
    zero = F.array_repeat(F.lit(0.0), n)
    for key, given in (("declared", declared), ("suffix", suffix)):
        if given is not None:
            out = out.join(small(reliability(key)), F.col(key) == F.col(f"{key}_v"), "left")
        else:
            out = out.withColumn(f"{key}_log", F.lit(None).cast("array<double>"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(add(add(log_prior, F.coalesce("score", zero)), F.coalesce("declared_log", zero)), F.coalesce("suffix_log", zero))
    out = out.withColumn("fused", fused)
    top = F.array_max("fused")
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumn("top", top)
    spread = F.aggregate(F.transform("fused", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    return out.select(
        F.col("id").alias("_id"), F.col("th").alias("_th"), F.element_at(names, F.array_position("fused", F.col("top")).cast("int")).alias("language"), F.round(1 / spread, 6).alias("probability"),
        F.get(names, F.col("best")).alias("text_language"), "declared", "suffix", "host", (F.col("score").isNotNull()).alias("_spoken"),
    )


def accepted() -> Column:
    """A row is kept if its text speaks a known language with enough probability."""
    return F.col("_spoken") & (F.col("language") != UNKNOWN) & (F.col("probability") >= KEEP_ABOVE)


def document_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Documents: their source stands for the host; markup in the text may declare a language.
    The label column is read for the training sample alone."""
    model = TextModel.fit(training_rows(docs, id_col, text_col, label_col))
    return identify(docs, model, id_col, text_col, F.col(host_col), declared=declared_language(F.col(text_col)))


def language_report(docs: DataFrame, **how) -> DataFrame:
    found = document_languages(docs, **how)
    return found.select(F.col("_id").alias("doc_id"), "language", "probability", "text_language", "declared", F.coalesce(accepted(), F.lit(False)).alias("kept"))


def page_report(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The whole table of web pages under text models fitted on the labelled documents."""
    found = page_languages(pages, TextModel.fit(training_rows(docs, "doc_id", "text", "lang")))
    return found.select(F.col("_id").alias("page_id"), "host", "declared", "text_language", "language", "probability", F.coalesce(accepted(), F.lit(False)).alias("kept"))


def page_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages: markup, host and suffix all count."""
    host, domain, suffix = host_parts(F.col(url_col))
    return identify(pages, model, id_col, html_col, host, domain, suffix, declared_language(F.col(html_col)))


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those that are rejected."""
    gone = document_languages(docs, id_col, text_col, **how).where(~F.coalesce(accepted(), F.lit(False))).select("_id", "_th").distinct()
    gone = small(written(gone, "rejected"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(text_of(docs[text_col])) == gone["_th"]), "left_anti")
