"""Awkward rows for the operators and for every stage, and the whole pipeline against brute force."""

import importlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarmac.llm import exact_dedup, language, mixing, near_dedup, substring_dedup
from tests.llm.test_operators import DE, EN, WORDS, brute_classes, sentence, table, talk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeats_without_ids_and_of_one_id(spark):
    """Null ids count as one document that comes last; rows of one id count as one."""
    rng = random.Random(21)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    own = lambda: sentence(rng, 14)
    rows = [(None, own() + " " + passage, "en", "s"), (None, own() + " " + passage, "en", "s"), (5, own() + " " + passage, "en", "s"), (9, own() + " " + passage, "en", "s"), (9, own() + " " + passage, "en", "s")]
    got = Counter(r.doc_id for r in substring_dedup.repeat_report(table(spark, rows)).collect())
    assert got == {None: 2, 9: 2}
    same = table(spark, [(4, passage, "en", "s")] * 3 + [(6, passage, "en", "s")] * 2)
    assert Counter(r.doc_id for r in substring_dedup.substring_dedup(same).where("text = ''").collect()) == {6: 2}


def test_repeats_in_a_very_long_text(spark):
    rng = random.Random(22)
    passage = " ".join(f"{rng.choice(WORDS)}{k}" for k in range(60))
    filler = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(120_000))
    rows = [(1, "opening " + passage, "en", "s"), (2, filler + " " + passage + " " + filler[:50_000], "en", "s")]
    got = {r.doc_id: r for r in substring_dedup.repeat_report(table(spark, rows)).collect()}
    middle = " ".join(passage.split()[18:42])
    assert set(got) == {2} and 1 in got[2].first_ids and middle not in got[2].kept_text and len(got[2].kept_text) > 100_000


def test_language_of_long_and_repeated_rows(spark):
    rng = random.Random(23)
    rows = [(k, talk(rng, (EN, DE)[k % 2], 50), ("en", "de")[k % 2], "s") for k in range(80)]
    rows += [(90, talk(rng, DE, 60_000), "de", "s"), (91, talk(rng, EN, 40), "en", "s"), (91, talk(rng, EN, 40), "en", "s"), (91, talk(rng, DE, 40), "de", None)]
    got = defaultdict(list)
    for r in language.language_report(table(spark, rows)).collect():
        got[r.doc_id].append(r.language)
    assert got[90] == ["de"] and sorted(got[91]) == ["de", "en", "en"]


def test_training_rows_are_bounded(spark):
    rows = [(1, "a" * (language.TRAIN_BYTES + 1), "en", "s")] + [(3, "one", "en", "s")] * 500 + [(4, "two", "de", "s")]
    usable = {t for t, _ in language.training_rows(table(spark, rows), "doc_id", "text", "lang")}
    assert len(language.training_rows(table(spark, rows), "doc_id", "text", "lang")) <= 3 and usable <= {"one", "two"}


def test_pages_of_the_whole_table(spark):
    rng = random.Random(24)
    docs = table(spark, [(k, talk(rng, (EN, DE)[k % 2], 60), ("en", "de")[k % 2], "s") for k in range(60)])
    html = lambda body, lang: f"<html lang={lang}><body><p>{body}</p></body></html>"
    rows = [(k, f"http://h{k % 3}.example.{('uk', 'de')[k % 2]}/", html(talk(rng, (EN, DE)[k % 2], 50), ("en", "de")[k % 2])) for k in range(60)] + [(100, None, None), (101, "::", "")]
    got = {r.page_id: r for r in language.page_report(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == 62 and all((got[k].language, got[k].declared, got[k].kept) == (("en", "de")[k % 2], ("en", "de")[k % 2], True) for k in range(60))
    assert not got[100].kept and not got[101].kept and got[100].host is None


@pytest.mark.parametrize("bits", [None, 3])
def test_directory_follows_the_number_of_texts(spark, bits):
    texts = [(k, f"text {k % 700}", "en", "s") for k in range(1500)]
    hasher = F.xxhash64 if bits is None else lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(1 << bits)), 60)
    _, entries, small = exact_dedup.build_index(table(spark, texts), capacity=100)
    _, _, large = exact_dedup.build_index(table(spark, texts), capacity=5)
    assert small.max_depth < large.max_depth and len(small.buckets) < len(large.buckets) <= entries.count()
    out = exact_dedup.exact_report(table(spark, texts), capacity=5, hasher=hasher).collect()
    assert all(r.keep_id % 700 == r.doc_id % 700 and r.keep_id + 700 > 1499 and r.group_size in (2, 3) for r in out) and len(out) == 1500


def test_owners_hold_one_bucket_each(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    directory = exact_dedup.Directory({r["p"]: r["n"] for r in rows.groupBy(F.shiftrightunsigned("h", 52).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}, 100)
    placed = directory.placed(rows).select("bucket", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(directory.buckets) > 16 and sorted((r.bucket, r.task) for r in placed) == [(k, k) for k in range(len(directory.buckets))]


def test_mix_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(k, "some words here", "s", "x", 1.0) for k in range(4)], "doc_id long, text string, source string, mix_pass string, mix_position double")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "mix_pass", "mix_words", "mix_position"] and {r.mix_pass for r in out.collect()} <= {1, 2}


def test_counted_join_beyond_the_bound(spark, monkeypatch):
    from tarmac.llm import common

    rows = spark.createDataFrame([(k % 50, k) for k in range(400)] + [(7, 1000 + k) for k in range(300)], "h long, at long")
    counted = common.written(rows.groupBy(F.col("h").alias("fh")).agg(F.count("*").alias("times")).where("fh % 2 = 1"), "counted")
    want = Counter(map(tuple, common.join_counted(rows, counted, {"h": "fh"}, "times").select("h", "at").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    far = common.join_counted(rows, counted, {"h": "fh"}, "times", hot=100)
    assert Counter(map(tuple, far.select("h", "at").collect())) == want and len(want) == 500
    none_hot = common.join_counted(rows, counted, {"h": "fh"}, "times", hot=1000)
    assert Counter(map(tuple, none_hot.select("h", "at").collect())) == want


def test_no_folder_of_this_machine_on_a_cluster():
    from types import SimpleNamespace

    from tarmac.llm import common

    context = SimpleNamespace(getConf=lambda: {}, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_root(SimpleNamespace(sparkContext=context))


# ---- pipeline --------------------------------------------------------------------


def corpus():
    rng = random.Random(31)
    line = "this line stands in many of the documents of the corpus"
    text = lambda n=60: talk(rng, EN, n)
    item = [f"q{k}word" for k in range(20)]
    base = [text(120) for _ in range(4)]
    rows = [(k, text(), "en") for k in range(30)] + [(30 + k, talk(rng, DE, 60), "de") for k in range(20)]
    rows += [(100 + k, text() + "\n" + line + "\n" + text(), "en") for k in range(5)]
    rows += [(200 + k, base[k % 4] + (" and then" if k >= 4 else ""), "en") for k in range(12)]
    rows += [(300, text() + " " + " ".join(item) + " " + text(), "en"), (301, text(30) + " " + " ".join(w if k % 9 else "other" for k, w in enumerate(item)), "en")]
    rows += [(400, "", "en"), (401, None, None), (402, "Привет мир это русский текст " * 9, None), (403, "12345 !!!", "en"), (None, text(), "en"), (None, None, None)]
    rows += [(500, t := text(), "en"), (500, t, "en"), (501, text(30_000), "en")]
    return [(i, t, lang, "src", len(t or "")) for i, t, lang in rows], " ".join(item), line


def test_pipeline_is_brute_force(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows, item, line = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t, *_ in rows if t and re.search("[a-z]", t)]  # no language in the others
    last = max(i for i, t in kept if i is not None and line in t.split("\n"))
    kept = [(i, "\n".join(x for x in t.split("\n") if x != line or i == last)) for i, t in kept]
    classes = brute_classes(kept)
    once = {i: t for i, t in kept if i is None or classes[i] == i}
    clean = {i: t for i, t in once.items() if i not in (300, 301)}
    assert {(r.doc_id, r.text) for r in out} == set(clean.items())
    first = [r for r in out if r.mix_pass == 1]
    assert len(first) == len(clean) and abs(sum(r.mix_words for r in out) - 1.5 * sum(len(t.split()) for t in clean.values())) <= 0.5
    assert all(r.mix_words == len(r.text.split()) for r in first)


def test_stages_without_rows(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert near_dedup.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_stages_on_rows_without_ids_or_texts(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(None, None, None, None, None)] * 3 + [(None, "the house is by the river", None, None, None)] * 2 + [(1, None, None, None, None), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name in ("line_dedup", "decontamination"):
            assert out.count() == len(rows), name
        if name == "near_dedup":
            assert Counter(r.doc_id for r in out.collect()) == {None: 5, 1: 1}
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("text IS NULL OR text = ''").count() == 0
