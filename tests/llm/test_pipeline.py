"""The pipeline on the smallest tables, stage by stage against its own operators."""

import importlib

import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        left = out.count()
        assert 0.5 * n <= left <= n, name
        docs, n = out, left
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns[: len(columns)] == columns and last.count() > 0


def test_run_repeats(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    once, twice = (sorted(map(str, pipeline.run(spark, SF).drop("text").collect())) for _ in range(2))
    assert once == twice


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_mixing", "op7_warc", "op8_url_filter", "op9_decontamination", "op10_line_dedup"])
def test_oracle(spark, name):
    import duckdb

    from tarmac import llm

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = llm.queries()[name](spark, SF)
    cursor = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(cursor.fetchall())


def plain(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
