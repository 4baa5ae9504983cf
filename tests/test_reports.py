"""Reports read from files in the encodings that shells leave behind."""

from pyspark.sql import functions as F

from tarmac.operators import reports
from tarmac.sources import graphs

BENCH = "goos: linux\r\ncpu:  Some CPU @ 2 GHz\nBenchmarkRoute/hierarchical-8   \t 100\t 2500.5 ns/op\t 64 B/op  12 visited_nodes/op\nBenchmarkShort-8 1\nBenchmarkOdd-8 5 x ns/op 7 B/op\nPASS\n"


def test_encodings(spark, tmp_path):
    kinds = {"a": BENCH.encode(), "b": b"\xff\xfe" + BENCH.encode("utf-16-le"), "c": b"\xfe\xff" + BENCH.encode("utf-16-be"), "d": BENCH.encode("utf-16-le"), "e": b"\xff\xfe" + BENCH.encode("utf-16-le") + b"x"}
    for name, data in kinds.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    lines = reports.text_lines(reports.read_texts(spark, f"{tmp_path}/*.txt")).cache()
    got = {}
    for r in reports.bench_metrics(lines, "path").collect():
        got.setdefault(r.path[-5], set()).add((r.name, r.unit, r.value))
    want = {("BenchmarkRoute/hierarchical", "ns/op", 2500.5), ("BenchmarkRoute/hierarchical", "B/op", 64.0), ("BenchmarkRoute/hierarchical", "visited_nodes/op", 12.0), ("BenchmarkOdd", "B/op", 7.0)}
    assert got == dict.fromkeys(kinds, want)
    assert {(r.key, r.value) for r in reports.bench_setting(lines).collect()} == {("goos", "linux"), ("cpu", "Some CPU @ 2 GHz")}
    wide = {r.name: (r["ns/op"], r["B/op"]) for r in reports.pivoted(reports.bench_metrics(lines.where(F.endswith("path", F.lit("a.txt")))), ("ns/op", "B/op")).collect()}
    assert wide == {"BenchmarkRoute/hierarchical": (2500.5, 64.0), "BenchmarkOdd": (None, 7.0)}


def test_logs(spark, tmp_path):
    (tmp_path / "build-4.log").write_text("start\noverlay ready in 1m2.5s now\nbuild complete in 350ms\n")
    (tmp_path / "build-8.log").write_text("overlay ready in 5s\n")
    (tmp_path / "runs-2.log").write_text("[x] workers=3 avg=1.5s runs=7\n[x] workers=3 other\n[x] workers=? avg=20ms\n[y] workers=1 avg=1s\n")
    texts = reports.read_texts(spark, f"{tmp_path}/*.log")
    assert [(r.workers, r.overlay_ms, r.total_ms) for r in reports.build_summaries(texts).collect()] == [(4, 62500.0, 350.0)]
    assert sorted((r.workers, r.avg_ms, r.runs) for r in reports.run_summaries(texts, "[x]").collect()) == [(2, 20.0, 0), (3, 1500.0, 7)]
    (tmp_path / "s.json").write_text('{"requests": 5, "p95": 1.5, "more": 1}')
    assert [(r.requests, r.p95) for r in reports.load_summaries(reports.read_texts(spark, f"{tmp_path}/s.json"), "requests long, p95 double").collect()] == [(5, 1.5)]


def test_search_in_a_viewbox_and_country(spark):
    places = spark.createDataFrame([("Main A", "32.0", "34.0", "IL"), ("Main B", "50.0", "8.0", "de"), ("Main C", "32.5", "34.5", "se")], "display_name string, lat string, lon string, country string")
    names = lambda **how: [r.displayName for r in graphs.search_places(places, "main", **how).collect()]
    assert names() == ["Main A", "Main B", "Main C"] and names(viewbox="33,33,35,31") == ["Main A", "Main C"] and names(countries="il, DE") == ["Main A", "Main B"]
