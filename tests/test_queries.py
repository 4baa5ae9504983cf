"""Every query of the road network against its SQL on the smallest tables."""

import duckdb
import pytest

from tarmac.oracles import ORACLES
from tarmac.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(cursor.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_base_repair_takes_twenty_hops(spark, monkeypatch):
    from tarmac import queries

    chain = [(k, k + 1, 10, k) for k in range(30)] + [(0, d, 1, 100 + d) for d in (9, 20, 21)]
    edges = spark.createDataFrame(chain, "src long, dst long, wt long, edge_id long")

    def cost(dst):
        own = edges.where(f"src <> 0 OR dst IN (1, {dst})")
        monkeypatch.setattr(queries, "_repair_jobs", lambda *_: (spark.createDataFrame([(1, 0, dst, 4000)], "job long, src long, dst long, budget long"), own))
        return [r.cost for r in QUERIES["r16_repair_base"](spark, SF).collect()]

    assert cost(9) == [90] and cost(20) == [200] and cost(21) in ([], [None])
