"""Every registered query with SQL against it, on the smallest tables."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def _modules():
    from caddis.plans import catalog_queries, general_queries, store_queries

    return catalog_queries, general_queries, store_queries


@pytest.mark.parametrize("name", [n for m in _modules() for n in m.ORACLE])
def test_query_equals_its_sql(con, spark, name):
    module = next(m for m in _modules() if name in m.ORACLE)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    df = module.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted([tuple(map(plain, r)) for r in df.select(*columns).collect()], key=repr)
    sql = con.sql(module.ORACLE[name])
    order = [sql.columns.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in order) for r in sql.fetchall()], key=repr), name


def test_queries_without_sql_run(con, spark):
    for module in _modules():
        for name in set(module.QUERIES) - set(module.ORACLE):
            assert module.QUERIES[name](spark, SMALL).count() > 0, name


def test_entry_points_exist():
    import __spark_entry__ as e

    assert {"p1_found", "p5_found", "best_match", "catalogue_build"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_the_build_matches_titles_once(con, spark, monkeypatch):
    from caddis.plans import catalog_queries, pipeline

    calls, real = [], catalog_queries.matched
    monkeypatch.setattr(catalog_queries, "matched", lambda *a: calls.append(a) or real(*a))
    assert pipeline.built(spark, SMALL, ("enriched", "resolve_names")).columns[-2:] == ["name", "source"] and len(calls) == 1
