"""Class rows against the pairs they stand for, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def tables():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")


def test_links_of_groups_are_the_pairs(spark):
    from caddis.llm import queries as Q

    groups = Q.p3_groups(spark, SMALL).toPandas()
    pairs = Q.p3_found(spark, SMALL).toPandas()
    assert groups.links.sum() == 2 * len(pairs) > 0 and groups.product_id.is_unique


def test_links_of_forms_are_the_pairs(spark):
    from caddis.llm import queries as Q

    forms = Q.p2_forms(spark, SMALL)
    linked = forms.where("links > 0").select("field", "product_id").distinct()
    found = Q.p2_found(spark, SMALL)
    both = found.select("field", F.col("product_id_a").alias("product_id")).union(found.select("field", "product_id_b")).distinct()
    assert linked.exceptAll(both).count() == 0 and both.exceptAll(linked).count() == 0 and found.count() > 0


def test_every_query_runs(spark):
    from caddis.llm import queries as Q

    for name in ("p4_ranking", "p6_matches", "p8_report", "p9_shares", "p7_ids"):
        assert Q.QUERIES[name](spark, SMALL).count() > 0, name


def test_ranking_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from caddis.llm import queries as Q

    con = duckdb.connect()
    for name in ("games", "mc_user_cache"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    columns = ["product_id", "critic", "user", "review_count", "projection", "position"]
    got = sorted(map(tuple, Q.p4_ranking(spark, SMALL).select(*columns).collect()), key=repr)
    assert got == sorted(con.sql(Q.ORACLE["p4_ranking"]).select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
