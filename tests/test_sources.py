import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caddis.operators import catalog as C
from caddis.sources.tables import file_listing, json_records, optional_table
from caddis.streaming.pending import resolve_stream


def test_sources(spark, rows, tmp_path):
    record = T.StructType([T.StructField("title", T.StringType()), T.StructField("score", T.IntegerType())])
    (tmp_path / "a.json").write_text(json.dumps({"games": [{"title": "x", "score": 3}, {"title": None}]}))
    assert rows(json_records(spark, str(tmp_path / "a.json"), record)) == [("x", 3), (None, None)]
    assert optional_table(spark, str(tmp_path / "none"), record).count() == 0
    assert [r["size"] > 0 for r in file_listing(spark, str(tmp_path), "*.json").collect()] == [True]
    assert file_listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_stream_looks_a_key_up_once(spark, rows, tmp_path):
    def lookup(keys):
        return keys.select("slug", F.when(F.col("slug") != "b", F.length("slug")).alias("payload"))

    schema = T.StructType([T.StructField("slug", T.StringType())])
    folder, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    for batch in (["a", "b", "a", None], ["b", "cc"], []):
        spark.createDataFrame([(x,) for x in batch], schema).write.mode("append").parquet(folder)
        resolve_stream(spark, folder, schema, "slug", lookup, cache, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(cache).select("slug", "payload")) == [("a", 1), ("b", None), ("cc", 2)]


def test_row_rules(spark, rows):
    df = spark.createDataFrame([(1, '["ConsoleGen8"]', True), (2, "null", True), (3, None, True), (4, '["ConsoleGen9"]', False), (5, "{bad", True), (6, "[]", True)], "i int, gen string, on boolean")
    older, newer = C.console_generations("gen", F.col("on"))
    assert rows(df.select("i", older, newer)) == [(1, True, False), (2, True, True), (3, True, False), (4, False, False), (5, True, False), (6, False, False)]
    images = spark.createDataFrame([([("Logo", "//a"), ("Poster", "https://b")],), ([("Logo", "//a")],), ([],), (None,)], "images array<struct<purpose:string,uri:string>>")
    assert [r[0] for r in images.select(C.pick_image("images")).collect()] == ["https://b", "https://a", None, None]
    reported = lambda n: spark.createDataFrame([(n,)], "n bigint")
    assert rows(C.completeness(df, reported(6))) == [(6, 6, True)] and rows(C.completeness(df, reported(7))) == [(6, 7, False)]
    assert rows(C.completeness(df, reported(6), strict=True)) == [(6, 6, True)]
    with pytest.raises(Exception, match="fewer rows"):
        C.completeness(df, reported(7), strict=True).collect()
    facets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", None)], "x string, y int")
    assert rows(C.split_facet(facets, ["x", "y"])) == [("x", "a", 2, 2)]


def test_sinks_and_lookups(spark, rows, tmp_path):
    from caddis.operators import lookup as K
    from caddis.sources.sinks import rewrite, write_snapshot

    df = spark.createDataFrame([(1, 80), (2, None)], "id int, score int")
    assert rows(write_snapshot(df, str(tmp_path / "s"), "score", scored_only=True)) == [(2, 1)]
    assert rows(spark.read.parquet(str(tmp_path / "s/rows"))) == [(1, 80)]
    rewrite(spark, str(tmp_path / "s/rows"), lambda t: t.withColumn("x", F.lit(1)))
    assert rows(spark.read.parquet(str(tmp_path / "s/rows"))) == [(1, 80, 1)]
    entities = spark.createDataFrame([(2, ["game"], ["Amo Gate"], "later"), (1, ["game", "x"], ["AMO  gáte!", None], "first"), (0, ["film"], ["amo gate"], "film")], "ordinal int, types array<string>, names array<string>, label string")
    asked = spark.createDataFrame([("Amo Gate™",), ("???",), (None,)], "query string")
    assert rows(K.knowledge_lookup(asked, entities, ["game"])) == [("Amo Gate™", 1, "first")]
    english = spark.createDataFrame([(1, "Amo"), (2, "Amo")], "id int, name string")
    localized = spark.createDataFrame([(1, "Amo"), (2, "阿莫")], "id int, name string")
    assert rows(K.two_language_lookup(spark.createDataFrame([("amo",)], "query string"), english, localized)) == [("amo", "阿莫")]
    union, failed = K.tolerant_union([("a", lambda: df), ("b", lambda: spark.read.parquet(str(tmp_path / "none")))])
    assert union.count() == 2 and failed == ["b"]


def test_scans_are_split_until_no_part_is_too_large(spark):
    df = spark.createDataFrame([(f"o'{i % 3}" if i % 7 else None, i % 5) for i in range(200)], "x string, y int")
    parts = C.split_scan(df, ["x", "y"], 40)
    assert sum(n for _, n in parts) == 200 and all(n <= 40 and df.where(f).count() == n for f, n in parts)
    assert C.split_scan(df, ["x"], 500) == [("true", 200)] and C.split_scan(df.limit(0), ["x"], 5) == [("true", 0)]
    with pytest.raises(ValueError, match="cannot be split"):
        C.split_scan(df, ["y"], 10)


def test_what_facets_cannot_cut_is_cut_by_a_key(spark):
    df = spark.createDataFrame([(f"o'{i % 2}", None if i % 50 == 0 else f"k'{i // 3:03}") for i in range(200)], "x string, k string")
    parts = C.split_scan(df, ["x"], 10, key="k")
    assert sum(n for _, n in parts) == 200 and all(n <= 10 and df.where(f).count() == n for f, n in parts)
    assert df.where(" OR ".join(f"({f})" for f, _ in parts)).count() == 200
    numbers = spark.range(1000).withColumn("x", F.lit(1))
    assert [n for _, n in C.split_scan(numbers, ["x"], 400, key="id")] == [400, 400, 200]
    with pytest.raises(ValueError, match="cannot be split"):
        C.split_scan(df, ["x"], 1, key="k")


def test_flags_choices_and_pages(spark, rows):
    skus = spark.createDataFrame([(1, [({"XPA": True},), ({"XPA": None},)]), (2, [({"XPA": False},)]), (3, []), (4, None)], "i int, skus array<struct<props:map<string,boolean>>>")
    assert [r[0] for r in skus.orderBy("i").select(C.any_flag("skus", "props.XPA", True)).collect()] == [True, False, False, False]
    with pytest.raises(ValueError, match="none of"):
        C.one_of("steam", ("xgp", "psplus"))
    games = spark.createDataFrame([("a", 90, None, 2015, ["pc"]), ("b", 70, 8.0, 2015, ["pc", "cloud"]), ("c", None, None, 2020, ["cloud"]), ("d", 95, 9.0, 1999, ["pc"]), ("e", 95, 9.0, 2020, ["console"]), ("f", 95, 9.0, None, None)], "product_id string, critic int, user double, year int, platforms array<string>")
    got = lambda **k: [r["product_id"] for r in C.page(games, **k).orderBy("position").collect()]
    assert got(selected=["handheld"]) == ["a", "b"] and got(selected=["cloud", "handheld"], least_critic=75, unrated=True) == ["a", "c"]
    assert got(selected=["pc"], least_user=7.0, since=None, sort="user") == ["d", "b"] and got(selected=["console"]) == ["e"]


def test_pipeline_writes_and_degrades(spark, tmp_path):
    import os

    from caddis.plans import pipeline

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    summary = pipeline.run(spark, "/root/testdata/sf0.001", str(tmp_path / "out")).head()
    written = spark.read.parquet(str(tmp_path / "out/rows"))
    assert summary["total"] == written.count() > 0 and summary["scored"] == written.where("critic IS NOT NULL").count()
    with pytest.raises(ValueError):
        pipeline.built(spark, "/root/testdata/sf0.001", ("cook",))
    cached = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, pipeline.or_cached(lambda: spark.read.parquet("/nowhere"), cached, "k").collect())) == [("a", 1), ("b", 2)]
    fresh = spark.createDataFrame([("b", 9)], "k string, v int")
    assert sorted(map(tuple, pipeline.or_cached(lambda: fresh, cached, "k").collect())) == [("a", 1), ("b", 9)]
