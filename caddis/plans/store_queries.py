"""Queries of sources, sinks, nested values and orders, with the SQL they are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caddis.functions import text as X
from caddis.operators import catalog as C
from caddis.operators import lookup as K
from caddis.operators import merge as G
from caddis.operators.naming import first_pure
from caddis.operators.ranks import ordered
from caddis.plans import catalog_queries as Q
from caddis.plans import pipeline
from caddis.plans import sql_text as S
from caddis.session import ensure_checkpoint_dir
from caddis.sources.sinks import rewrite, write_snapshot
from caddis.sources.tables import file_listing, json_records, optional_table, table


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint directory, for what a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"


# ---- sources and sinks ---------------------------------------------------------------------------------------------


def scored_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of the scored games only: its summary, which counts all, beside the rows that were written."""
    path = _folder(spark)
    summary = write_snapshot(Q.page_games(spark, d).select("product_id", "critic"), path, "critic", scored_only=True)
    written = spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("written"), F.sum("critic").alias("points"))
    return summary.crossJoin(written)  # one row each


def rewritten_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Play time added to a table that is already there, in place."""
    path = _folder(spark)
    write_snapshot(Q.page_games(spark, d).select("product_id", "title"), path)
    times = Q.page_games(spark, d).select("product_id", "main").where("main > 0")
    rewrite(spark, f"{path}/rows", lambda t: t.join(times, "product_id", "left"))
    return spark.read.parquet(f"{path}/rows")


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as JSON envelopes and read again with a declared schema."""
    path = _folder(spark)
    rows = table(spark, d, "switch_catalog").select("product_id", "title", "categories", "switch1")
    bucket = F.pmod(F.xxhash64("product_id"), F.lit(16))
    envelopes = rows.groupBy(bucket.alias("part")).agg(F.collect_list(F.struct("product_id", "title", "categories", "switch1")).alias("games"))
    envelopes.repartition("part").write.partitionBy("part").json(path)  # a file each
    record = T.StructType([T.StructField("product_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("switch1", T.BooleanType())])
    return json_records(spark, path, record).select("product_id", "title", F.array_join("categories", ",").alias("categories"), "switch1").distinct()


def file_set(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder that was just written: one a market."""
    path = _folder(spark)
    table(spark, d, "publishers").select("publisher", "market").repartition(1).write.partitionBy("market").parquet(path)
    files = file_listing(spark, path, "*.parquet")
    return files.select(F.regexp_extract("path", "market=([^/]*)/", 1).alias("market"), (F.col("size") > 0).alias("filled"))


def optional_scan(spark: SparkSession, d: str) -> DataFrame:
    """Slugs against a cache that doesn't exist yet: all are still to be looked up."""
    schema = T.StructType([T.StructField("slug", T.StringType()), T.StructField("payload", T.IntegerType())])
    return G.pending(table(spark, d, "mc_cache"), optional_table(spark, f"{_folder(spark)}/none", schema), "slug")


def cached_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Scores while the lookup is down: those of the cache."""
    cached = Q.cache(spark, d).select("slug", "score")
    return pipeline.or_cached(lambda: spark.read.parquet(f"{d}/no_such_table.parquet"), cached, "slug")


def fresh_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a lookup that answers for some slugs, the cache's for the rest."""
    fresh = table(spark, d, "mc_cache").where("slug IS NOT NULL AND user_score > 5").groupBy("slug").agg(F.max("user_score").alias("score"))
    return pipeline.or_cached(lambda: fresh, Q.cache(spark, d).select("slug", "score"), "slug")


def catalogue_build(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.built(spark, d)


def scan_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of at most 400 customers into which a scan capped there must be cut."""
    parts = C.split_scan(table(spark, d, "customer").withColumn("c_region", F.col("c_nationkey") % 5), ["c_mktsegment", "c_nationkey", "c_region"], 400, key="c_custkey")
    return spark.createDataFrame(parts, "filter string, n bigint")


# ---- nested values -------------------------------------------------------------------------------------------------


def action_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether any genre entry of a review entry is Action."""
    return table(spark, d, "mc_cache").select("ordinal", C.any_flag("genres", "name", "Action").alias("action"))


def genre_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the genre entries, empty ones left out."""
    names = F.filter(F.transform("genres", lambda g: g["name"]), lambda n: n.isNotNull() & (n != ""))
    return table(spark, d, "mc_cache").select("ordinal", F.coalesce(F.array_join(names, ","), F.lit("")).alias("genres"))


def prop_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the events' property maps, and the sum of each map's values."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return e.select("event_id", total.alias("total"), F.explode(F.map_entries("m")).alias("e")).select("event_id", "total", "e.key", "e.value")


def picked_images(spark: SparkSession, d: str) -> DataFrame:
    """The image of each listing by the order of purposes: the poster where it is sold for the newer console."""
    purpose = F.when(F.col("ps5"), F.lit("Poster")).otherwise(F.lit("Logo"))
    bare = F.regexp_replace("image", "^https:", "")
    images = F.array(F.struct(F.lit("Logo").alias("purpose"), F.concat(bare, F.lit("?logo")).alias("uri")), F.struct(purpose.alias("purpose"), F.col("image").alias("uri")))
    rows = table(spark, d, "psplus").where("image IS NOT NULL").select("product_id", images.alias("images"))
    return rows.select("product_id", C.pick_image("images").alias("image")).distinct()


def localized_join(spark: SparkSession, d: str) -> DataFrame:
    """Listings with the last localized title of the same product; null where that is empty or the title itself."""
    base = table(spark, d, "psplus").where("title <> ''").select("product_id", "title").distinct()
    local = table(spark, d, "psplus").groupBy("product_id").agg(G.latest("title_zh", "fetched_at").alias("zh"))
    return base.join(local, "product_id", "left").select("product_id", "title", F.nullif("zh", "title").alias("title_zh"))


def two_language_parts(spark: SparkSession, d: str) -> DataFrame:
    """The Chinese part of names in two languages, in either order."""
    rows = table(spark, d, "xgp").where("title <> '' AND title_zh <> ''").select("title", "title_zh").distinct()
    both = F.concat(F.col("title"), F.lit(" — "), F.col("title_zh"))
    glued = F.concat(F.col("title_zh"), F.lit(" "), F.col("title"))
    return rows.select("title", "title_zh", X.chinese_part(both, F.col("title")).alias("after"), X.chinese_part(glued, F.col("title")).alias("before"))


def article_names(spark: SparkSession, d: str) -> DataFrame:
    """Localized names by several hops: the entity of the same name and an allowed type, the title of its article as
    shown, without a disambiguation, and for want of one its label."""
    p = table(spark, d, "psplus").where("product_id IS NOT NULL AND title <> ''")
    names = p.groupBy("product_id").agg(F.min("title").alias("name"), F.max("title_zh").alias("zh"), F.max(F.coalesce("ps5", F.lit(False))).alias("on"))
    shown = F.when(F.col("on"), F.concat(F.lit("<i>"), F.col("zh"), F.lit("</i> (2023年游戏)")))
    entities = names.select(F.col("product_id").alias("ordinal"), F.array(F.lit("game")).alias("types"), F.array("name").alias("names"), F.struct(shown.alias("article"), F.col("zh").alias("own")).alias("label"))
    asked = table(spark, d, "xgp").where("title IS NOT NULL").select(F.col("title").alias("query"))
    found = K.knowledge_lookup(asked, entities, ["game", "expansion"])
    own = F.when(X.has_cjk(F.col("label.own")), F.col("label.own"))
    return found.select("query", "ordinal", F.coalesce(X.article_title(F.col("label.article")), own).alias("name"))


def pure_names(spark: SparkSession, d: str) -> DataFrame:
    """Of a listing's two localized spellings the first without a Latin word, else the first."""
    rows = table(spark, d, "xgp").where("title <> '' AND title_zh <> ''").select("title", "title_zh").distinct()
    return rows.select("title", "title_zh", first_pure([F.concat("title_zh", F.lit(" "), "title"), F.col("title_zh")]).alias("name"))


# ---- orders --------------------------------------------------------------------------------------------------------


def code_unit_order(spark: SparkSession, d: str) -> DataFrame:
    """All titles in the order of their characters' codes."""
    return ordered(Q.titles(spark, d), F.col("title").asc())


def platform_pages(spark: SparkSession, d: str) -> DataFrame:
    """The scored review entries as a paged list gives them, 50 a page, best first, with their place in it."""
    entries = table(spark, d, "mc_cache").where("critic_score > 0").select("slug", "critic_score", "ordinal")
    return C.pages(entries, [F.col("critic_score").desc(), F.col("ordinal").asc()], 50).drop("ordinal")


QUERIES = {
    f.__name__: f
    for f in (
        scored_snapshot, rewritten_snapshot, json_round_trip, file_set, optional_scan, cached_lookup, fresh_lookup, catalogue_build, scan_parts, action_flags, genre_names,
        prop_entries, picked_images, localized_join, two_language_parts, article_names, pure_names, code_unit_order, platform_pages,
    )
}

_ZH = "SELECT product_id, first(title_zh ORDER BY fetched_at DESC NULLS LAST, title_zh DESC) FILTER (WHERE title_zh <> '') AS zh FROM psplus GROUP BY 1"
_O = Q.ORACLE

ORACLE = {
    "scored_snapshot": f"SELECT count(*) AS total, count(critic) AS scored, count(critic) AS written, sum(critic)::BIGINT AS points FROM ({Q._PAGE})",
    "rewritten_snapshot": f"SELECT product_id, title, CASE WHEN main > 0 THEN main END AS main FROM ({Q._PAGE})",
    "json_round_trip": "SELECT DISTINCT product_id, title, array_to_string(categories, ',') AS categories, switch1 FROM switch_catalog",
    "file_set": "SELECT DISTINCT coalesce(market, '__HIVE_DEFAULT_PARTITION__') AS market, true AS filled FROM publishers",
    "optional_scan": "SELECT DISTINCT slug FROM mc_cache WHERE slug IS NOT NULL",
    "cached_lookup": f"SELECT slug, score FROM ({Q._CACHE})",
    "fresh_lookup": f"WITH f AS (SELECT slug, max(user_score) AS score FROM mc_cache WHERE slug IS NOT NULL AND user_score > 5 GROUP BY 1) SELECT * FROM f UNION ALL SELECT slug, score FROM ({Q._CACHE}) WHERE slug NOT IN (SELECT slug FROM f)",
    "catalogue_build": f"SELECT l.product_id, l.store, l.title, e.critic, e.slug, e.confidence, e.user_score, e.reviews, e.main, e.extra, e.complete, n.name, n.source, k.score AS rank_score, k.cluster FROM ({Q._LISTED}) l LEFT JOIN ({_O['enriched']}) e USING (product_id) LEFT JOIN ({_O['resolve_names']}) n USING (product_id) LEFT JOIN ({_O['rank_all']}) k USING (product_id) WHERE l.title IS NOT NULL",
    "action_flags": "SELECT ordinal, coalesce(len(list_filter(genres, lambda g: g.name = 'Action')) > 0, false) AS action FROM mc_cache",
    "genre_names": "SELECT ordinal, coalesce(array_to_string(list_filter(list_transform(genres, lambda g: g.name), lambda n: n IS NOT NULL AND n <> ''), ','), '') AS genres FROM mc_cache",
    "prop_entries": "WITH m AS (SELECT event_id, props::JSON AS j, json_keys(props::JSON) AS ks FROM events WHERE props IS NOT NULL), v AS (SELECT event_id, unnest(ks) AS key, j, ks FROM m) SELECT event_id, list_sum(list_transform(ks, lambda k: (j ->> ('$.' || k))::BIGINT))::BIGINT AS total, key, (j ->> ('$.' || key))::BIGINT AS value FROM v",
    "picked_images": "SELECT DISTINCT product_id, CASE WHEN ps5 THEN image ELSE 'https:' || regexp_replace(image, '^https:', '') || '?logo' END AS image FROM psplus WHERE image IS NOT NULL",
    "localized_join": f"SELECT DISTINCT p.product_id, p.title, nullif(z.zh, p.title) AS title_zh FROM psplus p LEFT JOIN ({_ZH}) z USING (product_id) WHERE p.title <> ''",
    "article_names": f"WITH e AS (SELECT product_id, min(title) AS name, max(title_zh) AS zh FROM psplus WHERE product_id IS NOT NULL AND title <> '' GROUP BY 1), f AS (SELECT {S.identity_key('name')} AS k, min(product_id) AS ordinal, arg_min(struct_pack(z := zh), product_id).z AS zh FROM e GROUP BY 1), q AS (SELECT DISTINCT title AS query, {S.identity_key('title')} AS k FROM xgp WHERE title IS NOT NULL) SELECT query, ordinal, CASE WHEN {S.has_cjk('zh')} THEN zh END AS name FROM q JOIN f USING (k) WHERE k <> ''",
    "pure_names": f"SELECT DISTINCT title, title_zh, CASE WHEN NOT {S.is_mixed(chr(40) + chr(39) + chr(39) + ' || title_zh || chr(32) || title)')} THEN title_zh || ' ' || title WHEN NOT {S.is_mixed('title_zh')} THEN title_zh ELSE title_zh || ' ' || title END AS name FROM xgp WHERE title <> '' AND title_zh <> ''",
    "code_unit_order": f"SELECT title, row_number() OVER (ORDER BY title) AS position FROM ({Q._TITLES})",
    "platform_pages": "SELECT slug, critic_score, place, ((place - 1) // 50)::INTEGER AS page FROM (SELECT slug, critic_score, row_number() OVER (ORDER BY critic_score DESC, ordinal) AS place FROM mc_cache WHERE critic_score > 0)",
}
