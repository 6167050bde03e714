"""Queries of the catalogue operators, with the SQL they are checked against.

Every query runs over its whole tables. Listings are one row per product, the product id being the ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caddis.functions import text as X
from caddis.functions.similarity import collapsed, dice, same_entry, same_start
from caddis.operators import catalog as C
from caddis.operators import lookup as K
from caddis.operators import matching as M
from caddis.operators import merge as G
from caddis.operators import ranking as R
from caddis.operators import naming as N
from caddis.operators.ranks import ordered
from caddis.plans import sql_text as S
from caddis.session import cut, drop_cut, freed_shuffles
from caddis.sources.tables import table

# Invented taste clusters and play history, in the vocabulary of the tables.
CLUSTERS = [
    (1, "quests", 300.0, ["expedition", "voyage"], ["crimson"], ["citadel", "kingdom", "garden"], ["Role-Playing", "Adventure"]),
    (2, "nights", 120.0, ["twilight", "obsidian"], ["hollow"], ["silent", "lonely"], ["Horror"]),
    (3, "engines", 80.0, ["circuit", "machine"], [], ["electric", "iron"], ["Racing", "Simulation"]),
]
HISTORY = ["Crimson Pildilduma", "Electric Zotothupa", "Thidren Renzi Expedition", "Hollow Rerekoso", "Benu"]
OVERRIDES = [("Dralen Vendra Oath", "流影仙绿"), ("Didopodri", "Didopodri"), ("Lisa Drarfa", "金楼")]
# A small public map from traditional to simplified characters; a full one is a parameter of the operators.
SIMPLIFIED = ("國戰龍門開東車馬鳥魚風雲電長會學實對時萬與業無見語說請讀貓", "国战龙门开东车马鸟鱼风云电长会学实对时万与业无见语说请读猫")
STORES = ("xgp", "psplus", "switch_catalog")


def round6(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


# ---- text ----------------------------------------------------------------------------------------------------------


def titles(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("title") for t in STORES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("title IS NOT NULL").distinct()


def normalize_titles(spark: SparkSession, d: str) -> DataFrame:
    key = X.normalize(F.col("title"))
    rows = titles(spark, d).withColumn("key", key)
    return rows.select("title", "key", F.array_join(X.sequel_numbers(F.col("key")), ",").alias("sequels"), X.flat(F.col("key")).alias("flat"), X.identity_key(F.col("title")).alias("identity"), X.history_key(F.col("title")).alias("history"), X.edition_stripped(F.col("title")).alias("stripped"))


def store_titles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "psplus").select(F.lit("psplus").alias("store"), "title", X.console_title(F.col("title")).alias("clean"))
    b = table(spark, d, "switch_catalog").where(~X.is_extra(F.col("title"))).select(F.lit("switch").alias("store"), "title", X.handheld_title(F.col("title")).alias("clean"))
    return a.unionByName(b).where("title IS NOT NULL").distinct()


def title_variants(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("title", F.explode(X.variants(F.col("title"))).alias("v")).select("title", "v.query", "v.weight")


def block_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which each title key is found (every word) and asks (its first)."""
    keys = titles(spark, d).select(X.normalize(F.col("title")).alias("key")).distinct()
    found = keys.select("key", F.lit("item").alias("side"), F.explode(X.item_blocks(F.col("key"))).alias("block"))
    return found.unionByName(keys.select("key", F.lit("query").alias("side"), F.explode(X.query_blocks(F.col("key"))).alias("block")))


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part names that share a block, with guards and similarity; a small dimension of names."""
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    key = X.normalize(F.col("a"))
    left = names.withColumn("block", F.explode(X.query_blocks(key)))
    right = names.withColumn("block", F.explode(X.item_blocks(key))).withColumnRenamed("a", "b")
    pairs = left.join(right, "block").select("a", "b").distinct()
    a, b = X.normalize(F.col("a")), X.normalize(F.col("b"))
    return pairs.select("a", "b", same_entry(a, b).alias("entry"), same_start(a, b).alias("start"), round6(dice(a, b)).alias("dice"), round6(dice(collapsed(a), collapsed(b))).alias("close"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length(X.strip_tags(F.col("text"))).cast("bigint").alias("kept"), F.md5(X.strip_tags(F.col("text"))).alias("digest"))


# ---- matching ------------------------------------------------------------------------------------------------------


def listings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per product of the three stores: the latest non-empty value of each text column."""
    parts = [table(spark, d, t).select(F.lit(t).alias("store"), "product_id", "fetched_at", *columns) for t in STORES]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("product_id IS NOT NULL")
    return every.groupBy("product_id").agg(F.min("store").alias("store"), *[G.latest(c, "fetched_at").alias(c) for c in columns])


def match_titles(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d, "title", "release_date").where("title IS NOT NULL").select(F.col("product_id").alias("ordinal"), "title", F.col("release_date").alias("date"))


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Matches of all title keys that have a critic score, with the entry's title and date."""
    first = G.keep_first(table(spark, d, "mc_cache").where("type = 'game-title' AND slug IS NOT NULL AND title IS NOT NULL"), ["slug"], ["ordinal"]).select("slug", F.col("release_date").alias("review_date"))
    found = M.best_match(match_titles(spark, d), table(spark, d, "mc_cache"))
    with freed_shuffles(spark):
        kept = cut(found.where("critic_score IS NOT NULL").join(first, "slug"))
        drop_cut(found)
    return kept


def best_match(spark: SparkSession, d: str) -> DataFrame:
    found = M.best_match(match_titles(spark, d), table(spark, d, "mc_cache"))
    return found.select("key", "slug", round6(F.col("score")).alias("score"), X.fixed3(F.col("score")).alias("confidence"), "critic_score")


def widened_match(spark: SparkSession, d: str) -> DataFrame:
    return M.widened_match(match_titles(spark, d), table(spark, d, "mc_cache")).select("key", "slug", round6(F.col("score")).alias("score"), "rounds")


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Play-time entries, one per product of the scored catalogue that has one: its title, the review entry's title and
    the slug's words as aliases, and the user reviews as the number of reports."""
    g = page_games(spark, d).where("title IS NOT NULL AND (main IS NOT NULL OR extra IS NOT NULL OR complete IS NOT NULL)")
    slug = F.translate(F.regexp_extract("url", "([^/]+)/*$", 1), "-", " ")
    alias = F.concat_ws(",", F.translate("match_title", ",", " "), F.nullif(slug, F.lit("")))
    return g.select(F.col("product_id").alias("ordinal"), F.col("title").alias("name"), F.nullif(alias, F.lit("")).alias("alias"), X.year_of(F.col("release_date")).alias("year"), F.lit("game").alias("type"), "main", "extra", "complete", F.coalesce("reviews", F.lit(0)).alias("count"))


def played_titles(spark: SparkSession, d: str, match: DataFrame | None = None) -> DataFrame:
    """Titles to look play times up for, with the title and date of their review entry. match: as ``matched`` has found it."""
    rows = match_titles(spark, d).withColumn("key", X.normalize(F.col("title")))
    found = (match or matched(spark, d)).select("key", F.col("item_title").alias("picked"), F.col("review_date").alias("picked_date"))
    return rows.join(found, "key", "left").drop("key")


def alias_match(spark: SparkSession, d: str) -> DataFrame:
    """Play-time entry of each title key, by name or alias, in two passes."""
    return M.alias_match(played_titles(spark, d), durations(spark, d)).select("key", "ordinal", round6(F.col("score")).alias("score"), "pass")


def play_times(spark: SparkSession, d: str, match: DataFrame | None = None) -> DataFrame:
    """Hours of each title key; null where the main time is missing or fewer than three reports came in."""
    items = durations(spark, d).select("ordinal", "main", "extra", "complete", "count")
    good = (F.col("main") > 0) & (F.col("count") >= 3)
    found = M.alias_match(played_titles(spark, d, match), durations(spark, d)).join(items, "ordinal")
    return found.select("key", *[F.when(good, F.col(c)).alias(c) for c in ("main", "extra", "complete")], "count", X.fixed3(F.col("score")).alias("confidence"))


# ---- merging and enrichment ----------------------------------------------------------------------------------------


def list_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tier = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return e.select(F.col("user_id").alias("concept"), F.col("event_type").alias("list_key"), tier.alias("tier"), (F.col("value") > 50).alias("ps4"), (F.col("value") <= 50).alias("ps5"), F.col("props"), F.col("event_id").alias("ordinal"))


def merge_lists(spark: SparkSession, d: str) -> DataFrame:
    m = G.merge_lists(list_rows(spark, d), "concept", "list_key", "tier", ["ps4", "ps5"], ["props"], "ordinal")
    return m.select("concept", "tier", F.array_join("lists", ",").alias("lists"), "ps4", "ps5", "props")


def first_last_shortest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    first = G.keep_first(rows, ["p_brand"], ["p_partkey"]).select("p_brand", F.col("p_partkey").alias("first_key"))
    last = G.keep_last(rows, ["p_brand"], "p_partkey").select("p_brand", F.col("p_partkey").alias("last_key"))
    short = G.keep_shortest(rows, ["p_brand"], "p_name", "p_partkey").select("p_brand", F.col("p_partkey").alias("short_key"), "p_name", "first_seen")
    return first.join(last, "p_brand").join(short, "p_brand")


def product_platforms(spark: SparkSession, d: str) -> DataFrame:
    """Products with the ordered set of platforms of their listings; [] where there is none."""
    rows = table(spark, d, "xgp").select("product_id", F.posexplode_outer("platforms").alias("pos", "platform"))
    sets = rows.where("platform IS NOT NULL").groupBy("product_id").agg(G.ordered_set("platform", "pos").alias("platforms"))
    ids = table(spark, d, "xgp").select("product_id").distinct()
    return ids.join(sets, "product_id", "left").select("product_id", F.coalesce(F.array_join("platforms", ","), F.lit("")).alias("platforms"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Known hits and misses of the review cache, one whole row per slug: a hit before a miss, then the most reviews."""
    rows = table(spark, d, "mc_user_cache").where("slug IS NOT NULL AND status IS NOT NULL")
    order = F.struct((F.col("status") == "hit").alias("h"), F.coalesce("review_count", F.lit(-1)).alias("c"), F.coalesce("score", F.lit(-1.0)).alias("s"))
    return rows.groupBy("slug").agg(F.max_by(F.struct("status", "score", "review_count"), order).alias("c")).select("slug", "c.*")


def pending_slugs(spark: SparkSession, d: str) -> DataFrame:
    return G.pending(table(spark, d, "mc_cache"), cache(spark, d), "slug")


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "mc_cache").where("slug IS NOT NULL AND user_score > 0").groupBy("slug").agg(F.lit("hit").alias("status"), F.max("user_score").alias("score"), F.lit(None).cast("int").alias("review_count"))
    return G.cache_upsert(cache(spark, d).select("slug", "status", "score", F.col("review_count").cast("int").alias("review_count")), new, "slug")


def two_pass_lookup(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "mc_cache").where("slug IS NOT NULL").select("slug").distinct()
    first = cache(spark, d).select("slug", F.when(F.col("status") == "hit", F.nullif("score", F.lit(0.0))).alias("payload"))
    second = table(spark, d, "mc_cache").where("slug IS NOT NULL").groupBy("slug").agg(F.max(F.nullif("user_score", F.lit(0.0))).alias("payload"))
    return G.two_pass(queries, first, second, "slug").select("slug", "payload", "source")


def cover_difference(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "xgp").where("image <> ''").select(F.regexp_extract("image", "([^/]+)$", 1).alias("file"))
    have = table(spark, d, "games").where("title IS NOT NULL").select(F.concat("product_id", F.lit(".jpg")).alias("file"))
    return G.difference_both_ways(wanted, have, "file")


def enriched(spark: SparkSession, d: str, match: DataFrame | None = None) -> DataFrame:
    """Listings with match, user score and play time; the whole match is null where nothing matched or has a score.

    match: as ``matched`` has found it; it is found once for both the score and the play time."""
    rows = match_titles(spark, d).withColumn("key", X.normalize(F.col("title")))
    found = match or matched(spark, d)
    match = found.select("key", "slug", "critic_score", X.fixed3(F.col("score")).alias("confidence"))
    users = cache(spark, d).where("status = 'hit'").select("slug", F.nullif("score", F.lit(0.0)).alias("user_score"), F.col("review_count").alias("user_review_count"))
    times = play_times(spark, d, found).select("key", "main", "extra", "complete")
    metacritic = F.when(F.col("slug").isNotNull(), F.struct("critic_score", "slug", "confidence", "user_score", "user_review_count"))
    playtime = F.when(F.col("main").isNotNull(), F.struct("main", "extra", "complete"))
    nested = rows.join(match, "key", "left").join(users, "slug", "left").join(times, "key", "left").select("ordinal", "title", metacritic.alias("metacritic"), playtime.alias("playtime"))
    m = lambda c, name: F.col(f"metacritic.{c}").alias(name)
    return nested.select(F.col("ordinal").alias("product_id"), "title", m("critic_score", "critic"), m("slug", "slug"), m("confidence", "confidence"), m("user_score", "user_score"), m("user_review_count", "reviews"), "playtime.main", "playtime.extra", "playtime.complete")


# ---- names ---------------------------------------------------------------------------------------------------------


def names(spark: SparkSession, d: str, match: DataFrame | None = None) -> DataFrame:
    """Listings of all stores with the matched title, override, store name, and another store's name as lookup.

    What a name is looked up by is the matched title, else the store's.
    """
    rows = listings(spark, d, "title", "title_zh").where("title IS NOT NULL").withColumn("key", X.normalize(F.col("title"))).where("key <> ''")
    found = (match or matched(spark, d)).select("key", F.col("item_title").alias("match_title"))
    asked = rows.join(found, "key", "left").withColumn("query", X.marks_stripped(F.coalesce(F.nullif("match_title", F.lit("")), F.col("title")))).withColumn("_q", X.identity_key(F.col("query")))
    other = table(spark, d, "psplus").where("title <> '' AND title_zh <> ''").groupBy(X.identity_key(F.col("title")).alias("_q")).agg(F.min("title_zh").alias("lookup"))
    table_ = spark.createDataFrame(OVERRIDES, "t string, value string").select(X.identity_key(F.col("t")).alias("key"), "value")  # a few literal rows
    joined = asked.join(other.where("_q <> ''"), "_q", "left")
    return G.overrides(joined, F.broadcast(table_), [F.col("_q"), X.identity_key(F.col("title"))])


def resolve_names(spark: SparkSession, d: str, match: DataFrame | None = None) -> DataFrame:
    return N.resolve_names(names(spark, d, match), "product_id", "override", "title_zh", "lookup", ["title", "match_title"], SIMPLIFIED)


def tidy_names(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("title_zh")
    parts = [table(spark, d, t).where("title_zh IS NOT NULL").select("title_zh") for t in STORES]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return rows.withColumn("tidy", X.tidied(z, SIMPLIFIED)).select("title_zh", X.unquoted(F.col("tidy")).alias("tidy"), X.has_cjk(z).alias("cjk"), X.is_mixed(z).alias("mixed"), X.is_traditional(z, SIMPLIFIED).alias("traditional"))


# ---- rows, facets, pages -------------------------------------------------------------------------------------------


def console_flags(spark: SparkSession, d: str) -> DataFrame:
    older, newer = C.console_generations("console_gen", F.coalesce(F.array_contains("platforms", "console"), F.lit(False)))
    return table(spark, d, "xgp").select("product_id", older.alias("xbox_one"), newer.alias("xbox_series"), F.coalesce(F.array_contains("platforms", "cloud"), F.lit(False)).alias("cloud"), F.nullif(F.nullif("title_zh", F.lit("")), F.col("title")).alias("other_title"), X.cover_url(F.col("image")).alias("cover"))


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.facet_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def facet_split_choice(spark: SparkSession, d: str) -> DataFrame:
    return C.split_facet(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    """Orders that lineitem holds against those reported."""
    want = table(spark, d, "orders").select(F.count_distinct("o_orderkey").alias("want"))  # one row
    return C.completeness(table(spark, d, "lineitem").select("l_orderkey").distinct(), want)


def page_games(spark: SparkSession, d: str) -> DataFrame:
    """One row per product of the scored catalogue, flat: each part from the latest delivery that has it."""
    g = table(spark, d, "games").where("product_id IS NOT NULL").withColumns({"m": F.col("metacritic"), "p": F.col("playtime")})
    worth = [F.coalesce("m.score", F.lit(-1)), F.coalesce("m.url", F.lit("")), F.coalesce("m.user_score", F.lit(-1.0))]
    one = g.groupBy("product_id").agg(
        *[G.latest(c, "fetched_at").alias(c) for c in ("title", "title_zh", "release_date")],
        G.latest("m", "fetched_at", *worth).alias("m"),
        G.latest("p", "fetched_at", F.coalesce("p.main", F.lit(-1.0))).alias("p"),
        G.latest("platforms", "fetched_at", F.array_join("platforms", ",")).alias("platforms"),
    )
    return one.select("product_id", "title", "title_zh", F.col("m.score").alias("critic"), F.col("m.user_score").alias("user"), F.col("m.user_review_count").alias("reviews"), "m.url", F.col("m.title").alias("match_title"), "m.genres", F.col("m.release_date").alias("review_date"), "release_date", "p.main", "p.extra", "p.complete", "platforms")


def page_list(spark: SparkSession, d: str) -> DataFrame:
    """Bands, years with the store's as fallback, devices, and unrated games kept as their own band.

    A handheld takes what the pc list has, the cloud is a device of its own.
    """
    g = page_games(spark, d)
    year = F.coalesce(X.year_of(F.col("review_date")), X.year_of(F.col("release_date")))
    return g.where(year >= 2010).select("product_id", year.alias("year"), C.score_band(F.col("critic"), 75, 50).alias("critic_band"), C.score_band(F.col("user"), 7.5, 5.0).alias("user_band"), F.array_join(C.devices("platforms"), ",").alias("devices"), F.coalesce((F.col("critic") >= 90) & (F.col("user") >= 8) & (F.col("main") < 20), F.lit(False)).alias("planned_preset"))


def _page(spark: SparkSession, d: str, **choices) -> DataFrame:
    g = page_games(spark, d).withColumn("year", F.coalesce(X.year_of(F.col("review_date")), X.year_of(F.col("release_date"))))
    return C.page(g, **choices).select("product_id", "critic", "user", "year", "position")


def page_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Games on a handheld or in the cloud with at least 75 and 7.0, best user score first."""
    return _page(spark, d, selected=["handheld", "cloud"], least_critic=75, least_user=7.0, sort="user")


def page_with_unrated(spark: SparkSession, d: str) -> DataFrame:
    """Games of any year on pc with at least 60, and the unrated ones, best critic score first."""
    return _page(spark, d, selected=["pc"], least_critic=60, since=None, unrated=True, sort="critic")


def plan_filter(spark: SparkSession, d: str) -> DataFrame:
    """Products of a cumulative plan: the least tier of a product's listings, at most 2; console flags as filters."""
    p = table(spark, d, "psplus").groupBy("product_id").agg(F.min("tier").alias("tier"), F.max("ps4").alias("ps4"), F.max("ps5").alias("ps5"))
    return p.where("tier <= 2").select("product_id", "tier", (F.col("ps5") | F.col("ps4")).alias("on_ps5"), F.col("ps5").alias("native"))


def edition_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = page_games(spark, d).where("url IS NOT NULL")
    pc = F.coalesce(F.array_contains("platforms", "pc"), F.lit(False))
    return rows.groupBy("url").agg(F.count("*").alias("editions"), F.min("product_id").alias("first_id"), F.max(pc).alias("on_pc"))


def share_pages(spark: SparkSession, d: str) -> DataFrame:
    """All scored games in frames of twelve, best first."""
    best = page_games(spark, d).where("critic IS NOT NULL").select("product_id", "critic")
    return C.pages(best, [F.col("critic").desc(), F.col("product_id").asc()])


def search_titles(spark: SparkSession, d: str) -> DataFrame:
    return page_games(spark, d).where(F.lower("title").contains("oath") | F.col("title_zh").contains("誓言")).select("product_id", "title")


def collated_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles in a reader's order; the localized ones by pinyin."""
    return page_games(spark, d).select("product_id", "title", "title_zh").orderBy(F.collate("title", "UNICODE"), F.collate("title_zh", "zh_Hans"), "product_id")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    g = page_games(spark, d).where("critic IS NOT NULL")
    line = F.concat(X.padded(F.col("critic").cast("string"), 2, left=True), F.lit("/"), X.padded(F.coalesce(F.when(F.col("user").isNotNull(), F.format_string("%.1f", "user")), F.lit("-")), 4), F.lit(" "), X.padded(F.coalesce("title", F.lit("")), 28))
    return g.select("product_id", line.alias("line"))


def work_cap(spark: SparkSession, d: str) -> DataFrame:
    """The 800 customers first in line; the cap is the feature."""
    return table(spark, d, "customer").orderBy("c_custkey").limit(800).select("c_custkey", "c_name")


def work_left(spark: SparkSession, d: str) -> DataFrame:
    """Customers left for the next runs, and how many runs of 800 and minutes of 60 that makes."""
    rest = table(spark, d, "customer").join(work_cap(spark, d).select("c_custkey"), "c_custkey", "left_anti")
    n = F.count("*")
    return rest.agg(n.alias("left"), F.ceil(n / F.lit(800)).alias("runs"), F.ceil(n / F.lit(60)).alias("minutes"))


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 24 entries of each leading genre with the best critic score, by a total order."""
    from pyspark.sql import Window

    rows = table(spark, d, "mc_cache").select("ordinal", "slug", "critic_score", F.try_element_at("genres", F.lit(1))["name"].alias("genre")).where("genre IS NOT NULL")
    w = Window.partitionBy("genre").orderBy(F.col("critic_score").desc_nulls_last(), "ordinal")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 24")


def play_hours(spark: SparkSession, d: str) -> DataFrame:
    """Seconds as hours to one decimal, 0 as none, and the year penalty of two dates."""
    hours = F.floor(F.nullif(F.col("o_totalprice"), F.lit(0.0)) / 3600.0 * 10 + 0.5) / 10
    penalty = F.coalesce(F.least(F.lit(0.03), F.abs(F.year("o_orderdate") - 1998) * F.lit(0.004)), F.lit(0.0))
    return table(spark, d, "orders").select("o_orderkey", hours.alias("hours"), round6(penalty).alias("penalty"))


def json_probe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "int")
    return e.select("event_id", k.alias("k"), F.coalesce(F.is_variant_null(F.try_variant_get("v", "$.k", "variant")), F.lit(False)).alias("is_null"))


# ---- lookups -------------------------------------------------------------------------------------------------------


def knowledge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Store titles looked up among the review entries, by title or slug, games only."""
    entities = table(spark, d, "mc_cache").select("ordinal", F.array("type").alias("types"), F.array_compact(F.array("title", "slug")).alias("names"), F.col("slug").alias("label"))
    return K.knowledge_lookup(titles(spark, d).select(F.col("title").alias("query")), entities, ["game-title"])


def two_language_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "psplus")
    asked = table(spark, d, "xgp").where("title IS NOT NULL").select(F.col("title").alias("query"))
    return K.two_language_lookup(asked, p.select(F.col("product_id").alias("id"), F.col("title").alias("name")), p.select(F.col("product_id").alias("id"), F.col("title_zh").alias("name")))


def detail_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Details of the products on the pc list: the last delivery's, a description of at most 400 characters."""
    x = table(spark, d, "xgp")
    ids = x.where(F.array_contains("platforms", "pc")).select("product_id")
    wanted = x.select("product_id", F.substring(F.coalesce(F.nullif("short_description", F.lit("")), F.col("title")), 1, 400).alias("description"), "release_date", "fetched_at", F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("release_date", F.lit("")), F.coalesce("short_description", F.lit(""))).alias("tie"))
    return K.details(ids, wanted, "product_id", F.struct("fetched_at", "tie")).select("product_id", F.length("description").alias("described"))


def id_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct products of the three stores, with the number of stores and lists they stand on."""
    parts = [table(spark, d, t).select(F.lit(t).alias("store"), "product_id") for t in ("xgp", "psplus", "switch_catalog")]
    union, _ = K.tolerant_union([(str(i), lambda p=p: p) for i, p in enumerate(parts)])
    return union.where("product_id IS NOT NULL").groupBy("product_id").agg(F.count_distinct("store").alias("stores"), F.count("*").alias("deliveries"))


def url_keys(spark: SparkSession, d: str) -> DataFrame:
    """Host and path of image addresses, and titles as they stand in a query string."""
    x = table(spark, d, "xgp").where("image IS NOT NULL AND title IS NOT NULL").select("product_id", "image", "title").distinct()
    return x.select("product_id", F.parse_url("image", F.lit("HOST")).alias("host"), F.parse_url("image", F.lit("PATH")).alias("path"), F.length(F.url_decode(F.url_encode("title"))).alias("round_trip"))


def genre_component(spark: SparkSession, d: str) -> DataFrame:
    """The first genre entry named Action of each review entry, and whether there is one."""
    return table(spark, d, "mc_cache").select("ordinal", K.component("genres", "Action", "name").alias("action"))


# ---- metrics -------------------------------------------------------------------------------------------------------


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Totals, scored, with user score, with play time, and play-time coverage among the best, in one pass."""
    g = page_games(spark, d)
    best, timed = F.col("critic") >= 80, F.col("main") > 0
    counts = g.agg(F.count("*").alias("total"), F.count_if(F.col("critic") > 0).alias("scored"), F.count_if(F.col("user").isNotNull()).alias("with_user"), F.count_if(timed).alias("timed"), F.count_if(best).alias("best"), F.count_if(best & timed).alias("best_timed"), F.count_if(X.has_cjk(F.col("title_zh"))).alias("localized"))
    return counts.select("*", C.percent(F.col("best_timed"), F.col("best")).alias("coverage"))


def tier_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "psplus").groupBy("product_id").agg(F.min("tier").alias("tier"), F.max("title_zh").alias("zh"), F.max("ps5").alias("ps5"))
    return p.groupBy("tier").agg(F.count("*").alias("games"), F.count_if(X.has_cjk(F.col("zh"))).alias("localized"), F.count_if("ps5").alias("on_ps5"))


def list_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "psplus").select("product_id", F.explode("lists").alias("list")).groupBy("list").agg(F.count_distinct("product_id").alias("entries"))


def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Title keys matched, unmatched, and of the matched those whose user score the cache already knows."""
    keys = M.distinct_keys(match_titles(spark, d)).select("key")
    known = cache(spark, d).select("slug", F.lit(True).alias("_known"))
    s = keys.join(best_match(spark, d), "key", "left").join(known, "slug", "left")
    return s.agg(F.count_if(F.col("slug").isNotNull()).alias("matched"), F.count_if(F.col("slug").isNull()).alias("unmatched"), F.count_if("_known").alias("from_cache"))


def name_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Names by source, those that keep a Latin word, and those still in traditional characters."""
    name = F.col("name")
    return resolve_names(spark, d).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("names"), F.count_if(F.coalesce(X.is_mixed(name), F.lit(False))).alias("mixed"), F.count_if(X.is_traditional(name, SIMPLIFIED)).alias("traditional"))


def cover_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Covers wanted, there, new and orphaned, and wanted ones whose address is no file and so must fail."""
    counts = cover_difference(spark, d).groupBy("state").agg(F.count("*").alias("files"))
    failed = table(spark, d, "xgp").where("image <> ''").agg(F.lit("failed").alias("state"), F.count_if(~F.col("image").rlike(r"/[^/]+\.[a-z]+$")).alias("files"))
    return counts.unionByName(failed)


def platform_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Products on each handheld generation, and those sold as the second one's edition."""
    s = table(spark, d, "switch_catalog").where("product_id IS NOT NULL").groupBy("product_id").agg(F.max("switch1").alias("one"), F.max("switch2").alias("two"), F.max(F.coalesce(F.col("title").rlike(f"(?i){X.HANDHELD_EDITION}"), F.lit(False))).alias("edition"))
    return s.agg(F.count_if("one").alias("switch1"), F.count_if("two").alias("switch2"), F.count_if("edition").alias("editions"))


def list_platform_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "xgp").select("product_id", F.explode("platforms").alias("platform")).groupBy("platform").agg(F.count_distinct("product_id").alias("products"))


# ---- ranking -------------------------------------------------------------------------------------------------------


def rank_games(spark: SparkSession, d: str) -> DataFrame:
    g = page_games(spark, d)
    description = table(spark, d, "xgp").groupBy("product_id").agg(G.latest("short_description", "fetched_at").alias("description"))
    return g.where("title IS NOT NULL").join(description, "product_id", "left").select(F.col("product_id").alias("ordinal"), "title", "title_zh", "description", "url", "match_title", "genres", "critic", "user", "reviews")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    clusters = spark.createDataFrame(CLUSTERS, R.CLUSTERS)
    history = spark.createDataFrame([(h,) for h in HISTORY], "name string")
    return R.recommend(rank_games(spark, d), clusters, history)


def rank_all(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select(F.col("ordinal").alias("product_id"), round6(F.col("score")).alias("score"), "cluster", "why")


def rank_top20(spark: SparkSession, d: str) -> DataFrame:
    return R.top(_ranked(spark, d), 20).select(F.col("ordinal").alias("product_id"), round6(F.col("score")).alias("score"))


def rank_top8_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_cluster(_ranked(spark, d), 8).select("cluster", "place", F.col("ordinal").alias("product_id"))


def played_games(spark: SparkSession, d: str) -> DataFrame:
    history = spark.createDataFrame([(h,) for h in HISTORY], "name string")
    played, _ = R.split_played(rank_games(spark, d), history, R.title_forms(F.col("title"), F.col("match_title"), F.col("title_zh")))
    return played.select(F.col("ordinal").alias("product_id"), "title")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_titles, store_titles, title_variants, block_keys, part_pairs, html_strip, best_match, widened_match, alias_match, play_times, merge_lists, first_last_shortest,
        product_platforms, pending_slugs, cache_upsert, two_pass_lookup, cover_difference, enriched, resolve_names, tidy_names, console_flags, facet_counts, facet_split_choice,
        completeness_gate, page_list, page_by_user, page_with_unrated, plan_filter, edition_merge, share_pages, search_titles, collated_titles, report_lines, work_cap, work_left, top_candidates, play_hours, json_probe,
        knowledge_lookup, two_language_lookup, detail_lookup, id_union, url_keys, genre_component, run_metrics, tier_metrics, list_metrics, match_metrics, name_metrics, cover_metrics, platform_metrics, list_platform_metrics, rank_all, rank_top20, rank_top8_per_cluster, played_games,
    )
}

# ---- SQL -----------------------------------------------------------------------------------------------------------

_TITLES = "SELECT DISTINCT title FROM (SELECT title FROM xgp UNION ALL SELECT title FROM psplus UNION ALL SELECT title FROM switch_catalog) WHERE title IS NOT NULL"
_R6 = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
_VARIANTS = f"""
n AS (SELECT title, {S.normalize('title')} AS key, {S.normalize(S.before_dash('title'))} AS dash, {S.normalize("split_part(title, ':', 1)")} AS colon FROM t),
v AS (
  SELECT title, key, key AS query, 1.0::DOUBLE AS weight, 1 AS turn FROM n WHERE key <> ''
  UNION ALL SELECT title, key, dash, 0.97, 2 FROM n WHERE dash <> '' AND dash <> key
  UNION ALL SELECT title, key, colon, 0.97, CASE WHEN dash <> '' AND dash <> key THEN 3 ELSE 2 END FROM n WHERE colon <> '' AND colon <> key AND colon <> dash)"""
_STORES = " UNION ALL ".join(f"SELECT '{t}' AS store, product_id, title, title_zh, release_date, fetched_at FROM {t}" for t in STORES)
_LAST = lambda c, cond=None, ties=None: f"first({c} ORDER BY fetched_at DESC NULLS LAST, {ties or c + ' DESC'}) FILTER (WHERE {cond or c + chr(32) + '<>' + chr(32) + chr(39) * 2})"
_LISTED = f"SELECT product_id, min(store) AS store, {_LAST('title')} AS title, {_LAST('title_zh')} AS title_zh, {_LAST('release_date')} AS date FROM ({_STORES}) WHERE product_id IS NOT NULL GROUP BY 1"
_KEYS = f"""
l AS MATERIALIZED ({_LISTED}),
k0 AS MATERIALIZED (SELECT product_id, title, {S.year('date')} AS year, {S.normalize('title')} AS key FROM l WHERE title IS NOT NULL),
k AS MATERIALIZED (SELECT key, title, year FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY product_id) AS r FROM k0 WHERE key <> '') WHERE r = 1),
t AS (SELECT title FROM k)"""


def _matched(queries: str, items: str, bonus: bool, p: str = "") -> str:
    """Scores of all keys and items, with their rank: all pairs that pass the guards are compared in full, no blocks.

    Only where a title begins with no letter or digit of its own do the guards alone say too little; such pairs must
    share a word or the first two characters, as the operator's description has it.
    """
    rank = "p.s - coalesce(least(0.03::DOUBLE, abs(k.year - i.year) * 0.004::DOUBLE), 0)" + (" + CASE WHEN i.critic_score > 0 THEN 0.02::DOUBLE ELSE 0 END" if bonus else "")
    close = lambda x: f"replace({x}, ' ', '')"
    side = lambda c: f"{S.sequels(c)} AS n, string_split({S.flat(c)}, ' ') AS w, replace({S.flat(c)}, ' ', '') AS j"
    return f"""
{p}qs AS MATERIALIZED (SELECT *, {side('query')} FROM (SELECT DISTINCT query FROM ({queries}))),
{p}i AS MATERIALIZED ({items}),
{p}os AS MATERIALIZED (SELECT *, {side('item')} FROM (SELECT DISTINCT item FROM {p}i)),
{p}gd AS MATERIALIZED (SELECT query, item FROM {p}qs a JOIN {p}os b ON a.n = b.n WHERE (list_contains(b.w, a.w[1]) OR (starts_with(b.j, a.w[1]) AND starts_with(a.j, b.w[1]))) AND ((a.w[1] <> '' AND b.w[1] <> '') OR list_contains(b.w, a.w[1]) OR substring(a.j, 1, 2) = substring(b.j, 1, 2))),
{p}ds AS MATERIALIZED (SELECT query, item, greatest({S.dice('query', 'item')}, {S.dice(close('query'), close('item'))}) AS s FROM {p}gd),
{p}sc AS MATERIALIZED (SELECT q.key, q.turn, i.ordinal, q.weight * d.s AS s FROM {p}ds d JOIN ({queries}) q USING (query) JOIN {p}i i USING (item)),
{p}rk AS MATERIALIZED (SELECT p.key, p.ordinal, p.s, p.turn, {rank} AS ranked, k.year AS ky, i.year AS iy FROM {p}sc p JOIN k ON k.key = p.key JOIN (SELECT DISTINCT ordinal, year, critic_score FROM {p}i) i ON i.ordinal = p.ordinal WHERE p.s > 0)"""


_ITEMS = f"SELECT ordinal, slug, critic_score, {S.year('release_date')} AS year, item, title AS item_title, release_date FROM (SELECT *, {S.normalize('title')} AS item, row_number() OVER (PARTITION BY slug ORDER BY ordinal) AS r FROM mc_cache WHERE type = 'game-title' AND slug IS NOT NULL AND title IS NOT NULL) WHERE r = 1 AND item <> ''"
_VQ = "SELECT k.key, v.query, v.weight, v.turn FROM k JOIN v ON v.title = k.title"
_FIND = f"WITH {_KEYS}, {_VARIANTS}, {_matched(_VQ, _ITEMS, True)}, bp AS (SELECT key, ordinal, max(s) AS s, max(ranked) AS ranked FROM rk GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ranked DESC, ordinal) AS r FROM bp), best AS MATERIALIZED (SELECT w.key, i.slug, i.item_title, i.release_date AS review_date, w.s, nullif(i.critic_score, 0) AS critic_score FROM w JOIN i USING (ordinal) WHERE r = 1 AND s >= 0.82)"
_BEST = _FIND
_CACHE = "SELECT slug, status, score, review_count FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY status = 'hit' DESC, coalesce(review_count, -1) DESC, coalesce(score, -1) DESC) AS r FROM mc_user_cache WHERE slug IS NOT NULL AND status IS NOT NULL) WHERE r = 1"
_PAGE = f"""SELECT product_id, title, title_zh, m.score AS critic, m.user_score AS "user", m.user_review_count AS reviews, m.url AS url, m.title AS match_title, m.genres AS genres, m.release_date AS review_date, release_date, p.main AS main, p.extra AS extra, p.complete AS complete, platforms FROM (
SELECT product_id, {_LAST('title')} AS title, {_LAST('title_zh')} AS title_zh, {_LAST('release_date')} AS release_date, {_LAST('metacritic', 'metacritic IS NOT NULL', "coalesce(metacritic.score, -1) DESC, coalesce(metacritic.url, '') DESC, coalesce(metacritic.user_score, -1) DESC")} AS m,
{_LAST('playtime', 'playtime IS NOT NULL', 'coalesce(playtime.main, -1) DESC')} AS p, {_LAST('platforms', 'len(platforms) > 0', "array_to_string(platforms, ',') DESC")} AS platforms FROM games WHERE product_id IS NOT NULL GROUP BY 1)"""
_DURATIONS = f"""SELECT product_id AS ordinal, title AS name, nullif(concat_ws(',', replace(match_title, ',', ' '), nullif(replace(regexp_extract(url, '([^/]+)/*$', 1), '-', ' '), '')), '') AS alias, {S.year('release_date')} AS year, main, extra, complete, coalesce(reviews, 0) AS count FROM ({_PAGE}) WHERE title IS NOT NULL AND (main IS NOT NULL OR extra IS NOT NULL OR complete IS NOT NULL)"""
_SPOKEN = f"SELECT DISTINCT ordinal, year, 0 AS critic_score, item FROM (SELECT ordinal, year, {S.normalize('n')} AS item FROM (SELECT ordinal, year, unnest([name] || coalesce(string_split(alias, ','), [])) AS n FROM du)) WHERE item <> ''"
_TIMES = f"""{_FIND}, du AS MATERIALIZED ({_DURATIONS}),
pk0 AS MATERIALIZED (SELECT k0.*, coalesce(nullif(b.item_title, ''), k0.title) AS picked, coalesce({S.year('b.review_date')}, k0.year) AS py FROM k0 LEFT JOIN (SELECT * FROM best WHERE critic_score IS NOT NULL) b USING (key) WHERE key <> ''),
pk AS MATERIALIZED (SELECT * FROM (SELECT key, picked, py AS year, row_number() OVER (PARTITION BY key ORDER BY product_id) AS r FROM pk0) WHERE r = 1),
pq AS MATERIALIZED (SELECT key, key AS query, 1.0::DOUBLE AS weight, 2 AS turn FROM pk UNION ALL SELECT key, {S.normalize('picked')}, 1.0, 1 FROM pk WHERE {S.normalize('picked')} <> ''),
{_matched("SELECT * FROM pq", _SPOKEN, False, "z").replace("JOIN k ON", "JOIN pk k ON")},
zb AS (SELECT key, ordinal, max(s) FILTER (WHERE turn = 2) AS s2, max(s) AS s1, max(ranked) FILTER (WHERE turn = 2) AS r2, max(ranked) AS r1 FROM zrk GROUP BY 1, 2),
zp1 AS (SELECT * FROM (SELECT key, ordinal, s1 AS s, 1 AS pass, row_number() OVER (PARTITION BY key ORDER BY r1 DESC, ordinal) AS r FROM zb) WHERE r = 1 AND s >= 0.82),
zp2 AS (SELECT * FROM (SELECT key, ordinal, s2 AS s, 2 AS pass, row_number() OVER (PARTITION BY key ORDER BY r2 DESC, ordinal) AS r FROM zb WHERE s2 IS NOT NULL) WHERE r = 1 AND s >= 0.82),
pt AS MATERIALIZED (SELECT key, ordinal, s, pass FROM zp1 UNION ALL SELECT key, ordinal, s, pass FROM zp2 WHERE key NOT IN (SELECT key FROM zp1))"""
_HOURS = "SELECT pt.key, CASE WHEN main > 0 AND count >= 3 THEN main END AS main, CASE WHEN main > 0 AND count >= 3 THEN extra END AS extra, CASE WHEN main > 0 AND count >= 3 THEN complete END AS complete, count, printf('%.3f', s)::DOUBLE AS confidence FROM pt JOIN du USING (ordinal)"
_COVERS = "w AS (SELECT DISTINCT regexp_extract(image, '([^/]+)$', 1) AS file FROM xgp WHERE image <> ''), h AS (SELECT DISTINCT product_id || '.jpg' AS file FROM games WHERE title IS NOT NULL), diff AS (SELECT coalesce(w.file, h.file) AS file, CASE WHEN h.file IS NULL THEN 'new' WHEN w.file IS NULL THEN 'orphan' ELSE 'kept' END AS state FROM w FULL JOIN h USING (file))"
_LIST = lambda xs: "[" + ", ".join(S.q(x) for x in xs) + "]::VARCHAR[]"
_CLUSTERS = "SELECT * FROM (VALUES " + ", ".join(f"({o}, {S.q(k)}, {h}::DOUBLE, {_LIST(a)}, {_LIST(b)}, {_LIST(c)}, {_LIST(g)})" for o, k, h, a, b, c, g in CLUSTERS) + ") AS c(ord, cluster, hours, strong, named, weak, genre)"
_HISTORY = "SELECT DISTINCT name FROM (SELECT " + S.history_key("n") + " AS name FROM (VALUES " + ", ".join(f"({S.q(h)})" for h in HISTORY) + ") AS h(n)) WHERE name <> ''"
_FORM = lambda c: S.history_key(S.edition_stripped(f"replace(replace({c}, '《', ''), '》', '')"))
_PLAYED = f"forms AS (SELECT product_id, unnest([{_FORM('title')}, {_FORM('match_title')}, {_FORM('title_zh')}]) AS f FROM g), played AS (SELECT DISTINCT product_id FROM forms JOIN ({_HISTORY}) h ON f <> '' AND (f = h.name OR (length(h.name) >= 10 AND starts_with(f, h.name || ' '))))"
_RANKED = f"""WITH page AS ({_PAGE}), g0 AS (SELECT page.*, x.description, coalesce(nullif(url, ''), lower(page.title)) AS k FROM page LEFT JOIN (SELECT product_id, {_LAST('short_description')} AS description FROM xgp GROUP BY 1) x USING (product_id) WHERE page.title IS NOT NULL),
g1 AS (SELECT *, min(product_id) OVER (PARTITION BY k) AS first_seen, row_number() OVER (PARTITION BY k ORDER BY length(title), product_id) AS r FROM g0),
g AS (SELECT * FROM g1 WHERE r = 1 AND critic > 0), {_PLAYED},
x AS (SELECT *, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(array_to_string(genres, ' '), ''))) AS text, lower(concat_ws(' ', title, match_title)) AS tt FROM g WHERE product_id NOT IN (SELECT product_id FROM played)),
cl AS (SELECT *, sum(hours) OVER () AS total FROM ({_CLUSTERS})),
a AS (SELECT x.product_id, x.first_seen, x.critic, x."user", x.reviews, cl.ord, cl.cluster, cl.hours / cl.total AS part, list_filter(strong, lambda w: contains(text, w)) AS s, list_filter(named, lambda w: contains(tt, w)) AS n, list_filter(weak, lambda w: contains(text, w)) AS w, list_filter(genre, lambda w: list_contains(coalesce(genres, []), w)) AS ge FROM x, cl),
b AS (SELECT *, 3.0::DOUBLE * len(s) + 4.0::DOUBLE * len(n) + len(w) + 1.5::DOUBLE * len(ge) AS raw, array_to_string(list_slice(s || n || w || ge, 1, 3), ', ') AS why FROM a WHERE len(s) > 0 OR len(n) > 0 OR (len(ge) > 0 AND len(w) >= 2)),
h AS (SELECT *, raw / (raw + 3.0::DOUBLE) * part AS hit, 0.5::DOUBLE * critic / 100 + 0.5::DOUBLE * CASE WHEN "user" IS NOT NULL AND coalesce(reviews, 0) >= 30 THEN "user" / 10 ELSE critic / 100::DOUBLE END AS q FROM b),
ranked AS (SELECT product_id, first(first_seen) AS first_seen, sum(hit) * first(q) * first(q) AS score, arg_max(cluster, hit - ord * 1e-12) AS cluster, arg_max(why, hit - ord * 1e-12) AS why FROM h GROUP BY 1)"""
def _without(before: str, after: str, name: str, out: str, plain: str) -> str:
    """CTEs that cut a title out of a name."""
    edge = r"[\s\x{00A0}\x{3000}/|—–:：-]+"
    cut = S.squeeze(S.sub(f"substring({name}, 1, turn - 1) || ' ' || substring({name}, turn + length({plain}))", f"^{edge}|{edge}$"))
    chinese = S.sub("rest", "[^一-鿿]")
    return f"""{after}a AS MATERIALIZED (SELECT *, instr(lower({name}), lower({plain})) AS turn FROM {before}), {after}b AS MATERIALIZED (SELECT *, {cut} AS rest FROM {after}a),
{after} AS MATERIALIZED (SELECT * EXCLUDE (turn, rest), CASE WHEN length({plain}) >= 2 AND turn > 0 AND {chinese} <> '' AND NOT {S.only_editions(chinese)} THEN rest ELSE {name} END AS {out} FROM {after}b)"""


_NAMED = f"""{_FIND}, o(t, value) AS (VALUES {", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in OVERRIDES)}), ok AS (SELECT {S.identity_key('t')} AS key, value FROM o),
x AS MATERIALIZED (SELECT l.product_id, l.title, l.title_zh, k0.key FROM l JOIN k0 USING (product_id) WHERE k0.key <> ''),
p AS MATERIALIZED (SELECT {S.identity_key('title')} AS q, min(title_zh) AS lookup FROM psplus WHERE title <> '' AND title_zh <> '' GROUP BY 1),
x1 AS MATERIALIZED (SELECT x.*, b.item_title, {S.trim(S.sub("coalesce(nullif(b.item_title, ''), x.title)", '[®™©]'))} AS query FROM x LEFT JOIN (SELECT * FROM best WHERE critic_score IS NOT NULL) b USING (key)),
x2 AS MATERIALIZED (SELECT *, {S.identity_key('query')} AS q FROM x1),
r AS MATERIALIZED (SELECT x2.*, p.lookup, coalesce(a.value, b.value) AS override, {S.trim(S.sub('x2.title', '[®™©]'))} AS en, {S.trim(S.sub("coalesce(x2.item_title, '')", '[®™©]'))} AS en2 FROM x2 LEFT JOIN p ON p.q = x2.q AND p.q <> '' LEFT JOIN ok a ON a.key = x2.q LEFT JOIN ok b ON b.key = {S.identity_key('x2.title')}),
u AS (SELECT product_id, en, en2, override, 1 AS pri, override AS raw, 'override' AS source FROM r WHERE override IS NOT NULL UNION ALL SELECT product_id, en, en2, override, 2, title_zh, 'store' FROM r WHERE {S.has_cjk('title_zh')} UNION ALL SELECT product_id, en, en2, override, 3, lookup, 'lookup' FROM r WHERE lookup IS NOT NULL),
u1 AS MATERIALIZED (SELECT *, {S.tidy(f"translate(raw, {S.q(SIMPLIFIED[0])}, {S.q(SIMPLIFIED[1])})")} AS n0 FROM u),
{_without("u1", "u2", "n0", "n1", "en")}, {_without("u2", "u3", "n1", "n2", "en2")},
u5 AS MATERIALIZED (SELECT *, regexp_extract(n2, '[(（]([^()（）]*[一-鿿][^()（）]*)[)）]') AS br, regexp_extract(n2, '[(（]([^()（）]*[一-鿿][^()（）]*)[)）]', 1) AS inner_ FROM u3),
u6 AS MATERIALIZED (SELECT *, {S.tidy("CASE WHEN br <> '' AND NOT " + S.has_cjk("replace(n2, br, '')") + " THEN " + S.trim('inner_') + " ELSE n2 END")} AS name FROM u5),
good AS MATERIALIZED (SELECT *, CASE WHEN override IS NOT NULL THEN 0 WHEN {S.is_mixed('name')} THEN 1 ELSE 0 END AS later FROM u6 WHERE {S.has_cjk('name')}),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY later, pri) AS k FROM good) WHERE k = 1),
resolved AS (SELECT r.product_id, CASE WHEN r.override IS NOT NULL AND NOT {S.has_cjk('r.override')} THEN NULL ELSE pick.name END AS name, CASE WHEN r.override IS NOT NULL AND NOT {S.has_cjk('r.override')} THEN 'override' ELSE pick.source END AS source FROM r LEFT JOIN pick USING (product_id))"""
_TRADITIONAL = lambda c: f"coalesce(translate({c}, {S.q(SIMPLIFIED[0])}, {S.q(SIMPLIFIED[1])}) <> {c}, false)"
_DEVICES = "list_filter([CASE WHEN list_contains(platforms, 'console') THEN 'console' END, CASE WHEN list_contains(platforms, 'pc') THEN 'pc' END, CASE WHEN list_contains(platforms, 'pc') THEN 'handheld' END, CASE WHEN list_contains(platforms, 'cloud') THEN 'cloud' END], lambda x: x IS NOT NULL)"
_YEARS = f"SELECT *, coalesce({S.year('review_date')}, {S.year('release_date')}) AS year FROM ({_PAGE})"

ORACLE = {
    "normalize_titles": f"WITH t AS ({_TITLES}), n AS (SELECT title, {S.normalize('title')} AS key FROM t) SELECT title, key, array_to_string({S.sequels('key')}, ',') AS sequels, {S.flat('key')} AS flat, {S.identity_key('title')} AS identity, {S.history_key('title')} AS history, {S.edition_stripped('title')} AS stripped FROM n",
    "store_titles": "SELECT DISTINCT 'psplus' AS store, title, " + S.trim(S.sub(S.sub("title", X.CONSOLE_PAIR), X.CONSOLE_HITS)) + " AS clean FROM psplus WHERE title IS NOT NULL UNION ALL SELECT DISTINCT 'switch', title, " + S.squeeze(S.sub(S.sub("title", "[™®©]"), rf"(?i){X.HANDHELD_EDITION}\b.*$")) + " FROM switch_catalog WHERE title IS NOT NULL AND NOT regexp_matches(" + S.sub("title", "[™®©]") + rf", '(?i)\b({X.EXTRAS})\b')",
    "title_variants": f"WITH t AS ({_TITLES}), {_VARIANTS} SELECT title, query, weight FROM v",
    "block_keys": f"WITH t AS ({_TITLES}), n AS (SELECT DISTINCT {S.normalize('title')} AS key FROM t), f AS (SELECT key, string_split({S.flat('key')}, ' ') AS w, 'p:' || substring(replace({S.flat('key')}, ' ', ''), 1, 2) AS p FROM n) SELECT DISTINCT key, 'item' AS side, unnest(list_transform(w, lambda x: 'w:' || x) || [p]) AS block FROM f UNION ALL SELECT key, 'query', unnest(['w:' || w[1], p]) FROM f",
    "part_pairs": f"WITH n AS (SELECT DISTINCT p_name AS a, {S.normalize('p_name')} AS x, string_split({S.flat(S.normalize('p_name'))}, ' ') AS w FROM part), p AS (SELECT l.a, r.a AS b, l.x AS x, r.x AS y FROM n l JOIN n r ON list_contains(r.w, l.w[1]) OR substring(array_to_string(l.w, ''), 1, 2) = substring(array_to_string(r.w, ''), 1, 2)) SELECT a, b, {S.same_entry('x', 'y')} AS entry, {S.same_start('x', 'y')} AS start, {_R6(S.dice('x', 'y'))} AS dice, {_R6(S.dice("replace(x, ' ', '')", "replace(y, ' ', '')"))} AS close FROM p",
    "html_strip": "SELECT doc_id, length(t) AS kept, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, '<[^>]+>', '', 'g') AS t FROM documents WHERE text IS NOT NULL)",
    "best_match": f"{_BEST} SELECT key, slug, {_R6('s')} AS score, printf('%.3f', s)::DOUBLE AS confidence, critic_score FROM best",
    "widened_match": f"""WITH {_KEYS}, {_VARIANTS}, {_matched(_VQ, _ITEMS, True)}, turns AS (SELECT unnest([1, 2, 3]) AS n),
bp AS (SELECT n, key, ordinal, max(s) AS s, max(ranked) AS ranked, any_value(ky) AS ky, any_value(iy) AS iy FROM rk JOIN turns ON rk.turn <= turns.n GROUP BY 1, 2, 3),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, key ORDER BY ranked DESC, ordinal) AS r FROM bp) WHERE r = 1 AND s >= 0.82),
f AS (SELECT k.key, turns.n, w.ordinal, w.s, (w.s IS NULL OR w.s < 0.98 OR coalesce(abs(w.ky - w.iy) > 3, false)) AS shaky FROM k CROSS JOIN turns LEFT JOIN w ON w.key = k.key AND w.n = turns.n),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shaky, CASE WHEN shaky THEN -n ELSE n END) AS r FROM f) WHERE r = 1)
SELECT ch.key, i.slug, {_R6('ch.s')} AS score, ch.n AS rounds FROM ch JOIN i USING (ordinal)""",
    "alias_match": f"{_TIMES} SELECT key, ordinal, {_R6('s')} AS score, pass FROM pt",
    "play_times": f"{_TIMES} {_HOURS}",
    "merge_lists": "WITH r AS (SELECT user_id AS concept, event_type AS l, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 3 END AS tier, value > 50 AS ps4, value <= 50 AS ps5, props, event_id FROM events), l AS (SELECT concept, string_agg(l, ',' ORDER BY o) AS lists FROM (SELECT concept, l, min(event_id) AS o FROM r GROUP BY 1, 2) GROUP BY 1) SELECT concept, min(tier) AS tier, any_value(l.lists) AS lists, bool_or(ps4) AS ps4, bool_or(ps5) AS ps5, arg_min(props, event_id) AS props FROM r JOIN l USING (concept) GROUP BY concept",
    "first_last_shortest": "SELECT p_brand, min(p_partkey) AS first_key, max(p_partkey) AS last_key, arg_min(p_partkey, length(p_name) * 1000000000 + p_partkey) AS short_key, arg_min(p_name, length(p_name) * 1000000000 + p_partkey) AS p_name, min(p_partkey) AS first_seen FROM part GROUP BY 1",
    "product_platforms": "WITH r AS (SELECT product_id, unnest(platforms) AS p, generate_subscripts(platforms, 1) AS i FROM xgp), s AS (SELECT product_id, string_agg(p, ',' ORDER BY i, p) AS platforms FROM (SELECT product_id, p, min(i) AS i FROM r WHERE p IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT DISTINCT x.product_id, coalesce(s.platforms, '') AS platforms FROM xgp x LEFT JOIN s USING (product_id)",
    "pending_slugs": f"SELECT DISTINCT slug FROM mc_cache WHERE slug IS NOT NULL AND slug NOT IN (SELECT slug FROM ({_CACHE}))",
    "cache_upsert": f"WITH n AS (SELECT slug, 'hit' AS status, max(user_score) AS score, NULL::INTEGER AS review_count FROM mc_cache WHERE slug IS NOT NULL AND user_score > 0 GROUP BY 1) SELECT * FROM ({_CACHE}) WHERE slug NOT IN (SELECT slug FROM n) UNION ALL SELECT * FROM n",
    "two_pass_lookup": f"WITH a AS (SELECT slug, CASE WHEN status = 'hit' THEN nullif(score, 0) END AS p FROM ({_CACHE})), b AS (SELECT slug, max(nullif(user_score, 0)) AS p FROM mc_cache WHERE slug IS NOT NULL GROUP BY 1) SELECT b.slug, coalesce(a.p, b.p) AS payload, CASE WHEN a.p IS NOT NULL THEN 1 WHEN b.p IS NOT NULL THEN 2 END AS source FROM b LEFT JOIN a USING (slug)",
    "cover_difference": f"WITH {_COVERS} SELECT * FROM diff",
    "cover_metrics": f"WITH {_COVERS} SELECT state, count(*) AS files FROM diff GROUP BY 1 UNION ALL SELECT 'failed', count(*) FILTER (WHERE NOT regexp_matches(image, '/[^/]+\\.[a-z]+$')) FROM xgp WHERE image <> ''",
    "enriched": f"{_TIMES}, us AS ({_CACHE}), hr AS ({_HOURS}) SELECT k0.product_id, k0.title, b.critic_score AS critic, b.slug, b.confidence, u.score AS user_score, u.review_count AS reviews, hr.main, hr.extra, hr.complete FROM k0 LEFT JOIN (SELECT *, printf('%.3f', s)::DOUBLE AS confidence FROM best WHERE critic_score IS NOT NULL) b ON b.key = k0.key LEFT JOIN (SELECT slug, nullif(score, 0) AS score, review_count FROM us WHERE status = 'hit') u ON u.slug = b.slug LEFT JOIN hr ON hr.key = k0.key",
    "match_metrics": f"{_BEST}, us AS ({_CACHE}) SELECT count(best.slug) AS matched, count(*) - count(best.slug) AS unmatched, count(us.slug) AS from_cache FROM k LEFT JOIN best USING (key) LEFT JOIN us ON us.slug = best.slug",
    "resolve_names": f"{_NAMED} SELECT product_id, name, source FROM resolved",
    "name_metrics": f"{_NAMED} SELECT coalesce(source, 'none') AS source, count(*) AS names, count(*) FILTER (WHERE {S.is_mixed('name')}) AS mixed, count(*) FILTER (WHERE {_TRADITIONAL('name')}) AS traditional FROM resolved GROUP BY 1",
    "tidy_names": f"SELECT DISTINCT title_zh, {S.tidy(f'translate(title_zh, {S.q(SIMPLIFIED[0])}, {S.q(SIMPLIFIED[1])})')} AS tidy, {S.has_cjk('title_zh')} AS cjk, {S.is_mixed('title_zh')} AS mixed, {_TRADITIONAL('title_zh')} AS traditional FROM ({_STORES}) WHERE title_zh IS NOT NULL",
    "console_flags": "WITH x AS (SELECT *, coalesce(list_contains(platforms, 'console'), false) AS c, CASE WHEN console_gen IS NULL OR NOT json_valid(console_gen) THEN 'absent' WHEN json_type(console_gen) = 'NULL' THEN 'null' ELSE 'list' END AS kind FROM xgp) SELECT product_id, c AND (kind IN ('null', 'absent') OR (kind = 'list' AND contains(console_gen, '\"ConsoleGen8\"'))) AS xbox_one, c AND (kind = 'null' OR (kind = 'list' AND contains(console_gen, '\"ConsoleGen9\"'))) AS xbox_series, coalesce(list_contains(platforms, 'cloud'), false) AS cloud, nullif(nullif(title_zh, ''), title) AS other_title, regexp_replace(image, '" + X.COVER_STEPS + "', '/image/\\1/" + X.COVER_FORM + "/', 'g') AS cover FROM x",
    "facet_counts": "SELECT 'p_brand' AS attribute, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2",
    "facet_split_choice": "WITH f AS (SELECT 1 AS o, 'p_brand' AS attribute, p_brand AS value, count(*) AS n FROM part GROUP BY 3 UNION ALL SELECT 2, 'p_type', p_type, count(*) FROM part GROUP BY 3 UNION ALL SELECT 3, 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 3), t AS (SELECT count(*) AS total FROM part) SELECT attribute, value, n, least(n, total - n) AS balance FROM f, t WHERE n < total ORDER BY balance DESC, o, value LIMIT 1",
    "completeness_gate": "SELECT a AS fetched, b AS expected, a >= b * 0.99 AS complete FROM (SELECT count(DISTINCT l_orderkey) AS a FROM lineitem), (SELECT count(DISTINCT o_orderkey) AS b FROM orders)",
    "page_list": f"SELECT product_id, year, CASE WHEN critic IS NULL THEN 'none' WHEN critic >= 75 THEN 'high' WHEN critic >= 50 THEN 'middle' ELSE 'low' END AS critic_band, CASE WHEN \"user\" IS NULL THEN 'none' WHEN \"user\" >= 7.5 THEN 'high' WHEN \"user\" >= 5 THEN 'middle' ELSE 'low' END AS user_band, array_to_string({_DEVICES}, ',') AS devices, coalesce(critic >= 90 AND \"user\" >= 8 AND main < 20, false) AS planned_preset FROM ({_YEARS}) WHERE year >= 2010",
    "page_by_user": f"SELECT product_id, critic, \"user\", year, row_number() OVER (ORDER BY \"user\" DESC NULLS LAST, product_id) AS position FROM ({_YEARS}) WHERE list_has_any({_DEVICES}, ['handheld', 'cloud']) AND critic >= 75 AND \"user\" >= 7.0 AND year >= 2010",
    "page_with_unrated": f"SELECT product_id, critic, \"user\", year, row_number() OVER (ORDER BY critic DESC NULLS LAST, product_id) AS position FROM ({_YEARS}) WHERE list_contains({_DEVICES}, 'pc') AND (critic IS NULL OR critic >= 60)",
    "plan_filter": "SELECT product_id, tier, ps5 OR ps4 AS on_ps5, ps5 AS native FROM (SELECT product_id, min(tier) AS tier, bool_or(ps4) AS ps4, bool_or(ps5) AS ps5 FROM psplus GROUP BY 1) WHERE tier <= 2",
    "edition_merge": f"WITH g AS ({_PAGE}) SELECT url, count(*) AS editions, min(product_id) AS first_id, bool_or(coalesce(list_contains(platforms, 'pc'), false)) AS on_pc FROM g WHERE url IS NOT NULL GROUP BY 1",
    "share_pages": f"SELECT product_id, critic, place, ((place - 1) // 12)::INTEGER AS page FROM (SELECT product_id, critic, row_number() OVER (ORDER BY critic DESC, product_id) AS place FROM ({_PAGE}) WHERE critic IS NOT NULL)",
    "search_titles": f"WITH g AS ({_PAGE}) SELECT product_id, title FROM g WHERE contains(lower(title), 'oath') OR contains(title_zh, '誓言')",
    "report_lines": f"WITH g AS ({_PAGE}) SELECT product_id, lpad(critic::VARCHAR, greatest(length(critic::VARCHAR), 2)::INTEGER, ' ') || '/' || rpad(coalesce(printf('%.1f', \"user\"), '-'), greatest(length(coalesce(printf('%.1f', \"user\"), '-')), 4)::INTEGER, ' ') || ' ' || rpad(coalesce(title, ''), greatest(length(coalesce(title, '')), 28)::INTEGER, ' ') AS line FROM g WHERE critic IS NOT NULL",
    "work_cap": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 800",
    "work_left": "SELECT count(*) AS left, ceil(count(*) / 800)::BIGINT AS runs, ceil(count(*) / 60)::BIGINT AS minutes FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 800)",
    "top_candidates": "SELECT ordinal, slug, critic_score, genre, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY critic_score DESC NULLS LAST, ordinal) AS place FROM (SELECT ordinal, slug, critic_score, genres[1].name AS genre FROM mc_cache) WHERE genre IS NOT NULL) WHERE place <= 24",
    "play_hours": f"SELECT o_orderkey, floor(nullif(o_totalprice, 0) / 3600 * 10 + 0.5) / 10 AS hours, {_R6("coalesce(least(0.03::DOUBLE, abs(year(o_orderdate) - 1998) * 0.004::DOUBLE), 0)")} AS penalty FROM orders",
    "json_probe": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_type(props, '$.k') = 'NULL', false) AS is_null FROM events",
    "knowledge_lookup": f"WITH q AS (SELECT title AS query, {S.identity_key('title')} AS k FROM ({_TITLES})), e AS (SELECT ordinal, slug, unnest([title, slug]) AS n FROM mc_cache WHERE type = 'game-title'), f AS (SELECT {S.identity_key('n')} AS k, min(ordinal) AS ordinal, arg_min(struct_pack(l := slug), ordinal).l AS label FROM e WHERE n IS NOT NULL GROUP BY 1) SELECT query, ordinal, label FROM q JOIN f USING (k) WHERE k <> ''",
    "two_language_lookup": f"WITH q AS (SELECT DISTINCT title AS query, {S.identity_key('title')} AS k FROM xgp WHERE title IS NOT NULL), e AS (SELECT product_id AS id, {S.identity_key('title')} AS k FROM psplus), z AS (SELECT product_id AS id, min(title_zh) AS name FROM psplus WHERE {S.has_cjk('title_zh')} GROUP BY 1) SELECT query, arg_min(name, id) AS name FROM q JOIN e USING (k) JOIN z USING (id) WHERE k <> '' GROUP BY 1",
    "id_union": "SELECT product_id, count(DISTINCT s) AS stores, count(*) AS deliveries FROM (SELECT 1 AS s, product_id FROM xgp UNION ALL SELECT 2, product_id FROM psplus UNION ALL SELECT 3, product_id FROM switch_catalog) WHERE product_id IS NOT NULL GROUP BY 1",
    "url_keys": "SELECT DISTINCT ON (product_id, image, title) product_id, regexp_extract(image, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(image, '^[a-z]+://[^/]+([^?]*)', 1) AS path, length(title)::INTEGER AS round_trip FROM xgp WHERE image IS NOT NULL AND title IS NOT NULL",
    "genre_component": "SELECT ordinal, list_filter(genres, lambda g: g.name = 'Action')[1].name AS action FROM mc_cache",
    "run_metrics": f"WITH g AS ({_PAGE}), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE critic > 0) AS scored, count(\"user\") AS with_user, count(*) FILTER (WHERE main > 0) AS timed, count(*) FILTER (WHERE critic >= 80) AS best, count(*) FILTER (WHERE critic >= 80 AND main > 0) AS best_timed, count(*) FILTER (WHERE {S.has_cjk('title_zh')}) AS localized FROM g) SELECT *, floor(100.0::DOUBLE * best_timed / nullif(best, 0) + 0.5)::BIGINT AS coverage FROM c",
    "tier_metrics": f"SELECT tier, count(*) AS games, count(*) FILTER (WHERE {S.has_cjk('zh')}) AS localized, count(*) FILTER (WHERE ps5) AS on_ps5 FROM (SELECT product_id, min(tier) AS tier, max(title_zh) AS zh, bool_or(ps5) AS ps5 FROM psplus GROUP BY 1) GROUP BY 1",
    "list_metrics": "SELECT list, count(DISTINCT product_id) AS entries FROM (SELECT product_id, unnest(lists) AS list FROM psplus) GROUP BY 1",
    "platform_metrics": rf"SELECT count(*) FILTER (WHERE a) AS switch1, count(*) FILTER (WHERE b) AS switch2, count(*) FILTER (WHERE e) AS editions FROM (SELECT product_id, bool_or(switch1) AS a, bool_or(switch2) AS b, bool_or(coalesce(regexp_matches(title, '(?i){X.HANDHELD_EDITION}'), false)) AS e FROM switch_catalog WHERE product_id IS NOT NULL GROUP BY 1)",
    "list_platform_metrics": "SELECT platform, count(DISTINCT product_id) AS products FROM (SELECT product_id, unnest(platforms) AS platform FROM xgp) GROUP BY 1",
    "collated_titles": f"SELECT product_id, title, title_zh FROM ({_PAGE})",
    "detail_lookup": "WITH w AS (SELECT product_id, coalesce(nullif(short_description, ''), title) AS description, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC NULLS LAST, tie DESC) AS r FROM (SELECT *, coalesce(title, '') || '|' || coalesce(release_date, '') || '|' || coalesce(short_description, '') AS tie FROM xgp)) SELECT product_id, length(substring(description, 1, 400))::INTEGER AS described FROM w WHERE r = 1 AND product_id IN (SELECT product_id FROM xgp WHERE list_contains(platforms, 'pc'))",
    "rank_all": f"{_RANKED} SELECT product_id, {_R6('score')} AS score, cluster, why FROM ranked WHERE score > 0",
    "rank_top20": f"{_RANKED} SELECT product_id, {_R6('score')} AS score FROM ranked WHERE score > 0 ORDER BY ranked.score DESC, first_seen LIMIT 20",
    "rank_top8_per_cluster": f"{_RANKED} SELECT cluster, place::INTEGER AS place, product_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, first_seen) AS place FROM ranked WHERE score > 0) WHERE place <= 8",
    "played_games": f"WITH g AS (SELECT * FROM ({_PAGE}) WHERE title IS NOT NULL), {_PLAYED} SELECT g.product_id, g.title FROM g JOIN played USING (product_id)",
}
