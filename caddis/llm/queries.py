"""Queries of the training-data operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caddis.llm.blend import blended_ranking
from caddis.llm.encode import encode_texts, token_counts
from caddis.llm.entities import match_records
from caddis.llm.listings import group_listings, same_item_pairs
from caddis.llm.packing import pack, packing_report
from caddis.llm.repetition import repeated_share, repetitive
from caddis.llm.scripts import lookalike_pairs, with_consistent_form
from caddis.llm.titles import localized_name
from caddis.session import cut, drop_cut, freed_shuffles
from caddis.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [("psplus.title", "psplus", "title"), ("xgp.title_zh", "xgp", "title_zh")]
    found = [lookalike_pairs(table(spark, d, t), "product_id", c).select(F.lit(f).alias("field"), F.col("id_a").alias("product_id_a"), F.col("id_b").alias("product_id_b")) for f, t, c in parts]
    return found[0].unionByName(found[1])


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form, with the number of other products' rows that look the same but are spelled
    otherwise (``links``). Rows are counted by form and by spelling, so a form that very many share is one row there."""
    parts = [("psplus.title", "psplus", "title"), ("xgp.title_zh", "xgp", "title_zh")]
    rows = [table(spark, d, t).select(F.lit(f).alias("field"), "product_id", F.col(c).alias("text")).distinct() for f, t, c in parts]
    forms = cut(with_consistent_form(rows[0].unionByName(rows[1]), "text"))
    spelled = forms.where("consistent <> ''").groupBy("field", "consistent", "text").agg(F.count("*").alias("_n"))
    alike = spelled.groupBy("field", "consistent").agg(F.sum("_n").alias("_all"))
    links = spelled.join(alike, ["field", "consistent"]).select("field", "text", (F.col("_all") - F.col("_n")).alias("links"))
    return forms.join(links, ["field", "text"], "left").select("field", "product_id", "text", "consistent", F.coalesce("links", F.lit(0)).alias("links"))


def scored_games(spark: SparkSession, d: str) -> DataFrame:
    """One row per product: its latest delivery's critic score, and the user score and review count of its entry."""
    w = Window.partitionBy("product_id").orderBy(F.col("fetched_at").desc_nulls_last(), F.col("critic").desc_nulls_last(), "slug")
    critic = F.when(F.col("metacritic.score") > 0, F.col("metacritic.score").cast("double"))
    games = (
        table(spark, d, "games")
        .select("product_id", "fetched_at", critic.alias("critic"), F.regexp_extract("metacritic.url", r"([^/]+)/*$", 1).alias("slug"))
        .withColumn("_k", F.row_number().over(w))
        .where("_k = 1")
    )
    users = table(spark, d, "mc_user_cache").where("slug IS NOT NULL AND status = 'hit'").groupBy("slug").agg(F.max(F.struct("review_count", "score")).alias("u"))
    users = users.select("slug", F.when(F.col("u.score") > 0, F.col("u.score")).alias("user"), F.col("u.review_count").cast("double").alias("review_count"))
    return games.join(users, "slug", "left").select("product_id", "critic", "user", "review_count")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """One ranking of the games; the projection is shown to six decimals, the position is by its full value."""
    ranked = blended_ranking(scored_games(spark, d), "product_id", {"critic": 1, "user": 1, "review_count": 1})[0]
    return ranked.withColumn("projection", F.floor(F.col("projection") * 1e6 + 0.5) / 1e6)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "containers").where("container_kind IS NOT NULL AND capacity_tokens > 0")
    rows = kinds.groupBy("container_kind").agg(F.min("capacity_tokens")).limit(1_001).collect()  # a repeated kind has its least capacity
    if len(rows) > 1_000:
        raise ValueError("more than 1,000 kinds of containers")
    capacities = {r[0]: r[1] for r in rows}
    return pack(token_counts(table(spark, d, "documents")), capacities)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeated_share(table(spark, d, "documents"))


def _latest(df: DataFrame, *columns: str) -> DataFrame:
    """One row per product: its latest non-empty title and the other columns' latest non-empty values."""
    filled = {c: F.when(F.col(c).cast("string") != "", F.col(c)) if t == "string" else F.when(F.size(c) > 0, F.col(c)) for c, t in df.select(*columns).dtypes}
    return df.where("product_id IS NOT NULL").groupBy("product_id").agg(*[F.max_by(v, F.when(v.isNotNull(), F.struct(F.col("fetched_at"), v.cast("string")))).alias(c) for c, v in filled.items()])


def listings(spark: SparkSession, d: str) -> DataFrame:
    """One row per product of the three catalogues: its latest non-empty title, localized name, full release date and makers."""

    @F.pandas_udf("string")
    def local(titles):
        return titles.map(localized_name, na_action="ignore")

    parts = [table(spark, d, t).select("product_id", "title", "title_zh", "release_date", "developer", "publisher", "fetched_at") for t in ("xgp", "psplus", "switch_catalog")]
    rows = _latest(parts[0].unionByName(parts[1]).unionByName(parts[2]), "title", "title_zh", "release_date", "developer", "publisher")
    day = F.substring("release_date", 1, 10)
    return rows.withColumn("release_date", F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), day)).withColumn("title_zh", local("title_zh"))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    with freed_shuffles(spark):
        rows = cut(listings(spark, d))
    groups = group_listings(rows, facts=("release_date", "title_zh"), makers=("developer", "publisher"))
    drop_cut(rows)
    return groups


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its group and the number of the group's other listings (``links``)."""
    groups = _grouped(spark, d).select(F.col("id").alias("product_id"), F.col("group").alias("group_id")).distinct()
    groups = cut(groups)
    sizes = groups.groupBy("group_id").agg((F.count("*") - 1).alias("links"))
    return groups.join(sizes, "group_id").select("product_id", "group_id", "links")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return same_item_pairs(_grouped(spark, d)).select(F.col("id_a").alias("product_id_a"), F.col("id_b").alias("product_id_b"))


def review_entries(spark: SparkSession, d: str) -> DataFrame:
    """One row per slug of the review cache; a missing title is read off the slug, without a namesake's year."""
    entries = table(spark, d, "mc_cache").where("slug IS NOT NULL")
    genres = F.filter(F.transform("genres", lambda g: g["name"]), lambda g: g.isNotNull() & (g != ""))
    one = entries.groupBy(F.col("slug").alias("_id")).agg(
        F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.col("ordinal"))).alias("title"),
        F.min(F.when(F.col("release_date").rlike("[0-9]"), F.col("release_date"))).alias("_date"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce(genres, F.array().cast("array<string>"))))).alias("_genres"),
        F.coalesce(F.max(F.col("type") != "game-title"), F.lit(False)).alias("_dlc"),
    )
    spoken = F.translate(F.regexp_replace("_id", r"-(19|20)\d\d$", ""), "-", " ")
    return one.select("_id", F.coalesce("title", spoken).alias("_title"), "_date", "_genres", "_dlc")


def unmatched_games(spark: SparkSession, d: str, attached: bool = False) -> DataFrame:
    games = table(spark, d, "games")
    having = games.groupBy("product_id").agg(F.max(F.col("metacritic").isNotNull()).alias("_has")).where(F.col("_has") == attached).select("product_id")
    return _latest(games, "title", "release_date", "categories").join(having, "product_id").select(F.col("product_id").alias("_id"), F.col("title").alias("_title"), F.col("release_date").alias("_date"), F.col("categories").alias("_genres"), F.lit(False).alias("_dlc"))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_records(unmatched_games(spark, d), review_entries(spark, d)).select(F.col("l_id").alias("product_id"), F.col("r_id").alias("slug"), "confidence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("product_id", "slug")


QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_ranking": p4_ranking,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p7_ids": p7_ids,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

_SCORES = ("critic", "user", "review_count")
_PAIRS = ((0, 1), (0, 2), (1, 2))
_RANKED = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE END AS r{i}" for i, c in enumerate(_SCORES))
_Z = ", ".join(f"(r{i} - avg(r{i}) OVER ()) / nullif(stddev_pop(r{i}) OVER (), 0) AS z{i}" for i in range(3))
# the first component by power iteration, from equal loadings
_STEP = [" + ".join("w%d" % j if i == j else f"c{min(i, j)}{max(i, j)} * w{j}" for j in range(3)) for i in range(3)]

ORACLE: dict[str, str] = {
    "p4_ranking": f"""WITH RECURSIVE one AS (
  SELECT product_id, CASE WHEN metacritic.score > 0 THEN metacritic.score::DOUBLE END AS critic, regexp_extract(metacritic.url, '([^/]+)/*$', 1) AS slug,
    row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC NULLS LAST, CASE WHEN metacritic.score > 0 THEN metacritic.score END DESC NULLS LAST, regexp_extract(metacritic.url, '([^/]+)/*$', 1) NULLS FIRST) AS k FROM games),
u AS (SELECT slug, CASE WHEN score > 0 THEN score END AS "user", review_count::DOUBLE AS review_count FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY review_count DESC NULLS LAST, score DESC NULLS LAST) AS k FROM mc_user_cache WHERE slug IS NOT NULL AND status = 'hit') WHERE k = 1),
g AS (SELECT product_id, critic, u."user", u.review_count FROM one LEFT JOIN u USING (slug) WHERE k = 1),
r AS (SELECT product_id, {", ".join(f'g."{c}"' for c in _SCORES)}, {_RANKED.replace("user", '"user"')} FROM g),
z AS MATERIALIZED (SELECT *, {_Z} FROM r),
c AS MATERIALIZED (SELECT {", ".join(f"coalesce(corr(z{i}, z{j}), 0) AS c{i}{j}" for i, j in _PAIRS)} FROM z),
w AS (SELECT 0 AS n, 1.0::DOUBLE AS w0, 1.0::DOUBLE AS w1, 1.0::DOUBLE AS w2 UNION ALL SELECT n + 1, a / sqrt(a * a + b * b + d * d), b / sqrt(a * a + b * b + d * d), d / sqrt(a * a + b * b + d * d) FROM (SELECT n, {_STEP[0]} AS a, {_STEP[1]} AS b, {_STEP[2]} AS d FROM w, c WHERE n < 2000)),
f AS (SELECT * FROM w WHERE n = 2000),
p AS (SELECT product_id, critic, "user", review_count, CASE WHEN coalesce(z0, z1, z2) IS NOT NULL THEN coalesce(z0, 0) * w0 + coalesce(z1, 0) * w1 + coalesce(z2, 0) * w2 END AS projection FROM z, f)
SELECT product_id, critic, "user", review_count, floor(projection * 1e6 + 0.5) / 1e6 AS projection, row_number() OVER (ORDER BY projection DESC NULLS LAST, product_id NULLS FIRST) AS position FROM p""",
}
