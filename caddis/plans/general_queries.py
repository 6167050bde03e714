"""Queries of the general data-processing operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caddis.operators.shred import game_objects, shred
from caddis.operators.snapshots import snapshot_changes, validity_intervals
from caddis.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    occurrences, bridges, _ = shred(table(spark, d, "raw_games"))
    return game_objects(occurrences, bridges).select("envelope_id", "game_pos", "kind", "parent_pos", "pos").distinct()


def _own(nodes: DataFrame, kind: str, fields: str) -> DataFrame:
    """(node_id, a): the own fields of the objects of a kind. Numbers are read as text and cast, as some are spelled so."""
    return nodes.where(F.col("kind") == kind).select("node_id", F.from_json("attributes", fields).alias("a"))


def _flat(spark: SparkSession, d: str, kind: str, fields: str, *columns) -> DataFrame:
    """One flat table: the objects of a kind with their parent link and their own fields."""
    occurrences, bridges, nodes = shred(table(spark, d, "raw_games"))
    rows = game_objects(occurrences, bridges).where(F.col("kind") == kind)
    return rows.join(_own(nodes, kind, fields), "node_id").select("envelope_id", "game_pos", *(["parent_pos"] if kind == "review" else []), "pos", *columns)


def _double(path: str, name: str):
    return F.col(path).try_cast("double").alias(name)


def p1_games(spark: SparkSession, d: str) -> DataFrame:
    """Games with the fields of their metacritic and playtime objects, null where these are missing."""
    occurrences, bridges, nodes = shred(table(spark, d, "raw_games"))
    games = _own(nodes, "game", "productId string, title string, releaseDate string").select("node_id", F.col("a.productId").alias("product_id"), F.col("a.title").alias("title"), F.col("a.releaseDate").alias("release_date"))
    critic = _own(nodes, "metacritic", "score string, mustPlay boolean, user struct<score:string,count:string>").select("node_id", _double("a.score", "critic"), F.col("a.mustPlay").alias("must_play"), _double("a.user.score", "user_score"), F.col("a.user.count").try_cast("bigint").alias("user_count"))
    time = _own(nodes, "playtime", "main string, extra string, complete string").select("node_id", _double("a.main", "main"), _double("a.extra", "extra"), _double("a.complete", "complete"))
    for kind, own in (("metacritic", critic), ("playtime", time)):
        below = bridges.where(F.col("kind") == kind).select(F.col("parent_id").alias("_n"), "node_id").join(own, "node_id").drop("node_id")
        games = games.join(below.withColumnRenamed("_n", "node_id"), "node_id", "left")
    return occurrences.select(F.col("root_id").alias("envelope_id"), F.col("ordinal").alias("game_pos"), "node_id").join(games, "node_id").drop("node_id")


def p1_genres(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "genre", "name string", F.col("a.name").alias("name"))


def p1_platforms(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "platform", "name string, critic struct<score:string,count:string>", F.col("a.name").alias("name"), _double("a.critic.score", "critic"), F.col("a.critic.count").try_cast("bigint").alias("critic_count"))


def p1_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "review", "outlet string, score string, published string, author struct<alias:string,verified:boolean>", F.col("a.outlet").alias("outlet"), _double("a.score", "score"), F.col("a.published").alias("published"), F.col("a.author.alias").alias("author_alias"), F.col("a.author.verified").alias("author_verified"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "run", "kind string, hours string, platform string, player struct<id:string,tags:array<string>>", F.col("a.kind").alias("kind"), _double("a.hours", "hours"), F.col("a.platform").alias("platform"), F.col("a.player.id").try_cast("bigint").alias("player_id"), F.array_join("a.player.tags", ",").alias("player_tags"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "catalog_snapshots")).select("service", F.col("key").alias("product_id"), "snapshot_date", "change")


def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    return validity_intervals(table(spark, d, "catalog_snapshots")).select("service", F.col("key").alias("product_id"), "first_date", "last_date", "next_date")


_LATEST = """
WITH d AS (SELECT service, snapshot_date, row_number() OVER (PARTITION BY service ORDER BY snapshot_date) AS n FROM (SELECT DISTINCT service, snapshot_date FROM catalog_snapshots)),
r AS (
  SELECT service, snapshot_date, product_id, title, tier, list_sort(list_distinct(platforms)) AS p,
    row_number() OVER (PARTITION BY service, snapshot_date, product_id ORDER BY loaded_at DESC NULLS LAST) AS k
  FROM catalog_snapshots),
s AS (SELECT r.service, r.snapshot_date, d.n, product_id, title, tier, p FROM r JOIN d USING (service, snapshot_date) WHERE k = 1)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_games, p1_genres, p1_platforms, p1_reviews, p1_runs, p5_found, p5_intervals)}


def _text(v: str, times: int = 2) -> str:
    """A JSON value, read again while it is a text that holds JSON."""
    for _ in range(times):
        v = f"CASE WHEN json_type({v}) = 'VARCHAR' AND json_valid({v} ->> '$') THEN ({v} ->> '$')::JSON ELSE {v} END"
    return f"({v})"


def _listed(v: str) -> str:
    """List of {pos, val} of a JSON value that spells a list."""
    keys = f"json_keys({v})"
    return (
        f"(CASE json_type({v}) WHEN 'ARRAY' THEN list_transform(range(json_array_length({v})::BIGINT), lambda i: {{'pos': i::INTEGER, 'val': json_extract({v}, '$[' || i || ']')}}) "
        f"WHEN 'OBJECT' THEN CASE WHEN len({keys}) > 0 AND len(list_filter({keys}, lambda k: NOT regexp_full_match(k, '[0-9]{{1,9}}'))) = 0 "
        f"THEN list_transform({keys}, lambda k: {{'pos': k::INTEGER, 'val': json_extract({v}, '$.\"' || k || '\"')}}) ELSE [{{'pos': 0, 'val': {v}}}] END ELSE [] END)"
    )


def _below(name: str, rows: str, keys: str, path: str) -> str:
    """CTEs: the objects listed at a path of column ``o`` of some rows, with their place."""
    return (
        f"{name}0 AS MATERIALIZED (SELECT {keys}, {_text(f'json_extract(o, {chr(39)}{path}{chr(39)})')} AS v FROM {rows}), "
        f"{name}1 AS (SELECT {keys}, unnest({_listed('v')}) AS e FROM {name}0), "
        f"{name} AS MATERIALIZED (SELECT DISTINCT {keys}, e.pos AS pos, e.val::VARCHAR::JSON AS o FROM {name}1 WHERE json_type(e.val) = 'OBJECT')"
    )


_RECORDS = f"""WITH r AS MATERIALIZED (SELECT envelope_id, payload::JSON AS j FROM raw_games WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload ELSE 'null' END) = 'OBJECT'),
l0 AS (SELECT envelope_id, 0 AS list, json_extract(j, '$.games') AS v FROM r UNION ALL SELECT envelope_id, 1 + e.pos, json_extract(e.val, '$.games') FROM (SELECT envelope_id, unnest({_listed("json_extract(j, '$.groups')")}) AS e FROM r)),
l AS MATERIALIZED (SELECT DISTINCT envelope_id, list, v::VARCHAR::JSON AS v, json_array_length(v)::INTEGER AS n FROM l0 WHERE json_type(v) = 'ARRAY'),
b AS (SELECT *, (sum(n) OVER (PARTITION BY envelope_id ORDER BY list) - n)::INTEGER AS base FROM l),
g0 AS (SELECT envelope_id, base, unnest({_listed("v")}) AS e FROM b),
g AS MATERIALIZED (SELECT DISTINCT envelope_id, base + e.pos AS game_pos, e.val::VARCHAR::JSON AS o FROM g0 WHERE json_type(e.val) = 'OBJECT'),
{_below("ge", "g", "envelope_id, game_pos", "$.metacritic.genres")}, {_below("pl", "g", "envelope_id, game_pos", "$.metacritic.platforms")}, {_below("ru", "g", "envelope_id, game_pos", "$.playtime.runs")},
pp AS (SELECT envelope_id, game_pos, pos AS parent_pos, o FROM pl), {_below("re", "pp", "envelope_id, game_pos, parent_pos", "$.reviews")}
"""
_NUM = lambda path, kind="DOUBLE": f"try_cast(o ->> '$.{path}' AS {kind})"

ORACLE = {
    "p1_found": _RECORDS + "SELECT envelope_id, game_pos, 'genre' AS kind, -1 AS parent_pos, pos FROM ge UNION ALL SELECT envelope_id, game_pos, 'platform', -1, pos FROM pl UNION ALL SELECT envelope_id, game_pos, 'run', -1, pos FROM ru UNION ALL SELECT envelope_id, game_pos, 'review', parent_pos, pos FROM re",
    "p1_games": _RECORDS + f"SELECT envelope_id, game_pos, o ->> '$.productId' AS product_id, o ->> '$.title' AS title, o ->> '$.releaseDate' AS release_date, {_NUM('metacritic.score')} AS critic, {_NUM('metacritic.mustPlay', 'BOOLEAN')} AS must_play, {_NUM('metacritic.user.score')} AS user_score, {_NUM('metacritic.user.count', 'BIGINT')} AS user_count, {_NUM('playtime.main')} AS main, {_NUM('playtime.extra')} AS extra, {_NUM('playtime.complete')} AS complete FROM g",
    "p1_genres": _RECORDS + "SELECT envelope_id, game_pos, pos, o ->> '$.name' AS name FROM ge",
    "p1_platforms": _RECORDS + f"SELECT envelope_id, game_pos, pos, o ->> '$.name' AS name, {_NUM('critic.score')} AS critic, {_NUM('critic.count', 'BIGINT')} AS critic_count FROM pl",
    "p1_reviews": _RECORDS + f"SELECT envelope_id, game_pos, parent_pos, pos, o ->> '$.outlet' AS outlet, {_NUM('score')} AS score, o ->> '$.published' AS published, o ->> '$.author.alias' AS author_alias, {_NUM('author.verified', 'BOOLEAN')} AS author_verified FROM re",
    "p1_runs": _RECORDS + f"SELECT envelope_id, game_pos, pos, o ->> '$.kind' AS kind, {_NUM('hours')} AS hours, o ->> '$.platform' AS platform, {_NUM('player.id', 'BIGINT')} AS player_id, array_to_string((o -> '$.player.tags')::VARCHAR[], ',') AS player_tags FROM ru",
    "p5_found": _LATEST
    + """
SELECT coalesce(b.service, a.service) AS service, coalesce(b.product_id, a.product_id) AS product_id, d.snapshot_date,
  CASE WHEN a.product_id IS NULL THEN 'added' WHEN b.product_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM s a FULL JOIN s b ON a.service = b.service AND a.product_id = b.product_id AND b.n = a.n + 1
JOIN d ON d.service = coalesce(b.service, a.service) AND d.n = coalesce(b.n, a.n + 1)
WHERE d.n > 1 AND (a.product_id IS NULL OR b.product_id IS NULL OR a.title IS DISTINCT FROM b.title OR a.tier IS DISTINCT FROM b.tier OR a.p IS DISTINCT FROM b.p)
""",
    "p5_intervals": _LATEST
    + """,
m AS (
  SELECT *, CASE WHEN lag(n) OVER w = n - 1 AND lag(title) OVER w IS NOT DISTINCT FROM title AND lag(tier) OVER w IS NOT DISTINCT FROM tier AND lag(p) OVER w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS f
  FROM s WINDOW w AS (PARTITION BY service, product_id ORDER BY n)),
g AS (SELECT *, sum(f) OVER (PARTITION BY service, product_id ORDER BY n) AS i FROM m),
v AS (SELECT service, product_id, min(snapshot_date) AS first_date, max(snapshot_date) AS last_date, max(n) AS n FROM g GROUP BY service, product_id, i)
SELECT v.service, v.product_id, v.first_date, v.last_date, d.snapshot_date AS next_date FROM v LEFT JOIN d ON d.service = v.service AND d.n = v.n + 1
""",
}
