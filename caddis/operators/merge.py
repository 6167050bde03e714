"""Ordered de-duplication, merging of lists, and caches that know their misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order that must be total; null keys form one group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return keep_first(df, keys, [F.col(ordinal).desc()])


def latest(value: str, at: str, *ties: Column) -> Column:
    """Aggregate: the value of the last row that has one (not null, not '' or []), in order of ``at``, null times first.

    Among rows of one time the greatest of ``ties`` counts, or of the value itself.
    """
    v = F.col(value)
    return F.max_by(v, F.when(v.isNotNull() & F.coalesce(v.cast("string") != "", F.lit(True)), F.struct(F.col(at), *(ties or (v,)))))


def keep_shortest(df: DataFrame, keys: list[str], text: str, ordinal: str) -> DataFrame:
    """The row with the shortest text of each key, the first of equals, with the ordinal of the key's first row as ``first_seen``."""
    seen = F.min(ordinal).over(Window.partitionBy(*keys))
    return keep_first(df.withColumn("first_seen", seen), keys, [F.length(text), F.col(ordinal)])


def ordered_set(value: str, ordinal: str) -> Column:
    """Aggregate: the distinct values of a group in the order in which they came first."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(ordinal), F.col(value))))), lambda s: s[value]))


def merge_lists(rows: DataFrame, key: str, list_key: str, tier: str, flags: list[str], kept: list[str], ordinal: str) -> DataFrame:
    """One row per key of several lists: least tier, lists in order, any of the flags, and the other columns as first seen.

    Lists are collected once per distinct list of a key, so a key that holds very many rows keeps a short array.
    """
    slim = rows.groupBy(key, list_key).agg(F.min(ordinal).alias("_o"), F.min(tier).alias(tier), *[F.max(f).alias(f) for f in flags], F.min_by(F.struct(*kept), ordinal).alias("_kept"))
    merged = slim.groupBy(key).agg(F.min(tier).alias(tier), ordered_set(list_key, "_o").alias("lists"), *[F.max(f).alias(f) for f in flags], F.min_by("_kept", "_o").alias("_kept"))
    return merged.select(key, tier, "lists", *flags, "_kept.*")


def pending(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys that were never tried: neither hit nor known miss is in the cache."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def cache_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with new rows in place of old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def two_pass(queries: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Hits of the first lookup, then the second lookup's for what the first missed; what both miss is a final miss.

    Lookups: key, payload (null for a miss). Returns key, payload, source (1, 2 or null).
    """
    hits = first.where("payload IS NOT NULL")
    one = queries.join(hits, key).withColumn("source", F.lit(1))
    left = queries.join(hits, key, "left_anti")
    two = left.join(second.where("payload IS NOT NULL"), key, "left").withColumn("source", F.when(F.col("payload").isNotNull(), 2))
    return one.unionByName(two)


def difference_both_ways(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(key, state): ``new`` where only wanted, ``orphan`` where only there, ``kept`` where both; null keys are left out."""
    a = wanted.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_w", F.lit(True))
    b = have.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_h").isNull(), "new").when(F.col("_w").isNull(), "orphan").otherwise("kept").alias("state"))


def overrides(df: DataFrame, table: DataFrame, keys: list[Column], name: str = "override") -> DataFrame:
    """df with the override of the first of its keys that has one; table: key, value. Keys of the table must be unique."""
    out = df
    found = []
    for i, k in enumerate(keys):
        side = table.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}"))
        out = out.withColumn(f"_q{i}", k).join(side, F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.select(*df.columns, F.coalesce(*found).alias(name))
