"""What changed between full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caddis.session import broadcast_if_small


def _digest(values: list[str], sets: list[str]):
    """Hash of a version. A null differs from any value; a set ignores order and repetition."""
    parts = []
    for c in values:
        parts += [F.col(c).isNull(), F.col(c)]
    for c in sets:
        parts += [F.col(c).isNull(), F.to_json(F.array_sort(F.array_distinct(F.col(c))))]
    return F.xxhash64(*parts)


def snapshot_ordinals(df: DataFrame) -> DataFrame:
    """(_s, _d) -> ordinal of the snapshot within its service and the date of the next one."""
    w = Window.partitionBy("_s").orderBy("_d")
    return (
        df.select("_s", "_d")
        .distinct()
        .select("_s", "_d", F.row_number().over(w).alias("_o"), F.lead("_d").over(w).alias("_next"))
    )


def validity_intervals(
    df: DataFrame,
    service: str = "service",
    snapshot: str = "snapshot_date",
    key: str = "product_id",
    version: str = "loaded_at",
    values: tuple[str, ...] = ("title", "tier"),
    sets: tuple[str, ...] = ("platforms",),
) -> DataFrame:
    """Intervals of consecutive snapshots in which a key kept one version.

    Returns service, key, row_hash, first_ordinal, last_ordinal, first_date, last_date and next_date (the service's
    snapshot after last_date, null if none). Within a snapshot the row with the greatest ``version`` counts; a null
    version is older than any other, and rows tied on it are settled by the greatest row hash, so that the result does
    not depend on the order of rows. Rows without a key or a snapshot date describe no record and are left out; a null
    service is a service of its own. Other columns are ignored, whatever their names. An empty table gives no rows.

    One partially aggregated shuffle picks the rows that count; windows and the interval aggregation then share one
    partitioning by service and key. A key's rows in a partition number at most its service's snapshots.
    """
    rows = df.select(
        F.col(service).alias("_s"),
        F.col(snapshot).cast("string").alias("_d"),
        F.col(key).cast("string").alias("_k"),
        F.col(version).alias("_v"),
        _digest(list(values), list(sets)).alias("_h"),
    ).where("_k IS NOT NULL AND _d IS NOT NULL")
    dates = broadcast_if_small(snapshot_ordinals(rows))
    last = rows.groupBy("_s", "_k", "_d").agg(F.max(F.struct("_v", "_h")).alias("_m")).select("_s", "_k", "_d", F.col("_m._h").alias("_h"))
    placed = last.alias("a").join(dates.alias("b"), F.expr("a._s <=> b._s AND a._d = b._d")).select("a._s", "a._k", "a._d", "a._h", "b._o", "b._next")
    placed = placed.repartition("_s", "_k")
    w = Window.partitionBy("_s", "_k").orderBy("_o")
    start = (F.lag("_h").over(w).eqNullSafe(F.col("_h"))) & (F.lag("_o").over(w) == F.col("_o") - 1)
    marked = placed.withColumn("_start", F.when(start, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_start").over(w))
    return (
        islands.groupBy("_s", "_k", "_island")
        .agg(
            F.first("_h").alias("row_hash"),
            F.min("_o").alias("first_ordinal"),
            F.max("_o").alias("last_ordinal"),
            F.min("_d").alias("first_date"),
            F.max("_d").alias("last_date"),
            F.max_by("_next", "_o").alias("next_date"),
        )
        .select(F.col("_s").alias("service"), F.col("_k").alias("key"), "row_hash", "first_ordinal", "last_ordinal", "first_date", "last_date", "next_date")
    )


def snapshot_changes(df: DataFrame, **columns) -> DataFrame:
    """Change events (service, key, snapshot_date, change) between consecutive snapshots of each service.

    An interval that starts right after another of its key is ``changed``, any other start ``added``; an end that no
    interval of the key follows at once is ``removed`` in the next snapshot. A service's first snapshot has no events,
    and what is still there in its last one has not ended. For rows and columns see ``validity_intervals``.
    """
    spans = validity_intervals(df, **columns)
    w = Window.partitionBy("service", "key").orderBy("first_ordinal")
    spans = spans.select("*", F.lag("last_ordinal").over(w).alias("_before"), F.lead("first_ordinal").over(w).alias("_after"))
    begun = F.when(F.col("first_ordinal") > 1, F.struct(F.col("first_date").alias("snapshot_date"), F.when(F.col("_before") == F.col("first_ordinal") - 1, "changed").otherwise("added").alias("change")))
    gone = F.col("next_date").isNotNull() & ~F.coalesce(F.col("_after") == F.col("last_ordinal") + 1, F.lit(False))
    ended = F.when(gone, F.struct(F.col("next_date").alias("snapshot_date"), F.lit("removed").alias("change")))
    return spans.select("service", "key", F.explode(F.filter(F.array(begun, ended), lambda e: e.isNotNull())).alias("e")).select("service", "key", "e.snapshot_date", "e.change")
