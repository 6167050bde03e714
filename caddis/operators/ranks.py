"""Global ranks without a single-task window: rows are sorted into ranges, and each range's offset is added.

The ranges come from a sample of the sorting columns, ties and nulls included, so a value that very many rows share is
split over many tasks, and there are as many tasks as the session has shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caddis.session import cut


def _before(ranges: DataFrame) -> DataFrame:
    """(_range, _before): what stands before each range; one row a range (its number and _total), so one task holds it."""
    return ranges.withColumn("_before", F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).select("_range", "_before")


def ordered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """df with the place, from 1, of each row in an order of columns; equal rows in any order. df is written once.

    One shuffle: rows go to ranges of the order and are sorted there; a row's number in its range comes from the sort.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_total"))
    within = F.col("_at") - F.shiftleft(F.col("_range"), 33) + 1
    return rows.join(F.broadcast(_before(counts)), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_at", "_before")


def positions(df: DataFrame, column: str, ties: str, name: str = "position") -> DataFrame:
    """df with the place, from 1, of each row in descending order of a double column, ties in ascending order of ``ties``.

    Rows with a null or NaN in the column come last, in order of ``ties``; null ties come before others.
    """
    keyed = df.withColumn("_v", F.when(F.isnan(column), None).otherwise(F.col(column)))
    return ordered(keyed, F.col("_v").desc_nulls_last(), F.col(ties).asc_nulls_first(), name=name).drop("_v")


def value_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count, rank): the average rank, from 1, of each distinct non-null value of each column.

    All columns in one pass. Rows are counted per value before anything is ordered, so a value held by any share of the
    rows is one row in the ordering. Null and NaN have no rank.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(each.alias("e")).select("e.*").where("value IS NOT NULL AND NOT isnan(value)").groupBy("column", "value").agg(F.count("*").alias("count"))
    ranges = cut(counts.repartitionByRange("column", "value").withColumn("_range", F.spark_partition_id()))
    within = ranges.withColumn("_run", F.sum("count").over(Window.partitionBy("_range", "column").orderBy("value")))
    totals = ranges.groupBy("column", "_range").agg(F.sum("count").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.partitionBy("column").orderBy("_range")) - F.col("_total")).select("column", "_range", "_before")
    return within.join(F.broadcast(before), ["column", "_range"]).select("column", "value", "count", (F.col("_before") + F.col("_run") - (F.col("count") - 1) / F.lit(2.0)).alias("rank"))
