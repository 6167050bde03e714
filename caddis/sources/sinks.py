"""Sinks: snapshots with a summary, and enrichment of a table in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, score: str | None = None, scored_only: bool = False) -> DataFrame:
    """Writes a catalogue as Parquet and its one-row summary beside it; returns the summary.

    The total counts all rows, also where only those with a score are written.
    """
    has = F.col(score).isNotNull() if score else F.lit(False)
    df.agg(F.count("*").alias("total"), F.count_if(has).alias("scored")).write.mode("overwrite").parquet(f"{path}/summary")
    (df.where(has) if scored_only else df).write.mode("overwrite").parquet(f"{path}/rows")
    return df.sparkSession.read.parquet(f"{path}/summary")


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replaces a table by change(table): written beside it, then swapped, as Spark can't overwrite what it reads.

    If a run is broken off between the steps, the table is at ``path`` or at ``path.old``, whole.
    """
    jvm = spark._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
