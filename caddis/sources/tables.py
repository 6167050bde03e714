"""Table sources. A table is a Parquet file or folder under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan of one table. Filters and column choices made on it reach the Parquet reader."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan of a table that may not exist yet; a missing one is an empty relation with the given schema."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def json_records(spark: SparkSession, path: str, record: T.StructType, field: str = "games") -> DataFrame:
    """Rows of the array ``field`` inside JSON files of one envelope each, read with a declared schema (no inference)."""
    envelope = T.StructType([T.StructField(field, T.ArrayType(record))])
    return spark.read.schema(envelope).option("multiLine", True).json(path).selectExpr(f"inline({field})")


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A directory and those in it as a relation (path, size); contents are never read. A missing one is empty."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, size bigint")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).selectExpr("path", "length AS size")
