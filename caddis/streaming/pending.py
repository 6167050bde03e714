"""Keys arriving as files, looked up once each: a stream against a cache that knows its misses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from caddis.operators.merge import pending
from caddis.sources.tables import optional_table


def resolve_stream(spark: SparkSession, folder: str, schema: StructType, key: str, lookup: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str) -> StreamingQuery:
    """Looks up the keys of Parquet files as they arrive, and appends hits and misses to the cache, a Parquet folder.

    lookup takes a DataFrame of the key and returns key, payload (null for a miss). A key is looked up once, in the first
    batch that has it. Each batch writes a folder of its own under its number, so a batch run again replaces its rows.
    Call with an available-now trigger: the query ends when all files present have been read.
    """
    row = spark.createDataFrame([], schema).select(key)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = optional_table(session, cache, lookup(row).schema.add("batch", IntegerType()))
        done = known.where(f"batch <> {int(number)}")
        found = lookup(pending(batch, done, key))
        found.write.mode("overwrite").parquet(f"{cache}/batch={int(number)}")

    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
