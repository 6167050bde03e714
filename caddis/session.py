"""Session helpers: shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 100_000
#: Whether a DataFrame made under it removes its shuffles' files when it has run.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary one, deleted at its end; on a cluster, whose nodes would not see
    such a folder, that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="caddis-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """DataFrames made and run inside leave no shuffle files, which else stay until the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def drop_cut(*cuts: DataFrame) -> None:
    """Deletes the checkpoints of DataFrames as ``cut`` returned them; nothing that is yet to run may read them."""
    for df in cuts:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows (counted), else unchanged, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df in as many hash partitions as the session has for shuffles, however few bytes they hold: for work that is heavy
    a row, which AQE would put into one task if the rows are short."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def filled(df: DataFrame) -> DataFrame:
    """df as it is read, but dealt out to all cores if its files give them too few partitions, as small tables do.

    A plan with a shuffle in it is left as it is: asking for its partitions would run it.
    """
    cores, execution = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
