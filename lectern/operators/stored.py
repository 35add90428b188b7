"""Tables written between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a temporary one serves on a local master; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-lectern-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, is worked out once, survives lost executors. options: of the Parquet writer."""
    path = f"{shared_folder(df.sparkSession)}/lectern/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Small rows whose work is large dealt over all tasks: as pages or packages to be made and read, of which a split by bytes holds too many."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism))


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together for windows over them, in 16 small tasks a core or more: a window's own shuffle makes
    tasks as few as spark.sql.shuffle.partitions says, each of which sorts its rows in memory."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, 16 * df.sparkSession.sparkContext.defaultParallelism), *keys)
