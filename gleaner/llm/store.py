"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.skew import checkpoint_dir


def folder(spark: SparkSession) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back.

    It cuts lineage and survives lost executors, and later reads take only the
    columns they need.
    """
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` wrote, once no result still needs them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
