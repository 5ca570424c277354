"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from curalens.session import work_dir


def landing_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder; it goes when the driver ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def land(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: short lineage that survives lost executors."""
    path = landing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
