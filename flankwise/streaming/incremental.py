"""Resumable prediction: only rows without a stored result for the same run are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(rows: DataFrame, stored: DataFrame, key: str, run_id: str) -> DataFrame:
    """Rows without a stored result of this run; results of another run do not count."""
    done = stored.where(F.col("run_id") == run_id).select(key)
    return rows.join(done, key, "left_anti")


def resume(spark: SparkSession, rows: DataFrame, path: str, key: str, run_id: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append the missing results to the table at `path`, partitioned by run, and return this run's results."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    left = pending(rows, spark.read.parquet(path), key, run_id) if exists else rows
    compute(left).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path).where(F.col("run_id") == run_id)
