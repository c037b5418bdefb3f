"""Session defaults and the few helpers that look at the running session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """Session for tests and benches. A cluster brings its own session instead."""
    cpus = master[6:-1] if master.startswith("local[") else ""
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": "12g",
    }
    builder = SparkSession.builder.master(master).appName("flankwise")
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; fall back to a scratch one only when none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flankwise-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp")))


def spread(df: DataFrame) -> DataFrame:
    """Split an input that arrives in fewer partitions than there are cores.

    A big table already has enough input splits and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a table once where several branches of a plan read it.

    A reliable checkpoint in the shared folder: it survives lost executors and
    keeps the plans that follow small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def prepare(spark: SparkSession) -> SparkSession:
    """Let only measured sizes decide about broadcasts.

    Size estimates of exploded rows (windows, candidates, k-mers) are far too low,
    so the static rule is off and adaptive execution chooses after the shuffle,
    with skewed partitions split.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    return spark


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table has no more than `rows` rows; counting stops just beyond."""
    return df.limit(rows + 1).count() <= rows
