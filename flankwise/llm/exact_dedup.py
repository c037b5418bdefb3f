"""Exact deduplication as a stream over disk-backed keyed state."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flagged, read_back, row_key, rows_kept, shared_path, small_batches, stored, text_or_empty, write_shared

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "digest string, keep struct<id: bigint, key: binary>, n bigint"


@F.pandas_udf(T.StringType())
def text_sha256(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.sha256(t.encode().lower()).hexdigest())


@F.pandas_udf(T.BooleanType())
def same_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x.encode().lower() == y.encode().lower() for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StringType())
def lowered(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.encode().lower().decode())


def keyed_state(rows: DataFrame, path: str, files_per_trigger: int) -> DataFrame:
    """Stream the written rows through state keyed by digest, then read the state itself: (digest, keep {id, key}, n).

    The state (RocksDB, checkpointed to the shared folder) never expires. It keeps per
    digest the stable identifier and the content locator (the key that finds the row again) of the row
    that stays, and a count; a task sends one partial row per digest, so a text
    that makes up a third of the input is no hot key.
    """
    spark = rows.sparkSession
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Else every state partition sets some megabytes of disk aside, whatever it holds.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # One bound for all state partitions of an executor.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    checkpoint = shared_path(spark, "dedup-state")
    arriving = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    state = arriving.groupBy("digest").agg(F.max(F.struct("id", "key")).alias("keep"), F.count(F.lit(1)).alias("n"))
    state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    held = session.read.format("statestore").load(checkpoint)
    keep, n = [f"value.{f.name}" for f in held.schema["value"].dataType.fields]
    found = held.select(F.col("key.digest").alias("digest"), F.col(keep).alias("keep"), F.col(n).alias("n"))
    return spark.read.schema(STATE).parquet(write_shared(found, "dedup-groups"))


def stream_exact_dedup(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", files_per_trigger: int = 1000, digest=text_sha256
) -> DataFrame:
    """Verdict per row: (id, key, keep_id, group_size, kept, digest); `exact_survivors` applies them.

    Texts are equal when identical after lower-casing A-Z; null is empty. Of equal
    texts the largest id stays (null below all; of repeats of that row one). Digests stream through
    keyed state; every hit is then compared in full bytes with the text at the kept
    locator. Should texts of one digest differ, the rows of that digest are grouped by
    text instead. Texts move only where their digest has several rows. An empty table
    has no verdicts; other columns of `docs` are not read, so none can clash.
    """
    spark = docs.sparkSession
    body = small_batches(docs).select(F.col(doc).alias("id"), text_or_empty(text).alias("body"), row_key(doc, text).alias("key"))
    slim = body.select("id", "key", digest("body").alias("digest"))
    path = write_shared(slim, "dedup-digests")
    slim = read_back(slim, path)
    if slim.isEmpty():
        return slim.select("id", "key", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    state = keyed_state(slim, path, files_per_trigger)

    groups = state.where("n > 1").select("digest", F.col("keep.key").alias("keep_key"))
    listed = slim.join(groups, "digest", "left_semi").select("key")
    texts = flagged(body.select("key", "body"), F.col("key"), listed).where("_flag").select("key", "body", digest("body").alias("digest"))
    members = texts.join(groups, "digest")
    keepers = members.where("key = keep_key").groupBy("digest").agg(F.any_value("body").alias("keep_body"))
    hits = members.where("key <> keep_key").select("digest", "body")
    differing = stored(hits.join(keepers, "digest").where(~same_bytes("body", "keep_body")).select("digest").distinct(), "dedup-differing")

    numbered = slim.select("*", F.lit(1).alias("nth"))
    if not slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        numbered = slim.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("digest")))
    verdict = lambda joined: joined.select(
        "id", "key", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("key") == F.col("keep.key")) & (F.col("nth") == 1)).alias("kept"), "digest")
    verdicts = numbered.join(state, "digest")
    if differing.isEmpty():
        return verdict(verdicts)
    keys = slim.join(differing, "digest", "left_semi").select("key").distinct()
    normal = body.join(keys, "key", "left_semi").select("key", "id", lowered("body").alias("normal"))
    groups = normal.groupBy("normal").agg(F.max(F.struct("id", "key")).alias("keep"), F.count(F.lit(1)).alias("n"))
    by_key = normal.select("key", "normal").distinct().join(groups, "normal").select("key", "keep", "n")
    settled = numbered.join(by_key, "key")
    return verdict(verdicts.join(differing, "digest", "left_anti")).unionByName(verdict(settled))


def exact_survivors(docs: DataFrame, doc: str = "doc_id", text: str = "text", files_per_trigger: int = 1000) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    verdicts = stored(stream_exact_dedup(docs, doc, text, files_per_trigger).select("key", "kept"), "dedup-verdicts")
    return rows_kept(docs, verdicts, doc, text)
