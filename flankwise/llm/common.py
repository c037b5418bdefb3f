"""What the operators share: tables in the cluster's shared folder, words and small pieces of plans."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Byte table that lower-cases A-Z and turns everything but digits, letters and non-ASCII bytes into a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the files: lost executors lose nothing."""
    return read_back(df, write_shared(df, name))


def write_shared(df: DataFrame, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_back(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch between an executor and its Python workers, a single longer text aside.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose texts go to Python in batches bounded by bytes: 10,000 rows of long texts would fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def release() -> None:
    """Give a worker's free memory back to the system.

    Workers live on between tasks and stages; what their allocators keep would count beside the next stage's needs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker function that releases its memory at the end of each task."""

    @functools.wraps(work)
    def frugal(batches):
        yield from work(batches)
        release()

    return frugal


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def runs(texts: list[bytes], most_bytes: int = 800_000, most_rows: int = 1000) -> Iterator[slice]:
    """Cut a batch into slices of bounded size; a longer text is a slice by itself."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and (total + len(text) > most_bytes or i - start >= most_rows):
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Size of the fixed bit table that tells which rows may be concerned: 2 MB, whatever the data.
FILTER_BITS = 1 << 24


def row_key(doc: str, text: str | Column) -> Column:
    """Names a row by 128 bits of the SHA-256 of its id and its text; rows of equal key are repeats of each other.

    Null text is empty, a null id is no other id.
    """
    named = F.when(F.col(doc).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(doc).cast("string")))
    return F.unhex(F.substring(F.sha2(F.concat(named, F.lit("\n"), text_or_empty(text)), 256), 1, 32))


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that `shared_path` named, on whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def term_bytes(keep: str) -> bytes:
    """Byte table for `terms`: A-Z lower-cased, what is neither an ASCII character of `keep` nor above ASCII a blank."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in keep else 32 for b in range(256))


def terms(text: bytes, table: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size; pieces end between terms, but for one that is longer than a piece."""
    start = 0
    while start < len(text):
        end = min(start + piece, len(text))
        while end < len(text) and table[text[end]] != 32:
            end += 1
        yield text[start:end].translate(table).split()
        start = end


def flagged(df: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """`df` with the boolean column `_flag`: false only where `key` is surely not in the one column of `listed`.

    The bit table has a fixed size, so it may be copied to all tasks: rows without a flag need no join and no
    shuffle. The more keys are listed the more rows get a flag in vain; results never depend on it.
    """
    spot = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    bits = listed.select(spot(F.col(listed.columns[0])).alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    probed = df.withColumn("_spot", spot(key)).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    place = F.bitmap_bit_position("_spot").cast("int")
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
    return probed.join(F.broadcast(bits), "_bucket", "left").withColumn("_flag", F.coalesce(bit, F.lit(False))).drop("_spot", "_bucket", "_bits")


def rows_kept(docs: DataFrame, verdicts: DataFrame, doc: str, text: str) -> DataFrame:
    """The rows of `docs` whose verdict (key, kept) keeps them; of repeats of a kept row one stays.

    Only rows that may have been dropped meet the verdicts; all others pass as they are.
    """
    dropped = verdicts.where("not kept").select("key").distinct()
    once = verdicts.where("kept").select("key").join(dropped, "key", "left_semi").distinct()
    rows = flagged(docs.select(F.struct("*").alias("_doc"), row_key(doc, text).alias("key")), F.col("key"), dropped)
    rest = rows.where("_flag")
    stay = rest.join(dropped, "key", "left_anti")
    kept = rows.where("not _flag").unionByName(stay)
    if not once.isEmpty():
        kept = kept.unionByName(rest.join(once, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("_doc.*")
