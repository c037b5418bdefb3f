"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import value_range
from .common import flagged, remove_shared, row_key, shared_path, small_batches, stored, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
#: A line is hot when it makes up this share of a batch: at most HOT_LINES of them, so they may be copied to all tasks.
HOT_LINES = 10_000


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128 bits of the SHA-256 of a line's key (blanks stripped, A-Z lower-cased); none for a shorter key."""
    key = line.strip(BLANKS)
    return hashlib.sha256(key.encode().lower()).digest()[:16] if len(key) >= min_chars else None


def line_hashes(text: Column, min_chars: int) -> Column:
    """The distinct hashes of a text's lines."""

    @F.pandas_udf("array<binary>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({h for line in t.split("\n") if (h := line_hash(line, min_chars))}))

    return hashes(text)


def without_lines(text: Column, drops: Column, min_chars: int) -> Column:
    """struct<kept, n_dropped>: a text without its lines of the given hashes."""

    @F.pandas_udf("kept string, n_dropped bigint")
    def cut(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        rows = []
        for body, drop in zip(texts, dropped):
            drop = set() if drop is None else set(map(bytes, drop))
            lines = body.split("\n")
            kept = [line for line in lines if line_hash(line, min_chars) not in drop] if drop else lines
            rows.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["kept", "n_dropped"])

    return cut(text, drops)


class SortedRuns:
    """Runs of (hash, docs, keeper, hot), each bucketed and sorted by hash in the shared folder.

    All runs have the same buckets, so a batch meets them by merge joins that shuffle the batch alone. When a level
    holds `fan` runs they are merged into one run of the next level. Runs are merged by joins, not as a union with a
    grouping: Spark 4.1.2 was seen to leave equal hashes apart in a grouped union of bucketed tables.
    """

    def __init__(self, spark: SparkSession, fan: int):
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_path(self.spark, "line-run")
        rows.write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name, path

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def merged(self, names: list[str]) -> DataFrame:
        """Entries of several runs, one per hash; two runs are merged bucket by bucket, without a shuffle."""
        whole = self.spark.table(names[0])
        for name in names[1:]:
            whole = whole.alias("a").join(self.spark.table(name).alias("b"), F.col("a.hash") == F.col("b.hash"), "full").select(
                F.coalesce("a.hash", "b.hash").alias("hash"), (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs"),
                F.greatest("a.keeper", "b.keeper").alias("keeper"), (F.coalesce("a.hot", F.lit(False)) | F.coalesce("b.hot", F.lit(False))).alias("hot"))
        return whole

    def add(self, own: DataFrame, min_docs: int) -> None:
        """Merge-anti-join a batch with the runs and add what is left as a run of its own.

        A hash that one run already has in `min_docs` documents is settled: later batches hold smaller ids, so
        neither its keeper nor its verdict changes. Only its hot entries are written, to be known as hot.
        """
        marks = []
        for i, run in enumerate(self.tables()):
            own = own.join(run.where(F.col("docs") >= min_docs).select("hash", F.lit(True).alias(f"in_{i}")), "hash", "left")
            marks.append(f"in_{i}")
        if marks:
            own = own.where(F.coalesce(*marks).isNull() | F.col("hot"))
        self._push(0, self.write(own.select("hash", "docs", "keeper", "hot")))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            old, self.levels[level] = self.levels[level], []
            merged = self.write(self.merged([name for name, _ in old]))
            self._remove(old)
            self._push(level + 1, merged)

    def everything(self) -> DataFrame:
        return self.merged([name for level in self.levels for name, _ in level])

    def _remove(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove_shared(self.spark, path)

    def close(self) -> None:
        self._remove([run for level in self.levels for run in level])
        self.levels = []


def repeated_lines(lines: DataFrame, min_docs: int, batches: int, fan: int) -> DataFrame:
    """(hash, docs, keeper, hot) of hashes in at least `min_docs` documents, from lines (batch, row, doc, hash).

    Batches come in descending ids. `docs` is exact for hashes never settled before their last batch, else a lower bound.
    """
    spark = lines.sparkSession
    sizes = dict(lines.groupBy("batch").count().collect())  # a row per batch
    runs = SortedRuns(spark, fan)
    for batch in sorted(sizes):
        share = max(sizes[batch] // HOT_LINES, min_docs)
        own = lines.where(F.col("batch") == batch).groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
        runs.add(own.withColumn("hot", F.col("docs") > share), min_docs)
    listed = stored(runs.everything().where(F.col("docs") >= min_docs), "line-repeats")
    runs.close()
    return listed


def dedup_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 6, fan: int = 2
) -> DataFrame:
    """(row {all columns}, kept, n_lines, n_dropped): each text without its repeated lines.

    A text is split at \\n; a line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of at least `min_chars`
    code points in at least `min_docs` documents lose all their lines, but for those in the largest id that
    holds the key. Documents are cut into `batches` of descending ids (by quantiles); each batch meets the
    sorted runs of earlier ones. Keys are compared by 128 bits of SHA-256.

    The texts are read twice; between, only hashes move, and at the end the texts that lose lines. A key in a large share of
    all documents is copied to all tasks, as there can be only few of them.

    Null and empty text: one empty line. Each row counts as a document; rows of one id all keep a line that this id keeps. A null id
    is below all others. Ids are integers. Texts of any length pass whole. An empty table gives an empty result.
    Columns keep their names inside the struct `row`.
    """
    spark = docs.sparkSession
    body = small_batches(docs).select(
        F.struct("*").alias("_doc"), F.col(doc).alias("doc"), text_or_empty(text).alias("body"), row_key(doc, text).alias("row"))
    batch = F.lit(batches - 1) - (value_range(body.select("doc"), "doc", batches) if batches > 1 else F.lit(0))
    lines = body.select(batch.alias("batch"), "row", "doc", F.explode(line_hashes(F.col("body"), min_chars)).alias("hash"))
    path = shared_path(spark, "lines")
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema("row binary, doc bigint, hash binary, batch int").parquet(path)
    n_lines = (F.octet_length("body") - F.octet_length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    if lines.isEmpty():
        return body.select(F.col("_doc").alias("row"), F.col("body").alias("kept"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))

    repeats = repeated_lines(lines, min_docs, batches, fan)
    hot = F.broadcast(repeats.where("hot").select("hash", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("is_hot")))
    maybe = flagged(lines, F.col("hash"), repeats.select("hash")).where("_flag").join(hot, "hash", "left")
    loses = lambda keeper: ~F.col("doc").eqNullSafe(F.col(keeper))
    hot_drops = maybe.where(F.col("is_hot") & loses("hot_keeper")).select("row", "hash")
    drops = hot_drops.unionByName(
        maybe.where("is_hot is null").join(repeats.where("not hot").select("hash", "keeper"), "hash").where(loses("keeper")).select("row", "hash"))
    sets = stored(drops.groupBy("row").agg(F.collect_set("hash").alias("drops")), "line-drops")

    rows = flagged(body, F.col("row"), sets.select("row"))
    same = rows.where("not _flag").select(
        F.col("_doc").alias("row"), F.col("body").alias("kept"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    cut = rows.where("_flag").join(sets, "row", "left").select(
        "_doc", n_lines.alias("n_lines"), without_lines(F.col("body"), F.col("drops"), min_chars).alias("cut"))
    return same.unionByName(cut.select(F.col("_doc").alias("row"), "cut.kept", "n_lines", "cut.n_dropped"))
