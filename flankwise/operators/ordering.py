"""Dense row numbers without putting a whole table or a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def dense_position(rows: DataFrame, identity: list[str], keys: list[str], name: str) -> DataFrame:
    """0-based dense number of each row inside its key, in digest order of `identity`.

    `identity` must be unique within a key. Rows fall into 4096 buckets by digest,
    are numbered inside their bucket, and the sizes of the earlier buckets are
    added. The numbering depends on the values alone, not on partitions or retries.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity]))
    placed = rows.withColumn("_bucket", F.substring(digest, 1, BUCKET_DIGITS))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*identity)
    numbered = placed.withColumn("_in", F.row_number().over(inner) - 1)
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return numbered.join(offsets, [*keys, "_bucket"]).withColumn(
        name, (F.col("_offset") + F.col("_in")).cast("long")
    ).drop("_bucket", "_in", "_offset")


def value_range(rows: DataFrame, order: str, buckets: int = 256) -> Column:
    """Number of the quantile range a numeric column falls into; the cuts are a few literals, the same for every task."""
    cuts = sorted(set(rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.002)))
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(bounds, lambda b: b < F.col(order)))


def running_total(
    rows: DataFrame, amount: str, order: str, keys: list[str], name: str, descending: bool = False, whole: bool = False
) -> DataFrame:
    """Sum of `amount` over the rows of a key before each row; `order` is numeric and unique within a key.

    Each quantile range is summed by itself and takes the totals of the earlier
    ranges; with `whole` (few rows) a key is one window.
    """
    direction = F.desc if descending else F.asc
    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    if whole:
        window = earlier(Window.partitionBy(*keys).orderBy(direction(order)))
        return rows.withColumn(name, F.coalesce(F.sum(amount).over(window), F.lit(0)))
    placed = rows.withColumn("_range", value_range(rows, order))
    inner = earlier(Window.partitionBy(*keys, "_range").orderBy(direction(order)))
    summed = placed.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    sizes = placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_n"))
    outer = earlier(Window.partitionBy(*keys).orderBy(direction("_range")))
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_offset"))
    return summed.join(offsets, [*keys, "_range"]).withColumn(name, F.col("_offset") + F.col("_in")).drop("_range", "_in", "_offset")


def ordered_position(rows: DataFrame, order: str, ties: list[str], keys: list[str], name: str, buckets: int = 256) -> DataFrame:
    """1-based number of each row inside its key, by the numeric column `order` and then `ties`.

    The column's quantiles cut the rows into ranges. Rows are numbered inside
    their range and the sizes of the earlier ranges are added, so a key that
    holds most of the rows is spread over all ranges.
    """
    placed = rows.withColumn("_range", value_range(rows, order, buckets))
    numbered = placed.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order, *ties)))
    sizes = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return numbered.join(offsets, [*keys, "_range"]).withColumn(
        name, (F.col("_offset") + F.col("_in")).cast("long")
    ).drop("_range", "_in", "_offset")
