"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows per range of the last permutation: bounds what one task has to number.
RANGE_ROWS = 20_000
#: Up to so many parts their cuts are copied to all tasks; more are joined by part.
COPIED_PARTS = 50_000


def hypergeometric(good: int, total: int, draws: int, u: float) -> int:
    """The number of good ones among `draws` of `total`, by inversion outward from the mode, at any size."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    left, a, b = u - up, mode, mode
    while left > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (draws - b) / ((b + 1) * (total - good - draws + b + 1))
            b += 1
            left -= up
            if left <= 0:
                return b
        if a > low:
            down *= a * (total - good - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            left -= down
            if left <= 0:
                return a
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows of each part go to each shard in a uniformly random assignment with these exact margins."""
    draw, room, out = random.Random(seed), list(shards), []
    for size in parts:
        row, need, total = [], size, sum(room)
        for i, space in enumerate(room):
            got = hypergeometric(space, total, need, draw.random()) if need else 0
            row.append(got)
            total -= space
            need -= got
        room = [r - g for r, g in zip(room, row)]
        out.append(row)
    return out


def unit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)


def hypergeometric_shards(rows: DataFrame, shards: int = 24, seed: int = 8) -> DataFrame:
    """(row {all columns}, shard, slot): a uniform random order dealt into shards whose counts differ by one at most.

    The rows are written once; their written parts are the matrix's rows, so counts and
    permutations always see the same parts, after lost executors too. The matrix has one small
    count per part and shard and is drawn from the parts' counts alone. In a part, rows are
    permuted by a random key and the first ones go to shard 0, the next to shard 1 and so
    on, as many as drawn; in a shard they are permuted again: ranges of a second key are
    numbered by themselves and start after the earlier ranges. slot counts from 0 without gaps.

    Rows with nulls, empty or repeated rows are rows like others; an empty table gives no rows.
    Columns keep their names inside the struct `row`.
    """
    spark = rows.sparkSession
    kept = stored(rows.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "shard-rows")
    counts = [(r.part, r.n) for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]
    total = sum(n for _, n in counts)
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    firsts = []
    for (part, _), row in zip(counts, matrix):
        end, ends = 0, []
        for n in row:
            end += n
            ends.append(end)
        firsts.append((part, ends))
    cuts = spark.createDataFrame(firsts, "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "place"), "place")
    if len(firsts) <= COPIED_PARTS:
        cuts = F.broadcast(cuts)
    dealt = kept.withColumn("nth", F.row_number().over(local)).join(cuts, "part").select(
        "row", "place", F.size(F.filter("ends", lambda e: e < F.col("nth"))).alias("shard"))
    ranges = max(1, math.ceil(total / shards / RANGE_ROWS))
    key = F.xxhash64(F.lit(seed + 1), "place")
    ranged = dealt.select("row", "place", "shard", key.alias("key"), F.floor(unit(key) * ranges).cast("int").alias("range"))
    filled = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("shard", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "range").orderBy("key", "place")
    return ranged.withColumn("nth", F.row_number().over(inner) - 1).join(starts, ["shard", "range"]).select(
        "row", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
