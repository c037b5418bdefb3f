"""Mixing sources to target weights by hash-random order and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows per range of hash keys: bounds what one running sum has to order.
RANGE_ROWS = 20_000
#: Up to so many sources their cuts are copied to all tasks; more are joined by source.
COPIED_SOURCES = 50_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, n, source_size): weights by code point order, null last.

    A source gets min(limit, level * weight) with limit = epochs * its size. Sorted by
    limit/weight the limited sources come first, so the level is found by two running
    sums: the first place where the level of the rest stays below its own limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    whole = Window.partitionBy()
    listed = sizes.select("source", "n", "source_size", weight.alias("weight")).withColumn(
        "limit", F.col("source_size") * float(epochs)
    ).withColumn("budget", F.sum("source_size").over(whole) * float(share))
    tightest = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    from_here = tightest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = listed.withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    ).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(tightest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("level", level).select(
        "source", "n", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def source_cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source where its budget ends: (source, source_size, target, passes, cut_key, cut_words).

    `passes` whole epochs are taken, and of one more the rows of smaller key than `cut_key` and
    `cut_words` of each row of that key. Ranges of equal key width are summed and added up;
    only in the range where the goal falls are rows put in order.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    unit = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 11).cast("double") / float(1 << 53)
    sized = targets.withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS)).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("goal", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    ranged = rows.alias("r").join(sized.alias("t"), same("r", "t")).select(
        "r.*", "goal", F.floor(unit * F.col("ranges")).cast("int").alias("range"))
    keys = ranged.groupBy("source", "range", "key", "goal").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    sums = keys.groupBy("source", "range", "goal").agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    crossed = sums.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0))).where(
        "goal > 0 and start < goal and start + words >= goal").select("source", "range", "start")
    inner = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = keys.alias("k").join(crossed.alias("c"), same("k", "c") & (F.col("k.range") == F.col("c.range"))).select("k.*", "start")
    cut = inside.withColumn("at", F.col("start") + F.coalesce(F.sum("words").over(inner), F.lit(0))).where(
        "at < goal and at + words >= goal").select("source", "key", F.floor((F.col("goal") - F.col("at")) / F.col("rows")).alias("cut_words"))
    return sized.alias("t").join(cut.alias("c"), same("t", "c"), "left").select(
        "t.source", "source_size", "target", "passes", F.col("c.key").alias("cut_key"), F.col("c.cut_words"))


def mix_sources(
    docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.0, epochs: float = 3.0, seed: int = 20,
    doc: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """(row {all columns}, size, source_size, target, taken, copies): what the mix takes of each row.

    Rows get hash-random keys; inside a source they are ordered by key, in ranges of
    equal key width whose sums give each range its start. The target is taken as
    whole epochs of the source plus the first words of that order, cut inside the
    row where the budget ends: `taken` words. `copies` rounds the cut row to
    whole documents; a row without words gets the copy when it lies before the cut, a source without any words none. Both depend on seed and rows alone. The cut is one key per source, so each
    row is decided where it is read and no text moves.

    Null text has size 0, null is a source of its own (the last one), repeated rows have one key
    and share the cut evenly, an empty table gives an empty mix. Columns keep their
    names inside the struct `row`.
    """
    key = F.xxhash64(F.lit(seed), F.col(doc), F.col(text))
    sized = docs.select(
        F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"))
    rows = stored(sized.select("source", "size", "key"), "mix-rows")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, list(weights), share, epochs), "mix-targets")
    few = targets.count() <= COPIED_SOURCES
    cuts = stored(source_cuts(rows, F.broadcast(targets) if few else targets), "mix-cuts")
    if few:
        cuts = F.broadcast(cuts)
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(0)
    passes = F.col("passes")
    return sized.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select(
        "row", "size", "source_size", "target", (passes * F.col("size") + extra).cast("long").alias("taken"),
        (passes + F.when(F.when(F.col("size") > 0, 2 * extra >= F.col("size")).otherwise(F.col("key") < F.col("cut_key")), 1).otherwise(0)).cast("int").alias("copies"))
