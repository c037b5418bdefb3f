"""Harmonic packing of token ids into sequences of one capacity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, text_or_empty, tidy
from .tokens import encoder

SMALLEST_EXACT = 64
#: Up to so many counts (13 per task at most) are copied to all tasks; more are joined by class and task.
COPIED_OFFSETS = 200_000
PIECES = "part int, doc long, start long, length int, ids binary, doc_tokens long, slot int, exact boolean, nth long"


def cut_lengths(total: int, capacity: int) -> list[tuple[int, int, bool]]:
    """(length, slot, exact) of a document's pieces: whole sequences, then halves, quarters ... and a short rest."""
    pieces = [(capacity, capacity, True)] * (total // capacity)
    rest, slot = total % capacity, capacity // 2
    while slot >= SMALLEST_EXACT:
        if rest >= slot:
            pieces.append((slot, slot, True))
            rest -= slot
        slot //= 2
    if rest:
        pieces.append((rest, 1 << (rest - 1).bit_length(), False))
    return pieces


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc: str, text: str) -> DataFrame:
    """Every document's ids, cut. `nth` counts the pieces of one class inside one task."""

    def cut(batches):
        part, codec, seen = TaskContext.get().partitionId(), encoder(tokenizer), {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                rows: list[tuple] = []
                for key, ids in zip(some.column(0).to_pylist(), codec.encode(some.column(1).to_pylist())):
                    ids += end
                    start, total = 0, len(ids) // 4
                    for length, slot, exact in cut_lengths(total, capacity):
                        nth = seen[slot, exact] = seen.get((slot, exact), -1) + 1
                        rows.append((part, key, start, length, ids[4 * start:4 * (start + length)], total, slot, exact, nth))
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()))],
                    names=["part", "doc", "start", "length", "ids", "doc_tokens", "slot", "exact", "nth"])

    rows = small_batches(docs).select(F.col(doc).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(tidy(cut), PIECES)


def harmonic_packing(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack documents into sequences: (doc, start, length, ids, doc_tokens, slot, exact, sequence_id, offset).

    A length belongs to the class of the reciprocal capacity/j it fits, j a power
    of two, and a bin of that class takes j pieces, whatever they are. Since
    documents may be cut, all but the last piece of a document is exactly as long as its
    slot, so bins are full; only rests below 64 ids leave some room in their slots.
    Workers fill bins by themselves: a piece needs its number within its class and
    task and the class's counts of the earlier tasks. The pieces that do not fill a
    bin, fewer than j per class, share the last sequences, largest slots first.

    `ids` are little-endian unsigned 32-bit integers. Null text is empty (the end
    id alone), null and repeated ids are rows like others, an empty table gives no
    sequences; only the two named columns are read, others never clash.
    """
    if capacity & (capacity - 1) or capacity < 2 * SMALLEST_EXACT:
        raise ValueError("capacity must be a power of two of at least 128")
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity, doc, text), "pieces")
    counts = pieces.groupBy("slot", "exact", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("slot", "exact").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # At most 13 classes: six or so exact ones and seven of rests.
    per = F.floor(F.lit(capacity) / F.col("slot"))
    totals = counts.groupBy("slot", "exact").agg(F.sum("n").alias("total")).withColumn("full", F.floor(F.col("total") / per))
    larger = Window.orderBy(F.desc("slot"), F.desc("exact"))
    above = larger.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("total") - F.col("full") * per) * F.col("slot")
    classes = totals.select(
        "slot", "exact", "full",
        F.coalesce(F.sum("full").over(above), F.lit(0)).alias("first_bin"),
        F.coalesce(F.sum(left).over(above), F.lit(0)).alias("left_before"),
        F.sum("full").over(larger.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_full"),
    )
    placed = stored(offsets.drop("n").join(F.broadcast(classes), ["slot", "exact"]), "piece-offsets")
    if placed.count() <= COPIED_OFFSETS:
        placed = F.broadcast(placed)
    number = F.col("before") + F.col("nth")
    inside = F.col("number") < F.col("full") * per
    bins = pieces.join(placed, ["slot", "exact", "part"]).withColumn("number", number).withColumn(
        "sequence_id",
        F.when(inside, F.col("first_bin") + F.floor(F.col("number") / per)).otherwise(
            F.col("all_full") + F.floor((F.col("left_before") + (F.col("number") - F.col("full") * per) * F.col("slot")) / capacity)
        ).cast("long"),
    ).withColumn("regular", inside & F.col("exact"))
    columns = ["doc", "start", "length", "ids", "doc_tokens", "slot", "exact", "sequence_id"]
    even = bins.where("regular").select(*columns, (F.pmod("number", per) * F.col("slot")).cast("long").alias("offset"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("slot"), F.desc("exact"), "number").rowsBetween(Window.unboundedPreceding, -1)
    short = bins.where("not regular").select(*columns, F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"))
    return even.unionByName(short)
