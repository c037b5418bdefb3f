"""Token-id files: blocks of the context-mixing range coder, written and read by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_or_empty, tidy
from .range_coder import BLOCK, decode_blocks, encode_blocks
from .tokens import encoder

#: Pieces of a block, at most; a block of many short documents ends early.
MOST_PIECES = 1 << 16
FORMAT = "part int, block int, first long, n_ids int, nths array<long>, docs array<long>, lengths array<int>, payload binary"
PIECES = "part int, nth long, doc long, place long, length int, ids binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc: str = "doc_id", text: str = "text") -> None:
    """Write every document's ids and an end id, in ascending order of `doc`, as coded blocks.

    Parts are ranges of ids, so parts in order and blocks in order give the whole stream. A block
    is a row of the files: up to 2^21 ids of the part's stream from `first` on, coded by themselves with a
    checksum, and whose pieces they are: number in the part, id and length. Any block can
    be read alone; long documents go on in the next blocks. A written part is committed as a
    whole, so a lost task is simply written anew.

    Null text is empty (the end id alone), null ids come first, repeated ids stay rows of their own,
    an empty table gives empty files. Ids must stay below 65,536.
    """

    def code(batches):
        part, codec = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        block, first, nth = 0, 0, 0
        ids: list[np.ndarray] = []
        pieces: list[tuple] = []
        filled = 0

        def coded_block():
            payload = encode_blocks([np.concatenate(ids)])[0]
            row = (part, block, first, filled, [x[0] for x in pieces], [x[1] for x in pieces], [x[2] for x in pieces], payload)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            names = ["part", "block", "first", "n_ids", "nths", "docs", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                for key, coded in zip(some.column(0).to_pylist(), codec.encode(some.column(1).to_pylist())):
                    rest = np.frombuffer(coded + end, "<u4")
                    if rest.max() >= 1 << 16:
                        raise ValueError("ids of 65,536 and more do not fit this format")
                    while len(rest):
                        take = rest[:BLOCK - filled]
                        ids.append(take)
                        pieces.append((nth, key, len(take)))
                        filled += len(take)
                        rest = rest[len(take):]
                        if filled == BLOCK or len(pieces) == MOST_PIECES:
                            yield coded_block()
                            block, first, filled, ids, pieces = block + 1, first + filled, 0, [], []
                    nth += 1
        if filled:
            yield coded_block()

    rows = small_batches(docs).select(F.col(doc).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(tidy(code), FORMAT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, nth, doc, place, length, ids): the pieces of the files, `ids` as little-endian unsigned 32-bit bytes.

    `place` is the piece's start in its part. A damaged block is an error.
    """

    def decode(batches):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                at, out, wide = 0, [], decode_blocks([row["payload"]])[0].astype("<u4").tobytes()
                for nth, doc, length in zip(row["nths"], row["docs"], row["lengths"]):
                    out.append((row["part"], nth, doc, row["first"] + at, length, wide[4 * at:4 * (at + length)]))
                    at += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "nth", "doc", "place", "length", "ids"])

    return small_batches(spark.read.schema(FORMAT).parquet(path)).mapInArrow(tidy(decode), PIECES)


def shift_table(length: int) -> list[int]:
    """What `length` zero bytes do to each bit of a CRC-32."""
    table = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    times = lambda m, v: _product(m, v)
    power, result = table, [1 << i for i in range(32)]
    bits = 8 * length
    while bits:
        if bits & 1:
            result = [times(power, v) for v in result]
        power = [times(power, v) for v in power]
        bits >>= 1
    return result


def _product(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings put together, from their own (CRC-32, length) in order."""
    total = 0
    for crc, length in parts:
        total = _product(_shift(length), total) ^ crc
    return total


_shifts: dict[int, list[int]] = {}


def _shift(length: int) -> list[int]:
    if length not in _shifts:
        if len(_shifts) > 20_000:
            _shifts.clear()
        _shifts[length] = shift_table(length)
    return _shifts[length]


@F.udf(T.LongType())
def pieces_crc(pieces):
    return joined_crc([(p.crc, 4 * p.length) for p in pieces]) if len(pieces) > 1 else pieces[0].crc


def document_digests(pieces: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) per document from its pieces; a piece is reduced to its checksum before it moves."""
    slim = pieces.select("part", "nth", "doc", "place", "length", F.crc32("ids").alias("crc"))
    whole = slim.groupBy("part", "nth").agg(
        F.any_value("doc").alias("doc"), F.min("place").alias("place"), F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("place", "length", "crc"))).alias("pieces"))
    digests = whole.select("part", "doc", "place", "n_tokens", pieces_crc("pieces").alias("ids_crc32"))
    return digests


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): ids of all earlier parts, from the blocks' counts; one row per written part."""
    sizes = spark.read.schema(FORMAT).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
