"""Ranked lexical search over norm buckets of impact vectors."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, term_bytes, terms, text_or_empty, tidy

WORDS = term_bytes(string.ascii_lowercase + string.digits)
#: Vectors of one bucket: neighbours in the order of norms.
BUCKET = 2048
#: The share of the longest vectors that is searched first, for the other vectors' thresholds.
HEAD = 1 / 64
#: The focus of an item is its heaviest terms that leave this share of its squared norm to the rest.
REST = 0.05
#: Relative slack of bounds in doubles.
SLACK = 1e-9
NO_ID = -(1 << 63)


@dataclass
class Item:
    """An item's weighted terms: `ids` ascending with `weights`, the focus terms, and norms of all and of the rest."""

    ids: np.ndarray
    weights: np.ndarray
    focus: np.ndarray
    focus_weights: np.ndarray
    norm: float
    rest: float


def item_of(ids: list[int], weights: list[int]) -> Item:
    ids, weights = np.array(ids, np.int64), np.array(weights, np.int64)
    order = np.argsort(ids)
    ids, weights = ids[order], weights[order]
    heavy = np.argsort(-weights, kind="stable")
    squares = weights[heavy].astype(float) ** 2
    left = squares.sum() - np.cumsum(squares)
    n = int(np.searchsorted(-left, -REST * squares.sum())) + 1
    focus = np.sort(heavy[:n])
    rest = squares[n:].sum()
    return Item(ids, weights, ids[focus], weights[focus], math.sqrt(squares.sum()), math.sqrt(rest))


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each item, rows of one item together."""

    @tidy
    def split(batches):
        for batch in batches:
            rows = [(name, t) for name, body in zip(batch.column(0).to_pylist(), batch.column(1))
                    for t in {t for piece in terms(body.as_buffer().to_pybytes(), WORDS) for t in piece}]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())],
                                  names=["item", "term"])

    read = small_batches(items).select(F.col(item).cast("long").alias("item"), text_or_empty(text).alias("text"))
    return read.mapInArrow(split, "item bigint, term string").distinct()


def document_terms(docs: DataFrame, doc: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(doc, n, ids, tfs) of documents with terms: n all terms, ids and tfs those that items have."""

    @tidy
    def count(batches):
        for batch in batches:
            columns = ([], [], [], [])
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts: Counter = Counter()
                for piece in terms(body.as_buffer().to_pybytes(), WORDS):
                    counts.update(piece)
                if counts:
                    met = counts.keys() & number.keys()
                    for column, value in zip(columns, (name, counts.total(), [number[t] for t in met], [counts[t] for t in met])):
                        column.append(value)
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32())),
                                   pa.array(columns[3], pa.list_(pa.int64()))], names=["doc", "n", "ids", "tfs"])

    read = small_batches(docs).select(F.col(doc).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    return read.mapInArrow(count, "doc bigint, n bigint, ids array<int>, tfs array<bigint>")


def norm_buckets(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc, norm, ids, impacts), range-sorted by falling norm and written so; vectors of equal norm spread by their id."""
    m = f"(10 + (90 * n * {n_docs}L) div {n_terms}L)"
    impacts = F.expr(f"transform(tfs, t -> (1000000000L * t) div (1000 * t + 8 * {m}))")
    rows = vectors.where(F.size("ids") > 0).select("doc", "ids", impacts.alias("impacts"))
    rows = rows.withColumn("norm", F.expr("sqrt(aggregate(impacts, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"))
    order = [F.desc("norm"), F.xxhash64("doc")]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "impact-buckets")


class Bucket:
    """Up to BUCKET impact vectors, with their entries in the order of vectors and of terms."""

    def __init__(self, docs: np.ndarray, norms: np.ndarray, ids: np.ndarray, impacts: np.ndarray, offsets: np.ndarray):
        self.docs, self.norms, self.ids, self.impacts, self.offsets = docs, norms, ids, impacts, offsets
        self.longest = float(norms.max())
        by_term = np.argsort(ids, kind="stable")
        self.term_ids, self.term_impacts = ids[by_term], impacts[by_term]
        self.term_rows = np.repeat(np.arange(len(docs)), np.diff(offsets))[by_term]

    def survivors(self, item: Item, least: float) -> np.ndarray:
        """Vectors whose bound reaches `least`: focus coordinates are exact, the rest is bounded by the norms that are left."""
        start = np.searchsorted(self.term_ids, item.focus)
        size = np.searchsorted(self.term_ids, item.focus, side="right") - start
        at = np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        rows, values = self.term_rows[at], self.term_impacts[at].astype(float)
        reached = np.bincount(rows, values * np.repeat(item.focus_weights, size), len(self.docs))
        used = np.bincount(rows, values * values, len(self.docs))
        bound = reached + item.rest * np.sqrt(np.maximum(self.norms**2 * (1 + SLACK) - used, 0))
        return np.flatnonzero(bound * (1 + SLACK) >= least)

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact integer scores of some vectors; `dense` holds the item's weights by term."""
        size = np.diff(self.offsets)[rows]
        ahead = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.arange(size.sum()) + np.repeat(self.offsets[rows] - ahead, size)
        return np.add.reduceat(dense[self.ids[at]] * self.impacts[at], ahead)


def search_buckets(items: list[Item], n_ids: int, thresholds: np.ndarray, top: int):
    """A task's search: (item, doc, score) of the best `top` vectors it has for each item that reach the thresholds."""

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = thresholds.astype(float)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)
        dense = np.zeros(n_ids, np.int64)
        for batch in batches:
            docs = batch.column(0).fill_null(NO_ID).to_numpy()
            norms = batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            ids, impacts = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for first in range(0, len(docs), BUCKET):
                last = min(first + BUCKET, len(docs))
                part = slice(offsets[first], offsets[last])
                bucket = Bucket(docs[first:last], norms[first:last], ids[part], impacts[part], offsets[first:last + 1] - offsets[first])
                for k, item in enumerate(items):
                    if item.norm * bucket.longest * (1 + SLACK) < least[k]:
                        continue
                    rows = bucket.survivors(item, least[k])
                    if not len(rows):
                        continue
                    dense[item.ids] = item.weights
                    scores = bucket.scores(rows, dense)
                    dense[item.ids] = 0
                    good = (scores > 0) & (scores >= least[k])
                    scores, found = np.concatenate((best[k][0], scores[good])), np.concatenate((best[k][1], bucket.docs[rows[good]]))
                    order = np.lexsort((found, -scores))[:top]
                    best[k] = scores[order], found[order]
                    if len(order) == top:
                        least[k] = max(least[k], float(scores[order[-1]]))
        sizes = [len(s) for s, _ in best]
        found = np.concatenate([d for _, d in best])
        yield pa.record_batch([
            pa.array(np.repeat(np.arange(len(items)), sizes), pa.int64()), pa.array(found, pa.int64(), mask=found == NO_ID),
            pa.array(np.concatenate([s for s, _ in best]), pa.int64())], names=["k", "doc", "score"])

    return search


def _search_block(docs: DataFrame, listed: DataFrame, top: int, doc: str, text: str) -> DataFrame:
    """Best documents of a bounded block of items, from (item, term)."""
    spark = docs.sparkSession
    rows = listed.collect()  # bounded: one block of items
    number = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    vectors = stored(document_terms(docs, doc, text, {t.encode(): i for t, i in number.items()}), "impact-terms")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = spark.createDataFrame([], "item bigint, doc bigint, score bigint, rank int")
    if not n_docs or not number:
        return empty
    df = dict(vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # at most a row per term of the block
    weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for i, n in df.items()}
    held: dict[int, list[int]] = {}
    for r in rows:
        if number[r.term] in weight:
            held.setdefault(r.item, []).append(number[r.term])
    names = [name for name in held]
    items = [item_of(held[name], [weight[i] for i in held[name]]) for name in names]
    if not items:
        return empty

    buckets = norm_buckets(vectors, n_docs, n_terms)
    cut = buckets.approxQuantile("norm", [1 - HEAD], HEAD / 8)[0]
    by_rank = Window.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by_rank).cast("int")).where(F.col("rank") <= top)

    def found(part: DataFrame, thresholds: np.ndarray) -> DataFrame:
        return part.select("doc", "norm", "ids", "impacts").mapInArrow(
            search_buckets(items, len(number), thresholds, top), "k bigint, doc bigint, score bigint")

    head = stored(ranked(found(buckets.where(F.col("norm") >= cut), np.zeros(len(items)))).drop("rank"), "impact-head")
    thresholds = np.zeros(len(items))
    for k, least in head.groupBy("k").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).select("k", "least").collect():
        thresholds[k] = least
    rest = found(buckets.where(F.col("norm") < cut), thresholds)
    naming = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k bigint, item bigint"))
    return ranked(head.unionByName(rest)).join(naming, "k").select("item", "doc", "score", "rank")


def lexical_search(
    docs: DataFrame, items: DataFrame, top: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_items: int = 1000,
) -> DataFrame:
    """(item, doc, score, rank): each item's `top` documents by summed weighted impacts, equal scores by ascending id.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Documents become vectors of
    integer impacts over the terms of the items, sorted by length into buckets. Per item, Cauchy-Schwarz skips buckets whose
    longest vector cannot reach the threshold; inside, the item's heaviest coordinates are summed exactly and the
    rest is bounded by the norms left over; what survives is scored in integers. The longest vectors are searched
    first and give each item its first threshold. Bounds are strict, so no tie is lost, and every document is either scored or proven lower.

    Items come in blocks of about `block_items` (by digest); each block reads the documents once. Null texts have no terms; documents without
    terms count nowhere; items without a term of any document have no rows. Rows of one item id are one item.
    Repeated documents are ranked each; a null id comes before all others. Ids are 64-bit integers. Texts of any length are read in pieces. Empty tables give an
    empty result; other columns are not read.
    """
    listed = stored(item_terms(items, item, item_text), "impact-items")
    blocks = -(-listed.select("item").distinct().count() // block_items)
    numbered = listed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))))
    found = [_search_block(docs, numbered.where(F.col("block") == b).select("item", "term"), top, doc, text) for b in range(max(blocks, 1))]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole
