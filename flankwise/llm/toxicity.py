"""Toxicity score: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, runs, small_batches, text_or_empty, tidy

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Labelled rows that the model is fitted on at most, the smallest by hash.
SAMPLE = 4_000
ROUNDS = 300


def ngram_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, feature) of every character n-gram of a few texts, repeats included.

    Texts are lower-cased and taken between two blanks, so words at their ends look like words within.
    """
    marked = "".join(f"\0 {t.lower()} " for t in texts) + "\0" * max(ORDERS)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 0) - 1
    owner = np.minimum(owner, len(texts) - 1)
    count = len(points) - max(ORDERS)
    found, rolled = [], np.zeros(count, dtype=np.uint64)
    clean = np.ones(count, dtype=bool)
    for i in range(max(ORDERS)):
        step = points[i:i + count]
        clean &= step != 0
        rolled = (rolled + step + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        if i + 1 in ORDERS:
            found.append(np.where(clean, rolled >> np.uint64(64 - BITS), np.uint64(1 << BITS)).astype(np.int64))
    return owner[:count], np.stack(found)


def distinct_features(texts: list[str]) -> list[np.ndarray]:
    """Per text its distinct features, sorted."""
    owner, features = ngram_features(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    marks, found = np.zeros((1 << BITS) + 1, dtype=bool), []
    for first, end in zip(cuts, cuts[1:]):
        marks[features[:, first:end]] = True
        marks[1 << BITS] = False
        own = np.flatnonzero(marks)
        marks[own] = False
        found.append(own.astype(np.uint32))
    return found


@dataclass
class Model:
    bias: float
    features: np.ndarray
    weights: np.ndarray


def fit(vectors: list[np.ndarray], labels: np.ndarray) -> Model:
    """Naive Bayes ratios, then a regularised logistic regression over the scaled features.

    A ratio counts when it is sqrt(2 ln(2 rows of the rarer class)) standard errors from zero, the usual threshold for
    many noisy coefficients, and is zero otherwise. Without both classes the score is the known share.
    """
    labels = labels.astype(float)
    positives, n = labels.sum(), len(labels)
    bias = float(np.log((positives + 0.5) / (n - positives + 0.5))) if n else 0.0
    empty = Model(bias, np.empty(0, np.int64), np.empty(0, np.float32))
    if not n or positives in (0, n):
        return empty
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for vector, label in zip(vectors, labels):
        (p if label else q)[vector] += 1
    share_p, share_q = p / (positives + 2), q / (n - positives + 2)
    ratio = np.log(share_p / share_q)
    error = np.sqrt(1 / p + 1 / q)
    certain = np.sqrt(2 * np.log(2 * min(positives, n - positives)))
    used = np.abs(ratio) > certain * error
    vectors = [v[used[v]] for v in vectors]
    owner = np.repeat(np.arange(n), [len(v) for v in vectors])
    column = np.concatenate(vectors)
    names, column = np.unique(column, return_inverse=True)
    if not len(names):
        return empty
    scale = ratio[names]
    value = scale[column]
    w, b = np.zeros(len(names)), bias
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):  # full-batch Adam
        z = b + np.bincount(owner, value * w[column], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        gw = np.bincount(column, g[owner] * value, minlength=len(names)) + 1e-5 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
        w = w - rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return Model(float(b), names.astype(np.int64), (w * scale).astype(np.float32))


def labelled_sample(labels: DataFrame, doc: str, label: str, usable: Column, sample: int) -> DataFrame:
    """At most `sample` labelled ids, by hash; several labels of one id count as the largest."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & usable).groupBy(F.col(doc).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("_label"))
    return known.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, usable: Column, doc: str, text: str, label: str, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows for which `usable` (a condition on the label table) holds.

    Features are made where the texts are; the sample's vectors, at most `sample` of at most 2^20 ids, meet in one task.
    """
    chosen = labelled_sample(labels, doc, label, usable, sample)

    def vectors(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = batch.column(0).to_pylist()
            known = batch.column(1).to_pylist()
            for part in runs([t.encode("utf-8", "surrogatepass") for t in texts]):
                found = distinct_features(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.tobytes() for f in found], pa.binary()), pa.array(known[part], pa.int32())], names=["features", "label"])

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        model = fit([np.frombuffer(f, np.uint32) for f in group["features"]], group["label"].to_numpy())
        return pd.DataFrame({"bias": [model.bias], "features": [model.features.tobytes()], "weights": [model.weights.tobytes()]})

    # The sample is bounded by its parameter, so it may be copied.
    meet = docs.select(F.col(doc).alias("_id"), text_or_empty(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = meet.select("_text", "_label").mapInArrow(tidy(vectors), "features binary, label int").groupBy().applyInPandas(
        fitted, "bias double, features binary, weights binary").collect()
    if not rows:
        return Model(0.0, np.empty(0, np.int64), np.empty(0, np.float32))
    return Model(rows[0].bias, np.frombuffer(rows[0].features, np.int64), np.frombuffer(rows[0].weights, np.float32))


def score_texts(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    owner, features = ngram_features(texts)
    z = np.full(len(texts), bias)
    known = [f < (1 << BITS) for f in features]
    hits = []
    for f, k in zip(features, known):
        place = np.flatnonzero(k & (table[np.minimum(f, (1 << BITS) - 1)] != 0))
        hits.append((owner[place].astype(np.int64) << BITS) | f[place])
    pairs = np.unique(np.concatenate(hits))
    z += np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, usable: Column, doc: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE,
) -> DataFrame:
    """Every row of `docs` with `score` (0 to 1) in a struct: (row {all columns}, score).

    The features of a text are its distinct character n-grams of 3 to 6, hashed to
    2^20; a feature's value is its naive Bayes log-count ratio. Null text is empty and,
    like any text without known n-grams, scores the bias. Rows without label, null
    labels and null ids are not learned from; without labels every score is 0.5.
    Columns keep their names inside the struct `row`.
    """
    model = train(small_batches(docs), labels, usable, doc, text, label, sample)
    names, weights, bias = model.features, model.weights, model.bias

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[names] = weights
        for series in parts:
            texts, out = series.tolist(), []
            for part in runs([t.encode("utf-8", "surrogatepass") for t in texts]):
                out.append(score_texts(texts[part], table, bias))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))
        release()

    return docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("_text")).select("row", score("_text").alias("score"))
