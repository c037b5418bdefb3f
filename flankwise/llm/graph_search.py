"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Distinct vectors of a shard, queries of a block: bound the memory of a task.
SHARD_ROWS, QUERY_BLOCK = 12_000, 10_000
DEGREE, BUILD_BEAM, RELAXED = 24, 48, 1.2
INSERT = 400
#: Vectors of a shard whose norms differ by more than 2 ** BAND_BITS get graphs of their own; so few points are scanned whole.
BAND_BITS, SCAN_ROWS = 1, 256
#: A graph's search beam begins at LEAST_BEAM and doubles until HELD searches find the share RECALL of what a scan finds.
LEAST_BEAM, HELD, RECALL = 80, 128, 0.96


def usable(vector: Column) -> Column:
    """Not null, not empty, of finite components only, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def bands(vectors: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors by bands of like norms, the middle band around the median norm.

    A graph knows directions only; among like norms the largest inner products lie in the nearest directions. Norms
    are taken as logarithms, so none overflows.
    """
    most = np.abs(vectors).max(axis=1)
    bits = np.log2(most) + 0.5 * np.log2(((vectors / most[:, None]) ** 2).sum(axis=1))
    band = np.rint((bits - np.median(bits)) / BAND_BITS)
    return [np.flatnonzero(band == b) for b in np.unique(band)]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by the power of two above its largest component: exact, and no product overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def together(vectors: np.ndarray) -> np.ndarray:
    """All vectors divided by the power of two above the largest component of them all."""
    return np.ldexp(vectors, -int(np.frexp(np.abs(vectors).max())[1]))


def directions(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, negative inner products) of the `beam` nearest points found for each query, all queries step by step.

    Each query walks greedily: it opens the nearest point of its beam not opened yet and adds that point's
    neighbours, until its whole beam is opened. Missing places are -1.
    """
    n, q = len(points), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf)
    opened = np.ones((q, beam), bool)
    ids[:, 0], opened[:, 0] = entry, False
    far[:, 0] = -(queries @ points[entry])
    seen = np.zeros((q, n + 1), bool)  # The last place stands for a missing neighbour.
    seen[:, [entry, n]] = True
    live = np.arange(q)
    while len(live):
        pending = np.where(opened[live], np.inf, far[live])
        place = pending.argmin(axis=1)
        going = np.isfinite(pending[np.arange(len(live)), place])
        live, place = live[going], place[going]
        if not len(live):
            break
        opened[live, place] = True
        near = links[ids[live, place]]
        near = np.where(near < 0, n, near)
        known = seen[live[:, None], near]
        seen[live[:, None], near] = True
        away = np.where(known, np.inf, -np.einsum("qd,qkd->qk", queries[live], points[np.minimum(near, n - 1)]))
        all_ids = np.hstack([ids[live], np.where(known, -1, near)])
        all_far = np.hstack([far[live], away])
        all_open = np.hstack([opened[live], known])
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        far[live] = np.take_along_axis(all_far, best, 1)
        opened[live] = np.take_along_axis(all_open, best, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(points: np.ndarray, point: int, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE of the candidates, nearest first; one is left out if a kept one is RELAXED times nearer to it."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != point)])
    if not len(candidates):
        return candidates
    block = points[candidates]
    away = ((block - points[point]) ** 2).sum(axis=1)
    order = np.argsort(away, kind="stable")
    candidates, block, away = candidates[order], block[order], away[order]
    square = (block ** 2).sum(axis=1)
    between = square[:, None] + square[None, :] - 2 * block @ block.T
    open_ = np.ones(len(candidates), bool)
    kept = []
    for i in range(len(candidates)):
        if open_[i]:
            kept.append(i)
            if len(kept) == DEGREE:
                break
            open_ &= RELAXED * RELAXED * between[i] > away
    return candidates[kept]


def build_graph(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(neighbours per point, -1 where fewer; entry point) of unit vectors. Points join in batches: greedy searches
    in the graph so far propose neighbours, pruning keeps diverse ones, and edges go back, pruned again where too many."""
    n = len(points)
    links = np.full((n, DEGREE), -1, np.int64)
    middle = points.mean(axis=0)
    entry = int(((points - middle) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(10).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    start = 1
    while start < n:
        batch = order[start:start + min(INSERT, max(1, start))]
        found, _ = beam_search(points, links, points[batch], entry, BUILD_BEAM)
        # Points of one batch do not see each other in the graph yet, so the nearest of them are candidates as well.
        most = min(BUILD_BEAM, len(batch))
        mates = batch[np.argpartition(-(points[batch] @ points[batch].T), most - 1, axis=1)[:, :most]]
        back: dict[int, list[int]] = {}
        for point, candidates in zip(batch, np.hstack([found, mates])):
            kept = robust_prune(points, point, candidates)
            links[point, :len(kept)] = kept
            links[point, len(kept):] = -1
            for other in kept:
                back.setdefault(int(other), []).append(int(point))
        for other, sources in back.items():
            own = links[other][links[other] >= 0]
            new = np.unique(np.concatenate([own, sources]))
            kept = new if len(new) <= DEGREE else robust_prune(points, other, new)
            links[other, :len(kept)] = kept
            links[other, len(kept):] = -1
        start += len(batch)
    return links, entry


def beam_width(points: np.ndarray, links: np.ndarray, entry: int, held: np.ndarray, own: np.ndarray, neighbours: int) -> int:
    """The narrowest of the doubled beams whose recall reaches RECALL on the held queries; the number of points if none does.

    `own` is each query's place among the points, -1 where it is none of them: it finds itself too easily to count.
    """
    scores = held @ points.T
    inside = np.flatnonzero(own >= 0)
    scores[inside, own[inside]] = -np.inf
    most = min(neighbours, len(points) - 1)
    best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    beam = max(LEAST_BEAM, 2 * (neighbours + 1))
    while beam < len(points):
        found, _ = beam_search(points, links, held, entry, beam)
        hits = sum(len(np.intersect1d(b, f[f != o][:most])) for b, f, o in zip(best, found, own))
        if hits >= RECALL * best.size:
            return beam
        beam *= 2
    return len(points)


def build_index(vectors: DataFrame, key: str, vector: str, neighbours: int) -> DataFrame:
    """The written index: a row per shard and band of norms with its distinct vectors, the smallest ids of each and the graph.

    Equal vectors are one point, so a vector that makes up a third of the rows is no cluster of
    zero distances; of its ids the neighbours + 1 smallest can ever be asked for. Shards are
    cut by hash so that each holds some SHARD_ROWS points.
    """
    first = Window.partitionBy("vector").orderBy("id")
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= neighbours + 1)
    points = stored(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "graph-points")
    shards = max(1, math.ceil(points.count() / SHARD_ROWS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        data = np.array(group["vector"].tolist(), dtype=np.float64)
        sample = np.random.default_rng(11).permutation(len(data))[:HELD]
        held = scaled(data[sample])
        rows = []
        for places in bands(data):
            own, ids = data[places], [group["ids"].iloc[i] for i in places]
            links, entry, beam = np.empty(0), 0, len(own)
            if len(own) > SCAN_ROWS:
                links, entry = build_graph(directions(own))
                at = np.full(len(data), -1)
                at[places] = np.arange(len(places))
                beam = beam_width(together(own), links, entry, held, at[sample], neighbours)
            rows.append((group["shard"].iloc[0], len(own), entry, beam, own.tobytes(), links.astype(np.int32).tobytes(),
                         np.concatenate(ids).astype(np.int64).tobytes(), np.array([len(i) for i in ids], np.int32).tobytes()))
        return pd.DataFrame(rows, columns=["shard", "n", "entry", "beam", "vectors", "links", "ids", "counts"])

    spread = points.select("vector", "ids", F.element_at("ids", 1).alias("first")).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(3), "first"), F.lit(shards)).cast("int"))
    # By range: mostly a task per shard, where a hash would put several into one.
    return stored(spread.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(
        build, "shard int, n int, entry int, beam int, vectors binary, links binary, ids binary, counts binary"), "graph-index")


def graph_nearest(
    vectors: DataFrame, queries: DataFrame, neighbours: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest other rows by inner product, nearest first.

    Every usable row is in the graph of one shard and band of norms; a query beam-searches each graph, in blocks
    of queries, and scans small bands whole. Each graph's beam was widened when it was built until the recall measured on a
    held sample reached RECALL. Scores are inner products of the original vectors in double precision; ties go to the
    smaller id. A query without other candidates has no rows; null, zero and non-finite vectors and null keys
    take no part, equal ids and vectors are rows like others, an empty table gives nothing. Vectors
    must have one length; columns beside the two are not read.
    """
    index = build_index(vectors, key, vector, neighbours)
    asked = stored(queries.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("query_id"), F.col(vector).alias("asked")), "graph-queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    shards = index.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
    sent = asked.select("query_id", "asked", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))).alias("shard"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(graphs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        for start in range(0, len(wanted) if len(graphs) else 0, 500):
            some = wanted.iloc[start:start + 500]
            exact = np.array(some["asked"].tolist(), dtype=np.float64)
            near: list[list[tuple[float, int]]] = [[] for _ in exact]
            for g in graphs.itertuples():
                data = np.frombuffer(g.vectors, np.float64).reshape(g.n, -1)
                ids, first = np.frombuffer(g.ids, np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(g.counts, np.int32))])
                if g.beam < g.n:
                    links = np.frombuffer(g.links, np.int32).reshape(g.n, DEGREE).astype(np.int64)
                    found, _ = beam_search(together(data), links, scaled(exact), int(g.entry), int(g.beam))
                else:
                    found = np.broadcast_to(np.arange(g.n), (len(exact), g.n))
                for query, own, row, all_ in zip(some["query_id"], exact, found, near):
                    row = row[row >= 0]
                    scores = (data[row] * own).sum(axis=1)
                    new = [(-s, int(i)) for r, s in zip(row, scores) for i in ids[first[r]:first[r + 1]] if i != query]
                    all_[:] = sorted(all_ + new)[:neighbours]
            for query, best in zip(some["query_id"], near):
                for s, i in best:
                    out["query_id"].append(query)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
