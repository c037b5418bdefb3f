"""Ranking metrics: tie-safe gold ranks, benchmark aggregates, rank statistics, resampling."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import LONGEST, STEP, counter_digests
from ..functions.iupac import augmented_matrix, is_subset, normalize_motif, valid_motif
from ..functions.matrix import matrix_cosine
from ..session import at_most, materialize
from .fusion import TIE
from .matching import motif_subset_join
from .ordering import dense_position, running_total

RECALL_AT = (1, 3, 5)
METRICS = ("mrr", "recall_at_1", "recall_at_3", "recall_at_5")


def finite(score: Column) -> Column:
    return F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)


def gold_rank_by_length(scored: DataFrame, golds: DataFrame, *, score: str, keys: list[str] = ["system_id"]) -> DataFrame:
    """Tie-pessimistic rank of the best gold candidate per (keys, pam_length).

    scored: (keys, candidate_pam, score); golds: (keys, gold_pam). A candidate is
    gold when it lies inside any gold motif of its length. Non-gold candidates
    tied with the best gold rank before it. Every gold length gets a row; without
    a scored candidate its rank is null and its reciprocal rank 0.
    """
    group = [*keys, "pam_length"]
    golds = golds.select(*keys, normalize_motif("gold_pam").alias("gold_pam")).distinct()
    rows = scored.select(
        *keys, normalize_motif("candidate_pam").alias("candidate_pam"), finite(F.col(score).cast("double")).alias("score")
    ).where(F.col("score").isNotNull()).withColumn("pam_length", F.length("candidate_pam"))
    pairs = motif_subset_join(rows.select("candidate_pam"), golds, "candidate_pam", "gold_pam")
    is_gold = golds.join(pairs, "gold_pam").select(*keys, "candidate_pam").distinct().withColumn("gold", F.lit(True))
    rows = rows.join(is_gold, [*keys, "candidate_pam"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    # A group is one candidate list of one length, so the best gold score is a bounded window.
    rows = rows.withColumn("best", F.max(F.when(F.col("gold"), F.col("score"))).over(Window.partitionBy(*group)))
    better = F.count_if(F.col("score") > F.col("best") + TIE)
    tied = F.count_if(~F.col("gold") & (F.abs(F.col("score") - F.col("best")) <= TIE))
    ranks = rows.groupBy(*group).agg(
        F.any_value("best").alias("best_gold_score"),
        F.count(F.lit(1)).alias("scored_candidates"),
        (better + 1).alias("optimistic_rank"),
        (better + tied + 1).alias("rank"),
    )
    lengths = golds.select(*keys, F.length("gold_pam").alias("pam_length")).distinct()
    found = F.col("best_gold_score").isNotNull()
    out = lengths.join(ranks, group, "left")
    return out.select(
        *group,
        F.coalesce("scored_candidates", F.lit(0)).alias("scored_candidates"),
        F.when(found, F.col("optimistic_rank")).alias("optimistic_rank"),
        F.when(found, F.col("rank")).alias("gold_rank"),
        F.when(found, 1.0 / F.col("rank")).otherwise(0.0).alias("reciprocal_rank"),
        *[F.when(found, F.col("rank") <= k).otherwise(F.lit(False)).alias(f"recall_at_{k}") for k in RECALL_AT],
    )


def prior_scores(candidates: DataFrame, priors: DataFrame, keys: list[str] = ["system_id"]) -> DataFrame:
    """Candidates (keys, candidate_pam, score) under a prior motif: 1 inside it, 0 outside, null where the length differs."""
    rows = candidates.select(*keys, normalize_motif("candidate_pam").alias("candidate_pam")).join(
        priors.select(*keys, normalize_motif("prior_pam").alias("_prior")), keys)
    score = F.when(F.length("candidate_pam") == F.length("_prior"), is_subset("candidate_pam", "_prior").cast("double"))
    return rows.select(*keys, "candidate_pam", score.alias("score"))


def best_spectrum_cosine(predictions: DataFrame, golds: DataFrame, *, keys: list[str] = ["system_id"], same_length: bool = True) -> DataFrame:
    """Predictions (keys, predicted_pam) with the best cosine of their matrix to a gold motif of the key; 0 without a valid one.

    By default only golds of the same length count, so a short broad motif gets no credit for a longer one.
    """
    matrix = lambda rows, name: rows.withColumn(f"_{name}", augmented_matrix(name))
    pred = predictions.select(*keys, normalize_motif("predicted_pam").alias("predicted_pam")).distinct()
    gold = golds.select(*keys, normalize_motif("gold_pam").alias("gold_pam")).distinct().where(valid_motif("gold_pam"))
    pairs = matrix(pred.where(valid_motif("predicted_pam")), "predicted_pam").join(matrix(gold, "gold_pam"), keys)
    if same_length:
        pairs = pairs.where(F.length("predicted_pam") == F.length("gold_pam"))
    best = pairs.groupBy(*keys, "predicted_pam").agg(F.max(matrix_cosine("_predicted_pam", "_gold_pam")).alias("spectrum_cosine"))
    return pred.join(best, [*keys, "predicted_pam"], "left").withColumn("spectrum_cosine", F.coalesce("spectrum_cosine", F.lit(0.0)))


def select_scope(variants: DataFrame, scope: str, *, control: str, variant: str = "variant_id", split: str = "future_task_split") -> DataFrame:
    """Variants of the development split, or all; the control variant must be among them."""
    if scope not in ("development", "all"):
        raise ValueError(f"unknown scope {scope}")
    chosen = variants if scope == "all" else variants.where(F.col(split) == "development")
    if chosen.where(F.col(variant) == control).isEmpty():
        raise ValueError(f"control variant {control} is missing")
    return chosen


def system_metrics(by_length: DataFrame, keys: list[str] = ["system_id"]) -> DataFrame:
    """Means over all gold lengths of a key; a length without scored candidates counts as 0."""
    return by_length.groupBy(*keys).agg(
        F.avg((F.col("scored_candidates") > 0).cast("double")).alias("coverage"),
        F.avg("reciprocal_rank").alias("mrr"),
        *[F.avg(F.col(f"recall_at_{k}").cast("double")).alias(f"recall_at_{k}") for k in RECALL_AT],
    ).withColumn("not_applicable", F.lit(False))


def not_applicable(systems: DataFrame, reason: str, keys: list[str] = ["system_id"]) -> DataFrame:
    """Method rows of systems that never supplied the channel: null metrics that leave every denominator."""
    return systems.select(
        *keys, F.lit(0.0).alias("coverage"), *[F.lit(None).cast("double").alias(m) for m in METRICS],
        F.lit(True).alias("not_applicable"), F.lit(reason).alias("reason"),
    )


def aggregate_benchmark(methods: DataFrame, grains: list[list[str]] | None = None) -> DataFrame:
    """Applicability-aware summary per method, in one pass over all grains.

    methods: one row per (system, method) with the `system_metrics` columns.
    `grains` lists extra grouping columns; None is the overall summary.
    """
    applicable = ~F.col("not_applicable")
    scored = applicable & (F.col("coverage") > 0)
    aggregates = [
        F.count_if(applicable).alias("systems_total"),
        F.count_if(~applicable).alias("systems_not_applicable"),
        F.count_if(scored).alias("systems_scored"),
        F.coalesce(F.avg(F.when(applicable, scored.cast("double"))), F.lit(0.0)).alias("system_coverage"),
    ]
    for metric in METRICS:
        aggregates.append(F.coalesce(F.avg(F.when(applicable, F.col(metric))), F.lit(0.0)).alias(f"{metric}_all_systems"))
        aggregates.append(F.avg(F.when(scored, F.col(metric))).alias(f"{metric}_eligible_systems"))
    if grains is None:
        return methods.groupBy("method").agg(*aggregates).where("systems_total > 0")
    columns = list(dict.fromkeys(c for grain in grains for c in grain))
    sets = [[F.col("method"), *[F.col(c) for c in grain]] for grain in grains]
    return methods.groupingSets(sets, "method", *columns).agg(
        *aggregates, F.grouping_id().cast("long").alias("grain")
    ).where("systems_total > 0")


def paired_deltas(methods: DataFrame, *, challenger: str = "fusion", baselines: list[str] = ["protein_only", "spacer_only"]) -> DataFrame:
    """MRR difference per system where both methods apply and both ranked something."""
    usable = methods.where(~F.col("not_applicable") & (F.col("coverage") > 0)).select("system_id", "method", "mrr")
    right = usable.where(F.col("method") == challenger).select("system_id", F.col("mrr").alias("_mrr"))
    return usable.where(F.col("method").isin(baselines)).join(right, "system_id").select(
        "system_id", F.concat(F.lit(f"{challenger}_minus_"), F.col("method")).alias("comparison"),
        (F.col("_mrr") - F.col("mrr")).alias("mrr_delta"),
    )


def paired_summary(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mrr_delta").alias("mean_mrr_delta"),
    )


def bootstrap_picks(iterations: int) -> tuple[int, int]:
    """1-based places of the interval's ends among the sorted resample means."""
    low = max(0, int(iterations * 0.025) - 1)
    high = min(iterations - 1, int(iterations * 0.975))
    return low + 1, high + 1


# Values of one block, and draws that one task deals to the blocks.
BLOCK = 1 << 16
DEALT = 1 << 18
# Draws that a task holds at once, and resamples that one task makes of a block.
HELD = 1 << 20
RESAMPLES = 250
# Tasks at most of a step of the bootstrap.
MAX_TASKS = 4096


def hashed_numbers(prefix: str, count: int) -> np.ndarray:
    """Numbers below 2^60, two per digest of `prefix` and a counter: the same on every engine and any partitioning."""
    text, digests, first, end = prefix.encode(), [], 0, (count + 1) // 2
    if len(text) + len(str(end)) > LONGEST:
        words = b"".join(md5(text + str(n).encode()).digest() for n in range(end))
        return (np.frombuffer(words, ">u8")[:count] >> np.uint64(4)).astype(np.int64)
    while first < end:
        last = min(first + STEP, end, 10 ** len(str(first)))
        digests.append(counter_digests(text, first, last))
        first = last
    words = np.concatenate(digests).astype("<u4", copy=False) if digests else np.empty((0, 4), "<u4")
    return (words.view(">u8").ravel()[:count] >> np.uint64(4)).astype(np.int64)


def run_column(iterations: int) -> Column:
    """A row per run of at most RESAMPLES resamples."""
    return F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // RESAMPLES) - 1)))


def draw_ranges(placed: DataFrame, keys: list[str], iterations: int) -> DataFrame:
    """(keys, size, _range, run): a row per range of draws and run of resamples."""
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    ranges = sizes.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / DEALT) - 1)))
    return ranges.select(*keys, "size", "_range").withColumn("run", run_column(iterations))


def dealt_draws(placed: DataFrame, keys: list[str], iterations: int, seed: int, tasks: int = 1) -> DataFrame:
    """(keys, block, run, size, counts): how many draws of each resample of a run fall into a block of values, per range of draws.

    Draw `j` of a resample belongs to the block of place number(seed-iteration-range, j) modulo size. A task counts the
    draws of one range and run into arrays, one per block; no draw is a row.
    """
    def deal(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                *key, size, at, run = row
                blocks, draws = -(-size // BLOCK), min(DEALT, size - at * DEALT)
                resamples = range(run * RESAMPLES, min((run + 1) * RESAMPLES, iterations))
                counts = np.zeros((blocks, len(resamples)), np.int64)
                if blocks == 1:
                    counts[0] = draws
                else:
                    for n, i in enumerate(resamples):
                        counts[:, n] = np.bincount(hashed_numbers(f"{seed}-{i}-{at}-", draws) % size // BLOCK, minlength=blocks)
                yield pd.DataFrame([[*key, block, run, size, counts[block]] for block in range(blocks)], columns=names)

    names = [*keys, "block", "run", "size", "counts"]
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["block bigint", "run int", "size bigint", "counts array<bigint>"])
    return draw_ranges(placed, keys, iterations).repartition(tasks, *keys, "_range", "run").mapInPandas(deal, schema)


def resample_sums(placed: DataFrame, values: list[str], keys: list[str], iterations: int, seed: int) -> DataFrame:
    """(keys, iteration, size, one sum per value) of bootstrap resamples of the rows (keys, place, values).

    A resample draws as many rows as its key has. Its draws are first dealt to blocks of BLOCK places (an exact
    multinomial split), then drawn inside each block where its values lie: draw `r` there is place
    number(seed-iteration-block, r) modulo the block's size. A task makes one run of resamples of one block and gives one
    array of partial sums per value; its memory depends on the block and the run, not on the number of draws.
    """
    def draw(key, left, right):
        if not len(left):
            return pd.DataFrame(columns=names)
        block, run = int(key[-2]), int(key[-1])
        left = left.sort_values("place")
        columns = [left[v].to_numpy(dtype=float) for v in values]
        counts = np.stack(right["counts"].to_numpy()).sum(axis=0)
        sums = np.zeros((len(values), len(counts)))
        for i in range(len(counts)):
            for first in range(0, counts[i], HELD):
                n = min(HELD, counts[i] - first)
                place = hashed_numbers(f"{seed}-{run * RESAMPLES + i}-{block}-{first // HELD}-", n) % len(left)
                for v, column in enumerate(columns):
                    sums[v, i] += column[place].sum()
        return pd.DataFrame([[*key[:-2], run, int(right["size"].iloc[0]), *sums]], columns=names)

    names = [*keys, "run", "size", *values]
    rows = placed.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")).withColumn("run", run_column(iterations))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["run int", "size bigint"] + [f"`{v}` array<double>" for v in values])
    group = [*keys, "block", "run"]
    # The rows of draws are few and their work is large: a given number of partitions is never drawn together.
    tasks = max(1, min(2 * draw_ranges(placed, keys, iterations).count(), MAX_TASKS))
    dealt = dealt_draws(placed, keys, iterations, seed, tasks)
    apart = lambda side: side.repartition(min(4 * tasks, MAX_TASKS), *group).groupBy(*group)
    parts = apart(rows).cogroup(apart(dealt)).applyInPandas(draw, schema)
    spread_out = parts.select(*keys, "run", "size", F.posexplode(F.arrays_zip(*values)).alias("_at", "_sums"))
    spread_out = spread_out.withColumn("iteration", F.col("run") * RESAMPLES + F.col("_at"))
    return spread_out.groupBy(*keys, "iteration", "size").agg(*[F.sum(f"_sums.{v}").alias(v) for v in values])


def bootstrap_mean_interval(
    values: DataFrame, *, value: str, identity: list[str], keys: list[str] = [], iterations: int = 2000, seed: int = 17
) -> DataFrame:
    """Bootstrap interval of the mean per key, from digest-driven draws that are summed where the values lie."""
    placed = materialize(dense_position(values.where(F.col(value).isNotNull()), identity, keys, "place").select(*keys, "place", value))
    means = resample_sums(placed, [value], keys, iterations, seed).withColumn("mean", F.col(value) / F.col("size"))
    low, high = bootstrap_picks(iterations)
    # One row per resample and key.
    ranked = means.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "iteration")))
    pick = lambda n, name: F.max(F.when(F.col("n") == n, F.col("mean"))).alias(name)
    return ranked.groupBy(*keys).agg(pick(low, "ci_low"), pick(high, "ci_high"))


def cluster_bootstrap_ratio(items: DataFrame, *, cluster: str, value: str, iterations: int = 2000, seed: int = 20260927) -> DataFrame:
    """Component bootstrap: resample clusters, ratio of sums, 2.5 and 97.5 percent quantiles."""
    sums = items.where(F.col(value).isNotNull()).groupBy(cluster).agg(
        F.sum(value).cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("items")
    )
    placed = materialize(dense_position(sums, [cluster], [], "place").select("place", "total", "items"))
    ratios = resample_sums(placed, ["total", "items"], [], iterations, seed).withColumn("ratio", F.col("total") / F.col("items"))
    return ratios.agg(
        F.percentile("ratio", F.lit(0.025)).alias("ci_low"), F.percentile("ratio", F.lit(0.975)).alias("ci_high")
    )


# Distinct (key, value) rows up to which one key's values are ranked in one window.
MAX_WINDOW_VALUES = 2_000_000


def value_ranks(rows: DataFrame, *, value: str, keys: list[str], descending: bool = False) -> DataFrame:
    """Mid-rank, preceding rows and copies of every distinct value of a key.

    Only distinct values are ranked, so a key with very many rows stays small as
    long as its values repeat. Very many distinct values are ranked in ranges.
    """
    counts = materialize(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies")))
    ranked = running_total(counts, "copies", value, keys, "before", descending, whole=at_most(counts, MAX_WINDOW_VALUES))
    return ranked.withColumn("mid_rank", F.col("before") + (F.col("copies") + 1) / 2.0)


def average_rank(rows: DataFrame, *, value: str, keys: list[str], descending: bool = False) -> DataFrame:
    """Every row with the average rank of its value; NaN is refused."""
    checked = rows.withColumn(
        value, F.when(F.isnan(F.col(value).cast("double")), F.raise_error(F.lit("ranks need comparable values")).cast("double")).otherwise(F.col(value))
    )
    ranks = value_ranks(checked, value=value, keys=keys, descending=descending).select(*keys, value, "mid_rank")
    return checked.join(ranks, [*keys, value])


def ranked_columns(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Distinct value combinations with their count `_n` and, per column, mid-rank and copies from either end.

    Where every key has few rows (counted), a key is one window and rows that already lie together by key do not move again.
    Otherwise the combinations are stored once and every column is ranked on its own distinct values.
    """
    combos = rows.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"))
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    if keys and largest <= MAX_KEY_ROWS:
        return _ranked_in_windows(combos, columns, keys)
    combos = materialize(combos)
    whole = at_most(combos, MAX_WINDOW_VALUES)
    out = combos.join(combos.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    for c in columns:
        counts = combos.groupBy(*keys, c).agg(F.sum("_n").alias("_copies"))
        ranks = running_total(counts, "_copies", c, keys, "_before", whole=whole)
        out = out.join(ranks.select(
            *keys, c, (F.col("_before") + (F.col("_copies") + 1) / 2.0).alias(f"_rank_{c}"),
            F.col("_before").alias(f"_below_{c}"), F.col("_copies").alias(f"_copies_{c}"),
        ), [*keys, c])
    return out


# Rows of a key up to which it is one window.
MAX_KEY_ROWS = 100_000


def _ranked_in_windows(combos: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    out = combos.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    for c in columns:
        up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(f"_copies_{c}", F.sum("_n").over(Window.partitionBy(*keys, c))).withColumn(f"_below_{c}", up_to - F.col(f"_copies_{c}"))
        out = out.withColumn(f"_rank_{c}", F.col(f"_below_{c}") + (F.col(f"_copies_{c}") + 1) / 2.0)
    # A missing value has no rank and its rows are left out, as in a join.
    return out.where(" and ".join(f"`{c}` is not null" for c in [*keys, *columns]))


def _correlation(left: str, right: str) -> Column:
    """Pearson of two rank columns over weighted rows, as an aggregate; null when a side is constant."""
    x, y, n = F.col(f"_rank_{left}"), F.col(f"_rank_{right}"), F.sum("_n")
    s = lambda e: F.sum(F.col("_n") * e)
    cov = n * s(x * y) - s(x) * s(y)
    vx, vy = n * s(x * x) - s(x) * s(x), n * s(y * y) - s(y) * s(y)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), cov / F.sqrt(vx) / F.sqrt(vy))


def _membership(column: str, k: int) -> Column:
    """Share in the top k of a value; ties at the cutoff share the places left."""
    copies = F.col(f"_copies_{column}")
    above = F.col("_total") - F.col(f"_below_{column}") - copies
    return F.greatest(F.lit(0.0), F.least(copies.cast("double"), F.lit(float(k)) - above)) / copies


def _overlap(left: str, right: str, k: int) -> Column:
    return F.sum(F.col("_n") * _membership(left, k) * _membership(right, k)) / float(k)


def spearman(rows: DataFrame, *, left: str, right: str, keys: list[str]) -> DataFrame:
    """Pearson correlation of mid-ranks per key; null when a side is constant."""
    return ranked_columns(rows, [left, right], keys).groupBy(*keys).agg(
        F.sum("_n").alias("n"), _correlation(left, right).alias("spearman"))


def top_membership(rows: DataFrame, *, value: str, keys: list[str], k: int) -> DataFrame:
    """Membership of each distinct value in the top k."""
    return ranked_columns(rows, [value], keys).select(*keys, value, _membership(value, k).alias("membership"))


def top_overlap(rows: DataFrame, *, left: str, right: str, keys: list[str], k: int = 5) -> DataFrame:
    """Dot product of two fractional top-k memberships, divided by k."""
    return ranked_columns(rows, [left, right], keys).groupBy(*keys).agg(_overlap(left, right, k).alias("overlap"))


# Items whose control values are copied to every task.
MAX_COPIED_ITEMS = 100_000


def variant_metrics(measures: DataFrame, control: DataFrame, *, variant: str, item: str, k: int = 5) -> DataFrame:
    """Spearman and top-k of prediction and of the control vector against each variant's target.

    measures: (variant, item, prediction, target); control: (item, control), one
    value per item. The deltas are variant minus control.
    """
    control = F.broadcast(control) if at_most(control, MAX_COPIED_ITEMS) else control
    ranked = ranked_columns(measures.join(control, item), ["prediction", "target", "control"], [variant])
    return ranked.groupBy(variant).agg(
        _correlation("prediction", "target").alias("spearman"), _correlation("control", "target").alias("control_spearman"),
        _overlap("prediction", "target", k).alias("top_overlap"), _overlap("control", "target", k).alias("control_top_overlap"),
    ).withColumn("delta_spearman", F.col("spearman") - F.col("control_spearman")).withColumn(
        "delta_top_overlap", F.col("top_overlap") - F.col("control_top_overlap"))


def group_summary(per_variant: DataFrame, labels: list[str]) -> DataFrame:
    """Counts, gains, means and medians of variant metrics for all rows and each value of each label."""
    label = F.explode(F.array(F.lit("all"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in labels]))
    paired = F.col("delta_spearman").isNotNull()
    gains = F.when(paired, F.col("delta_spearman"))
    return per_variant.withColumn("group", label).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(paired).alias("defined_spearman_pairs"),
        F.count_if(~paired).alias("undefined_spearman_pairs"),
        F.count_if(gains > 0).alias("positive_spearman_gains"),
        F.count_if(gains < 0).alias("negative_spearman_gains"),
        F.avg(F.when(paired, F.col("spearman"))).alias("mean_spearman"),
        F.avg(F.when(paired, F.col("control_spearman"))).alias("mean_control_spearman"),
        F.avg(gains).alias("mean_delta_spearman"),
        F.avg("top_overlap").alias("mean_top_overlap"),
        F.avg("delta_top_overlap").alias("mean_delta_top_overlap"),
        F.percentile("delta_top_overlap", F.lit(0.5)).alias("median_delta_top_overlap"),
    )


def key_differences(predictions: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only, and repeated prediction keys; empty = full coverage."""
    p = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    t = targets.select(*keys).distinct().withColumn("_t", F.lit(True))
    return p.join(t, keys, "full").select(
        *keys,
        F.when(F.col("_n").isNull(), F.lit("missing_prediction"))
        .when(F.col("_t").isNull(), F.lit("unexpected_prediction"))
        .when(F.col("_n") > 1, F.lit("duplicate_prediction")).alias("problem"),
    ).where("problem is not null")
