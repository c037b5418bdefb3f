"""Quantitative variant data: measurements per motif group, clipping, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import triplet_groups

FLOOR = -5.0
GROUPS = 64


def unpivot_measurements(variants: DataFrame, groups: list[str], key: str = "variant_id") -> DataFrame:
    """Wide variant rows to (variant, pam_group, raw, target, at_or_below_floor); the target is clipped at the floor."""
    long = variants.select(key, *[F.col(g).cast("double").alias(g) for g in groups]).unpivot([key], groups, "pam_group", "raw_log10_k")
    return clip(long)


def clip(measurements: DataFrame) -> DataFrame:
    raw = F.col("raw_log10_k")
    return measurements.withColumn("ranking_target_log10_k", F.greatest(raw, F.lit(FLOOR))).withColumn("at_or_below_floor", raw <= FLOOR)


def variant_profile(measurements: DataFrame, key: str = "variant_id") -> DataFrame:
    """Per variant: measured groups, censored ones, whether its clipped target is constant."""
    return measurements.groupBy(key).agg(
        F.count_distinct("pam_group").alias("groups"), F.count_if("at_or_below_floor").alias("censored"),
        (F.min("ranking_target_log10_k") == F.max("ranking_target_log10_k")).alias("constant_target"),
    )


def measurement_violations(measurements: DataFrame, variants: DataFrame, key: str = "variant_id") -> DataFrame:
    """Broken rules per variant: incomplete or repeated groups, wrong clip, non-finite values, unknown variants."""
    raw, target = F.col("raw_log10_k"), F.col("ranking_target_log10_k")
    known = variants.select(key).distinct().withColumn("_known", F.lit(True))
    good_group = F.coalesce(F.col("pam_group").rlike("^N[ACGT]{3}$"), F.lit(False))
    finite = F.coalesce(~F.isnan(raw) & (F.abs(raw) < float("inf")), F.lit(False))
    per = measurements.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(good_group, F.col("pam_group"))).alias("groups"),
        F.count_if(~finite).alias("bad_values"), F.count_if(finite & (target != F.greatest(raw, F.lit(FLOOR)))).alias("bad_clips"),
        F.count_if(F.col("at_or_below_floor") != (raw <= FLOOR)).alias("bad_flags"),
    )
    joined = per.join(known, key, "full")
    problems = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), F.lit("unknown_variant")), F.when(F.col("rows").isNull(), F.lit("no_measurements")),
        F.when(F.coalesce("groups", F.lit(0)) != GROUPS, F.lit("incomplete_groups")), F.when(F.col("rows") > F.col("groups"), F.lit("repeated_groups")),
        F.when(F.col("bad_values") > 0, F.lit("non_finite_value")), F.when(F.col("bad_clips") > 0, F.lit("wrong_clip")),
        F.when(F.col("bad_flags") > 0, F.lit("wrong_floor_flag")),
    ))
    return joined.select(key, F.explode(problems).alias("problem"))


def expected_groups(variants: DataFrame, key: str = "variant_id") -> DataFrame:
    """Every variant with all 64 groups N + 3-mer."""
    return variants.select(key).distinct().select(key, F.explode(triplet_groups()).alias("pam_group"))


def replay_audit(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions (sequence_sha256, predicted, consensus) against every training label of the same sequence."""
    from ..functions.matrix import flat_cosine

    return predictions.join(labels, "sequence_sha256", "left").withColumn(
        "cosine", flat_cosine(F.flatten("predicted"), F.flatten("label"))
    ).withColumn("consensus_equal", F.col("consensus") == F.col("label_consensus"))


def replay_summary(audit: DataFrame) -> DataFrame:
    """Cosine and consensus statistics overall and by source, in one pass."""
    return audit.where(F.col("source").isNotNull()).rollup("source").agg(
        F.count("cosine").alias("n"), F.avg("cosine").alias("mean_cosine"), F.percentile("cosine", F.lit(0.5)).alias("median_cosine"),
        F.avg(F.col("consensus_equal").cast("double")).alias("exact_consensus_rate"),
        F.count_if(F.col("cosine") < 0.50).alias("below_half"), F.count_if(F.col("cosine") < 0.75).alias("below_three_quarters"),
    )


def model_evaluation(predictions: DataFrame, golds: DataFrame, training: DataFrame) -> DataFrame:
    """Per family: predictions, exact and subset matches against gold motifs, leaked sequences."""
    from ..functions.iupac import is_subset

    seen = training.select("sequence").distinct().withColumn("_seen", F.lit(True))
    rows = predictions.join(golds, "protein_id").join(seen, "sequence", "left")
    per = rows.groupBy("protein_id", "family").agg(
        F.bool_or(F.col("predicted_pam") == F.col("gold_pam")).alias("exact"),
        F.bool_or(is_subset("predicted_pam", "gold_pam")).alias("covered"), F.bool_or(F.col("_seen").isNotNull()).alias("leaked"),
    )
    return per.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"), F.count_if("covered").alias("covered"), F.count_if("leaked").alias("leaked"))
