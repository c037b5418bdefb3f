"""Candidate motifs: generation, protein-channel scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iupac import BASES, normalize_motif, valid_motif
from ..functions.matrix import score_candidate, settled

MAX_CANDIDATES = 100_000


def concrete_motifs(length: Column) -> Column:
    """All 4^length ACGT strings in lexicographic order, from the base-4 digits of a counter."""
    numbers = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4.0), length).cast("long") - 1)
    spell = lambda n: F.translate(F.lpad(F.conv(n.cast("string"), 10, 4), length, F.lit("0")), "0123", BASES)
    return F.transform(numbers, spell)


def concrete_candidates(systems: DataFrame, *, key: str = "system_id", lengths: str = "pam_lengths", limit: int = MAX_CANDIDATES) -> DataFrame:
    """Exhaustive candidates per system: (key, pam_length, candidate_pam). Refuses more than `limit` per system."""
    size = F.aggregate(F.array_distinct(lengths), F.lit(0.0), lambda acc, n: acc + F.pow(F.lit(4.0), n.cast("double")))
    listed = F.when(size <= limit, F.array_distinct(lengths)).otherwise(
        F.raise_error(F.concat(F.lit("candidate set is larger than "), F.lit(str(limit)))).cast("array<int>")
    )
    by_length = systems.select(key, F.explode(listed).alias("pam_length"))
    return by_length.select(key, "pam_length", F.explode(concrete_motifs(F.col("pam_length"))).alias("candidate_pam"))


def triplet_groups() -> Column:
    """The 64 groups N + 3-mer."""
    return F.transform(concrete_motifs(F.lit(3)), lambda m: F.concat(F.lit("N"), m))


def listed_candidates(rows: DataFrame, value: str = "value", order: str = "position") -> DataFrame:
    """First occurrences of valid motifs from a list column; comments and blanks are skipped."""
    return (
        rows.where(~F.trim(F.col(value)).startswith("#") & (F.trim(F.col(value)) != ""))
        .select(normalize_motif(value).alias("candidate_pam"), order)
        .where(valid_motif("candidate_pam"))
        .groupBy("candidate_pam").agg(F.min(order).alias(order))
    )


def score_protein_candidates(candidates: DataFrame, matrices: DataFrame, *, key: str = "system_id") -> DataFrame:
    """Score each candidate against its system's matrix (key, matrix, pam_side) and rank it within its length."""
    scored = (
        candidates.withColumn("candidate_pam", normalize_motif("candidate_pam")).dropDuplicates([key, "candidate_pam"])
        .join(matrices.select(key, "matrix", "pam_side"), key)
        .withColumn("s", score_candidate("matrix", "candidate_pam", F.col("pam_side")))
        .select(
            key, "candidate_pam", F.length("candidate_pam").alias("pam_length"),
            F.col("s.informative_positions").alias("informative_positions"),
            F.col("s.geomean").alias("geometric_mean_probability"),
            F.col("s.score").alias("specificity_adjusted_score"),
            F.col("s.bits").alias("log2_enrichment_bits"),
        )
    )
    return rank_protein_candidates(scored, key)


def rank_protein_candidates(scored: DataFrame, key: str = "system_id") -> DataFrame:
    """Score, then geometric mean, then the motif itself; unscored candidates have no rank.

    Equal sums of other parts differ in their last bits, so scores and logarithms of means are compared in billionths.
    A partition is one system's candidates of one length, at most `MAX_CANDIDATES`.
    """
    unscored = F.col("specificity_adjusted_score").isNull()
    order = Window.partitionBy(key, "pam_length", unscored).orderBy(
        F.desc(settled(F.col("specificity_adjusted_score"))), F.desc(settled(F.ln("geometric_mean_probability"))), "candidate_pam"
    )
    return scored.withColumn("protein_rank", F.when(~unscored, F.row_number().over(order)))
