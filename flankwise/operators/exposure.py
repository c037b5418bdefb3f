"""Leakage and exposure: who was seen before, by exact sequence, neighbour or publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iupac import motifs_overlap

from ..functions.text import normalize_doi


def exact_type(kind: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(kind, F.lit("")), r"\s", "")).isin("II", "TYPEII")


def is_cas9_by_type(kind: Column, family: Column) -> Column:
    """The declared type decides; the family only where the type is blank."""
    blank = F.trim(F.coalesce(kind, F.lit(""))) == ""
    return F.when(blank, F.upper(F.coalesce(family, F.lit(""))).startswith("CAS9")).otherwise(exact_type(kind))


def is_cas9_by_either(kind: Column, family: Column) -> Column:
    return exact_type(kind) | F.upper(F.coalesce(family, F.lit(""))).startswith("CAS9")


def seen_flags(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows with a flag whether their key occurs among the known ones."""
    seen = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, key, "left").withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_seen")


def leaked(rows: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides; a training set must have none."""
    return rows.select(key).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct().join(
        benchmark.select(key).distinct(), key, "left_semi"
    )


def assert_no_leakage(rows: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    n = leaked(rows, benchmark, key).count()
    if n:
        raise ValueError(f"benchmark leakage: {n} exact values of {key} are present in the training data")
    return rows


def net_new_counts(new: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """One row: distinct baseline, new, overlapping and net-new keys."""
    filled = lambda df: df.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()
    sides = filled(baseline).withColumn("_b", F.lit(1)).join(filled(new).withColumn("_n", F.lit(1)), key, "full")
    return sides.agg(
        F.count("_b").alias("baseline"), F.count("_n").alias("new"),
        F.count_if(F.col("_b").isNotNull() & F.col("_n").isNotNull()).alias("overlap"),
        F.count_if(F.col("_b").isNull()).alias("net_new"),
    )


def net_new(new: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    return new.join(baseline.select(key).distinct(), key, "left_anti")


def exposure_class(cas9: Column, exact: Column, max_identity: Column) -> Column:
    return (
        F.when(~cas9, F.lit("not_applicable_non_cas9")).when(exact, F.lit("exact"))
        .when(max_identity >= 0.90, F.lit("near_90")).otherwise(F.lit("below_90"))
    )


def independence_audit(benchmark: DataFrame, official: DataFrame, training: DataFrame, neighbors: DataFrame) -> DataFrame:
    """One row per distinct benchmark sequence with its exposure and whether it is strictly independent.

    benchmark: sequence, crispr_type, cas_family, doi, pam, logo; official and
    training: sequence (and doi, crispr_type, cas_family); neighbors: sequence, max_identity.
    """
    cas9 = is_cas9_by_type(F.col("crispr_type"), F.col("cas_family"))
    known = official.where(is_cas9_by_type(F.col("crispr_type"), F.col("cas_family"))).select("sequence").distinct().withColumn("_exact", F.lit(True))
    tuned = training.select("sequence").distinct().withColumn("_tuned", F.lit(True))
    dois = training.select(normalize_doi("doi").alias("_doi")).where(F.col("_doi") != "").distinct().withColumn("_shared", F.lit(True))
    rows = benchmark.withColumn("_doi", normalize_doi("doi")).join(dois, "_doi", "left")
    grouped = rows.groupBy("sequence").agg(
        F.bool_or(cas9).alias("cas9"),
        F.count(F.lit(1)).alias("observation_rows"),
        F.count_distinct(F.upper(F.trim(F.coalesce("pam", F.lit(""))))).alias("unique_pams"),
        F.count_if(F.trim(F.coalesce("logo", F.lit(""))) != "").alias("logo_observation_rows"),
        F.count_distinct(F.when(F.col("_shared"), F.col("_doi"))).alias("shared_dois"),
    )
    joined = grouped.join(known, "sequence", "left").join(tuned, "sequence", "left").join(
        neighbors.groupBy("sequence").agg(F.max("max_identity").alias("max_identity")), "sequence", "left"
    )
    identity = F.when(F.col("cas9"), F.coalesce("max_identity", F.lit(0.0)))
    joined = joined.withColumn("exposure", exposure_class(F.col("cas9"), F.col("_exact").isNotNull(), F.coalesce(identity, F.lit(0.0))))
    strict = F.col("cas9") & (F.col("exposure") == "below_90") & F.col("_tuned").isNull() & (F.col("shared_dois") == 0)
    return joined.select(
        "sequence", "cas9", "observation_rows", "unique_pams", "logo_observation_rows", "exposure",
        identity.alias("max_identity"), F.col("_tuned").isNotNull().alias("finetune_overlap"), "shared_dois",
        strict.alias("strictly_independent"), (strict & (F.col("logo_observation_rows") > 0)).alias("strictly_independent_with_logo"),
    )


def independence_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("exposure").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("observation_rows").alias("observations"),
        F.count_if("finetune_overlap").alias("finetune_overlap"), F.count_if(F.col("shared_dois") > 0).alias("doi_overlap"),
        F.count_if("strictly_independent").alias("strictly_independent"),
    )


def admission_decision(exact: Column, near: Column, linked: Column, exposed: Column) -> Column:
    """Ordered reasons against a candidate; the first that holds names the decision."""
    return (
        F.when(exact, F.lit("EXCLUDE_OFFICIAL_EXACT")).when(near, F.lit("EXCLUDE_OFFICIAL_NEAR90"))
        .when(~linked, F.lit("BLOCKED_EXACT_SEQUENCE_LINK")).when(exposed, F.lit("RESERVE_PROJECT_TRAINING_EXPOSURE"))
        .otherwise(F.lit("REGISTER_STRICT_PROTEIN_ONLY"))
    )


def failure_mode(labels: Column, replay_cosine: Column, label_gold_overlap: Column, protein_rank: Column, spacer_rank: Column) -> Column:
    """Ordered diagnosis of one benchmark system."""
    return (
        F.when(labels == 0, F.lit("no_exact_training_label"))
        .when(replay_cosine < 0.50, F.lit("checkpoint_replay_failure"))
        .when(~label_gold_overlap, F.lit("training_label_vs_experimental_gold_mismatch"))
        .when(replay_cosine < 0.75, F.lit("weak_checkpoint_replay"))
        .when((protein_rank > 5) & (spacer_rank <= 5), F.lit("protein_ranking_failure_despite_label_alignment"))
        .otherwise(F.lit("no_primary_failure_detected"))
    )


def best_rank(ranks: DataFrame, method: str, name: str, keys: list[str] = ["system_id"]) -> DataFrame:
    """Best gold rank over all motif lengths of one method, null without any."""
    return ranks.where(F.col("method") == method).groupBy(*keys).agg(F.min("gold_rank").alias(name))


def failure_lookup(systems: DataFrame, golds: DataFrame, ranks: DataFrame, replay: DataFrame, keys: list[str] = ["system_id"]) -> DataFrame:
    """Diagnosis of every benchmark system from its registry, its ranks and the replay of its training labels.

    systems: (keys); golds: (keys, gold_pam); ranks: (keys, method, gold_rank); replay: (keys, label, cosine), a label per row, none for
    systems without training label. A label agrees when it overlaps any gold motif of the system.
    """
    labels = replay.where(F.col("label").isNotNull()).groupBy(*keys).agg(
        F.count_distinct("label").alias("training_labels"), F.max("cosine").alias("best_replay_cosine"))
    pairs = replay.select(*keys, "label").distinct().join(golds.select(*keys, "gold_pam").distinct(), keys)
    overlap = pairs.groupBy(*keys).agg(F.bool_or(F.coalesce(motifs_overlap("label", "gold_pam"), F.lit(False))).alias("label_gold_overlap"))
    joined = systems.select(*keys).distinct()
    for side in (labels, overlap, best_rank(ranks, "protein_only", "protein_rank", keys), best_rank(ranks, "spacer_only", "spacer_rank", keys)):
        joined = joined.join(side, keys, "left")
    joined = joined.withColumn("training_labels", F.coalesce("training_labels", F.lit(0))).withColumn(
        "label_gold_overlap", F.coalesce("label_gold_overlap", F.lit(False)))
    mode = failure_mode(F.col("training_labels"), F.col("best_replay_cosine"), F.col("label_gold_overlap"), F.col("protein_rank"), F.col("spacer_rank"))
    return joined.withColumn("failure_mode", mode)


def exposure_files(corpora: DataFrame, wanted: DataFrame) -> DataFrame:
    """Corpus files in which a wanted sequence or accession occurs: (wanted_id, files, rows).

    corpora: file, sequence, accession; wanted: wanted_id, sequence, accession.
    """
    by_sequence = wanted.where(F.coalesce("sequence", F.lit("")) != "").select("wanted_id", "sequence").join(
        corpora.select("sequence", "file", "row_id"), "sequence"
    ).drop("sequence")
    by_accession = wanted.where(F.coalesce("accession", F.lit("")) != "").select("wanted_id", "accession").join(
        corpora.select("accession", "file", "row_id"), "accession"
    ).drop("accession")
    found = by_sequence.unionByName(by_accession).distinct()
    return found.groupBy("wanted_id").agg(
        F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("rows")
    )
