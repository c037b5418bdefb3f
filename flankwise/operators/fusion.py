"""Late fusion of the protein and the spacer channel: joined, never averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iupac import chars, normalize_motif
from ..functions.matrix import settled
from ..session import materialize

POLICIES = ("abstain", "spacer_fallback", "legacy")
SUPPORT_ABOVE = 60.0
CONFLICT_BELOW = 40.0
TIE = 1e-12


def evidence_state(score: Column) -> Column:
    return F.when(score > SUPPORT_ABOVE, F.lit("support")).when(score < CONFLICT_BELOW, F.lit("conflict")).otherwise(
        F.lit("neutral")
    )


def evidence_assessment(protein: Column, spacer: Column, spacers: Column, targets: Column) -> Column:
    """struct(status, priority): a triage label, not a probability."""
    p, s = evidence_state(protein), evidence_state(spacer)
    independent = (F.coalesce(spacers, F.lit(0)) >= 2) & (F.coalesce(targets, F.lit(0)) >= 2)
    both = lambda state: (p == state) & (s == state)
    opposed = (p != s) & (p != "neutral") & (s != "neutral")
    cases = [
        (protein.isNull() & spacer.isNull(), F.lit("no_scored_evidence"), "insufficient_evidence"),
        (spacer.isNull(), F.lit("protein_only_unverified"), "needs_spacer_evidence"),
        (protein.isNull(), F.lit("spacer_only_unverified"), "needs_protein_evidence"),
        (both("support") & independent, F.lit("concordant_support"), "high_priority"),
        (both("support"), F.lit("concordant_support_limited_independence"), "medium_priority"),
        (both("conflict"), F.lit("concordant_conflict"), "low_priority"),
        (opposed, F.concat(F.lit("discordant_"), p, F.lit("_protein_"), s, F.lit("_spacer")), "manual_review"),
    ]
    status = priority = None
    for condition, label, rank in cases:
        status = F.when(condition, label) if status is None else status.when(condition, label)
        priority = F.when(condition, F.lit(rank)) if priority is None else priority.when(condition, F.lit(rank))
    return F.struct(
        status.otherwise(F.concat(F.lit("protein_"), p, F.lit("_spacer_"), s)).alias("status"),
        priority.otherwise(F.lit("uncertain")).alias("priority"),
    )


def spacer_column_names(protein_columns: list[str], spacer_columns: list[str], keys: list[str]) -> dict[str, str]:
    """Renaming of spacer columns beside the protein ones: spacer_ prefix, spacer_source_ on a clash."""
    names = {}
    taken = set(protein_columns)
    for name in spacer_columns:
        if name in keys or name == "candidate_pam":
            continue
        target = name if name.startswith("spacer_") else f"spacer_{name}"
        names[name] = f"spacer_source_{name}" if target in taken else target
    return names


def fuse(
    protein: DataFrame, spacer: DataFrame, *, keys: list[str] = ["system_id"], policy: str = "abstain",
) -> DataFrame:
    """Left join of the spacer channel onto the protein rows, then status and gate.

    A motif that the spacer side holds twice for one key is an error. The joined
    table is stored once, since the gate reads it along several branches; so are the gates, a row per key and length.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    names = spacer_column_names(protein.columns, spacer.columns, keys)
    right = spacer.withColumn("candidate_pam", normalize_motif("candidate_pam")).where(F.col("candidate_pam") != "")
    right = right.groupBy(*keys, "candidate_pam").agg(
        F.count(F.lit(1)).alias("_copies"), *[F.any_value(old).alias(new) for old, new in names.items()]
    )
    twice = F.concat(F.lit("duplicate spacer evidence for candidate "), F.col("candidate_pam"))
    right = right.withColumn(
        "_copies", F.when(F.col("_copies") == 1, F.lit(1)).otherwise(F.raise_error(twice).cast("int"))
    )
    left = protein.withColumn("candidate_pam", normalize_motif("candidate_pam")).where(F.col("candidate_pam") != "")
    fused = left.join(right, [*keys, "candidate_pam"], "left").where("_copies is null or _copies = 1").drop("_copies")
    count = lambda name: F.col(name) if name in fused.columns else F.lit(0)
    fused = fused.withColumn(
        "_a",
        evidence_assessment(
            F.col("specificity_adjusted_score"), F.col("spacer_evidence_score"),
            count("spacer_support_spacer_count"), count("spacer_support_target_count"),
        ),
    )
    fused = fused.withColumn("evidence_status", F.col("_a.status")).withColumn("evidence_priority", F.col("_a.priority")).drop("_a")
    fused = materialize(fused.withColumn("pam_length", F.length("candidate_pam")))
    return fused.join(materialize(fusion_gate(fused, keys=keys, policy=policy)), [*keys, "pam_length"])


def top_candidates(rows: DataFrame, score: str, keys: list[str], candidate: str = "candidate_pam") -> DataFrame:
    """Every candidate within 1e-12 of the best score of its group (a candidate list of one length)."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return rows.select(*keys, candidate, score, best.alias("_best")).where(
        F.abs(F.col(score) - F.col("_best")) <= TIE
    ).select(*keys, candidate)


def blanked(tops: DataFrame, text: str, most: int) -> DataFrame:
    """One row per top and choice of 1 to max(1, length / 4) positions: `masked` has them blanked."""
    rows = tops.withColumn("masked", F.col(text)).withColumn("_last", F.lit(0))
    steps = []
    for step in range(1, most + 1):
        rows = rows.where((step <= tolerance()) & (F.col("_last") < F.col("pam_length"))).withColumn(
            "_last", F.explode(F.sequence(F.col("_last") + 1, F.col("pam_length")))
        ).withColumn("masked", F.overlay("masked", F.lit("."), F.col("_last"), F.lit(1)))
        steps.append(rows.drop("_last"))
    out = steps[0]
    for rows in steps[1:]:
        out = out.unionByName(rows)
    return out


def tolerance() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("pam_length") / 4).cast("int"))


def top_distances(fused: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest Hamming distance between the two top sets, where it is within max(1, length / 4).

    Letters are compared as they stand, of all 15 symbols. A shared top is distance 0; only groups without
    one go on, by equal texts with a few positions blanked. Tops of the smaller set (of equal ones the
    protein's) may turn into plain bases only. No row = nothing within the tolerance.
    """
    group = [*keys, "pam_length"]
    protein = top_candidates(fused, "specificity_adjusted_score", group).withColumnRenamed("candidate_pam", "query")
    spacer = top_candidates(fused, "spacer_evidence_score", group).withColumnRenamed("candidate_pam", "window")
    shared = protein.join(spacer.withColumnRenamed("window", "query"), [*group, "query"], "left_semi").select(*group).distinct()
    sizes = protein.groupBy(*group).agg(F.count(F.lit(1)).alias("_left")).join(
        spacer.groupBy(*group).agg(F.count(F.lit(1)).alias("_right")), group
    ).join(shared, group, "left_anti").select(*group, (F.col("_left") <= F.col("_right")).alias("_from_protein"))
    longest = fused.agg(F.max("pam_length")).first()[0] or 1
    most = max(1, longest // 4)
    left = blanked(protein.join(sizes, group), "query", most)
    right = blanked(spacer.join(sizes.select(*group), group), "window", most)
    letters = F.arrays_zip(chars("query").alias("a"), chars("window").alias("b"))
    differing = F.filter(letters, lambda x: x["a"] != x["b"])
    plain = F.forall("_differing", lambda x: F.when(F.col("_from_protein"), x["b"]).otherwise(x["a"]).isin("A", "C", "G", "T"))
    near = left.join(right, [*group, "masked"]).withColumn("_differing", differing).where(plain).groupBy(*group).agg(
        F.min(F.size("_differing")).alias("top_distance"))
    return shared.withColumn("top_distance", F.lit(0)).unionByName(near)


def fusion_gate(
    fused: DataFrame, *, keys: list[str] = ["system_id"], policy: str = "abstain"
) -> DataFrame:
    """One gate per (keys, pam_length): do the channels' top sets agree, and what follows if not."""
    group = [*keys, "pam_length"]
    present = fused.groupBy(*group).agg(
        F.count("specificity_adjusted_score").alias("_p"), F.count("spacer_evidence_score").alias("_s")
    )
    missing = (F.col("_p") == 0) | (F.col("_s") == 0)
    if policy == "legacy":
        gates = present.withColumn("top_distance", F.lit(None).cast("int"))
        gate = F.when(missing, F.lit("abstain_missing_scored_source")).otherwise(F.lit("legacy_joint_ranking"))
    else:
        gates = present.join(top_distances(fused, keys), group, "left")
        other = "spacer_fallback_severe_top_disagreement" if policy == "spacer_fallback" else "abstain_severe_top_disagreement"
        gate = (
            F.when(missing, F.lit("abstain_missing_scored_source"))
            .when(F.col("top_distance").isNotNull(), F.lit("joint_ranking_top_agreement"))
            .otherwise(F.lit(other))
        )
    return gates.select(
        *group, gate.alias("fusion_gate"), tolerance().alias("fusion_top_hamming_tolerance"),
        F.when(~missing, F.col("top_distance")).alias("fusion_top_distance_within_tolerance"),
    )


def fusion_rank_score(protein: Column, spacer: Column, gate: Column) -> Column:
    """Rank key of a fused row: null when abstaining, the spacer score on fallback, else class, min, max."""
    p, s = evidence_state(protein), evidence_state(spacer)
    pair = F.concat_ws(",", F.array_sort(F.array(p, s)))
    # Order of the state pairs, best first.
    order = {
        "support,support": 5.0, "neutral,support": 4.0, "neutral,neutral": 3.0,
        "conflict,support": 2.0, "conflict,neutral": 1.0, "conflict,conflict": 0.0,
    }
    level = F.lit(None).cast("double")
    for name, value in order.items():
        level = F.when(pair == name, F.lit(value)).otherwise(level)
    return (
        F.when(protein.isNull() | spacer.isNull() | gate.startswith("abstain"), F.lit(None).cast("double"))
        .when(gate.startswith("spacer_fallback"), spacer)
        .otherwise(level * 1e6 + F.least(protein, spacer) * 1e3 + F.greatest(protein, spacer))
    )


def slim_fusion(protein: DataFrame, spacer: DataFrame, *, keys: list[str] = ["system_id"], order: str = "row_order") -> DataFrame:
    """Left join with twelve named columns; of duplicate spacer motifs the one latest in `order` wins."""
    kept = ["spacer_evidence_score", "spacer_rank", "log2_enrichment", "support_spacer_count",
            "support_target_count", "support_alignment_count", "evidence_kind"]
    latest = spacer.withColumn("candidate_pam", normalize_motif("candidate_pam")).groupBy(*keys, "candidate_pam").agg(
        F.max_by(F.struct(*kept), order).alias("s")
    )
    joined = protein.withColumn("candidate_pam", normalize_motif("candidate_pam")).join(latest, [*keys, "candidate_pam"], "left")
    count = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(0)).alias(name)
    return joined.withColumn("a", evidence_assessment(
        F.col("specificity_adjusted_score"), F.col("s.spacer_evidence_score"),
        F.col("s.support_spacer_count"), F.col("s.support_target_count"),
    )).select(
        *keys, "candidate_pam",
        F.col("specificity_adjusted_score").alias("protein_score"), "protein_rank",
        F.col("s.spacer_evidence_score").alias("spacer_score"), F.col("s.spacer_rank").alias("spacer_rank"),
        F.col("s.log2_enrichment").alias("spacer_log2_enrichment"),
        count("support_spacer_count"), count("support_target_count"), count("support_alignment_count"),
        F.coalesce("s.evidence_kind", F.lit("")).alias("evidence_kind"),
        F.col("a.status").alias("evidence_status"), F.col("a.priority").alias("evidence_priority"),
    )


# Presentation labels of a report row.
REPORT_LABELS = {
    "protein_only": "仅蛋白预测；未提供 spacer 证据",
    "orientation_warning": "方向警告；暂停解释 spacer 支持",
    "few_spacers": "spacer 证据不足（少于 2 条有效 spacer）",
    "insufficient": "证据不足",
    "conflict": "证据冲突；需人工复核",
    "both_support": "两路均支持（非独立验证）",
    "neutral": "中性或未获两路共同支持",
}


def report_status(protein: Column, spacer: Column, has_spacer: Column, effective_spacers: Column, warning: Column) -> Column:
    """Presentation label of one candidate in a report."""
    p, s = evidence_state(protein), evidence_state(spacer)
    label = {name: F.lit(text) for name, text in REPORT_LABELS.items()}
    return (
        F.when(~has_spacer, label["protein_only"])
        .when(warning, label["orientation_warning"])
        .when(F.coalesce(effective_spacers, F.lit(0)) < 2, label["few_spacers"])
        .when(protein.isNull() | spacer.isNull(), label["insufficient"])
        .when(((p == "support") & (s == "conflict")) | ((s == "support") & (p == "conflict")), label["conflict"])
        .when((p == "support") & (s == "support"), label["both_support"])
        .otherwise(label["neutral"])
    )


def report_candidates(protein: DataFrame, spacer: DataFrame | None, *, keys: list[str] = ["system_id"], orientation_warning: Column | None = None) -> DataFrame:
    """Report row of every protein candidate: both scores, rank, spacer support and the presentation label.

    protein: (keys, candidate_pam, specificity_adjusted_score, protein_rank); spacer: the scored spacer candidates of the same
    keys, or None where none were supplied; candidates without a spacer row have no spacer values.
    """
    rows = protein.select(*keys, "candidate_pam", F.col("specificity_adjusted_score").alias("protein_score"), F.col("protein_rank").alias("rank_within_length"))
    names = {"spacer_evidence_score": "spacer_score", "effective_spacer_count": "effective_spacers", "support_spacer_count": "support_spacers",
             "support_target_count": "support_target_contigs"}
    if spacer is None:
        types = {"spacer_score": "double"}
        rows = rows.select("*", *[F.lit(None).cast(types.get(n, "bigint")).alias(n) for n in names.values()], F.lit(False).alias("_has"))
    else:
        found = spacer.select(*keys, "candidate_pam", *[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("_has"))
        rows = rows.join(found, [*keys, "candidate_pam"], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    warning = F.lit(False) if orientation_warning is None else orientation_warning
    return rows.withColumn("status", report_status(
        F.col("protein_score"), F.col("spacer_score"), F.col("_has"), F.col("effective_spacers"), warning)).drop("_has")


def ranking_list(rows: DataFrame, score: str, keys: list[str] = ["system_id"]) -> DataFrame:
    """Place of every candidate of a key: score, then motif. A missing score ranks as the best one."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(score), "candidate_pam")
    return rows.withColumn("place", F.row_number().over(order))


def interpretation(slim: DataFrame, golds: DataFrame, *, keys: list[str] = ["system_id"]) -> DataFrame:
    """Per key: the two tops, whether they agree, and how candidates and golds fall by status."""
    first = lambda score: F.min_by("candidate_pam", F.struct(-F.coalesce(score, F.lit(1e9)), F.col("candidate_pam")))
    gold = golds.select(*keys, normalize_motif("gold_pam").alias("candidate_pam")).distinct().withColumn("_gold", F.lit(True))
    status = F.col("evidence_status")
    conflict = status.startswith("discordant_") | (status == "concordant_conflict")
    return slim.join(gold, [*keys, "candidate_pam"], "left").groupBy(*keys).agg(
        first(settled(F.col("protein_score")) / 1e9).alias("protein_top"),
        first(F.col("spacer_score")).alias("spacer_top"),
        F.count_if(F.col("_gold") & (status == "concordant_support")).alias("gold_with_concordant_support"),
        F.count_if(conflict).alias("conflicting_candidates"),
        F.count_if(status.endswith("neutral")).alias("neutral_candidates"),
    ).withColumn("agree_on_top", F.col("protein_top") == F.col("spacer_top"))
