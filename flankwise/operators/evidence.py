"""From flanks of matches to weighted evidence for motif candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import flank_motif, normalize_dna, random_bases, reverse_complement, shuffled_letters
from ..functions.iupac import BASES, masks, valid_motif
from ..functions.matrix import TINY, probability_consensus, row_bits, total
from ..session import materialize
from .matching import motif_match_join, spacer_hits

PRIOR_STRENGTH = 2.0
MIN_EFFECTIVE_SPACERS = 5
ORIENTATION_FACTOR = 1.25
SPACER_ORDER = ["spacer_evidence_score", "support_spacer_count", "support_target_count"]


def background_frequencies(targets: DataFrame, sequence: str = "target_sequence", keys: list[str] = []) -> DataFrame:
    """Base shares (keys, a, c, g, t) over all targets of a key; null without any base."""
    counts = [
        F.sum(F.length(sequence) - F.length(F.replace(F.col(sequence), F.lit(b), F.lit("")))).alias(b) for b in BASES
    ]
    whole = sum((F.col(b) for b in BASES), F.lit(0))
    return targets.groupBy(*keys).agg(*counts).select(
        *keys, *[F.try_divide(F.col(b).cast("double"), whole).alias(b.lower()) for b in BASES]
    )


def background_probability(motif: Column | str, frequencies: list[Column]) -> Column:
    """Product over the symbols of their summed base frequencies."""
    mass = lambda m: sum(
        (F.when(m.bitwiseAND(F.lit(1 << i)) > 0, f).otherwise(F.lit(0.0)) for i, f in enumerate(frequencies)), F.lit(0.0)
    )
    return F.aggregate(F.transform(masks(motif), mass), F.lit(1.0), lambda acc, p: acc * p)


def eligible_flanks(hits: DataFrame, *, side: str, lengths: list[int], keys: list[str] = []) -> DataFrame:
    """Hits with a usable flank, one row per motif length: (keys, length, motif, spacer, target, weight)."""
    motif = F.col("motif")
    return (
        hits.select(
            *keys, "spacer_sequence", "target_id", "orientation_weight",
            F.explode(F.array(*[
                F.struct(F.lit(n).alias("motif_length"), flank_motif("upstream_flank", "downstream_flank", side, n).alias("motif"))
                for n in lengths
            ])).alias("x"),
        )
        .select(*keys, "spacer_sequence", "target_id", "orientation_weight", "x.motif_length", "x.motif")
        .where(motif.isNotNull())
    )


def spacer_weights(flanks: DataFrame, keys: list[str] = []) -> DataFrame:
    """Weight per (spacer, motif); the weights of one spacer and length add up to 1.

    Alignments are summed per (spacer, motif) before anything is compared, so a
    spacer with very many hits has at most 4^length rows left.
    """
    group = [*keys, "motif_length", "spacer_sequence"]
    per_motif = flanks.groupBy(*group, "motif").agg(
        F.sum("orientation_weight").alias("raw_weight"), F.count(F.lit(1)).alias("alignments")
    )
    whole = Window.partitionBy(*group)
    return per_motif.withColumn("weight", F.col("raw_weight") / F.sum("raw_weight").over(whole))


def score_spacer_candidates(
    flanks: DataFrame,
    candidates: DataFrame,
    background: DataFrame,
    *,
    keys: list[str] = [],
    prior_strength: float = PRIOR_STRENGTH,
    minimum_spacers: int = 0,
) -> DataFrame:
    """Evidence per candidate motif from the output of `eligible_flanks`.

    candidates: (keys, candidate_pam); background: (keys, a, c, g, t), one row
    per key. With fewer effective spacers than `minimum_spacers` nothing is
    scored. Unscored candidates keep null scores and no rank.
    """
    group = [*keys, "motif_length"]
    weights = spacer_weights(flanks, keys)
    if minimum_spacers:
        enough = weights.groupBy(*group).agg(F.count_distinct("spacer_sequence").alias("n")).where(F.col("n") >= minimum_spacers)
        flanks = flanks.join(enough.drop("n"), group, "left_semi")
        weights = weights.join(enough.drop("n"), group, "left_semi")
    # One row per (motif, spacer) and one per (motif, target): both counts come from a single join.
    seen = flanks.select(*group, "motif", "target_id").distinct()
    observed = weights.select(*group, "motif", "spacer_sequence", "weight", "alignments").unionByName(seen, allowMissingColumns=True)
    effective = observed.groupBy(*group).agg(
        F.count_distinct("spacer_sequence").alias("effective_spacer_count"),
        F.count_distinct("target_id").alias("eligible_target_count"),
        F.sum("alignments").alias("eligible_alignment_count"),
    )
    listed = candidates.where(valid_motif("candidate_pam")).select(
        *keys, F.upper(F.trim("candidate_pam")).alias("candidate_pam")
    ).distinct().withColumn("motif_length", F.length("candidate_pam"))
    spelled = motif_match_join(flanks.select("motif"), listed, "motif", "candidate_pam")
    supported = listed.join(spelled, "candidate_pam").join(observed, [*group, "motif"]).groupBy(*group, "candidate_pam").agg(
        # Rounded far below any real difference, so that ranks do not depend on the order of addition.
        F.round(F.sum("weight"), 12).alias("support"),
        F.count_distinct("spacer_sequence").alias("support_spacer_count"),
        F.sum("alignments").alias("support_alignment_count"),
        F.count_distinct("target_id").alias("support_target_count"),
    )
    scored = listed.join(supported, [*group, "candidate_pam"], "left").join(effective, group, "left").fillna(
        0, ["support", "support_spacer_count", "support_alignment_count", "support_target_count",
            "effective_spacer_count", "eligible_target_count", "eligible_alignment_count"])
    if keys:
        scored = scored.join(background, keys)
    else:
        # One row of four numbers, read once as a scalar subquery.
        scored = scored.withColumn("_bg", background.select(F.struct("a", "c", "g", "t")).scalar()).select("*", "_bg.*").drop("_bg")
    q = background_probability("candidate_pam", [F.col(b) for b in "acgt"])
    return rank_spacer_candidates(_evidence_columns(scored.withColumn("background_probability", q), prior_strength), keys)


def _evidence_columns(scored: DataFrame, prior_strength: float) -> DataFrame:
    w, s, q = F.col("effective_spacer_count"), F.col("support"), F.col("background_probability")
    alpha = F.lit(float(prior_strength))
    informative = F.col("candidate_pam").rlike("[^N]")
    p = F.when((w > 0) & informative, (s + alpha * q) / (w + alpha))
    scored = scored.withColumn("empirical_support", F.when(w > 0, s / w)).withColumn("posterior_support", p)
    p = F.col("posterior_support")
    shift = F.when(p >= q, F.when(q < 1, (p - q) / (1.0 - q)).otherwise(0.0)).otherwise(
        F.when(q > 0, (p - q) / q).otherwise(0.0)
    )
    return scored.withColumn("spacer_evidence_score", F.when(p.isNotNull(), 50.0 * (shift + 1.0))).withColumn(
        "log2_enrichment", F.log2(F.greatest(p, F.lit(TINY)) / F.greatest(q, F.lit(TINY)))
    ).withColumn("log2_enrichment", F.when(p.isNotNull(), F.col("log2_enrichment")))


def rank_spacer_candidates(scored: DataFrame, keys: list[str] = []) -> DataFrame:
    """Ranks within one motif length, over scored rows only.

    A partition is one candidate list of one length, which is bounded by 4^length.
    """
    order = Window.partitionBy(*keys, "motif_length", F.col("spacer_evidence_score").isNull()).orderBy(
        *[F.desc(c) for c in SPACER_ORDER], "candidate_pam"
    )
    return scored.withColumn(
        "spacer_rank", F.when(F.col("spacer_evidence_score").isNotNull(), F.row_number().over(order))
    )


def flank_probability_matrix(flanks: DataFrame, keys: list[str] = []) -> DataFrame:
    """Spacer-weighted base distribution per flank position: (keys, motif_length, position, A, C, G, T)."""
    group = [*keys, "motif_length"]
    per_motif = spacer_weights(flanks, keys).groupBy(*group, "motif").agg(F.sum("weight").alias("weight"))
    return _base_shares(per_motif, group, "weight")


def _base_shares(per_motif: DataFrame, group: list[str], weight: str) -> DataFrame:
    placed = per_motif.select(*group, weight, F.posexplode(F.split("motif", "")).alias("position", "base"))
    sums = placed.groupBy(*group, "position").agg(*[
        F.sum(F.when(F.col("base") == b, F.col(weight)).otherwise(0.0)).alias(b) for b in BASES
    ])
    whole = sum((F.col(b) for b in BASES), F.lit(0.0))
    return sums.select(
        *group, (F.col("position") + 1).cast("long").alias("position"),
        *[F.coalesce(F.try_divide(F.col(b), whole), F.lit(0.25)).alias(b) for b in BASES],
    )


def side_information(flanks: DataFrame, keys: list[str] = []) -> DataFrame:
    """Unweighted view of one side: flank count, consensus, bits per position and their sum."""
    group = [*keys, "motif_length"]
    per_motif = flanks.groupBy(*group, "motif").agg(F.count(F.lit(1)).cast("double").alias("n"))
    shares = _base_shares(per_motif, group, "n").withColumn("row", F.array(*BASES))
    # At most ten positions per group are gathered.
    rows = shares.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("position", "row"))).alias("rows"))
    rows = rows.withColumn("matrix", F.transform("rows", lambda r: r["row"])).withColumn(
        "information_bits", F.transform("matrix", row_bits)
    )
    totals = per_motif.groupBy(*group).agg(F.sum("n").cast("long").alias("effective_flanks"))
    return rows.join(totals, group).select(
        *group, "effective_flanks", "information_bits",
        probability_consensus("matrix").alias("consensus"),
        total(F.col("information_bits")).alias("information_sum"),
    )


def motif_histogram(flanks: DataFrame, keys: list[str] = []) -> DataFrame:
    return flanks.groupBy(*keys, "motif_length", "motif").agg(F.count(F.lit(1)).alias("n"))


def orientation_warning(up_bits: Column, down_bits: Column, side: str) -> Column:
    """The other side carries the signal and exceeds the declared one by more than a quarter."""
    signal = F.when(up_bits >= down_bits, F.lit("upstream")).otherwise(F.lit("downstream"))
    declared, other = (up_bits, down_bits) if side == "upstream" else (down_bits, up_bits)
    return (signal != side) & (other > ORIENTATION_FACTOR * declared)


def best_hit_per_spacer(hits: DataFrame, *, side: str, length: int) -> DataFrame:
    """The first hit of lowest mismatch count per spacer, in (target, start, strand) order."""
    detail = F.struct(
        "mismatches", "target_id", "start", "strand", "spacer_sequence", "protospacer",
        F.substring("upstream_flank", 1, length).alias("upstream_flank"),
        F.substring("downstream_flank", 1, length).alias("downstream_flank"),
        F.coalesce(flank_motif("upstream_flank", "downstream_flank", side, length), F.lit("")).alias("pam"),
        "orientation_weight",
    )
    best = hits.groupBy("spacer_id").agg(F.min(detail).alias("hit")).select("spacer_id", "hit.*")
    available = (F.col("pam") != "").cast("int")
    return best.withColumn("flank_available", available).withColumn(
        "note", F.when(available == 1, F.lit("")).otherwise(F.lit("contig boundary: requested PAM-side flank unavailable"))
    )


def contig_consensus(rows: DataFrame, order: str = "spacer_id") -> DataFrame:
    """Most frequent motif per target; among equals the one seen first in `order`."""
    counts = rows.where((F.col("pam") != "") & (F.col("target_id").cast("string") != "")).groupBy("target_id", "pam").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")
    )
    return counts.groupBy("target_id").agg(
        F.min_by("pam", F.struct(-F.col("n"), "first_seen")).alias("consensus_pam"),
        F.sum("n").alias("spacers"),
    )


XGG = ["AGG", "CGG", "GGG", "TGG"]


def contig_collapse(rows: DataFrame, motifs: list[str] = XGG) -> DataFrame:
    """Contig-level support; the denominator is the number of contigs."""
    per_target = contig_consensus(rows)
    return per_target.agg(
        F.count(F.lit(1)).alias("target_contigs"),
        F.count_distinct("consensus_pam").alias("consensus_types"),
        F.count_if(F.col("consensus_pam").isin(motifs)).alias("contigs_in_set"),
        F.coalesce(F.avg(F.col("consensus_pam").isin(motifs).cast("double")), F.lit(0.0)).alias("contig_fraction"),
        F.coalesce(F.max("spacers"), F.lit(0)).alias("max_spacers_on_one_contig"),
    )


def busiest_contigs(rows: DataFrame, limit: int = 5) -> DataFrame:
    return contig_consensus(rows).orderBy(F.desc("spacers"), "target_id").limit(limit).select("target_id", "spacers")


def membership_fractions(hits: DataFrame, *, side: str, length: int, motifs: list[str] = XGG) -> DataFrame:
    """Share of motifs in the set at hit, spacer (best hit) and contig level."""
    inside = lambda c: F.avg(F.col(c).isin(motifs).cast("double"))
    by_hit = hits.select(flank_motif("upstream_flank", "downstream_flank", side, length).alias("pam")).where(
        F.col("pam").isNotNull()
    ).agg(F.count(F.lit(1)).alias("n"), inside("pam").alias("fraction")).withColumn("grain", F.lit("hit"))
    best = best_hit_per_spacer(hits, side=side, length=length).where("flank_available = 1")
    by_spacer = best.agg(F.count(F.lit(1)).alias("n"), inside("pam").alias("fraction")).withColumn("grain", F.lit("spacer"))
    by_contig = contig_consensus(best).agg(
        F.count(F.lit(1)).alias("n"), inside("consensus_pam").alias("fraction")
    ).withColumn("grain", F.lit("contig"))
    return by_hit.unionByName(by_spacer).unionByName(by_contig).select("grain", "n", "fraction")


def published_flank_split(rows: DataFrame, spacers: DataFrame, *, side: str) -> DataFrame:
    """Check flank rows against their spacers and mark each as used, excluded, no_hit or an error."""
    spacers = spacers.select(F.col("spacer_id"), F.col("spacer_sequence").alias("_known"))
    flank = F.col("oriented_upstream_flank" if side == "upstream" else "oriented_downstream_flank")
    joined = rows.join(spacers, "spacer_id", "left")
    status = (
        F.when(F.col("_known").isNull(), F.lit("error_unknown_spacer"))
        .when(F.col("_known") != normalize_dna("oriented_spacer"), F.lit("error_sequence_differs"))
        .when(~F.col("hit").isin("0", "1"), F.lit("error_hit_flag"))
        .when(F.col("hit") == "0", F.lit("no_hit"))
        .when(F.coalesce(normalize_dna(flank), F.lit("")) == "", F.lit("excluded_no_flank"))
        .otherwise(F.lit("used"))
    )
    return joined.withColumn("flank_status", status).drop("_known")


def published_hits(split: DataFrame) -> DataFrame:
    """Used flank rows in hit form. Each row is one aggregate record; its target count is unknown."""
    source = F.coalesce("source_row_id", "spacer_id") if "source_row_id" in split.columns else F.col("spacer_id")
    return split.where(F.col("flank_status") == "used").select(
        "spacer_id",
        normalize_dna("oriented_spacer").alias("spacer_sequence"),
        F.concat(F.lit("published_consensus::"), source).alias("target_id"),
        normalize_dna("oriented_upstream_flank").alias("upstream_flank"),
        normalize_dna("oriented_downstream_flank").alias("downstream_flank"),
        F.lit(1.0).alias("orientation_weight"),
    )


def hide_aggregate_counts(rows: DataFrame) -> DataFrame:
    """Counters of aggregate records are unknown (null), never 0; the record counts are kept beside."""
    kept = rows.withColumn("aggregate_support_record_count", F.col("support_target_count")).withColumn(
        "aggregate_eligible_record_count", F.col("eligible_target_count")
    )
    for name in ("support_target_count", "support_alignment_count", "eligible_target_count", "eligible_alignment_count"):
        kept = kept.withColumn(name, F.lit(None).cast("long"))
    return kept


def single_orientation(value: Column | str) -> Column:
    """forward or reverse when a bar-separated list names exactly one of them, else null."""
    named = F.array_distinct(F.filter(
        F.transform(F.split(F.col(value) if isinstance(value, str) else value, "\\|"), lambda x: F.lower(F.trim(x))),
        lambda x: x.isin("forward", "reverse"),
    ))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def orient_published_rows(
    rows: DataFrame,
    *,
    overlap: int = 3,
    motif_based: str = "orientation_PAMbased",
    database: str = "orientation_CRISPRCasdb",
) -> DataFrame:
    """Turn published spacers and flanks to the protospacer strand and drop the boundary overlap.

    rows: source_spacer, hit, raw_left_flank, raw_right_flank and two orientation
    columns. `orientation_error` holds the reason a row is unusable, else null.
    """
    first, second = single_orientation(motif_based), single_orientation(database)
    left = normalize_dna(F.coalesce("raw_left_flank", F.lit("")))
    right = normalize_dna(F.coalesce("raw_right_flank", F.lit("")))
    rows = rows.withColumn("orientation", F.coalesce(first, second)).withColumn(
        "orientation_source",
        F.when(first.isNotNull(), F.lit(motif_based)).when(second.isNotNull(), F.lit(f"{database}_fallback")),
    )
    back = F.col("orientation") == "reverse"
    rows = rows.withColumn("_up", F.when(back, reverse_complement(right)).otherwise(left)).withColumn(
        "_down", F.when(back, reverse_complement(left)).otherwise(right)
    )
    error = (
        F.when(F.col("orientation").isNull(), F.lit("no_unambiguous_orientation"))
        .when((F.col("hit") != "1") & ((left != "") | (right != "")), F.lit("flanks_without_hit"))
        .when((F.col("_up") != "") & (F.length("_up") <= overlap), F.lit("upstream_not_longer_than_overlap"))
        .when((F.col("_down") != "") & (F.length("_down") <= overlap), F.lit("downstream_not_longer_than_overlap"))
    )
    spacer = normalize_dna("source_spacer")
    return rows.withColumn("orientation_error", error).withColumn(
        "oriented_spacer", F.when(back, reverse_complement(spacer)).otherwise(spacer)
    ).withColumn(
        "oriented_upstream_flank", F.expr(f"substring(_up, 1, greatest(length(_up) - {overlap}, 0))")
    ).withColumn("oriented_downstream_flank", F.expr(f"substring(_down, {overlap + 1})")).drop("_up", "_down")


CONTROLS = ("positive_declared_orientation", "control_reverse_orientation", "control_shuffled_spacers", "control_shuffled_targets",
            "control_random_spacers")
# When the signal counts as there, and as gone.
SURVIVES, COLLAPSES = 0.5, 0.1


def control_measures(hits: DataFrame, *, side: str, length: int, keys: list[str], motifs: list[str] = XGG) -> DataFrame:
    """Per key: alignments, motifs, mapped spacers and the share of motifs of the set by alignment, spacer and contig.

    A spacer counts at its best hit that has a motif (fewest mismatches, then target, start, strand); a contig has the most
    frequent motif of these, of equals the one seen first. Of the hits only the columns that are read are stored, once for all measures.
    """
    inside = lambda c: F.coalesce(F.avg(F.col(c).isin(motifs).cast("double")), F.lit(0.0))
    rows = materialize(hits.select(
        *keys, "spacer_id", "target_id", "start", "strand", "mismatches", flank_motif("upstream_flank", "downstream_flank", side, length).alias("pam")))
    by_hit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alignments"), F.count("pam").alias("scored_flanks"), F.count_distinct("spacer_id").alias("mapped_spacers"),
        inside("pam").alias("xgg_fraction"))
    best = rows.where("pam is not null").groupBy(*keys, "spacer_id").agg(F.min(F.struct("mismatches", "target_id", "start", "strand", "pam")).alias("b")).select(
        *keys, "spacer_id", "b.target_id", "b.pam")
    by_spacer = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("spacer_best_hits_with_pam"), inside("pam").alias("spacer_level_xgg_fraction"))
    counts = best.groupBy(*keys, "target_id", "pam").agg(F.count(F.lit(1)).alias("n"), F.min("spacer_id").alias("first_seen"))
    contigs = counts.groupBy(*keys, "target_id").agg(F.min_by("pam", F.struct(-F.col("n"), "first_seen")).alias("pam"), F.sum("n").alias("spacers"))
    by_contig = contigs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_target_contigs"), inside("pam").alias("contig_level_xgg_fraction"), F.max("spacers").alias("max_spacers_on_one_contig"))
    return by_hit.join(by_spacer, keys, "left").join(by_contig, keys, "left").na.fill(0)


def negative_controls(
    spacers: DataFrame, targets: DataFrame, *, side: str, length: int, mismatches: int, flank_length: int = 10, keys: list[str] = [], seed: int = 0
) -> DataFrame:
    """(control, measures): the declared search beside four that must not find its signal.

    Spacers turned to the other strand; letters of each spacer, or of each target, permuted by seed (their composition is kept); spacers of
    random letters. A control without any alignment has a row of zeros.
    """
    changed = lambda rows, column, value: rows.withColumn(column, value)
    spacers = spacers.withColumn("spacer_sequence", normalize_dna("spacer_sequence"))
    targets = targets.withColumn("target_sequence", normalize_dna("target_sequence"))
    variants = {
        CONTROLS[0]: (spacers, targets),
        CONTROLS[1]: (changed(spacers, "spacer_sequence", reverse_complement("spacer_sequence")), targets),
        CONTROLS[2]: (changed(spacers, "spacer_sequence", shuffled_letters("spacer_sequence", seed, "spacer_id")), targets),
        CONTROLS[3]: (spacers, changed(targets, "target_sequence", shuffled_letters("target_sequence", seed, "target_id"))),
        CONTROLS[4]: (changed(spacers, "spacer_sequence", random_bases(F.length("spacer_sequence"), seed, "spacer_id")), targets),
    }
    found = None
    for name, (queries, places) in variants.items():
        hits = spacer_hits(queries, places, mismatches=mismatches, flank_length=flank_length, keys=keys).withColumn("control", F.lit(name))
        found = hits if found is None else found.unionByName(hits)
    measures = control_measures(found, side=side, length=length, keys=["control"])
    names = spacers.sparkSession.createDataFrame([(c,) for c in CONTROLS], "control string")
    return names.join(measures, "control", "left").na.fill(0)


def control_verdict(measures: DataFrame) -> DataFrame:
    """One row: does the signal stand, is it gone on the wrong strand, and do the controls without homology align nowhere."""
    value = lambda control, column: F.max(F.when(F.col("control") == control, F.col(column)))
    none = F.greatest(*[value(c, "alignments") for c in CONTROLS[2:]]) == 0
    return measures.agg(
        (value(CONTROLS[0], "xgg_fraction") > SURVIVES).alias("signal_survives_positive"),
        (value(CONTROLS[1], "xgg_fraction") < COLLAPSES).alias("collapses_under_wrong_orientation"),
        none.alias("collapses_under_homology_destroying_nulls"),
        value(CONTROLS[0], "max_spacers_on_one_contig").alias("contig_redundancy_max_spacers_on_one_contig"),
        value(CONTROLS[0], "contig_level_xgg_fraction").alias("contig_level_xgg_fraction"))
