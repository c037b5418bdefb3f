"""Corpus profile, ingest normalisation and assembly of published result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matrix import valid_logo
from .ordering import ordered_position

# The corpus columns in their order.
CORPUS_COLUMNS = ["crispr_type", "cas_family", "source", "protein_id", "citation", "doi", "protein_sequence", "pid_sequence",
                  "pam_consensus", "pam_logo_acgt", "raw_ref", "created_at", "sha256"]
# What a published row says about its order.
RANKED_BY_PROTEIN = "protein_only: ranked by protein compatibility within PAM length"
SPACER_MISSING = "spacer evidence unavailable for this candidate"
RANKED_BY_GATE = "fusion gate="
GATE_MISSING = "fusion gate not recorded"
INGEST_SOURCE = "Literature (new; unreviewed)"


def crosstab_with_margins(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Counts per pair of values with row, column and grand totals (null = total)."""
    return rows.cube(left, right).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("grain"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-empty values per column, in one pass."""
    share = lambda c: F.avg((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("double"))
    return rows.agg(*[share(c).alias(c) for c in columns]).unpivot([], columns, "column", "filled_share")


def length_histogram(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent text lengths."""
    return rows.groupBy(F.length(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(top)


def logo_validity(rows: DataFrame, column: str = "pam_logo_acgt") -> DataFrame:
    filled = F.coalesce(F.trim(column), F.lit("")) != ""
    return rows.agg(F.count_if(filled).alias("filled"), F.count_if(filled & valid_logo(column)).alias("valid"))


def normalize_for_corpus(rows: DataFrame) -> DataFrame:
    """Project any extracted rows onto the corpus columns: empty where absent, constant source."""
    have = set(rows.columns)
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have and c != "pid_sequence" else F.lit("")
    return rows.select(*[(F.lit(INGEST_SOURCE) if c == "source" else column(c)).alias(c) for c in CORPUS_COLUMNS])


def ingest_counts(rows: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.col(c) != "")
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), filled("pam_consensus").alias("with_consensus"),
                    filled("protein_sequence").alias("with_protein_sequence"), filled("protein_id").alias("with_protein_id"))


def assemble_results(
    protein: DataFrame, spacer: DataFrame, fusion: DataFrame, systems: DataFrame, *, display: DataFrame | None = None, top: int = 0,
    notes: dict[str, str] = {}, no_track_note: str = "", keys: list[str] = ["system_id", "candidate_pam"],
) -> DataFrame:
    """Published rows: each protein candidate of a system in the manifest with its spacer evidence, status and ranking basis.

    `systems` has system_id, evidence_track, evidence_source and further columns that every row repeats; a system without
    an entry has no rows. Rows stay if `display` lists their key, or a system is in no row of `display`, or their rank
    within the motif length is among the system's first `top`; with `top` alone, only those stay. What the spacer
    channel or the fusion does not say is null, never 0, and a system of the track protein_only has the note
    `no_track_note` in place of the one that `notes` gives for its source. Candidate ids count the kept rows of a system by length, rank and motif.
    The three tables have one row per key: all joins keep the number of protein rows.
    """
    kept = lambda df, have: df.select(*keys, *have, F.lit(True).alias("_" + have[0]))
    evidence = kept(spacer, ["spacer_evidence_score", "spacer_rank", "support_spacer_count", "support_target_count"])
    gates = kept(fusion, ["evidence_status", "fusion_gate"])
    rows = protein.join(systems, "system_id").join(evidence, keys, "left").join(gates, keys, "left")
    if display is not None:
        listed = display.select(*keys).distinct()
        rows = rows.join(listed.withColumn("_listed", F.lit(True)), keys, "left").join(
            listed.select("system_id").distinct().withColumn("_chosen", F.lit(True)), "system_id", "left")
        stay = F.coalesce("_listed", F.lit(False)) if top else F.coalesce("_listed", F.col("_chosen").isNull())
    else:
        stay = F.lit(not top)
    if top:
        first = Window.partitionBy("system_id").orderBy("protein_rank", "pam_length", "candidate_pam")
        rows = rows.withColumn("_n", F.row_number().over(first))
        stay = stay | (F.col("_n") <= top)
    alone, found = F.col("evidence_track") == "protein_only", F.col("_spacer_evidence_score").isNotNull()
    gate = F.nullif(F.trim("fusion_gate"), F.lit(""))
    basis = F.when(found, F.coalesce(F.concat(F.lit(RANKED_BY_GATE), gate), F.lit(GATE_MISSING))).otherwise(
        F.when(alone, F.lit(RANKED_BY_PROTEIN)).otherwise(F.lit(SPACER_MISSING)))
    known = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair]) if notes else F.create_map().cast("map<string,string>")
    note = F.when(alone, F.lit(no_track_note)).otherwise(F.coalesce(known[F.col("evidence_source")], F.lit(no_track_note)))
    rows = rows.where(stay).withColumn("evidence_status", F.when(found, F.col("evidence_status"))).withColumn(
        "ranking_basis", basis).withColumn("notes", note)
    inner = [c for c in rows.columns if c.startswith("_")]
    return sequential_ids(rows.drop("fusion_gate", *inner), ["pam_length", "protein_rank", "candidate_pam"], name="candidate_id")


def presentation_subset(rows: DataFrame, display: DataFrame, top: int, keys: list[str] = ["system_id", "candidate_pam"]) -> DataFrame:
    """Listed candidates and the best `top` of every system by protein rank."""
    listed = display.select(*keys).distinct().withColumn("_listed", F.lit(True))
    order = Window.partitionBy("system_id").orderBy("protein_rank", "candidate_pam")
    marked = rows.join(listed, keys, "left").withColumn("_n", F.when(F.col("protein_rank").isNotNull(), F.row_number().over(order)))
    return marked.where(F.col("_listed") | (F.col("_n") <= top)).drop("_listed", "_n")


def sequential_ids(rows: DataFrame, order: list[str], key: str = "system_id", name: str = "row_id") -> DataFrame:
    """system-0001, system-0002, ... within each system's kept rows."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(name, F.concat(F.col(key).cast("string"), F.lit("-"), F.lpad(n.cast("string"), 4, "0")))


def stable_row_ids(rows: DataFrame, columns: list[str], position: str, supplied: str = "row_id") -> DataFrame:
    """The supplied id, else a digest of the row's content with its repeat count in order of `position`."""
    payload = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)]))
    rows = rows.withColumn("_d", F.substring(F.sha2(payload, 256), 1, 16)).withColumn("_blank", F.coalesce(F.trim(supplied), F.lit("")) == "")
    counted = ordered_position(rows, position, [], ["_d", "_blank"], "_n")
    number = F.col("_n").cast("string")
    number = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    made = F.concat(F.lit("bench-"), F.col("_d"), F.lit("-"), number)
    return counted.withColumn(supplied, F.when(F.col("_blank"), made).otherwise(F.trim(supplied))).drop("_d", "_blank", "_n")


def spectrum_by_length(rows: DataFrame, keys: list[str], motif: str = "pam", order: str = "position") -> DataFrame:
    """map<length, motifs in first-seen order> per key. Distinct motifs of at most ten letters are gathered."""
    from ..functions.iupac import normalize_motif, valid_motif

    first = rows.where(valid_motif(motif)).groupBy(*keys, normalize_motif(motif).alias("m")).agg(F.min(order).alias("at"))
    lists = first.groupBy(*keys, F.length("m").alias("n")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("l"))
    entry = F.struct(F.col("n"), F.transform("l", lambda x: x["m"]).alias("v"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("spectrum"))


def system_rollup(rows: DataFrame, keys: list[str] = ["system_id"]) -> DataFrame:
    """Orientation pass of all lengths, fewest mapped spacers and the distinct gates."""
    return rows.groupBy(*keys).agg(
        F.bool_and(~F.col("orientation_warning")).alias("orientation_pass"), F.min("mapped_spacers").alias("mapped_spacers"),
        F.array_sort(F.collect_set("fusion_gate")).alias("gates"))
