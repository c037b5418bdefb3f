"""Benchmark manifests: every system row is checked against the rules of its tracks.

A row is one system with nested structs (see `SYSTEM_SCHEMA`); an absent field is
null. Each rule adds a message to `errors` or `warnings` when it is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iupac import valid_motif
from ..functions.text import safe_relative_path

# The enumerations and required fields of a manifest.
TIERS = ["engineering_regression", "retrospective_biological", "strict_independent"]
STATUSES = ["ready", "curating", "blocked", "deprecated"]
TRACKS = ["protein_only", "paired_evidence", "published_flanks", "end_to_end_genome"]
EXPOSURES = ["none", "near", "exact", "unknown"]
TARGET_INDEPENDENCE = ["virus_clustered", "contig_only", "not_applicable", "not_assessable_from_aggregate_flanks", "unknown"]
GOLD_MATCHES = ["exact_protein_or_strain", "species_ortholog", "not_resolved"]
EXPERIMENTAL_GOLD = ["experimental_activity", "experimental_functional_spectrum"]
PROVENANCE_FIELDS = ["source_name", "source_uri", "source_version", "license", "sha256", "sha256_scope"]
UNRESOLVED_LICENSES = ["", "unknown", "not_recorded"]
REQUIRED_FIELDS = [
    "system_id", "tier", "status", "crispr_type", "cas_family", "available_tracks", "protein_model", "protein_fasta",
    "protein_record_id", "pam_side", "pam_lengths", "gold_pam_spectrum", "gold_evidence_type", "gold_doi", "gold_assay",
    "gold_system_match", "protein_training_exposure", "target_independence", "host_taxon", "host_strain", "split_group",
    "provenance", "notes",
]
_ENTRY = "struct<" + ",".join(f"{f}:string" for f in PROVENANCE_FIELDS) + ">"
SYSTEM_SCHEMA = (
    "system_id string, tier string, status string, crispr_type string, cas_family string, available_tracks array<string>, "
    "protein_model string, protein_fasta string, protein_record_id string, pam_side string, pam_lengths array<int>, "
    "gold_pam_spectrum map<string,array<string>>, gold_evidence_type string, gold_doi string, "
    "gold_assay struct<assay_type:string,activity_values_available:boolean,conditions:string,source_locator:string>, "
    "gold_system_match string, protein_training_exposure string, target_independence string, host_taxon string, host_strain string, "
    "split_group string, notes string, spacer_fasta string, spacer_orientation string, target_fastas array<string>, max_mismatches int, "
    "published_flanks_tsv string, min_effective_spacers int, host_genome_fasta string, discovery_policy map<string,string>, "
    "target_dataset struct<name:string,release:string,frozen_at:string,selection_policy:string,cluster_policy:string>, "
    "published_flank_dataset struct<name:string,doi:string,release:string,frozen_at:string,row_selection_policy:string,"
    "orientation_policy:string,raw_target_identifiers_available:boolean>, "
    f"provenance struct<protein:{_ENTRY},spacers:{_ENTRY},targets:array<{_ENTRY}>,published_flanks:{_ENTRY},host_genome:{_ENTRY}>"
)
DOCUMENT_SCHEMA = (
    "format_version int, benchmark_name string, frozen_at string, candidate_policy string, minimum_strict_systems int, "
    f"systems array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in SYSTEM_SCHEMA.split(', '))}>>"
)


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def broken(rule: Column, message: str | Column) -> Column:
    """The message unless the rule holds; unknown counts as broken."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(~F.coalesce(rule, F.lit(False)), text)


def spectrum_valid(spectrum: Column) -> Column:
    """Non-empty motif lists under their lengths, without repeats or invalid letters."""
    return (F.size(spectrum) > 0) & F.forall(F.map_entries(spectrum), lambda e: (
        (F.size(e["value"]) > 0) & (F.size(F.array_distinct(e["value"])) == F.size(e["value"]))
        & F.forall(e["value"], lambda m: valid_motif(m) & (F.length(F.trim(m)).cast("string") == e["key"]))
    ))


def entry_valid(entry: Column) -> Column:
    full = F.lit(True)
    for field in PROVENANCE_FIELDS:
        full = full & filled(entry[field])
    return F.coalesce(full & F.lower(entry["sha256"]).rlike("^[0-9a-f]{64}$"), F.lit(False))


def _entry_rules(entry: Column, label: str, when: Column) -> tuple[list[Column], list[Column]]:
    missing = F.array_compact(F.array(*[F.when(~filled(entry[f]), F.lit(f)) for f in PROVENANCE_FIELDS]))
    digest = F.lower(F.coalesce(entry["sha256"], F.lit("")))
    errors = [
        F.when(when & entry.isNull(), F.lit(f"provenance.{label} must be an object")),
        F.when(when & entry.isNotNull() & (F.size(missing) > 0), F.concat(F.lit(f"provenance.{label} missing values: "), F.array_join(missing, ", "))),
        F.when(when & (digest != "") & ~digest.rlike("^[0-9a-f]{64}$"), F.lit(f"provenance.{label}.sha256 must be 64 lowercase hex characters")),
    ]
    license = F.lower(F.coalesce(entry["license"], F.lit("")))
    return errors, [F.when(when & entry.isNotNull() & license.isin(UNRESOLVED_LICENSES), F.lit(f"provenance.{label} license is unresolved"))]


def audit_systems(systems: DataFrame) -> DataFrame:
    """(system_id, valid, runnable, strict_eligible_tracks, errors, warnings) per v2 system row."""
    c = F.col
    tracks = F.coalesce(c("available_tracks"), F.array().cast("array<string>"))
    has = lambda track: F.array_contains(tracks, track)
    unless = lambda track, rule: ~has(track) | F.coalesce(rule, F.lit(False))
    one_of = lambda field, values: broken(c(field).isin(values), f"{field} must be one of {', '.join(values)}")
    lengths_match = F.array_sort(F.array_distinct("pam_lengths")) == F.array_sort(
        F.transform(F.map_keys("gold_pam_spectrum"), lambda k: k.try_cast("int")))
    missing = F.array_compact(F.array(*[F.when(c(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS]))
    errors = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing v2 fields: "), F.array_join(missing, ", "))),
        broken(filled(c("system_id")), "system_id must be a non-empty string"),
        one_of("tier", TIERS), one_of("status", STATUSES), one_of("pam_side", ["upstream", "downstream"]),
        one_of("protein_training_exposure", EXPOSURES), one_of("target_independence", TARGET_INDEPENDENCE), one_of("gold_system_match", GOLD_MATCHES),
        broken((F.size(tracks) > 0) & (F.size(F.array_except(tracks, F.array(*[F.lit(t) for t in TRACKS]))) == 0), "available_tracks must be a non-empty subset of the tracks"),
        broken(F.size(F.array_distinct(tracks)) == F.size(tracks), "available_tracks must not contain duplicates"),
        broken(spectrum_valid(c("gold_pam_spectrum")), "gold_pam_spectrum is not a valid spectrum"),
        broken(lengths_match, "pam_lengths must equal gold_pam_spectrum length keys"),
        *[broken(filled(c(f)), f"{f} must be a non-empty string") for f in ("protein_model", "protein_fasta", "protein_record_id", "host_taxon", "host_strain", "split_group")],
        broken(~filled(c("protein_fasta")) | safe_relative_path("protein_fasta"), "protein_fasta must be a workspace-relative safe path"),
        broken(unless("paired_evidence", filled(c("spacer_fasta"))), "paired_evidence requires spacer_fasta"),
        broken(unless("paired_evidence", c("spacer_orientation").isin("forward", "reverse")), "spacer_orientation must be forward or reverse"),
        broken(unless("paired_evidence", F.size("target_fastas") > 0), "paired_evidence requires non-empty target_fastas"),
        broken(unless("paired_evidence", safe_relative_path("spacer_fasta")), "spacer_fasta must be a workspace-relative safe path"),
        broken(unless("paired_evidence", F.forall(F.coalesce("target_fastas", F.array().cast("array<string>")), safe_relative_path)), "target_fastas entries must be workspace-relative safe paths"),
        broken(unless("paired_evidence", c("max_mismatches") >= 0), "paired_evidence requires non-negative max_mismatches"),
        *[broken(unless("published_flanks", safe_relative_path(f)), f"published_flanks requires a safe {f}") for f in ("spacer_fasta", "published_flanks_tsv")],
        broken(unless("published_flanks", c("min_effective_spacers") >= 1), "published_flanks requires positive min_effective_spacers"),
        broken(unless("end_to_end_genome", safe_relative_path("host_genome_fasta")), "end_to_end_genome requires a safe host_genome_fasta"),
        broken(unless("end_to_end_genome", c("discovery_policy").isNotNull()), "end_to_end_genome requires discovery_policy object"),
        broken(c("provenance").isNotNull(), "provenance must be an object"),
        broken(c("gold_assay").isNotNull(), "gold_assay must be an object"),
        *[broken(c(f"gold_assay.{f}").isNotNull(), f"gold_assay missing field: {f}") for f in ("assay_type", "activity_values_available", "conditions", "source_locator")],
        broken(unless("paired_evidence", F.size("provenance.targets") > 0), "provenance.targets must be a non-empty list"),
        broken(unless("paired_evidence", F.size("provenance.targets") == F.size("target_fastas")), "provenance.targets must align one-to-one with target_fastas"),
        *[broken(unless("paired_evidence", filled(c(f"target_dataset.{f}"))), f"target_dataset.{f} must be non-empty") for f in ("name", "release", "frozen_at", "selection_policy", "cluster_policy")],
        *[broken(unless("published_flanks", filled(c(f"published_flank_dataset.{f}"))), f"published_flank_dataset.{f} must be non-empty") for f in ("name", "doi", "release", "frozen_at", "row_selection_policy", "orientation_policy")],
        broken(unless("published_flanks", c("published_flank_dataset.raw_target_identifiers_available").isNotNull()), "published_flank_dataset.raw_target_identifiers_available must be boolean"),
    ]
    warnings = [
        F.when(c("protein_training_exposure").isin("exact", "near"), F.lit("protein is exposed to the model's training distribution")),
        F.when(has("paired_evidence") & ~F.coalesce(c("target_independence") == "virus_clustered", F.lit(False)), F.lit("target records are not verified independent virus clusters")),
        F.when(has("published_flanks"), F.lit("published flanks are aggregate per-spacer evidence without raw target identifiers")),
        F.when(~F.coalesce(c("status") == "ready", F.lit(False)), F.lit("system is not runnable")),
    ]
    always, spacers_used = F.lit(True), has("paired_evidence") | has("published_flanks")
    for label, when in (("protein", always), ("spacers", spacers_used), ("published_flanks", has("published_flanks")), ("host_genome", has("end_to_end_genome"))):
        e, w = _entry_rules(c(f"provenance.{label}"), label, when)
        errors, warnings = errors + e, w + warnings
    targets_valid = (F.size("provenance.targets") > 0) & F.forall("provenance.targets", entry_valid)
    errors.append(F.when(has("paired_evidence") & (F.size("provenance.targets") > 0) & ~F.coalesce(targets_valid, F.lit(False)), F.lit("provenance.targets holds an incomplete entry")))

    strict = (
        (c("tier") == "strict_independent") & (c("status") == "ready") & (c("protein_training_exposure") == "none") & filled(c("gold_doi"))
        & c("gold_evidence_type").isin(EXPERIMENTAL_GOLD) & (c("gold_system_match") == "exact_protein_or_strain") & entry_valid(c("provenance.protein"))
        & ~F.coalesce(c("gold_assay.assay_type"), F.lit("")).isin("", "known_reference", "not_recorded")
    )
    strict = F.coalesce(strict, F.lit(False))
    paired = (
        has("paired_evidence") & (c("target_independence") == "virus_clustered") & entry_valid(c("provenance.spacers")) & targets_valid
        & ~F.coalesce(c("target_dataset.cluster_policy"), F.lit("")).isin("", "not_clustered", "not_recorded")
    )
    eligible = F.array_compact(F.array(
        F.when(strict & has("protein_only"), F.lit("protein_only")), F.when(strict & paired, F.lit("paired_evidence")),
        F.when(strict & has("end_to_end_genome") & entry_valid(c("provenance.host_genome")), F.lit("end_to_end_genome")),
    ))
    errors.append(F.when(
        (c("tier") == "strict_independent") & (F.size(F.array_except(tracks, eligible)) > 0), F.lit("strict_independent row does not satisfy every declared track contract")))
    # The rules are gathered in slices, so that no generated method grows too large.
    checked = systems.select("system_id", "status", tracks.alias("tracks"), eligible.alias("strict_eligible_tracks"), F.array_distinct(F.array_compact(F.array(*warnings))).alias("warnings"),
                             F.array_compact(F.array(*errors)).alias("errors"))
    valid = F.size("errors") == 0
    return checked.select(
        "system_id", F.array_sort("tracks").alias("available_tracks"), valid.alias("valid"), (valid & (c("status") == "ready")).alias("runnable"),
        (F.size("strict_eligible_tracks") > 0).alias("strict_eligible"), "strict_eligible_tracks", "errors", "warnings",
    )


def audit_v1_systems(systems: DataFrame) -> DataFrame:
    """The shorter contract of version 1 rows."""
    c = F.col
    lengths_match = F.array_sort(F.array_distinct("pam_lengths")) == F.array_sort(F.transform(F.map_keys("gold_pam_spectrum"), lambda k: k.try_cast("int")))
    strict = F.coalesce(
        (c("tier") == "strict_independent") & (c("status") == "ready") & (c("protein_training_exposure") == "none") & filled(c("gold_doi"))
        & c("gold_evidence_type").isin(EXPERIMENTAL_GOLD) & (c("target_independence") == "virus_clustered"), F.lit(False))
    errors = F.array_compact(F.array(
        broken(spectrum_valid(c("gold_pam_spectrum")), "gold_pam_spectrum is not a valid spectrum"),
        broken(lengths_match, "pam_lengths must equal gold_pam_spectrum length keys"),
        broken(c("spacer_orientation").isin("forward", "reverse"), "spacer_orientation must be forward or reverse"),
        broken(c("pam_side").isin("upstream", "downstream"), "pam_side must be upstream or downstream"),
        broken(F.size("target_fastas") > 0, "target_fastas must be a non-empty list"),
        F.when((c("tier") == "strict_independent") & ~strict, F.lit("strict_independent row does not satisfy independence contract")),
    ))
    warnings = F.array_compact(F.array(
        F.when(c("protein_training_exposure").isin("exact", "near"), F.lit("protein is exposed to the model's training distribution")),
        F.when(~F.coalesce(c("target_independence") == "virus_clustered", F.lit(False)), F.lit("target records are not verified independent virus clusters")),
        F.when(~F.coalesce(c("status") == "ready", F.lit(False)), F.lit("system is not runnable")),
    ))
    rows = systems.select("system_id", "status", errors.alias("errors"), warnings.alias("warnings"), strict.alias("strict_eligible"))
    valid = F.size("errors") == 0
    return rows.select("system_id", valid.alias("valid"), (valid & (c("status") == "ready")).alias("runnable"), "strict_eligible", "errors", "warnings")


def document_violations(document: DataFrame, audits: DataFrame) -> DataFrame:
    """(kind, message) of a manifest document beside its system audits."""
    c = F.col
    v2 = c("format_version") == 2
    rules = F.array_compact(F.array(
        broken(c("format_version").isin(1, 2), "format_version must be 1 or 2"),
        broken(filled(c("benchmark_name")), "benchmark_name must be a non-empty string"),
        broken(c("systems").isNotNull(), "systems must be a list"),
        *[F.when(v2 & c(f).isNull(), F.lit(f"v2 manifest missing field: {f}")) for f in ("frozen_at", "candidate_policy", "minimum_strict_systems")],
        F.when(v2 & (c("minimum_strict_systems") < 1), F.lit("minimum_strict_systems must be a positive integer")),
    ))
    own = document.select(F.lit("error").alias("kind"), F.explode(rules).alias("message"))
    ids = document.select(F.explode("systems").alias("s")).groupBy(F.col("s.system_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = ids.select(F.lit("error").alias("kind"), F.concat(F.lit("duplicate system_id value: "), F.coalesce("id", F.lit("null"))).alias("message"))
    paired = audits.agg(F.count_if(F.array_contains("strict_eligible_tracks", "paired_evidence")).alias("n")).scalar()
    few = document.where(v2 & (paired < F.coalesce("minimum_strict_systems", F.lit(5)))).select(
        F.lit("warning").alias("kind"), F.lit("strict paired-evidence cohort is below minimum_strict_systems").alias("message"))
    return own.unionByName(repeated).unionByName(few)


def track_counts(audits: DataFrame) -> DataFrame:
    """Systems per declared track and how many of them are strictly eligible for it."""
    return audits.select(F.explode("available_tracks").alias("track"), "strict_eligible_tracks").groupBy("track").agg(
        F.count(F.lit(1)).alias("systems"), F.count_if(F.array_contains("strict_eligible_tracks", F.col("track"))).alias("strict_systems"))


def verify_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare recorded digests (path, sha256) with computed ones: ok, missing or mismatch."""
    found = actual.select("path", F.col("sha256").alias("_found"))
    return expected.join(found, "path", "left").withColumn(
        "state", F.when(F.col("_found").isNull(), F.lit("missing")).when(F.lower("sha256") == F.col("_found"), F.lit("ok")).otherwise(F.lit("mismatch"))
    ).drop("_found")


def column_contract(df: DataFrame, expected: list[str]) -> None:
    """The exact column list in its order, or an error."""
    if df.columns != expected:
        raise ValueError(f"columns {df.columns} differ from the contract {expected}")
