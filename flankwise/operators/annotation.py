"""Genome annotation tables joined into candidate systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import verify_protein
from ..functions.text import literal_list, safe_identifier

# Issues a named choice may override, and issues it may not.
OVERRIDABLE = ["ambiguous_or_putative_subtype", "unsupported_subtype"]
BLOCKING = ["gene_integrity_unverified", "missing_protein_sequence", "gene_coordinates_missing",
            "contig_not_in_input_genome", "gene_coordinates_invalid"]

# Files an annotation run writes, and the text of its known crash.
OPERON_TABLES = ["cas_operons.tab", "cas_operons_putative.tab", "cas_operons_orphan.tab"]
REQUIRED_OUTPUTS = ["genes.tab", "proteins.faa"]
RESULT_TABLES = [*OPERON_TABLES, "crisprs_all.tab", "CRISPR_Cas.tab"]
CRASH_TEXTS = ["['Hmm', 'ORF'] not in index", "KeyError"]


def union_with_precedence(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables; of rows with one key those of the earliest table count."""
    numbered = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    rows = numbered[0]
    for t in numbered[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    first = rows.groupBy(key).agg(F.min("_table").alias("_table"))
    return rows.join(first, [key, "_table"]).drop("_table")


def is_cas9_gene(name: Column) -> Column:
    return F.lower(name).rlike("^(cas9|csn1)")


def subtype_issue(prediction: Column) -> Column:
    unsure = prediction.isin("False", "Ambiguous", "Unknown") | prediction.contains("Putative")
    return F.when(prediction.startswith("II-"), F.lit(None)).when(unsure, F.lit("ambiguous_or_putative_subtype")).otherwise(
        F.lit("unsupported_subtype"))


def cas9_genes(operons: DataFrame) -> DataFrame:
    """One row per Cas9 gene of an operon; the gene and position lists must be equally long."""
    rows = operons.withColumn("names", literal_list("Genes")).withColumn("positions", literal_list("Positions"))
    zipped = F.when(F.size("names") == F.size("positions"), F.arrays_zip("names", "positions")).otherwise(
        F.raise_error(F.concat(F.lit("gene and position lists differ in operon "), F.col("Operon"))).cast("array<struct<names:string,positions:string>>")
    )
    return rows.withColumn("g", F.explode(zipped)).where(is_cas9_gene(F.col("g.names"))).select(
        F.col("Contig").alias("contig"), F.col("Operon").alias("operon"), F.col("Prediction").alias("prediction"),
        F.col("g.names").alias("gene_name"), F.col("g.positions").alias("pos"),
        F.concat_ws("_", "Contig", F.col("g.positions")).alias("system_id"),
    )


def collect_systems(operons: DataFrame, genes: DataFrame, proteins: DataFrame, contigs: DataFrame) -> DataFrame:
    """Candidate systems with verified proteins and their issues.

    operons: Contig, Operon, Prediction, Genes, Positions (list texts); genes:
    Contig, Pos, Start, End, Strand; proteins: record_id, sequence; contigs:
    contig, contig_sequence.
    """
    places = genes.select(
        F.col("Contig").alias("contig"), F.col("Pos").cast("string").alias("pos"), F.col("Start").cast("int").alias("start"),
        F.col("End").cast("int").alias("stop"), F.col("Strand").cast("string").alias("strand"),
    )
    known = proteins.select(F.col("record_id").alias("system_id"), F.regexp_replace("sequence", r"\*+$", "").alias("protein_sequence"))
    rows = cas9_genes(operons).join(places, ["contig", "pos"], "left").join(known, "system_id", "left").join(contigs, "contig", "left")
    rows = rows.withColumn("protein_sequence", F.coalesce("protein_sequence", F.lit("")))
    rows = rows.withColumn("v", verify_protein("protein_sequence", "contig_sequence", "start", "stop", "strand"))
    placed, on_genome = F.col("start").isNotNull(), F.col("contig_sequence").isNotNull()
    verified = placed & on_genome & F.col("v.verified")
    issues = F.array_compact(F.array(
        subtype_issue(F.col("prediction")),
        F.when(F.col("protein_sequence") == "", F.lit("missing_protein_sequence")),
        F.when(~placed, F.lit("gene_coordinates_missing")),
        F.when(~on_genome, F.lit("contig_not_in_input_genome")),
        F.when(~verified, F.lit("gene_integrity_unverified")),
    ))
    return rows.select(
        "system_id", "gene_name", "operon", "prediction", "contig", "pos", "start", "stop", "strand", "protein_sequence",
        F.length("protein_sequence").alias("protein_length"), verified.alias("integrity_verified"),
        F.when(placed & on_genome, F.col("v.notes")).otherwise(F.array().cast("array<string>")).alias("integrity_notes"), issues.alias("issues"),
    )


def linked_arrays(systems: DataFrame, loci: DataFrame, arrays: DataFrame, contigs: DataFrame, spacer_files: DataFrame) -> DataFrame:
    """Repeat arrays of each system's operon on its contig, with their own issues.

    spacer_files: array_id of the spacer files present.
    """
    named = loci.select(F.col("Operon").alias("operon"), F.explode(literal_list("CRISPRs")).alias("array_id")).distinct()
    files = spacer_files.select("array_id").distinct().withColumn("spacer_file_present", F.lit(True))
    rows = arrays.select(
        F.col("CRISPR").alias("array_id"), F.col("Contig").alias("contig"), F.col("Start").cast("int").alias("array_start"),
        F.col("End").cast("int").alias("array_stop"), F.upper("Consensus_repeat").alias("repeat"),
        (F.lower(F.trim(F.col("Trusted").cast("string"))) == "true").alias("trusted"),
    )
    lengths = contigs.select("contig", F.length("contig_sequence").alias("contig_length"))
    joined = systems.select("system_id", "operon", "contig").join(named, "operon").join(rows, ["array_id", "contig"]).join(
        lengths, "contig", "left").join(files, "array_id", "left")
    unsafe = F.raise_error(F.concat(F.lit("unsafe array identifier: "), F.col("array_id"))).cast("string")
    off = F.col("contig_length").isNotNull() & ~((F.col("array_start") >= 1) & (F.col("array_start") <= F.col("array_stop")) & (F.col("array_stop") <= F.col("contig_length")))
    issues = F.array_compact(F.array(
        F.when(off, F.lit("array_coordinates_out_of_range")),
        F.when(F.col("spacer_file_present").isNull(), F.lit("spacer_file_missing")),
        F.when(~F.coalesce(F.col("repeat").rlike("^[ACGT]+$"), F.lit(False)), F.lit("invalid_consensus_repeat")),
    ))
    return joined.select(
        "system_id", F.when(safe_identifier("array_id"), F.col("array_id")).otherwise(unsafe).alias("array_id"),
        "array_start", "array_stop", "repeat", F.length("repeat").alias("repeat_length"), "trusted",
        F.coalesce("spacer_file_present", F.lit(False)).alias("spacer_file_present"), issues.alias("issues"),
    )


def trusted_arrays(arrays: DataFrame, array_id: str | None = None) -> DataFrame:
    rows = arrays.where(F.col("trusted") & (F.size("issues") == 0) & F.col("spacer_file_present"))
    return rows if array_id is None else rows.where(F.col("array_id") == array_id)


def system_choice(systems: DataFrame) -> DataFrame:
    """How each system may be used: by itself, only when named, or never."""
    blocked = F.arrays_overlap("issues", F.array(*[F.lit(i) for i in BLOCKING]))
    return systems.withColumn(
        "choice", F.when(F.size("issues") == 0, F.lit("eligible")).when(blocked, F.lit("blocked")).otherwise(F.lit("override_only"))
    )


def select_system(systems: DataFrame, requested: str | None = None, *, allow_flagged: bool = False) -> DataFrame:
    """The named system if it may be used, or the only eligible one; an empty result asks for a choice."""
    rows = system_choice(systems)
    if requested is None:
        eligible = rows.where("choice = 'eligible'")
        return eligible if eligible.limit(2).count() == 1 else eligible.limit(0)
    named = rows.where(F.col("system_id") == requested).limit(1)
    found = named.select("choice", "issues").first()
    if found is None:
        raise ValueError(f"unknown system: {requested}")
    if found["choice"] == "blocked" and allow_flagged or found["choice"] != "eligible" and not allow_flagged:
        raise ValueError(f"system {requested} cannot be used: {', '.join(found['issues'])}")
    return named


def token_set_join(rows: DataFrame, registry: DataFrame, *, tokens: str, accession: str, first_only: bool = False) -> DataFrame:
    """Rows matched to every registry row whose accession is among the row's tokens, with the token's 0-based place.

    `tokens` is an array of distinct texts, `accession` the registry's key, each key once. Tokens are exploded and
    reduced to those the registry has before anything is joined back; a token that very many rows share stays spread, as only
    the registry's side is unique. With `first_only` a row keeps its match of lowest place.
    """
    named = registry.withColumn("_accession", F.col(accession))
    exploded = rows.select("*", F.posexplode(tokens).alias("token_place", "_accession"))
    matched = exploded.join(named, "_accession").drop("_accession")
    if not first_only:
        return matched
    kept = matched.columns
    # Matches of one row are few: at most its own tokens.
    best = matched.withColumn("_row", F.struct(*rows.columns)).groupBy("_row").agg(F.min_by(F.struct(*kept), "token_place").alias("_best"))
    return best.select("_best.*")



def run_diagnosis(runs: DataFrame, files: DataFrame, logs: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """Per run (keys, succeeded): `usable`, `no_usable_output` or `failed`, what is missing, and whether it is the known crash.

    files: (keys, path) below the run's folder, logs: (keys, text). A run that failed, wrote no result table and no search hits, and whose log
    holds the crash texts broke off upstream: it says nothing about the genome, so it is never a negative result. A run that
    succeeded needs all required files and one of the operon tables; tables of arrays may be absent.
    """
    path = F.col("path")
    seen = files.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(path.isin([*REQUIRED_OUTPUTS, *RESULT_TABLES, "hmmer.tab"]), path))).alias("_files"),
        F.bool_or(path.startswith("hmmer/")).alias("_hits"))
    crashed = F.lit(True)
    for text in CRASH_TEXTS:
        crashed = crashed & F.contains(F.col("text"), F.lit(text))
    signs = logs.groupBy(*keys).agg(F.bool_or(F.coalesce(crashed, F.lit(False))).alias("_crash"))
    rows = runs.join(seen, keys, "left").join(signs, keys, "left")
    has = F.coalesce("_files", F.array().cast("array<string>"))
    literal = lambda names: F.array(*[F.lit(n) for n in names])
    nothing = ~F.arrays_overlap(has, literal([*RESULT_TABLES, "hmmer.tab"])) & ~F.coalesce("_hits", F.lit(False))
    ok = F.coalesce("succeeded", F.lit(False))
    absent = F.array_except(literal(REQUIRED_OUTPUTS), has)
    absent = F.when(F.arrays_overlap(has, literal(OPERON_TABLES)), absent).otherwise(F.concat(absent, literal(["operon table"])))
    return rows.select(
        *keys, F.when(~ok, F.lit("failed")).when(F.size(absent) > 0, F.lit("no_usable_output")).otherwise(F.lit("usable")).alias("state"),
        F.when(ok, absent).otherwise(F.array().cast("array<string>")).alias("missing"),
        (~ok & nothing & F.coalesce("_crash", F.lit(False))).alias("upstream_crash"))
