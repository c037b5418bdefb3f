"""Packaging of a variant data set: checked variants, their measurements, what is quarantined, and the manifest row."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import RESIDUES
from ..functions.text import sequence_digest
from ..session import materialize
from .clusters import CODE_LENGTH, component_split, hamming_components
from .quantitative import FLOOR, unpivot_measurements

QUARANTINED = "other library; full mutation provenance not verified"


def substituted(core: Column, positions: list[int], residues: Column) -> Column:
    """A core with the k-th residue set in at the k-th position (from 1, ascending)."""
    pieces, at = [], 1
    for k, p in enumerate(positions, start=1):
        pieces += [F.substring(core, at, p - at), F.substring(residues, k, 1)]
        at = p + 1
    return F.concat(*pieces, F.substring(core, F.lit(at), F.length(core)))


def variant_violations(core: Column, positions: list[int], named_by: list[str]) -> Column:
    """array<string> of what is wrong with an eligible row (name, status, extra_mutations and its residue columns)."""
    note = lambda condition, text: F.when(~F.coalesce(condition, F.lit(False)), F.lit(text))
    return F.array_compact(F.array(
        note(F.col("status") == "good", "status_not_good"), note(F.col("extra_mutations") == "no", "extra_mutations"),
        note(F.concat(*[F.col(c) for c in named_by]) == F.col("name"), "name_differs_from_residues"),
        note(F.col("name").rlike(f"^[{RESIDUES}]{{{len(positions)}}}$"), "nonstandard_residues"),
        note(F.length(core) >= max(positions), "core_too_short"),
    ))


def package_variants(
    source: DataFrame, core: str, previously_used: DataFrame, *, positions: list[int], named_by: list[str], groups: list[str],
    library: str, wild_type: str,
) -> dict[str, DataFrame]:
    """variants, measurements, quarantine and a one-row manifest of wide source rows.

    source: name, source_library, status, extra_mutations, a column per residue (`named_by`) and one per motif group.
    Rows of other libraries are quarantined. A bad or repeated row of the wanted one is an error, and so is a value that is no finite
    number. Variants near each other (two letters apart) share a role; one used before keeps its component in development.
    """
    wanted = F.coalesce(F.col("source_library") == library, F.lit(False))
    base = F.lit(core)
    wrong = variant_violations(base, positions, named_by)
    eligible = source.where(wanted).withColumn("name", F.when(F.size(wrong) == 0, F.col("name")).otherwise(
        F.raise_error(F.concat_ws(": ", F.coalesce("name", F.lit("null")), F.array_join(wrong, ", ")))))
    eligible = eligible.select("name", "source_library", *groups)
    quarantine = source.where(~wanted).select(F.col("name").alias("variant_id"), "source_library", F.lit(QUARANTINED).alias("reason"))

    def checked(raw: Column) -> Column:
        finite = F.coalesce(~F.isnan(raw) & (F.abs(raw) < float("inf")), F.lit(False))
        return F.when(finite, raw).otherwise(F.raise_error(F.concat(F.lit("not a finite value: "), F.col("variant_id"))).cast("double"))

    wide = eligible.withColumnRenamed("name", "variant_id")
    measurements = unpivot_measurements(wide, groups).withColumn("raw_log10_k", checked(F.col("raw_log10_k")))
    # A variant's values stand in its row: nothing is spread over rows to be grouped again.
    targets = F.transform(F.array(*[F.col(g).cast("double") for g in groups]), lambda raw: F.greatest(checked(raw), F.lit(FLOOR)))
    profile = wide.select("variant_id", targets.alias("targets")).select(
        "variant_id", (F.array_min("targets") == F.array_max("targets")).alias("constant_target"))
    roles = materialize(component_split(materialize(hamming_components(eligible.select("name"), length=len(positions))), previously_used))
    used = previously_used.select("name").distinct().withColumn("_used", F.lit(True))
    sequence = substituted(base, positions, F.col("name"))
    distance = reduce(lambda a, b: a + b, [(F.substring("name", i + 1, 1) != wild_type[i]).cast("int") for i in range(len(wild_type))])
    variants = roles.join(used, "name", "left").select(
        F.col("name").alias("variant_id"), sequence.alias("protein_sequence"), sequence_digest(sequence).alias("sequence_sha256"),
        F.length(sequence).alias("protein_length"), F.lit(library).alias("source_library"), (F.col("name") == wild_type).alias("is_wt"),
        F.col("_used").isNotNull().alias("previously_evaluated"), distance.alias("distance_from_wt"),
        F.col("fingerprint").alias("component"), F.col("role").alias("future_split"))
    variants = variants.join(profile, "variant_id")
    return {"variants": variants, "measurements": measurements, "quarantine": quarantine,
            "manifest": package_manifest(variants, measurements, quarantine, len(positions))}


def package_manifest(variants: DataFrame, measurements: DataFrame, quarantine: DataFrame, length: int = CODE_LENGTH) -> DataFrame:
    """One row of counts, with the smallest distance between the two roles."""
    counted = variants.agg(
        F.count(F.lit(1)).alias("variants"), F.count_if("constant_target").alias("constant_target_variants"),
        F.count_distinct("component").alias("split_components"), F.count_if(F.col("future_split") == "development").alias("development"),
        F.count_if(F.col("future_split") == "reserved_evaluation").alias("reserved"))
    measured = measurements.agg(F.count(F.lit(1)).alias("measurements"), F.count_if("at_or_below_floor").alias("censored_measurements"))
    set_aside = quarantine.agg(F.count(F.lit(1)).alias("quarantined"))
    parts = [counted, measured, set_aside, role_distance(variants, length)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def role_distance(variants: DataFrame, length: int) -> DataFrame:
    """One row with the smallest number of differing letters between names of different roles, null with one role only.

    Names that share a spelling with d letters hidden differ in at most d of them: groups of one spelling that hold both roles
    give the answer without a pair being listed.
    """
    spellings = []
    for hidden in range(length + 1):
        for places in combinations(range(length), hidden):
            letters = [F.lit("_") if i in places else F.substring("variant_id", i + 1, 1) for i in range(length)]
            spellings.append(F.struct(F.lit(hidden).alias("hidden"), F.concat(*letters).alias("spelling")))
    masked = variants.select("future_split", F.explode(F.array(*spellings)).alias("m")).select("future_split", "m.*")
    both = masked.groupBy("hidden", "spelling").agg((F.min("future_split") != F.max("future_split")).alias("both"))
    return both.agg(F.min(F.when(F.col("both"), F.col("hidden"))).cast("long").alias("smallest_distance_between_roles"))
