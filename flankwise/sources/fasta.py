"""FASTA files as rows, one per record. Records are the splits, so a large file is read in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import RESIDUES, normalize_dna

# Alphabets of the readers.
DNA_LETTERS = "ACGTRYSWKMBDHVN"
PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWYBXZJUO*"
MIN_GENOME_BASES = 1


def read_fasta(spark: SparkSession, paths: str | list[str], *, kind: str = "dna") -> DataFrame:
    """(file, record_id, header, sequence, position) of all records.

    A line break with the record mark behind it is the separator, so files are split between
    records and a mark inside a header is text. Positions follow the order of `paths`.
    A protein record without an id is named after its position; an empty record
    is an error, and so is text in front of the first mark, which has no sequence
    lines of its own.
    """
    read = [spark.read.text(p, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"))
            for p in ([paths] if isinstance(paths, str) else paths)]
    raw = reduce(DataFrame.unionByName, read).select(
        F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", "").alias("value"), "file",
        F.monotonically_increasing_id().alias("position"),
    ).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    header = F.trim(F.regexp_extract("value", r"^([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    sequence = normalize_dna(body) if kind == "dna" else F.upper(body)
    record_id = F.regexp_extract(header, r"^(\S+)", 1)
    if kind == "protein":
        record_id = F.when(record_id == "", F.concat(F.lit("sequence_"), (F.col("position") + 1).cast("string"))).otherwise(record_id)
    rows = raw.select("file", record_id.alias("record_id"), header.alias("header"), sequence.alias("sequence"), "position")
    empty = F.concat(F.lit("empty FASTA record "), F.col("record_id"), F.lit(" in "), F.col("file"))
    return rows.withColumn("sequence", F.when((F.col("record_id") != "") & (F.col("sequence") != ""), F.col("sequence")).otherwise(F.raise_error(empty)))


def checked_alphabet(records: DataFrame, alphabet: str) -> DataFrame:
    """Fail on a letter outside the alphabet."""
    letters = alphabet.replace("*", r"\*")
    bad = F.concat(F.lit("illegal symbol in FASTA record "), F.col("record_id"))
    return records.withColumn("sequence", F.when(F.col("sequence").rlike(f"^[{letters}]+$"), F.col("sequence")).otherwise(F.raise_error(bad)))


def unique_records(records: DataFrame, *, allow_duplicates: bool = False) -> DataFrame:
    """(record_id, sequence, header): one row per id; with duplicates allowed their fragments are joined in file order."""
    if not allow_duplicates:
        twice = F.concat(F.lit("duplicate FASTA id "), F.col("record_id"))
        first = records.groupBy("record_id").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("sequence", "position").alias("sequence"), F.min_by("header", "position").alias("header"))
        return first.select("record_id", F.when(F.col("n") == 1, F.col("sequence")).otherwise(F.raise_error(twice)).alias("sequence"), "header")
    # The fragments of one id are one sequence in the end, so gathering them is what is asked for.
    parts = records.groupBy("record_id").agg(
        F.min_by("header", "position").alias("header"), F.array_sort(F.collect_list(F.struct("position", "sequence"))).alias("parts"))
    return parts.select("record_id", F.array_join(F.transform("parts", lambda p: p["sequence"]), "").alias("sequence"), "header")


def fasta_record(records: DataFrame, record_id: str | None = None) -> DataFrame:
    """The named record, or the first one; an error when there is none."""
    rows = records.where(F.col("record_id") == record_id) if record_id else records.orderBy("position").limit(1)
    if rows.isEmpty():
        raise ValueError(f"FASTA record not found: {record_id}")
    return rows


def single_protein(records: DataFrame) -> DataFrame:
    """Exactly one record made of the twenty residues."""
    if records.limit(2).count() != 1:
        raise ValueError("exactly one protein record is required")
    return checked_alphabet(records, RESIDUES)


def union_targets(records: DataFrame) -> DataFrame:
    """(target_id, target_sequence): in the order of the paths the first record of an id keeps it, later ones take their file's stem, then a counter."""
    rows = records.withColumn("stem", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    first = rows.groupBy("record_id").agg(F.min("position").alias("first"))
    rows = rows.join(first, "record_id").withColumn("keeps", F.col("position") == F.col("first")).withColumn(
        "name", F.when(F.col("keeps"), F.col("record_id")).otherwise(F.concat_ws(":", "stem", "record_id")))
    # A made name counts on where a record really has it.
    given = first.select(F.col("record_id").alias("name"), F.lit(1).alias("given"))
    n = F.row_number().over(Window.partitionBy("name", "keeps").orderBy("position")) + F.coalesce("given", F.lit(0))
    return rows.join(given, "name", "left").withColumn("n", n).select(
        F.when(F.col("keeps") | (F.col("n") == 1), F.col("name")).otherwise(F.concat_ws(":", "name", F.col("n").cast("string"))).alias("target_id"),
        F.col("sequence").alias("target_sequence"),
    )


def genome_summary(records: DataFrame) -> DataFrame:
    """Contigs, bases, longest contig and count of non-ACGT letters of a genome."""
    n = F.length("sequence")
    return records.agg(
        F.count(F.lit(1)).alias("contigs"), F.sum(n).alias("bases"), F.max(n).alias("longest_contig"),
        F.sum(F.length(F.regexp_replace("sequence", "[ACGT]", ""))).alias("other_letters"),
    )


def check_genome(records: DataFrame, *, max_bases: int, min_bases: int = MIN_GENOME_BASES) -> DataFrame:
    """The summary of a genome within the size bounds, an error otherwise."""
    summary = genome_summary(checked_alphabet(records, DNA_LETTERS))
    bases = F.col("bases")
    off = F.concat(F.lit("genome size out of bounds: "), bases.cast("string"))
    return summary.withColumn("bases", F.when(bases.between(min_bases, max_bases), bases).otherwise(F.raise_error(off).cast("long")))


def write_fasta(records: DataFrame, path: str, *, record_id: str = "record_id", sequence: str = "sequence", width: int = 80) -> None:
    """One text line group per record: header, then the sequence in lines of `width`."""
    wrapped = F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")
    records.select(F.concat(F.lit(">"), F.col(record_id).cast("string"), F.lit("\n"), wrapped).alias("value")).write.mode("errorifexists").text(path)
