"""Training tables: header and target checks of the reader, and the fingerprint row of a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrix import WINDOW, logo_from_json, position_weights, training_logo

# The family and the sequence column that each model is trained on.
MODEL_DATA = {
    "cas9_full": ("Type II", "protein_sequence"),
    "cas9": ("Type II", "pid_sequence"),
    "cas12": ("Type V", "protein_sequence"),
}
TARGET_COLUMNS = ["logo_json", "pam_logo_acgt", "pam_consensus"]


def family_type(value: Column | str) -> Column:
    """II, typeii and "Type II" name one type, V likewise; other values stay as they are."""
    raw = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    short = F.regexp_replace(F.upper(F.regexp_replace(raw, " ", "")), "^TYPE(?=(II|V)$)", "")
    return F.when(short.isin("II", "V"), F.concat(F.lit("Type "), short)).otherwise(F.trim(raw))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """The table as text, column names stripped of blanks and of a byte order mark."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8", multiLine=False, quote='"', escape='"')
    return rows.toDF(*[c.replace("﻿", "").strip() for c in rows.columns])


def _text(rows: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in rows.columns else F.lit("")


def training_violations(rows: DataFrame, model: str) -> Column:
    """array<string> of what keeps a row from training this model, empty for a good row."""
    family, sequence = MODEL_DATA[model]
    logo = _text(rows, "logo_json")
    matrix = logo_from_json(logo)
    sound = F.coalesce(F.forall(matrix, lambda r: F.forall(r, lambda v: ~F.isnan(v) & (v >= 0) & (v < float("inf"))) & (
        F.aggregate(r, F.lit(0.0), lambda a, v: a + v) > 0)), F.lit(False))
    weights = F.from_json(_text(rows, "position_weights"), "array<double>")
    good = (F.size(weights) == WINDOW) & F.forall(weights, lambda v: v.isNotNull() & (v > 0) & (v < float("inf")))
    note = lambda condition, text: F.when(condition, F.lit(text))
    return F.array_compact(F.array(
        note(family_type(_text(rows, "crispr_type")) != family, "wrong_family"), note(_text(rows, sequence) == "", "empty_sequence"),
        note(reduce(lambda a, b: a & b, [_text(rows, c) == "" for c in TARGET_COLUMNS]), "missing_target"),
        note((logo != "") & ~sound, "invalid_logo"),
        note((_text(rows, "position_weights") != "") & ~F.coalesce(good, F.lit(False)), "invalid_weights"),
    ))


def training_rows(rows: DataFrame, model: str) -> DataFrame:
    """Rows with `sequence`, `target` (10 x 4) and `weights`; the first violation of a row is an error, as is a missing column."""
    sequence = MODEL_DATA[model][1]
    missing = sorted({sequence, "crispr_type"} - set(rows.columns))
    if missing:
        raise ValueError(f"training table misses columns {missing}; it has {rows.columns}")
    wrong = training_violations(rows, model)
    checked = F.when(F.size(wrong) == 0, _text(rows, sequence)).otherwise(F.raise_error(F.concat(F.lit(f"{model}: "), F.array_join(wrong, ", "))))
    return rows.select(
        "*", checked.alias("sequence"), training_logo(_text(rows, "logo_json"), _text(rows, "pam_consensus")).alias("target"),
        position_weights(_text(rows, "position_weights")).alias("weights"))


def leaked_sequences(rows: DataFrame, benchmark: DataFrame, model: str) -> DataFrame:
    """Sequences of a training table that a benchmark of the same family holds too."""
    family, sequence = MODEL_DATA[model]
    held = benchmark.where(family_type("crispr_type") == family).select(F.trim(sequence).alias("sequence"))
    return rows.select(F.trim(sequence).alias("sequence")).distinct().join(held, "sequence", "left_semi")


def training_fingerprint(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(path, sha256, rows, model_name, required_family, sequence_column, schema) of the training files below a path.

    Digests are taken of the bytes of a file; rows are counted by the reader, which splits large files.
    """
    family, sequence = MODEL_DATA[model]
    digests = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    table = read_training(spark, path)
    counted = table.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return digests.withColumn("path", bare(F.col("path"))).join(counted.withColumn("path", bare(F.col("path"))), "path", "left").select(
        "path", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(model).alias("model_name"), F.lit(family).alias("required_family"),
        F.lit(sequence).alias("sequence_column"), F.array(*[F.lit(c) for c in table.columns]).alias("schema"))
