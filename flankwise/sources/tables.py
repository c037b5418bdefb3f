"""TSV, JSON and candidate-list readers and the matching writers."""

from __future__ import annotations

import json
import os
from html import escape

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iupac import valid_motif
from ..operators.candidates import listed_candidates
from ..operators.contract import DOCUMENT_SCHEMA, SYSTEM_SCHEMA
from .committed import write_committed

CANDIDATE_COLUMNS = ["candidate_pam", "pam", "pam_consensus"]


def read_tsv(spark: SparkSession, path: str, required: list[str] = []) -> DataFrame:
    """Header-named TSV with every column a string; missing required columns are an error."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return rows.fillna("")


def optional_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV with these columns, or an empty table of them where an annotator left no file: it writes none without findings."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return read_tsv(spark, path, columns)


def filled_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A few columns of the rows in which all of them are filled, each combination once."""
    rows = rows.select(*columns)
    for c in columns:
        rows = rows.where(F.coalesce(F.trim(c), F.lit("")) != "")
    return rows.distinct()


def exactly_one(rows: DataFrame, what: str) -> DataFrame:
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"{what}: expected one row, found {'none' if n == 0 else 'several'}")
    return rows


def corpus_files(spark: SparkSession, paths: list[str], sequence: str = "protein_sequence", accession: str = "protein_id") -> DataFrame:
    """(file, row_id, sequence, accession) of several corpus TSVs read together."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(paths)
    return rows.select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row_id"),
        F.upper(F.trim(sequence)).alias("sequence"), F.col(accession).alias("accession"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One manifest document with its nested systems."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True)


def manifest_systems(document: DataFrame) -> DataFrame:
    return document.select(F.explode("systems").alias("s")).select("s.*")


def read_systems(spark: SparkSession, path: str) -> DataFrame:
    """One manifest system per JSON line: the form for many systems."""
    return spark.read.schema(SYSTEM_SCHEMA).json(path)


CASE_SCHEMA = (
    "case_id string, system_id string, candidate_pams array<string>, pam_side string, pam_length int, max_mismatches int, "
    "spacer_orientation string, orientation_evidence string, gold_pam_spectrum array<string>, "
    "protein struct<fasta:string,record_id:string,model:string>, spacers struct<fasta:string>, targets array<string>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)


def case_violations(cases: DataFrame) -> DataFrame:
    """(case_id, problem): required fields, one motif width, declared orientation with its evidence."""
    c = F.col
    blank = lambda f: F.coalesce(F.trim(c(f).cast("string")), F.lit("")) == ""
    problems = F.array_compact(F.array(
        *[F.when(blank(f), F.lit(f"missing {f}")) for f in ("case_id", "system_id", "pam_side", "pam_length", "max_mismatches")],
        F.when(F.coalesce(F.size("candidate_pams"), F.lit(-1)) <= 0, F.lit("missing candidate_pams")),
        F.when(F.size(F.array_distinct(F.transform("candidate_pams", F.length))) > 1, F.lit("candidates of mixed width")),
        F.when(F.exists("candidate_pams", lambda m: F.length(m) != c("pam_length")), F.lit("candidate width differs from pam_length")),
        F.when(F.exists("candidate_pams", lambda m: ~valid_motif(m)), F.lit("invalid candidate")),
        F.when(~F.coalesce(c("spacer_orientation").isin("forward", "reverse"), F.lit(False)), F.lit("spacer_orientation undeclared")),
        F.when(blank("orientation_evidence"), F.lit("orientation without evidence")),
    ))
    return cases.select("case_id", F.explode(problems).alias("problem"))


def read_candidates(spark: SparkSession, inline: list[str] = [], path: str | None = None, *, strict: bool = True) -> DataFrame:
    """(candidate_pam, position) from a list and a plain or TSV file, first occurrences; invalid motifs fail when strict."""
    parts = []
    if inline:
        parts.append(spark.createDataFrame([(v, i) for i, v in enumerate(inline)], "value string, position long"))
    if path:
        lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id() + len(inline))
        header = (spark.read.text(path).first() or [""])[0].split("\t")
        named = next((c for c in CANDIDATE_COLUMNS if c in header), None)
        if named:
            at = header.index(named)
            lines = lines.where(F.col("value") != "\t".join(header)).withColumn("value", F.coalesce(F.get(F.split("value", "\t"), F.lit(at)), F.lit("")))
        parts.append(lines.select("value", "position"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if strict:
        used = ~F.trim("value").startswith("#") & (F.trim("value") != "")
        bad = F.concat(F.lit("invalid motif "), F.col("value"))
        rows = rows.withColumn("value", F.when(~used | valid_motif("value"), F.col("value")).otherwise(F.raise_error(bad)))
    return listed_candidates(rows)


def six_digits(value: Column) -> Column:
    """Doubles in the %.6g form; null becomes empty text."""
    return F.coalesce(F.when(value.isNotNull(), F.format_string("%.6g", value)), F.lit(""))


def write_tsv(rows: DataFrame, path: str, columns: list[str] | None = None, *, allow_empty: bool = True) -> None:
    """Header and tab-separated rows in part files; nested or missing values are for the caller to flatten.

    A table that is there already is accepted when its rows are the same, and refused otherwise (`sources/committed.py`).
    """
    write_committed(rows.select(*(columns or rows.columns)), path, sep="\t", allow_empty=allow_empty)


def write_union_tsv(tables: list[DataFrame], path: str) -> None:
    """Tables with different columns under the union of their columns, first seen first."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    write_tsv(rows, path)


def write_candidates_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Contract columns as text; an unavailable value is an empty cell, never 0."""
    have = set(rows.columns)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    write_committed(rows.select(*[cell(c).alias(c) for c in columns]), path, sep=",")


def write_once(rows: DataFrame, path: str) -> None:
    """Write as tab-separated text, or accept an existing table with the same rows; different content is refused."""
    write_committed(rows, path, sep="\t")


def _shown(value: Column, kind: str) -> Column:
    """Text of a report cell; unknown values are n/a, doubles have three digits."""
    text = F.format_string("%.3f", value) if kind in ("double", "float") else value.cast("string")
    return F.when(value.isNull(), F.lit("n/a")).otherwise(text)


def _escaped(text: Column) -> Column:
    """Text safe inside HTML."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def markdown_rows(summary: DataFrame) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[_shown(F.col(c), t) for c, t in summary.dtypes]), F.lit(" |\n"))


def html_rows(summary: DataFrame) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _escaped(F.coalesce(F.col(c).cast("string"), F.lit("n/a"))), F.lit("</td>")) for c in summary.columns], F.lit("</tr>\n"))


def write_report(rows: DataFrame, fragment: Column, path: str, order: list[str], head: str = "", tail: str = "", between: str = "") -> int:
    """One report file from one text fragment per row, in the order of `order`; the number of rows.

    Fragments are rendered where the rows are and ordered by ranges. The driver streams one partition after the other into
    the file and holds one partition at a time, whose size the session's shuffle partitions bound.
    """
    system, name = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    ordered = rows.select(fragment.alias("_fragment"), *order).orderBy(*order).select("_fragment")
    n = 0
    with system.open_output_stream(name) as out:
        out.write(head.encode())
        for row in ordered.toLocalIterator():
            if n and between:
                out.write(between.encode())
            out.write(row[0].encode())
            n += 1
        out.write(tail.encode())
    return n


def markdown_report(summary: DataFrame, path: str, order: list[str]) -> int:
    """Markdown table with n/a for unknown values."""
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns) + "\n"
    return write_report(summary, markdown_rows(summary), path, order, head)


def html_report(summary: DataFrame, path: str, order: list[str], title: str, notes: str = "", nothing: str = "") -> int:
    """A page with one table; `notes` is markup above it, `nothing` the text of the one row of an empty table."""
    cells = "".join(f"<th>{escape(c)}</th>" for c in summary.columns)
    head = f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title>{notes}<table><tr>{cells}</tr>\n"
    empty = f'<tr><td colspan="{len(summary.columns)}">{escape(nothing)}</td></tr>' if nothing and summary.isEmpty() else ""
    return write_report(summary, html_rows(summary), path, order, head + empty, "</table>")


def json_report(summary: DataFrame, path: str, order: list[str], fields: dict | None = None, name: str = "rows") -> int:
    """A JSON document: `fields`, then the rows as an array under `name`; null stays null."""
    head = json.dumps(fields or {}, ensure_ascii=False)[:-1] + (", " if fields else "") + json.dumps(name) + ": [\n"
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return write_report(summary.select("*", row.alias("_json")), F.col("_json"), path, order, head, "\n]}\n", ",\n")


# Presentation texts of a candidate report.
NO_CLEAR_MOTIF = "未得到明确 PAM。请勿把本次结果当作该 Cas9 的生物学 PAM，也不要把占位符当作候选筛选成功。可在明确候选集合下重跑。"
NO_CANDIDATE_ROWS = "没有候选行：模型没有给出可评分的明确 PAM。这不是生物学 PAM 结论，也不代表候选筛选成功。"
REPORT_COLUMNS = ["candidate_pam", "protein_score", "rank_within_length", "spacer_score", "effective_spacers", "support_spacers",
                  "support_target_contigs", "status"]


def candidate_report(candidates: DataFrame, proteins: DataFrame, folder: str, *, model: str, limitations: list[str], scope_note: str | None = None) -> dict:
    """The report of a run: report.json, candidates.tsv and report.html in `folder`; its summary fields.

    candidates: rows with REPORT_COLUMNS (`report_candidates`); proteins: (protein_id, predicted_pam, partial_consensus,
    determined_positions, no_clear_pam), the few proteins of the run. "No clear motif" is said of the proteins, not of the number of rows: a
    partial consensus gives no candidate rows and still has determined positions.
    """
    found = [r.asDict() for r in proteins.limit(MAX_REPORT_PROTEINS + 1).collect()]
    if len(found) > MAX_REPORT_PROTEINS:
        raise ValueError(f"a report is of at most {MAX_REPORT_PROTEINS} proteins")
    partial = [p["predicted_pam"] for p in found if p["partial_consensus"]]
    rows = candidates.select(*REPORT_COLUMNS)
    fields = {
        "format_version": 1, "model": model, "proteins": found, "training_exposure": "unknown", "limitations": limitations,
        "no_clear_pam": any(p["no_clear_pam"] for p in found), "no_candidate_rows": rows.isEmpty(), "partial_consensus": partial,
        "candidate_scope_note": scope_note,
    }
    order = ["rank_within_length", "candidate_pam"]
    json_report(rows, f"{folder}/report.json", order, fields, "candidates")
    cells = F.concat(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REPORT_COLUMNS]), F.lit("\n"))
    write_report(rows, cells, f"{folder}/candidates.tsv", order, "\t".join(REPORT_COLUMNS) + "\n")
    notes = f"<aside class=warn>{NO_CLEAR_MOTIF}</aside>" if fields["no_clear_pam"] else ""
    notes += "".join(f"<p>{escape(text)}</p>" for text in (model, scope_note, *partial, *limitations) if text)
    html_report(rows, f"{folder}/report.html", order, model, notes, NO_CANDIDATE_ROWS)
    return fields


# Proteins that one report document lists.
MAX_REPORT_PROTEINS = 1000
