"""Flat-file sequence records: reader, feature locations, coding sequences against their annotation, cores in references.

A record is one row. Only its own features lie in arrays; everything is an expression, so records are read, spliced and
translated where the file is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dna import CODON_BASES, CODON_RESIDUES, MAX_LENGTH, START_CODONS, reverse_complement, translate_dna
from ..functions.iupac import col

# Code tables that translate alike but for their start codons, and the join of spans.
CODE_TABLES = ["1", "11"]
SPAN = r"[<>]?\d{1,9}(?:\.\.[<>]?\d{1,9})?"
FRAMES = [0, 1, 2]


def read_genbank(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, text and the columns of `parsed_records`) of all records; files are split between records."""
    rows = spark.read.text(paths, lineSep="\n//").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parsed_records(rows.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))


def _after(text: Column, heading: str) -> Column:
    """What follows a heading line, empty where there is none."""
    return F.coalesce(F.get(F.split(text, rf"\n{heading}[^\n]*", 2), F.lit(1)), F.lit(""))


def _unquoted(value: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(value, r"\s*\n\s*", " "), r'^"|"\s*$', "")
    return F.replace(inner, F.lit('""'), F.lit('"'))


def _feature(block: Column) -> Column:
    """One feature: its kind, its location without blanks, its qualifiers in order.

    A quoted text may hold lines that look like a qualifier: a piece belongs to the one before it while a quote is open.
    """
    pieces = F.split(block, r"\n\s+/(?=\w)")
    quotes = lambda s: F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
    is_open = lambda done: F.coalesce(quotes(F.element_at(done, -1)) % 2 == 1, F.lit(False))
    joined = F.aggregate(
        F.slice(pieces, 2, F.size(pieces)), F.array().cast("array<string>"),
        lambda done, piece: F.when((F.size(done) > 0) & is_open(F.when(F.size(done) > 0, done)), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n/"), piece))
        )).otherwise(F.concat(done, F.array(piece))),
    )
    head = F.trim(F.get(pieces, F.lit(0)))
    return F.struct(
        F.regexp_extract(head, r"^(\S+)", 1).alias("kind"),
        F.regexp_replace(F.regexp_replace(head, r"^\S+", ""), r"\s", "").alias("location"),
        F.transform(joined, lambda q: F.struct(
            F.regexp_extract(q, r"^(\w+)", 1).alias("name"), _unquoted(F.regexp_replace(q, r"^\w+=?", "")).alias("value")
        )).alias("qualifiers"),
    )


def parsed_records(records: DataFrame, text: str = "text") -> DataFrame:
    """Adds record_id, declared_length, sequence (upper case) and features(kind, location, qualifiers) to record texts.

    A text without a LOCUS line is an error. Without a feature table there are no features, without an origin the
    sequence is empty.
    """
    t = F.concat(F.lit("\n"), F.regexp_replace(text, "\r", ""))
    locus = F.regexp_extract(t, r"\nLOCUS +([^\n]*)", 1)
    named = F.when(locus != "", F.regexp_extract(locus, r"^(\S+)", 1)).otherwise(F.raise_error(F.lit("a record without a LOCUS line")))
    table = F.get(F.split(_after(t, "FEATURES"), r"\n(?=[A-Z])", 2), F.lit(0))
    blocks = F.filter(F.split(table, r"\n {5}(?=\S)"), lambda b: F.trim(b) != "")
    bases = F.get(F.split(_after(t, "ORIGIN"), r"\n//", 2), F.lit(0))
    return records.select(
        *[c for c in records.columns if c != text], named.alias("record_id"),
        F.regexp_extract(locus, r"(\d+) bp", 1).try_cast("long").alias("declared_length"),
        F.upper(F.regexp_replace(bases, "[^A-Za-z]", "")).alias("sequence"), F.transform(blocks, _feature).alias("features"),
    )


def location_parts(location: Column | str) -> Column:
    """array<struct(first, last, reverse)> of a location in the order it is read, null for one that is not supported.

    Supported are single places, spans, partial ends, `join`, `complement` and their nesting. Remote places, places between
    bases, `order` and `one-of` do not say which bases follow each other.
    """
    place = col(location)
    whole = place.rlike(r"^complement\(join\(.*\)\)$")
    inner = F.when(whole, F.regexp_extract(place, r"^complement\(join\((.*)\)\)$", 1)).when(
        place.rlike(r"^join\(.*\)$"), F.regexp_extract(place, r"^join\((.*)\)$", 1)).otherwise(place)
    pieces = F.split(inner, ",")
    known = F.forall(pieces, lambda p: p.rlike(rf"^(?:{SPAN}|complement\({SPAN}\))$"))
    number = lambda p, i: F.get(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), F.lit(i)).try_cast("int")
    parts = F.transform(pieces, lambda p: F.struct(
        number(p, 0).alias("first"), F.coalesce(number(p, 1), number(p, 0)).alias("last"), p.startswith("complement").alias("reverse")))
    turned = F.transform(F.reverse(parts), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), (~p["reverse"]).alias("reverse")))
    return F.when(known & F.forall(parts, lambda p: p["last"].isNotNull()), F.when(whole, turned).otherwise(parts))


def spliced(sequence: Column | str, parts: Column | str) -> Column:
    """The bases of location parts, joined in order."""
    def bases(p: Column) -> Column:
        piece = F.substring(col(sequence), p["first"], p["last"] - p["first"] + 1)
        return F.when(p["reverse"], reverse_complement(piece)).otherwise(piece)

    return F.array_join(F.transform(col(parts), bases), "")


def _qualifier(name: str) -> Column:
    """The first value of a qualifier, null without one."""
    return F.get(F.filter("feature.qualifiers", lambda q: q["name"] == name), F.lit(0))["value"]


def coding_features(records: DataFrame, kind: str = "CDS") -> DataFrame:
    """Features of one kind with their bases, translation, agreement with the annotation and what speaks against it.

    Adds feature_number (place in its record), location, label, coding, protein, annotation, notes and verified.
    A coding sequence is verified when it is whole ACGT codons, reads without an inner stop, and equals its annotation; the
    last stop is left out, and an alternative start codon may be annotated as M.
    """
    keep = [c for c in records.columns if c not in ("features", "sequence")]
    # An outer explode: Spark gives a plain one a filter on the size of its array, moves that below and so repeats every step of the reading.
    rows = records.select(*keep, "sequence", F.posexplode_outer("features").alias("feature_number", "feature")).where(F.col("feature.kind") == kind)
    rows = rows.withColumn("parts", location_parts("feature.location")).withColumn("annotation", F.regexp_replace(_qualifier("translation"), r"\s", ""))
    size = F.length("sequence")
    inside = F.forall("parts", lambda p: (p["first"] >= 1) & (p["first"] <= p["last"]) & (p["last"] <= size))
    rows = rows.withColumn("placed", F.coalesce(inside, F.lit(False))).withColumn("all_bases", F.when(F.col("placed"), spliced("sequence", "parts")))
    shift = F.coalesce(_qualifier("codon_start").try_cast("int"), F.lit(1))
    rows = rows.withColumn("coding", F.substring("all_bases", shift, F.lit(MAX_LENGTH))).withColumn(
        "protein", F.regexp_replace(translate_dna("coding"), r"\*$", ""))
    same = F.col("protein") == F.col("annotation")
    other_start = F.col("annotation").startswith("M") & F.substring("coding", 1, 3).isin(START_CODONS) & (
        F.concat(F.lit("M"), F.substring("protein", 2, MAX_LENGTH)) == F.col("annotation"))
    note = lambda condition, text: F.when(condition, F.lit(text))
    placed = F.col("placed")
    notes = F.array_compact(F.array(
        note(F.col("parts").isNull(), "unsupported_location"), note(F.col("parts").isNotNull() & ~placed, "location_out_of_range"),
        note(placed & ~F.col("coding").rlike("^[ACGT]*$"), "not_acgt"), note(placed & (F.length("coding") % 3 != 0), "length_not_multiple_of_three"),
        note(placed & F.col("protein").contains("*"), "internal_stop_codon"),
        note(~F.coalesce(_qualifier("transl_table"), F.lit(CODE_TABLES[0])).isin(CODE_TABLES), "unsupported_code_table"),
        note(F.col("annotation").isNull(), "no_annotation"), note(placed & ~same & ~other_start, "translation_mismatch"),
    ))
    label = F.coalesce(_qualifier("label"), _qualifier("gene"), _qualifier("product"))
    return rows.select(
        *keep, "feature_number", F.col("feature.location").alias("location"), label.alias("label"), "coding", "protein", "annotation",
        notes.alias("notes"), (F.size(notes) == 0).alias("verified"))


# A residue per three base numbers: A, C, G, T as in `CODON_BASES`, 4 for anything else, which reads as X.
_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(CODON_BASES.encode(), np.uint8)] = range(4)
_RESIDUE = np.full(125, ord("X"), np.uint8)
_RESIDUE[[x * 25 + y * 5 + z for x in range(4) for y in range(4) for z in range(4)]] = np.frombuffer(CODON_RESIDUES.encode(), np.uint8)


@F.pandas_udf(T.ArrayType(T.LongType()))
def places_in(protein: pd.Series, sequence: pd.Series) -> pd.Series:
    """The first bases, counted from 1, of a protein's places in the three frames of a sequence; places of one frame do not overlap.

    The residues of all codons are looked up at once, for all frames; null for a null, none for an empty protein.
    """
    def found(protein, sequence):
        if protein is None or sequence is None:
            return None
        core, places = protein.encode(), []
        if core and len(sequence) >= 3:
            base = _BASE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
            residues = _RESIDUE[base[:-2] * 25 + base[1:-1] * 5 + base[2:]]
            for frame in FRAMES:
                reading = residues[frame::3].tobytes()
                at = reading.find(core)
                while at >= 0:
                    places.append(frame + 3 * at + 1)
                    at = reading.find(core, at + len(core))
        return places

    return pd.Series([found(p, s) for p, s in zip(protein, sequence)], dtype=object)


def core_places(cores: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Cores (keys, protein) found in the three frames of the references (keys, sequence) with the same keys.

    Gives (keys, frame, first, last), base places counted from 1 with both ends in, one row per place; places of one
    frame do not overlap. Unknown bases read as X.
    """
    wanted = cores.select(*keys, "protein").where("protein <> ''").distinct()
    return listed_places(references.select(*keys, "sequence").join(wanted, keys).withColumn("places", places_in("protein", "sequence")), keys)


def listed_places(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, first, last) of rows (keys, protein, places), a row per place."""
    rows = found.select(*keys, F.length("protein").alias("_n"), F.explode("places").alias("first"))
    return rows.select(*keys, ((F.col("first") - 1) % 3).cast("int").alias("frame"), "first", (F.col("first") + 3 * F.col("_n") - 1).cast("long").alias("last"))


def core_verdict(cores: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Per core: places in its reference, the first of them, and `unique`, `absent` or `repeated`."""
    counted = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("places"), F.min("first").alias("first"))
    n = F.coalesce("places", F.lit(0))
    return cores.select(*keys).distinct().join(counted, keys, "left").select(
        *keys, n.cast("long").alias("places"), "first",
        F.when(n == 1, F.lit("unique")).when(n == 0, F.lit("absent")).otherwise(F.lit("repeated")).alias("verdict"))


def residues_at(protein: Column | str, positions: list[int]) -> Column:
    """The residues at positions counted from 1, joined."""
    return F.concat(*[F.substring(col(protein), p, 1) for p in positions])
