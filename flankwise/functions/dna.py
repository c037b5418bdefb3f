"""Nucleotide and protein expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .iupac import DNA_PATTERN, col

# IUPAC letters and their complements, place by place.
COMPLEMENT_FROM = "ACGTRYSWKMBDHVN"
COMPLEMENT_TO = "TGCAYRSWMKVHDBN"

# The standard genetic code in T, C, A, G order of all three codon positions.
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ["ATG", "GTG", "TTG", "CTG", "ATT", "ATC", "ATA"]
STOP_CODONS = ["TAA", "TAG", "TGA"]
MAX_LENGTH = 2**31 - 1
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Notes that make a called gene untrustworthy.
BLOCKING_NOTES = [
    "internal_stop_codon",
    "nonstandard_residues",
    "gene_length_not_multiple_of_three",
    "no_valid_start_codon",
    "no_valid_stop_codon",
]


def normalize_dna(sequence: Column | str) -> Column:
    return F.translate(F.upper(F.regexp_replace(col(sequence), r"\s", "")), "U", "T")


def reverse_complement(sequence: Column | str) -> Column:
    """Letters outside the IUPAC alphabet pass through unchanged."""
    return F.reverse(F.translate(col(sequence), COMPLEMENT_FROM, COMPLEMENT_TO))


def reverse_complement_strict(sequence: Column | str) -> Column:
    s = normalize_dna(sequence)
    return F.when(s.rlike("^[ACGTRYSWKMBDHVN]*$"), reverse_complement(s)).otherwise(
        F.raise_error(F.concat(F.lit("unsupported DNA symbol in "), s))
    )


def is_dna(sequence: Column | str) -> Column:
    return F.coalesce(col(sequence).rlike(DNA_PATTERN), F.lit(False))


def _residue(codon: Column) -> Column:
    place = [F.instr(F.lit(CODON_BASES), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    known = codon.rlike("^[ACGT]{3}$")
    return F.when(
        known, F.substring(F.lit(CODON_RESIDUES), place[0] * 16 + place[1] * 4 + place[2] + 1, F.lit(1))
    ).otherwise(F.lit("X"))


def translate_dna(dna: Column | str) -> Column:
    """Residues of all whole codons; an unknown codon gives X, a partial one is dropped."""
    codons = F.regexp_extract_all(col(dna), F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, _residue), "")


def translate_dna_strict(dna: Column | str) -> Column:
    s = col(dna)
    clean = s.rlike("^[ACGT]*$") & (F.length(s) % 3 == 0)
    return F.when(clean, translate_dna(s)).otherwise(F.raise_error(F.lit("coding sequence is not whole ACGT codons")))


def verify_protein(
    protein: Column | str, contig: Column | str, start: Column | str, end: Column | str, strand: Column | str
) -> Column:
    """struct(verified boolean, notes array<string>) of a protein against its gene coordinates."""
    p, dna, lo, hi = col(protein), col(contig), col(start), col(end)
    sign = col(strand).cast("string")
    forward = sign.isin("1", "+")
    gene = F.substring(dna, lo, hi - lo + 1)
    coding = F.when(forward, gene).otherwise(reverse_complement(gene))
    without_stop = F.regexp_replace(translate_dna(coding), r"\*+$", "")
    starts = F.substring(coding, 1, 3).isin(START_CODONS)
    stops = F.when(F.length(coding) >= 3, F.substring(coding, -3, 3)).otherwise(coding).isin(STOP_CODONS)

    missing = p.isNull() | (p == "")
    no_place = dna.isNull() | lo.isNull() | hi.isNull() | sign.isNull()
    off_range = ~((lo >= 1) & (lo <= hi) & (hi <= F.length(dna)))
    bad_strand = ~sign.isin("1", "-1", "+", "-")
    placed = ~(no_place | off_range | bad_strand)
    same = without_stop == p
    other_start = (
        (F.length(without_stop) == F.length(p))
        & (F.substring(without_stop, 2, MAX_LENGTH) == F.substring(p, 2, MAX_LENGTH))
        & p.startswith("M")
        & starts
    )

    def note(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text))

    residue_notes = [
        note(p.contains("*"), "internal_stop_codon"),
        note(~p.rlike(f"^[{RESIDUES}]+$"), "nonstandard_residues"),
    ]
    place_note = (
        F.when(no_place, F.lit("no_genome_coordinates"))
        .when(off_range, F.lit("gene_coordinates_out_of_range"))
        .when(bad_strand, F.lit("unknown_strand"))
    )
    gene_notes = [
        note(placed & (F.length(coding) % 3 != 0), "gene_length_not_multiple_of_three"),
        note(placed & ~starts, "no_valid_start_codon"),
        note(placed & ~stops, "no_valid_stop_codon"),
    ]
    match_note = F.when(
        placed,
        F.when(same, F.lit("translation_matches_exactly"))
        .when(other_start, F.lit("translation_matches_with_alternative_start_codon"))
        .otherwise(F.lit("translation_mismatch")),
    )
    notes = F.when(missing, F.array(F.lit("protein_sequence_missing"))).otherwise(
        F.array_compact(F.array(*residue_notes, place_note, *gene_notes, match_note))
    )
    blocked = F.arrays_overlap(notes, F.array(*[F.lit(n) for n in BLOCKING_NOTES]))
    verified = F.coalesce(~missing & placed & (same | other_start) & ~blocked, F.lit(False))
    return F.struct(verified.alias("verified"), notes.alias("notes"))


def flank_motif(upstream: Column | str, downstream: Column | str, side: str, length: Column | int) -> Column:
    """The `length` flank bases next to the match, null when they are short or not ACGT."""
    n = F.lit(length) if isinstance(length, int) else length
    up, down = col(upstream), col(downstream)
    motif = F.substring(down, F.lit(1), n) if side == "downstream" else F.substring(
        up, F.greatest(F.length(up) - n + 1, F.lit(1)), n
    )
    return F.when((F.length(motif) == n) & is_dna(motif), motif)



def shuffled_letters(sequence: Column | str, seed: int, *keys: Column | str) -> Column:
    """A permutation of a sequence's letters, the same for the same seed and keys on every engine: composition is kept.

    Letters are put into the order of the digests of (seed, keys, place).
    """
    s = col(sequence)
    tag = [F.lit(str(seed)), *[col(k).cast("string") for k in keys]]
    letters = F.transform(F.split(s, ""), lambda c, i: F.struct(F.md5(F.concat_ws("-", *tag, i.cast("string"))).alias("d"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(letters), lambda x: x["c"]), "")


def random_bases(length: Column, seed: int, *keys: Column | str) -> Column:
    """ACGT letters from the digests of (seed, keys, place)."""
    tag = [F.lit(str(seed)), *[col(k).cast("string") for k in keys]]
    places = F.sequence(F.lit(0), length - 1)
    digit = lambda i: F.conv(F.substring(F.md5(F.concat_ws("-", *tag, F.lit("r"), i.cast("string"))), 1, 1), 16, 10).cast("int")
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit("ACGT"), digit(i) % 4 + 1, F.lit(1))), "")
