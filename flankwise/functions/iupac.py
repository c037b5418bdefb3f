"""IUPAC motifs as 4-bit base masks (A=1, C=2, G=4, T=8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbol at 1-based place m stands for the base set with mask m.
SYMBOL_BY_MASK = "ACMGRSVTWYHKDBN"
BASES = "ACGT"
MOTIF_PATTERN = "^[ACGTRYSWKMBDHVN]+$"
DNA_PATTERN = "^[ACGT]+$"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def chars(text: Column | str) -> Column:
    return F.filter(F.split(col(text), ""), lambda c: c != "")


def symbol_mask(symbol: Column) -> Column:
    """Mask of one symbol, 0 when it is not an IUPAC letter."""
    return F.instr(F.lit(SYMBOL_BY_MASK), symbol)


def masks(motif: Column | str) -> Column:
    return F.transform(chars(normalize_motif(motif)), symbol_mask)


def mask_symbol(mask: Column) -> Column:
    return F.substring(F.lit(SYMBOL_BY_MASK), mask, F.lit(1))


def normalize_motif(motif: Column | str) -> Column:
    return F.upper(F.trim(col(motif)))


def valid_motif(motif: Column | str) -> Column:
    return F.coalesce(normalize_motif(motif).rlike(MOTIF_PATTERN), F.lit(False))


def _all_positions(left: Column, right: Column, test) -> Column:
    return (F.size(left) == F.size(right)) & (F.size(left) > 0) & F.forall(
        F.zip_with(left, right, test), lambda ok: F.coalesce(ok, F.lit(False))
    )


def is_subset(motif: Column | str, of: Column | str) -> Column:
    """Every base set of `motif` lies inside the one of `of` (not the other way round)."""
    return _all_positions(
        masks(motif), masks(of),
        lambda a, b: (a > 0) & (b > 0) & (a.bitwiseAND(F.bitwise_not(b)) == 0),
    )


def motifs_overlap(left: Column | str, right: Column | str) -> Column:
    return _all_positions(masks(left), masks(right), lambda a, b: a.bitwiseAND(b) > 0)


def concrete_matches(sequence: Column | str, motif: Column | str) -> Column:
    """A concrete ACGT string of the motif's length with every base allowed."""
    return F.coalesce(normalize_motif(sequence).rlike(DNA_PATTERN), F.lit(False)) & is_subset(sequence, motif)


def information(motif: Column | str) -> Column:
    """Mean of 2 - log2(set size) over the positions."""
    bits = F.transform(masks(motif), lambda m: 2.0 - F.log2(F.bit_count(m).cast("double")))
    return F.try_divide(F.aggregate(bits, F.lit(0.0), lambda acc, b: acc + b), F.size(bits))


def expansion_size(motif: Column | str) -> Column:
    return F.aggregate(masks(motif), F.lit(1).cast("long"), lambda acc, m: acc * F.bit_count(m).cast("long"))


#: Letters of a motif that a join key looks at, and letters in one packed integer.
WINDOW = 8
PACKED = 15
HEX_BY_MASK = "123456789ABCDEF"


def packed_masks(motif: Column | str) -> Column:
    """Four bits per letter, PACKED letters per integer: a set of bases as bits, so that subsets are one AND per integer."""
    digits = F.translate(normalize_motif(motif), SYMBOL_BY_MASK, HEX_BY_MASK)
    pieces = F.regexp_extract_all(digits, F.lit(f".{{1,{PACKED}}}"), F.lit(0))
    return F.transform(pieces, lambda p: F.conv(p, 16, 10).cast("long"))


def set_sizes(motif: Column | str) -> Column:
    """The number of bases allowed at each place, a digit per letter."""
    return F.translate(normalize_motif(motif), SYMBOL_BY_MASK, "".join(str(m.bit_count()) for m in range(1, 16)))


def packed_subset(inner: Column | str, outer: Column | str) -> Column:
    """Every base set of one packed motif lies inside the one of the other, both of one length."""
    return F.forall(F.zip_with(col(inner), col(outer), lambda a, b: a.bitwiseAND(b) == a), lambda ok: ok)


def key_window(motif: Column | str) -> Column:
    """struct(at, shape): where the WINDOW letters that say most begin, and of these `x` where at most two bases are allowed, else `.`."""
    motif = normalize_motif(motif)
    said = F.transform(masks(motif), lambda m: F.greatest(F.lit(3) - F.bit_count(m), F.lit(0)))
    starts = F.sequence(F.lit(1), F.greatest(F.length(motif) - WINDOW + 1, F.lit(1)))
    valued = F.transform(starts, lambda at: F.struct(
        (-F.aggregate(F.slice(said, at, F.lit(WINDOW)), F.lit(0), lambda s, x: s + x)).alias("said"), at.alias("at")))
    at = F.array_min(valued)["at"]
    shape = F.translate(F.regexp_replace(F.substring(motif, at, F.lit(WINDOW)), "[NBDHV]", "."), "ACGTRYSWKM", "x" * 10)
    return F.struct(at.alias("at"), shape.alias("shape"))


def restricted_keys(motif: Column | str) -> Column:
    """All spellings of a motif of few letters with `.` left where more than two bases are allowed."""
    choices = F.transform(
        masks(motif),
        lambda m: F.when(F.bit_count(m) > 2, F.array(F.lit("."))).otherwise(
            F.filter(
                F.transform(
                    F.array(*[F.struct(F.lit(b).alias("b"), F.lit(1 << i).alias("bit")) for i, b in enumerate(BASES)]),
                    lambda s: F.when(m.bitwiseAND(s["bit"]) > 0, s["b"]),
                ),
                lambda b: b.isNotNull(),
            )
        ),
    )
    return F.aggregate(
        choices,
        F.array(F.lit("")),
        lambda acc, opts: F.flatten(F.transform(acc, lambda head: F.transform(opts, lambda b: F.concat(head, b)))),
    )


def augmented_matrix(motif: Column | str) -> Column:
    """10 rows of A, C, G, T weight plus an ambiguity cell; absent positions are zero rows."""
    def row(m: Column) -> Column:
        n = F.bit_count(m).cast("double")
        share = F.when(n == 4, F.lit(0.0)).otherwise(F.lit(2.0) / n)
        cells = [F.when(m.bitwiseAND(F.lit(1 << i)) > 0, share).otherwise(F.lit(0.0)) for i in range(4)]
        spare = F.when(n == 1, F.lit(0.0)).when(n == 4, F.lit(1.0)).otherwise(2.0 * (1.0 - 1.0 / n))
        return F.array(*cells, spare)
    padding = F.array_repeat(F.array(*[F.lit(0.0)] * 5), 10)
    return F.slice(F.concat(F.transform(masks(motif), row), padding), 1, 10)
