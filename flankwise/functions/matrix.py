"""Position-probability matrices: array<array<double>> with A, C, G, T columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .iupac import BASES, SYMBOL_BY_MASK, col, masks, normalize_motif

# Window width and the thresholds the scores are defined with.
WINDOW = 10
CONSENSUS_BITS = 0.70
SIGNAL_BITS = 0.15
LEVEL_LOW = 0.010
LEVEL_MED = 0.063
MIN_NOVELTY = 0.30
TINY = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def settled(value: Column) -> Column:
    """Billionths of a score as a whole number, so that scores equal but for the order of addition compare as equal.

    The offset keeps exact halves away from the rounding edge.
    """
    return F.floor(value * 1e9 + 0.5003)


def normalize_rows(matrix: Column | str) -> Column:
    """Rows scaled to sum 1; null unless 10x4, finite, non-negative with positive row sums."""
    m = col(matrix)
    row_ok = lambda r: (
        (F.size(r) == 4)
        & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
        & (total(r) > 0)
    )
    ok = (F.size(m) == WINDOW) & F.forall(m, lambda r: F.coalesce(row_ok(r), F.lit(False)))
    return F.when(ok, F.transform(m, lambda r: F.transform(r, lambda v: v / total(r))))


def entropy(row: Column) -> Column:
    return -total(F.transform(row, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))))


def row_bits(row: Column) -> Column:
    return F.lit(2.0) - entropy(row)


def information_stats(matrix: Column | str) -> Column:
    """struct(entropy, bits, mean_bits, signal_positions) of a normalised matrix."""
    m = col(matrix)
    bits = F.transform(m, row_bits)
    signal = F.filter(F.transform(bits, lambda b, i: F.when(b >= SIGNAL_BITS, i + 1)), lambda i: i.isNotNull())
    strong = F.filter(bits, lambda b: b >= SIGNAL_BITS)
    return F.struct(
        F.transform(m, entropy).alias("entropy"),
        bits.alias("bits"),
        F.try_divide(total(bits), F.size(bits)).alias("mean_bits"),
        F.coalesce(F.try_divide(total(strong), F.size(strong)), F.try_divide(total(bits), F.size(bits))).alias("mean_signal_bits"),
        signal.alias("signal_positions"),
    )


def probability_to_information(matrix: Column | str) -> Column:
    """p * sum_j p_j (ln(p_j + 1e-12) + ln 4) / ln 2, cell by cell."""
    def row(r: Column) -> Column:
        content = total(F.transform(r, lambda p: p * (F.ln(p + TINY) + F.ln(F.lit(4.0))))) / F.ln(F.lit(2.0))
        return F.transform(r, lambda p: p * content)
    return F.transform(col(matrix), row)


def signed_information(matrix: Column | str) -> Column:
    """Per-cell p (log2 p + 2), 0 for p <= 0. Differs from `probability_to_information` on purpose."""
    return F.transform(
        col(matrix), lambda r: F.transform(r, lambda p: F.when(p > 0, p * (F.log2(p) + 2.0)).otherwise(F.lit(0.0)))
    )


def base_at(index: Column) -> Column:
    return F.substring(F.lit(BASES), index, F.lit(1))


def _peak_or_n(row: Column) -> Column:
    peak = F.array_max(row)
    return F.when(peak < CONSENSUS_BITS, F.lit("N")).otherwise(base_at(F.array_position(row, peak).cast("int")))


def consensus_from_information(info: Column | str, side: Column | str) -> Column:
    """Strongest base per position, N below 0.70 bit, with the N run away from the target trimmed."""
    raw = F.array_join(F.transform(col(info), _peak_or_n), "")
    s = F.lit(side) if isinstance(side, str) and side in ("downstream", "upstream") else col(side)
    return F.when(s == "downstream", F.regexp_replace(raw, "N+$", "")).otherwise(F.regexp_replace(raw, "^N+", ""))


def resolution_status(consensus: Column | str) -> Column:
    c = col(consensus)
    return F.when(c == "", F.lit("unresolved")).when(c.contains("N"), F.lit("partial")).otherwise(F.lit("resolved"))


def probability_consensus(matrix: Column | str, floor: float = SIGNAL_BITS) -> Column:
    """Bases with p >= max(0.25, max/2) as one IUPAC letter per position, N below the bit floor."""
    def symbol(r: Column) -> Column:
        cut = F.greatest(F.lit(0.25), F.array_max(r) / 2.0)
        mask = sum(
            (F.when(F.get(r, F.lit(i)) >= cut, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(4)), F.lit(0)
        )
        return F.when((row_bits(r) < floor) | (mask == 0), F.lit("N")).otherwise(
            F.substring(F.lit(SYMBOL_BY_MASK), mask, F.lit(1))
        )
    return F.array_join(F.transform(col(matrix), symbol), "")


def allowed_mass(mask: Column, row: Column) -> Column:
    """Sum of the row over the bases in the mask."""
    return sum(
        (F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.get(row, F.lit(i))).otherwise(F.lit(0.0)) for i in range(4)),
        F.lit(0.0),
    )


def candidate_window(length: Column, side: Column) -> Column:
    """1-based first matrix row of a candidate of that length."""
    return F.when(side == "downstream", F.lit(1)).otherwise(F.lit(WINDOW) - length + 1)


def score_candidate(matrix: Column | str, motif: Column | str, side: Column | str) -> Column:
    """Score a motif against a normalised matrix.

    struct(informative_positions, geomean, score, bits); the last three are null
    for a motif without an informative position, for an invalid motif and for a
    length outside the window.
    """
    m = col(matrix)
    s = F.lit(side) if isinstance(side, str) and side in ("downstream", "upstream") else col(side)
    letters = masks(motif)
    length = F.size(letters)
    usable = (length >= 1) & (length <= WINDOW) & F.forall(letters, lambda x: x > 0)
    rows = F.slice(m, candidate_window(length, s), length)

    def position(mask: Column, row: Column) -> Column:
        n = F.bit_count(mask).cast("double")
        mass = allowed_mass(mask, row)
        base = n / 4.0
        support = F.when(mass >= base, F.try_divide(mass - base, 1.0 - base)).otherwise((mass - base) / base)
        return F.when(
            n < 4,
            F.struct(
                F.log2(F.lit(4.0) / n).alias("w"),
                support.alias("s"),
                F.log2(F.greatest(mass, F.lit(TINY)) / base).alias("e"),
                F.ln(F.greatest(mass, F.lit(TINY))).alias("g"),
            ),
        )

    scored = F.filter(F.zip_with(letters, rows, position), lambda x: x.isNotNull())
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("w", "sw", "ew", "g", "n")])
    sums = F.aggregate(
        scored,
        zero,
        lambda acc, x: F.struct(
            (acc["w"] + x["w"]).alias("w"),
            (acc["sw"] + x["s"] * x["w"]).alias("sw"),
            (acc["ew"] + x["e"] * x["w"]).alias("ew"),
            (acc["g"] + x["g"]).alias("g"),
            (acc["n"] + 1.0).alias("n"),
        ),
    )
    return F.when(
        usable & m.isNotNull(),
        F.transform(
            F.array(sums),
            lambda t: F.struct(
                t["n"].cast("int").alias("informative_positions"),
                F.when(t["n"] > 0, F.exp(t["g"] / t["n"])).alias("geomean"),
                F.when(t["n"] > 0, 50.0 * (t["sw"] / t["w"] + 1.0)).alias("score"),
                F.when(t["n"] > 0, t["ew"] / t["w"]).alias("bits"),
            ),
        )[0],
    )


def as_frequencies(matrix: Column | str, units: str = "prob") -> Column:
    """Matrix in probabilities or bits to per-position frequencies; an all-zero row stays zero."""
    m = col(matrix)
    if units == "bits":
        m = F.transform(m, lambda r: F.transform(
            r, lambda v: F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), v)) * F.ln(F.lit(2.0)))
        ))
    floor = F.transform(m, lambda r: F.transform(r, lambda v: F.greatest(v, F.lit(0.0))))
    return F.transform(floor, lambda r: F.transform(r, lambda v: F.when(total(r) == 0, v).otherwise(v / total(r))))


def reliability(matrix: Column | str, neighbour_similarity: Column | str, units: str = "prob", model: Column | None = None) -> Column:
    """Level, confidence and per-position detail of a predicted matrix."""
    freqs = as_frequencies(matrix, units)
    bits = F.transform(freqs, row_bits)
    weak = F.filter(F.transform(bits, lambda b, i: F.when(b < CONSENSUS_BITS, i + 1)), lambda i: i.isNotNull())
    consensus = F.array_join(
        F.zip_with(freqs, bits, lambda r, b: F.when(
            b >= CONSENSUS_BITS, base_at(F.array_position(r, F.array_max(r)).cast("int"))
        ).otherwise(F.lit("N"))),
        "",
    )
    signal = F.filter(bits, lambda b: b >= SIGNAL_BITS)
    used = F.when(F.size(signal) > 0, signal).otherwise(bits)
    mean_of = lambda a: F.coalesce(F.try_divide(total(a), F.size(a)), F.lit(0.0))
    novelty = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(neighbour_similarity)))
    confidence = mean_of(used) / 2.0 * novelty
    level = (
        F.when((confidence <= LEVEL_LOW) | (novelty < MIN_NOVELTY), F.lit("low"))
        .when(confidence <= LEVEL_MED, F.lit("med"))
        .otherwise(F.lit("high"))
    )
    side = F.when(F.lower(F.coalesce(model, F.lit(""))).contains("cas9"), F.lit("downstream")).otherwise(
        F.lit("upstream")
    ) if model is not None else F.lit("upstream")
    notes = F.array_compact(F.array(
        F.when(F.size(weak) == 0, F.lit("all positions resolved")).otherwise(
            F.concat(F.size(weak).cast("string"), F.lit(" weak position(s) at ["),
                     F.array_join(F.transform(weak, lambda i: i.cast("string")), ", "), F.lit("]"))
        ),
        F.when(novelty < 0.60, F.lit("input protein is out-of-domain (low training similarity) -> downweighted")),
        F.concat(F.lit("assumed PAM side: "), side),
    ))
    return F.struct(
        level.alias("level"),
        confidence.alias("confidence"),
        F.transform(freqs, entropy).alias("entropy"),
        bits.alias("bits"),
        mean_of(bits).alias("mean_bits"),
        weak.alias("weak_positions"),
        consensus.alias("consensus"),
        col(neighbour_similarity).alias("neighbour_similarity"),
        novelty.alias("novelty_weight"),
        notes.alias("notes"),
    )


def flat_cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine of two vectors; null on different shapes or a zero norm."""
    a, b = col(left), col(right)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def matrix_cosine(left: Column | str, right: Column | str) -> Column:
    return F.coalesce(flat_cosine(F.flatten(col(left)), F.flatten(col(right))), F.lit(0.0))


def vector_change(value: Column | str, reference: Column | str) -> Column:
    """struct(l2, relative_l2, cosine, max_abs) of a vector against its reference."""
    a, b = col(value), col(reference)
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    l2 = F.sqrt(total(F.transform(diff, lambda d: d * d)))
    ref = F.sqrt(total(F.transform(b, lambda y: y.cast("double") * y.cast("double"))))
    return F.struct(
        l2.alias("l2"),
        F.try_divide(l2, ref).alias("relative_l2"),
        flat_cosine(a, b).alias("cosine"),
        F.array_max(F.transform(diff, lambda d: F.abs(d))).alias("max_abs"),
    )


def matrix_from_bases(by_base: Column | str, positions: Column | int = WINDOW, pad: bool = True) -> Column:
    """map<base, array<double>> to position x base rows, zero-padded to the window when asked."""
    m = col(by_base)
    n = F.lit(positions) if isinstance(positions, int) else positions
    rows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.array(*[F.coalesce(F.get(F.element_at(m, F.lit(b)), i), F.lit(0.0)) for b in BASES]),
    )
    if not pad:
        return rows
    zero = F.array_repeat(F.array(*[F.lit(0.0)] * 4), WINDOW)
    return F.slice(F.concat(rows, zero), 1, WINDOW)


def logo_from_json(text: Column | str) -> Column:
    """JSON 10x4 text to a matrix, null when it has another shape."""
    m = F.from_json(col(text), "array<array<double>>")
    ok = (F.size(m) == WINDOW) & F.forall(
        m, lambda r: F.coalesce((F.size(r) == 4) & F.forall(r, lambda v: v.isNotNull()), F.lit(False))
    )
    return F.when(ok, m)


def logo_to_json(matrix: Column | str) -> Column:
    return F.to_json(col(matrix))


def valid_logo(text: Column | str) -> Column:
    return F.coalesce(logo_from_json(text).isNotNull(), F.lit(False))


def training_logo(logo_text: Column | str, motif: Column | str) -> Column:
    """Normalised logo, uniform for zero rows; without a usable logo the motif's base sets stand in."""
    uniform = F.array(*[F.lit(0.25)] * 4)
    logo = logo_from_json(logo_text)
    logo = F.when(F.forall(logo, lambda r: F.forall(r, lambda v: ~F.isnan(v) & (v >= 0) & (v < float("inf")))), logo)
    from_logo = F.transform(
        logo, lambda r: F.when(total(r) > 0, F.transform(r, lambda v: v / total(r))).otherwise(uniform)
    )
    spread_row = lambda m: F.when(m == 0, uniform).otherwise(F.array(*[
        F.when(m.bitwiseAND(F.lit(1 << i)) > 0, F.lit(1.0) / F.bit_count(m)).otherwise(F.lit(0.0)) for i in range(4)
    ]))
    rows = F.transform(F.coalesce(masks(normalize_motif(motif)), F.array().cast("array<int>")), spread_row)
    from_motif = F.slice(F.concat(rows, F.array_repeat(uniform, WINDOW)), 1, WINDOW)
    return F.coalesce(from_logo, from_motif)


def position_weights(text: Column | str) -> Column:
    """Ten positive weights from JSON, ones when blank, an error otherwise."""
    raw = F.trim(F.coalesce(col(text), F.lit("")))
    values = F.from_json(raw, "array<double>")
    ok = (F.size(values) == WINDOW) & F.forall(values, lambda v: v.isNotNull() & (v > 0) & (v < float("inf")))
    return (
        F.when(raw == "", F.array_repeat(F.lit(1.0), WINDOW))
        .when(ok, values)
        .otherwise(F.raise_error(F.lit("position weights must be ten finite positive numbers")).cast("array<double>"))
    )
