"""Worksheets as long rows (sheet_id, row, cells array<string>): find headers, read tables and matrices.

What identifies a table sits in a sheet's first rows; it is reduced to one small
row per sheet and joined back to the data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.iupac import BASES
from ..functions.matrix import matrix_from_bases, signed_information
from ..functions.text import optional_double

# Header names of semantic columns, in order of preference.
PAM_HEADERS = ["pam", "pam sequence", "pam_sequence", "pam consensus", "protospacer adjacent motif",
               "target adjacent motif", "target adjancent motif", "tam"]
PAM_PREFIXES = ["degenerate consensus", "degenerate_consensus"]
SEQUENCE_HEADERS = ["protein sequence", "protein_sequence", "amino acid sequence", "aa sequence", "sequence (aa)", "protein amino acid"]
ORGANISM_HEADERS = ["species", "organism", "strain", "source", "host", "bacterial strain", "organism/strain"]
NAME_HEADERS = ["protein", "protein name", "effector", "effector protein", "nuclease", "cas protein", "cas ortholog",
                "ortholog", "key name", "name"]
TARGET_HEADERS = ["target", "target gene", "target id", "target_id"]
# Keywords of column roles.
PAM_KEYS = ["pam", "protospacer adjacent", "consensus pam", "pam consensus"]
PREDICTED_KEYS = ["predicted pam", "pam prediction", "pred pam", "pam pred", "iupac pam seq", "inferred pam", "machine learning"]
ORGANISM_KEYS = ["organism", "strain", "species", "host", "source organism", "source_strain", "bacter", "host strain"]
PROTEIN_KEYS = ["aa sequence", "amino acid", "protein sequence", "aa_seq", "cas9 aa", "cas12 aa", "effector protein", "amino acid seq"]
REPEAT_KEYS = ["repeat"]
GUIDE_KEYS = ["sgrna", "guide rna", "grna", "crrna", "tracrrna", "tracr"]
NAME_KEYS = ["abrev", "abbrev", "name", "ortholog", "effector", "nuclease", "uniprot"]
# Labels of read-count tables and base rows.
READCOUNT_MARKERS = ["read counts", "normalized read counts", "enrichment", "depletion"]
SELECTED_LABELS = ["bound", "cut", "cleaved", "selected", "enriched"]
BASE_NAMES = {"a": "A", "c": "C", "g": "G", "t": "T", "u": "T", "adenine": "A", "cytosine": "C", "guanine": "G", "thymine": "T"}
HEADER_ROWS = 20
POSITIONS = 10


def trimmed(cells: Column | str) -> Column:
    return F.transform(F.col(cells) if isinstance(cells, str) else cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))


def header_key(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def find_column(cells: Column, names: list[str], prefixes: list[str] = []) -> Column:
    """0-based column with one of the names (the last of equals), else by guarded prefix; null when none fits."""
    keys = F.transform(cells, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    last = lambda key: F.size(keys) - F.array_position(F.reverse(keys), key)
    options = []
    for key in dict.fromkeys(header_key(n) for n in names):
        options.append(F.when(F.array_contains(keys, key), last(F.lit(key))))
    for key in dict.fromkeys(header_key(p) for p in prefixes):
        fits = F.filter(keys, lambda h: (h != "") & (h.startswith(key) | ((F.length(h) >= 8) & F.lit(key).startswith(h))))
        options.append(F.when(F.size(fits) > 0, last(F.get(fits, F.lit(0)))))
    return F.coalesce(*options).cast("int")


def plain_word(cell: Column) -> Column:
    return ~cell.rlike("[_0-9]") & (F.length(F.regexp_replace(cell, r"[^\p{L}]", "")) >= 4)


def clean_motif(cell: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(cell), "^[\"']+|[\"']+$", ""), r"\([^)]*\)", "")
    return F.regexp_replace(F.upper(F.translate(s, "U", "T")), "[^ACGTRYWSKMBDHVN]", "")


def usable_motif(motif: Column) -> Column:
    return F.length(motif).between(2, 12) & motif.rlike("[ACGT]")


def protein_like(cell: Column, minimum: int = 40) -> Column:
    s = F.regexp_replace(F.upper(F.trim(cell)), "[*-]", "")
    return (F.length(s) >= minimum) & s.rlike("^[ACDEFGHIKLMNPQRSTVWY]*$")


def motif_table_headers(grid: DataFrame) -> DataFrame:
    """(sheet_id, header_row, columns...) of the first row that names a motif column beside another plain word."""
    top = grid.where(F.col("row") < HEADER_ROWS).withColumn("h", trimmed("cells"))
    top = top.withColumn("pam_col", find_column(F.col("h"), PAM_HEADERS, PAM_PREFIXES)).where("pam_col is not null")
    beside = F.exists(F.transform("h", lambda c, i: plain_word(c) & (i != F.col("pam_col"))), lambda x: x)
    h = F.col("h")
    columns = F.struct(
        F.col("row").alias("header_row"), "pam_col", find_column(h, SEQUENCE_HEADERS, SEQUENCE_HEADERS).alias("seq_col"),
        find_column(h, ORGANISM_HEADERS).alias("org_col"), find_column(h, NAME_HEADERS).alias("name_col"),
        find_column(h, TARGET_HEADERS).alias("target_col"),
    )
    return top.where(beside).groupBy("sheet_id").agg(F.min_by(columns, "row").alias("c")).select("sheet_id", "c.*")


def motif_table_rows(grid: DataFrame) -> DataFrame:
    """Rows of direct motif tables: (sheet_id, row, pam_consensus, protein_sequence, protein_id, raw_ref)."""
    rows = grid.join(motif_table_headers(grid), "sheet_id").where(F.col("row") > F.col("header_row")).withColumn("h", trimmed("cells"))
    cell = lambda at: F.coalesce(F.get("h", F.col(at)), F.lit(""))
    pam = clean_motif(cell("pam_col"))
    label = lambda at, prefix: F.when(cell(at) != "", F.concat(F.lit(prefix), cell(at)))
    return rows.withColumn("pam_consensus", pam).where(usable_motif(F.col("pam_consensus"))).select(
        "sheet_id", "row", "pam_consensus",
        F.when(protein_like(cell("seq_col")), cell("seq_col")).otherwise(F.lit("")).alias("protein_sequence"),
        cell("name_col").alias("protein_id"),
        F.concat_ws(" | ", label("name_col", ""), label("org_col", "org="), label("target_col", "target=")).alias("raw_ref"),
    )


def _contains_any(text: Column, keys: list[str]) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | text.contains(key)
    return found


def column_roles(headers: DataFrame) -> DataFrame:
    """(sheet_id, role, column): the first column per role; predicted motifs are never a motif column.

    headers: one (sheet_id, cells) per sheet. Without a protein or organism
    column a sheet has no roles.
    """
    cells = headers.select("sheet_id", F.posexplode("cells").alias("column", "cell"))
    n = F.trim(F.regexp_replace(F.lower(F.coalesce("cell", F.lit(""))), "[^a-z0-9]+", " "))
    cells = cells.withColumn("n", n)
    n = F.col("n")
    named = _contains_any(n, NAME_KEYS) | (
        ~_contains_any(n, ["nucleotide", "amino acid"]) & F.concat(F.lit(" "), n, F.lit(" ")).contains(" id ")
    )
    tests = [
        ("pam", _contains_any(n, PAM_KEYS) & ~_contains_any(n, PREDICTED_KEYS)), ("organism", _contains_any(n, ORGANISM_KEYS)),
        ("aa", _contains_any(n, PROTEIN_KEYS)), ("repeat", _contains_any(n, REPEAT_KEYS)), ("sgrna", _contains_any(n, GUIDE_KEYS)), ("id", named),
    ]
    fits = cells.withColumn("roles", F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in tests])))
    header = fits.groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(F.struct("column", "roles"))).alias("columns"),
        F.bool_or(_contains_any(F.col("n"), PROTEIN_KEYS) | _contains_any(F.col("n"), ORGANISM_KEYS)).alias("usable"),
    ).where("usable")
    # A column takes the first of its roles that no earlier column holds.
    start = F.create_map().cast("map<string,int>")

    def take(held: Column, c: Column) -> Column:
        free = F.filter(c["roles"], lambda r: ~F.map_contains_key(held, r))
        return F.when(F.size(free) == 0, held).otherwise(F.map_concat(held, F.map_from_arrays(F.slice(free, 1, 1), F.array(c["column"]))))

    return header.select("sheet_id", F.explode(F.aggregate("columns", start, take)).alias("role", "column"))


def detected_columns(grid: DataFrame) -> DataFrame:
    """(sheet_id, aa, id) for sheets without named columns: the column of proteins and the last text column before it."""
    cells = grid.where(F.col("row") > 0).select("sheet_id", F.posexplode("cells").alias("column", "cell")).where(F.trim("cell") != "")
    long = (F.length(F.trim("cell")) >= 80) & F.trim("cell").rlike("^[A-Za-z*]+$")
    stats = cells.groupBy("sheet_id", "column").agg(
        F.avg(long.cast("double")).alias("share"), F.bool_or(F.length("cell") < 60).alias("short")
    )
    best = stats.where("share >= 0.5").groupBy("sheet_id").agg(F.min_by("column", F.struct(-F.col("share"), "column")).alias("aa"))
    named = stats.where("short").join(best, "sheet_id").where(F.col("column") < F.col("aa")).groupBy("sheet_id").agg(F.max("column").alias("id"))
    return best.join(named, "sheet_id", "left").select("sheet_id", "aa", F.coalesce("id", F.lit(-1)).alias("id"))


def oligo(cell: Column) -> Column:
    return F.translate(F.upper(F.trim(cell)), "U", "T")


def readcount_frequencies(grid: DataFrame) -> DataFrame:
    """(sheet_id, position, A, C, G, T, weight_mode) of enrichment or selected-count tables."""
    top = grid.where("row < 4").withColumn("h", F.transform(trimmed("cells"), F.lower))
    first_where = lambda test: F.get(F.filter(F.transform("h", lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull()), F.lit(0))
    selected = F.filter(F.transform("h", lambda c, i: F.when(c.isin(SELECTED_LABELS), i)), lambda i: i.isNotNull())
    mean = first_where(lambda c: c == "mean")
    line = F.array_join("h", " ")
    meta = top.groupBy("sheet_id").agg(
        F.bool_or((F.col("row") < 3) & _contains_any(line, READCOUNT_MARKERS)).alias("marked"),
        F.bool_or(F.get("h", F.lit(0)) == "pam").alias("labelled"),
        F.array_distinct(F.flatten(F.collect_list(selected))).alias("selected"),
        F.min_by(mean, F.when(mean.isNotNull(), F.col("row"))).alias("mean_col"),
    ).where("marked and labelled and (size(selected) > 0 or mean_col is not null)")
    data = grid.withColumn("oligo", oligo(F.get("cells", F.lit(0)))).where(F.col("oligo").rlike("^[ACGT]+$"))
    lengths = data.groupBy("sheet_id").agg(F.min_by(F.length("oligo"), "row").alias("size"))
    number = lambda i: F.coalesce(optional_double(F.get("cells", i)), F.lit(0.0))
    counted = F.aggregate(F.transform("selected", number), F.lit(0.0), lambda a, v: a + v)
    weighted = data.join(meta.join(lengths, "sheet_id"), "sheet_id").where(F.length("oligo") == F.col("size")).select(
        "sheet_id", "oligo", "size", F.when(F.col("mean_col").isNotNull(), number(F.col("mean_col"))).otherwise(counted).alias("w"),
        F.when(F.col("mean_col").isNotNull(), F.lit("mean_enrichment")).otherwise(F.lit("selected_counts")).alias("weight_mode"),
    )
    summed = weighted.groupBy("sheet_id", "oligo").agg(F.sum("w").alias("w"), F.any_value("weight_mode").alias("weight_mode"))
    return _position_shares(summed.withColumn("w", F.greatest("w", F.lit(0.0))), "oligo", "w")


def _position_shares(rows: DataFrame, text: str, weight: str) -> DataFrame:
    placed = rows.select("sheet_id", "weight_mode", weight, F.posexplode(F.split(F.substring(text, 1, POSITIONS), "")).alias("position", "base"))
    sums = placed.groupBy("sheet_id", "position").agg(
        *[F.sum(F.when(F.col("base") == b, F.col(weight)).otherwise(0.0)).alias(b) for b in BASES], F.any_value("weight_mode").alias("weight_mode")
    )
    whole = sum((F.col(b) for b in BASES), F.lit(0.0))
    return sums.select("sheet_id", (F.col("position") + 1).alias("position"),
                       *[F.when(whole > 0, F.col(b) / whole).otherwise(0.0).alias(b) for b in BASES], "weight_mode")


def base_name(cell: Column) -> Column:
    pairs = [F.lit(x) for item in BASE_NAMES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(cell)))


def position_matrix(grid: DataFrame) -> DataFrame:
    """(sheet_id, position, A, C, G, T) of count matrices with a header of small integers; later base rows win."""
    numbers = F.filter(F.transform(trimmed("cells"), lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")), lambda v: v.isNotNull())
    small = (F.size(numbers) >= 2) & F.forall(numbers, lambda v: (F.floor(v) >= 1) & (F.floor(v) <= 20))
    heads = grid.where(small).groupBy("sheet_id").agg(F.min_by(F.struct(F.col("row").alias("head"), F.size(numbers).alias("n")), "row").alias("h")).select("sheet_id", "h.*")
    base = base_name(F.get("cells", F.lit(0)))
    value = lambda i: F.coalesce(F.replace(F.trim(F.get("cells", i)), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    rows = grid.join(heads, "sheet_id").where((F.col("row") > F.col("head")) & base.isNotNull() & (F.size("cells") > F.col("n")))
    kept = rows.groupBy("sheet_id", base.alias("base")).agg(
        F.max_by(F.transform(F.expr("sequence(1, n)"), value), "row").alias("values")
    )
    placed = kept.select("sheet_id", "base", F.posexplode("values").alias("position", "v"))
    sums = placed.groupBy("sheet_id", "position").agg(*[F.sum(F.when(F.col("base") == b, F.col("v")).otherwise(0.0)).alias(b) for b in BASES])
    whole = sum((F.col(b) for b in BASES), F.lit(0.0))
    return sums.select("sheet_id", (F.col("position") + 1).alias("position"), *[F.when(whole > 0, F.col(b) / whole).otherwise(0.0).alias(b) for b in BASES])


def sequence_logo(grid: DataFrame) -> DataFrame:
    """(sheet_id, base, values) of logo sheets: digit columns of the header naming Base, first row per base."""
    lowered = F.transform(trimmed("cells"), F.lower)
    columns = F.filter(F.transform(trimmed("cells"), lambda c, i: F.when(c.rlike("^[0-9]+$"), i)), lambda i: i.isNotNull())
    heads = grid.where(F.array_contains(lowered, "base")).groupBy("sheet_id").agg(
        F.min_by(F.struct(F.col("row").alias("head"), columns.alias("columns")), "row").alias("h")
    ).select("sheet_id", "h.*")
    base = base_name(F.get("cells", F.lit(0)))
    value = lambda i: F.coalesce(optional_double(F.get("cells", i)), F.lit(0.0))
    rows = grid.join(heads, "sheet_id").where((F.col("row") > F.col("head")) & base.isNotNull())
    return rows.groupBy("sheet_id", base.alias("base")).agg(F.min_by(F.transform("columns", value), "row").alias("values"))


def sheet_matrices(grid: DataFrame) -> DataFrame:
    """(sheet_id, matrix, kind): logo sheet, else read counts, else position counts, as signed information."""
    logo = sequence_logo(grid).where(F.size("values") > 0).groupBy("sheet_id").agg(
        F.map_from_entries(F.collect_list(F.struct("base", "values"))).alias("m")
    ).where("size(m) = 4").select(
        "sheet_id", F.lit(0).alias("choice"), F.lit("sequence_logo").alias("kind"),
        matrix_from_bases("m", F.size(F.element_at("m", F.lit("A"))), pad=False).alias("freqs"),
    )
    padded = lambda df, choice, kind: df.groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.array(*BASES).alias("r")))).alias("p"), kind.alias("kind")
    ).select(
        "sheet_id", F.lit(choice).alias("choice"), "kind",
        F.slice(F.concat(F.transform("p", lambda x: x["r"]), F.array_repeat(F.array(*[F.lit(0.0)] * 4), POSITIONS)), 1, POSITIONS).alias("freqs"),
    )
    counts = padded(readcount_frequencies(grid), 1, F.concat(F.lit("read_count_"), F.any_value("weight_mode")))
    places = padded(position_matrix(grid), 2, F.any_value(F.lit("position_matrix")))
    best = logo.unionByName(counts).unionByName(places).groupBy("sheet_id").agg(F.min_by(F.struct("kind", "freqs"), "choice").alias("b"))
    return best.select("sheet_id", signed_information("b.freqs").alias("matrix"), F.col("b.kind").alias("kind"))


def dominant_symbol(a: Column, c: Column, g: Column, t: Column) -> Column:
    """One base from 75 percent, a pair from 85, a triple from 92, else N. Shares in, letter out."""
    top = F.greatest(a, c, g, t)
    single = F.when(a == top, F.lit("A")).when(c == top, F.lit("C")).when(g == top, F.lit("G")).otherwise(F.lit("T"))
    symbol = F.when(top >= 0.75, single)
    for code, share in (("R", a + g), ("Y", c + t), ("S", c + g), ("W", a + t), ("K", g + t), ("M", a + c)):
        symbol = symbol.when(share >= 0.85, F.lit(code))
    for code, share in (("V", a + c + g), ("H", a + c + t), ("D", a + g + t), ("B", c + g + t)):
        symbol = symbol.when(share >= 0.92, F.lit(code))
    return symbol.otherwise(F.lit("N"))


def kmer_counts_to_motif(counts: DataFrame, *, key: str = "table_id", flank_bits: float = 1.0, tail_bits: float = 0.25) -> DataFrame:
    """(key, consensus, pam_start, pam_end, total_counts) from k-mer counts.

    The motif lies between the leading run of positions with at least
    `flank_bits` and the trailing run with at most `tail_bits`; with nothing
    between them it is everything after the lead.
    """
    merged = counts.groupBy(key, "kmer").agg(F.sum("n").cast("double").alias("n"))
    placed = merged.select(key, "n", F.posexplode(F.split("kmer", "")).alias("i", "base"))
    sums = placed.groupBy(key, "i").agg(*[F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0.0)).alias(b) for b in BASES])
    whole = sum((F.col(b) for b in BASES), F.lit(0.0))
    shares = sums.select(key, "i", whole.alias("whole"), *[F.coalesce(F.try_divide(F.col(b), whole), F.lit(0.0)).alias(b) for b in BASES])
    entropy = sum((F.when(F.col(b) > 0, F.col(b) * F.log2(F.col(b))).otherwise(0.0) for b in BASES), F.lit(0.0))
    shares = shares.withColumn("bits", F.when(F.col("whole") > 0, 2.0 + entropy).otherwise(0.0))
    # One row per position of one table, at most the k-mer length.
    over = Window.partitionBy(key)
    ends = shares.withColumn("size", F.max("i").over(over) + 1)
    ends = ends.withColumn("start", F.coalesce(F.min(F.when(F.col("bits") < flank_bits, F.col("i"))).over(over), F.col("size")))
    ends = ends.withColumn("until", F.coalesce(F.max(F.when(F.col("bits") > tail_bits, F.col("i"))).over(over) + 1, F.lit(0)))
    inside = (F.col("i") >= F.col("start")) & ((F.col("i") < F.col("until")) | (F.col("until") <= F.col("start")))
    symbol = F.when(inside, F.struct("i", dominant_symbol(*[F.col(b) for b in BASES]).alias("s")))
    return ends.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(symbol)), lambda x: x["s"]), "").alias("consensus"),
        F.any_value("start").cast("long").alias("pam_start"), F.any_value("until").cast("long").alias("pam_end"),
        F.max(F.when(F.col("i") == 0, F.col("whole"))).cast("long").alias("total_counts"),
    )
