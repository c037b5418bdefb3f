"""Text expressions: markup, motif statements, names, keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .iupac import col

# Markers that decide the evidence class of a paper.
REVIEW_MARKERS = [
    "review", "systematic review", "meta-analysis", "perspective", "protocol",
    "survey of", "inspection of", "primer", "mini review", "minireview",
]
COMPUTATIONAL_MARKERS = [
    "computational", "in silico", "bioinformatic", "machine learning",
    "deep learning", "prediction of", "predicted", "algorithm",
    "web server", "database", "tool for", "benchmark",
    "neural network", "model predicts", "trained model",
]
ASSAY_TERMS = [
    "pam depletion", "pam screen", "pam screening", "interference assay",
    "interference assays", "transformation assay", "transformation assays",
    "plasmid clearance", "plasmid interference", "plasmid loss",
    "high-throughput pam", "depletion screen",
    "pam identification", "pam characterization", "pam characterisation",
    "pam determination", "protospacer adjacent motif",
    "protospacer-adjacent motif", "pam recognition", "pam library",
    "cleavage assay", "pam-scanr", "pam-detect", "ht-pamda", "pamda",
    "functional pam", "pam specificity", "pam preference",
    "endogenous crispr", "native crispr",
]

# Patterns of motif statements, accessions, names and markup.
PHRASE_PATTERNS = [
    r"""(?i)PAM\s+(?:is|was|of|:|＝|=)\s*["']?([ACGTURYSWKMBDHVN]{2,10})""",
    r"""(?i)["']?([ACGTURYSMWKMBDHVN]{2,10})["']?\s+PAM""",
    r"""(?i)PAM\s*\(?([ACGTURYSWKMBDHVN]{2,10})\)?""",
]
ACCESSION_PATTERN = r"\b([OPQ][0-9][A-Z0-9]{3}[0-9])\b"
TAXON_PATTERN = (
    "(?i)(Streptococcus|Staphylococcus|Bacillus|Escherichia|Francisella|Lachnospiraceae|Acidaminococcus|"
    "Campylobacter|Neisseria|Pseudomonas|Pyrococcus|Sulfolobus|Candidatus)"
)
FRAME_PATTERN = "(?i)5\\s*['’‘′″]\\s*-?\\s*([ACGTUNRYWSKMBDHV]{2,10})\\s*-?\\s*3\\s*['’‘′″]"
CAS_PATTERN = (
    r"\b([A-Za-z][A-Za-z0-9]*(?:Cas\d*[A-Za-z]?|Cpf1|IscB|TnpB|Cas13[abc]?|Cas12[a-z]?|Cascade[Cc]as[A-Za-z0-9]*))\b"
)
ITALIC_PATTERN = "<italic>([^<]{4,80})</italic>"
BINOMIAL_PATTERN = r"\b([A-Z][a-z]+)\s+([a-z]{3,})\b"
NOT_MOTIFS = ["AND", "ATG", "TAG", "TAA", "TGA", "ARE", "ANY", "AC", "CA", "NOT", "GAT"]
CAS_FAMILIES = ["Cas12a", "Cas12b", "Cas12f", "Cas12i", "Cas12j", "Cas9", "Cas8", "Cas10", "Cas3", "Cas13", "Cpf1"]
CRISPR_TYPES = ["I", "II", "III", "IV", "V", "VI"]


def strip_markup(xml: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(xml), "<[^>]+>", " "), r"\s+", " ")


def contains_any(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | text.contains(marker)
    return found


def markers_in(text: Column, markers: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(m), F.lit(m)) for m in markers]))


def classify_paper(title: Column | str, abstract: Column | str) -> Column:
    """struct(status, reason, assay_terms): a triage label, never ground truth."""
    text = F.concat(F.lower(F.coalesce(col(title), F.lit(""))), F.lit(" "), F.lower(F.coalesce(col(abstract), F.lit(""))))
    review, computed = contains_any(text, REVIEW_MARKERS), contains_any(text, COMPUTATIONAL_MARKERS)
    assays = markers_in(text, ASSAY_TERMS)
    listed, any_assay = F.array_join(assays, ", "), contains_any(text, ASSAY_TERMS)
    status = (
        F.when(review, F.lit("review_or_secondary")).when(any_assay & ~computed, F.lit("candidate_experimental"))
        .when(any_assay & computed, F.lit("uncertain")).when(computed, F.lit("computational_only")).otherwise(F.lit("uncertain"))
    )
    reason = (
        F.when(review, F.lit("review marker present"))
        .when(any_assay & ~computed, F.concat(F.lit("assay term(s): "), listed))
        .when(any_assay & computed, F.concat(F.lit("assay "), listed, F.lit(" but also computational marker")))
        .when(computed, F.lit("computational marker present, no assay term"))
        .otherwise(F.lit("no decisive assay/review/computational marker"))
    )
    return F.struct(status.alias("status"), reason.alias("reason"), assays.alias("assay_terms"))


def sanitize_motif(motif: Column | str) -> Column:
    return F.regexp_replace(F.upper(col(motif)), "[^ACGTRYSWKMBDHVN]", "")


def phrase_motifs(text: Column | str) -> Column:
    """Motifs named in phrases such as 'PAM is NGG', pattern by pattern, first mention kept."""
    found = F.concat(*[F.regexp_extract_all(col(text), F.lit(p), F.lit(1)) for p in PHRASE_PATTERNS])
    return F.array_distinct(F.filter(F.transform(found, sanitize_motif), lambda m: F.length(m).between(2, 10)))


def real_motif(motif: Column) -> Column:
    return (F.length(motif) >= 3) & ~motif.isin(NOT_MOTIFS)


def framed_motifs(text: Column | str) -> Column:
    """Distinct motifs written 5'-...-3', in order of mention."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(FRAME_PATTERN), F.lit(1)), F.upper)
    return F.array_distinct(F.filter(found, real_motif))


def accessions(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(ACCESSION_PATTERN), F.lit(1)))


def organism_hint(text: Column | str) -> Column:
    return F.regexp_extract(col(text), TAXON_PATTERN, 1)


def _first_matching(text: Column, choices: list[tuple[str, str]]) -> Column:
    out = None
    for label, pattern in choices:
        out = F.when(text.rlike(pattern), F.lit(label)) if out is None else out.when(text.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(""))


def cas_family_in(text: Column | str) -> Column:
    return _first_matching(col(text), [(f, rf"\b{f}\b") for f in CAS_FAMILIES])


def crispr_type_in(text: Column | str) -> Column:
    return _first_matching(col(text), [(f"Type {t}", rf"(?i)\bType\s*{t}\b") for t in CRISPR_TYPES])


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct(start, stop, full, inner)> of all matches with 0-based character offsets."""
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern)
    # The n-th match starts after the first n gaps and the n - 1 matches between them.
    def place(item: Column, i: Column) -> Column:
        skipped = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda acc, s: acc + F.length(s))
        start = skipped(gaps, i + 1) + skipped(full, i)
        return F.struct(
            start.alias("start"), (start + F.length(item)).alias("stop"), item.alias("full"), F.get(inner, i).alias("inner")
        )
    return F.transform(full, place)


def cas_name_near(text: Column, start: Column, stop: Column, window: int = 80) -> Column:
    """Last Cas name in the characters before a place, else the first one after it."""
    low = F.greatest(start - window, F.lit(0))
    before = F.regexp_extract_all(F.substring(text, low + 1, start - low), F.lit(CAS_PATTERN), F.lit(1))
    after = F.regexp_extract_all(F.substring(text, stop + 1, F.lit(window)), F.lit(CAS_PATTERN), F.lit(1))
    return F.coalesce(F.get(before, F.size(before) - 1), F.get(after, F.lit(0)))


def normalized_title(title: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(title)), "[^a-z0-9]+", "")


def normalize_doi(doi: Column | str) -> Column:
    value = F.lower(F.trim(F.coalesce(col(doi), F.lit(""))))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        value = F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 2**31 - 1)).otherwise(value)
    return F.regexp_replace(value, r"\.+$", "")


def optional_double(text: Column | str) -> Column:
    """Blank text is unknown (null), not zero."""
    return F.nullif(F.trim(col(text).cast("string")), F.lit("")).try_cast("double")


def optional_score(text: Column | str) -> Column:
    value = optional_double(text)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def optional_count(text: Column | str) -> Column:
    return F.coalesce(optional_double(text).cast("long"), F.lit(0))


def sequence_digest(sequence: Column | str) -> Column:
    return F.sha2(F.upper(F.regexp_replace(F.coalesce(col(sequence), F.lit("")), r"\s", "")), 256)


def system_name(sequence: Column | str, family: Column | str) -> Column:
    prefix = F.regexp_replace(F.lower(F.coalesce(col(family), F.lit(""))), "[^a-z0-9]", "")
    prefix = F.when(F.coalesce(col(family), F.lit("")) == "", F.lit("system")).otherwise(prefix)
    prefix = F.when(prefix == "", F.lit("system")).otherwise(prefix)
    return F.concat(prefix, F.lit("-"), F.substring(sequence_digest(sequence), 1, 16))


def safe_identifier(value: Column | str) -> Column:
    v = col(value)
    return F.coalesce(v.rlike("^[A-Za-z0-9._-]+$") & ~v.isin(".", ".."), F.lit(False))


def safe_relative_path(value: Column | str) -> Column:
    v = col(value)
    return F.coalesce((v != "") & ~v.startswith("/") & ~v.rlike(r"(^|[\\/])\.\.([\\/]|$)"), F.lit(False))


def literal_list(text: Column | str) -> Column:
    """A bracketed list of quoted or bare items as array<string>; anything else is an error."""
    t = F.trim(col(text))
    ok = t.rlike(r"^[\[(].*[\])]$")
    body = F.regexp_replace(F.regexp_replace(t, r"^[\[(]\s*", ""), r"\s*,?\s*[\])]$", "")
    item = F.lit(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"]+)\s*(?:,|$)""")
    items = F.transform(F.regexp_extract_all(body, item, F.lit(1)), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.when(ok, F.when(body == "", F.array().cast("array<string>")).otherwise(items)).otherwise(
        F.raise_error(F.concat(F.lit("malformed list: "), F.coalesce(t, F.lit("null")))).cast("array<string>")
    )


def supplement_links(xml: Column | str, base: Column | str) -> Column:
    """array<struct(url, label)> of supplementary files, resolved against the article's address."""
    block = r'(?s)<supplementary-material[^>]*xlink:href="[^"]+"[^>]*>.*?</supplementary-material>'
    blocks = F.regexp_extract_all(col(xml), F.lit(block), F.lit(0))
    folder = F.regexp_replace(col(base), "[^/]*$", "")
    root = F.regexp_extract(col(base), "^([a-z]+://[^/]+)", 1)

    def resolve(href: Column) -> Column:
        return F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))

    def of_block(b: Column) -> Column:
        label = F.regexp_extract(b, r'<supplementary-material[^>]*xlink:href="([^"]+)"', 1)
        media = F.regexp_extract_all(b, F.lit(r'<media[^>]*xlink:href="([^"]+)"'), F.lit(1))
        hrefs = F.when(F.size(media) > 0, media).otherwise(F.array(label))
        return F.transform(hrefs, lambda h: F.struct(resolve(h).alias("url"), label.alias("label")))

    return F.flatten(F.transform(blocks, of_block))


def accession_tokens(value: Column | str) -> Column:
    """The distinct non-empty parts of a bar-separated list, in order of first occurrence."""
    c = F.col(value) if isinstance(value, str) else value
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\\|"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
