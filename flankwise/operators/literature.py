"""From papers to reference rows: extraction, deduplication, consensus filter, gold merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.iupac import is_subset
from ..session import materialize

# Effector names with agreed consensus motif and accepted spellings.
CONSENSUS = {
    "SpCas9": ("NGG", ["NGG", "GG"]),
    "SpyCas9": ("NGG", ["NGG", "GG"]),
    "dSpCas9": ("NGG", ["NGG"]),
    "SaCas9": ("NNGRRT", ["NNGRRT", "NNGRR"]),
    "dSaCas9": ("NNGRRT", ["NNGRRT", "NNGRR"]),
    "FnCas9": ("NGG", ["NGG"]),
    "StCas9": ("NNAGAAW", ["NNAGAAW", "NNAGAA"]),
    "NmCas9": ("NNNNGATT", ["NNNNGATT", "NNNNGTTT"]),
    "NmeCas9": ("NNNNGATT", ["NNNNGATT", "NNNNGTTT"]),
    "CjCas9": ("NNNNRYAC", ["NNNNRYAC", "NNNNRYYC", "NNNVRYAC"]),
    "AsCas12a": ("TTTV", ["TTTV", "TTTN", "TTT"]),
    "FnCas12a": ("TTTV", ["TTTV", "TTTN"]),
}
# Source organism of unambiguous effector names.
ORGANISM = {
    "SpCas9": "Streptococcus pyogenes",
    "SpyCas9": "Streptococcus pyogenes",
    "dSpCas9": "Streptococcus pyogenes",
    "SaCas9": "Staphylococcus aureus",
    "dSaCas9": "Staphylococcus aureus",
    "FnCas9": "Francisella novicida",
    "CjCas9": "Campylobacter jejuni",
    "NmCas9": "Neisseria meningitidis",
    "NmeCas9": "Neisseria meningitidis",
    "StCas9": "Streptococcus thermophilus",
    "AsCas12a": "Acidaminococcus sp. BV3L6",
    "AsCpf1": "Acidaminococcus sp. BV3L6",
    "FnCas12a": "Francisella novicida",
    "FnCpf1": "Francisella novicida",
    "LbCas12a": "Lachnospiraceae bacterium ND2006",
    "LbCpf1": "Lachnospiraceae bacterium ND2006",
    "CoCas9": "Capnocytophaga ochracea",
    "SmacCas9": "Capnocytophaga canimorsus",
    "SmutCas9": "Streptococcus mutans",
    "SaHyCas9": "Staphylococcus hyicus",
    "CdCas9": "Corynebacterium diphtheriae",
    "DfCas9": "Rodentibacter pneumotropicus",
    "ScCas9": "Streptococcus macacae",
    "MbCas12a": "Moraxella bovis",
    "EbCas12a": "Eubacterium album",
}
# Verified accessions of effector names.
ACCESSION = {
    "SpCas9": "Q99ZW2",
    "SaCas9": "J7RUA5",
    "FnCas9": "A0Q5Y3",
    "NmeCas9": "C9X1G5",
    "CjCas9": "Q0P897",
    "StCas9": "G3ECR1",
    "AsCas12a": "U2UMQ6",
    "FnCas12a": "A0Q7Q2",
    "AsCpf1": "U2UMQ6",
    "FnCpf1": "A0Q7Q2",
    "LbCpf1": "C4Z1Q1",
    "Nme1Cas9": "C9X1G5",
    "MbCas12a": "A0AAQ2Q2F9",
    "EbCas12a": "A0ABT2M290",
    "CoCas9": "C7M7G9",
    "SmacCas9": "F9YQX1",
    "SmutCas9": "Q8DTE3",
    "SaHyCas9": "A0ACD5FQ62",
    "CdCas9": "Q6NKI3",
    "DfCas9": "A0AAW5LCH4",
    "ScCas9": "G5JVJ9",
}
# Trust order of sequence matches, best first.
MATCH_ORDER = {"verified": 0, "species": 1, "species_review": 2, "name_only": 3}
TRUSTED = ["verified", "species"]


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def organism_of(alias: Column) -> Column:
    return lookup(ORGANISM, alias)


def accession_of(alias: Column) -> Column:
    return lookup(ACCESSION, alias)


def family_keyword(alias: Column) -> Column:
    n = F.lower(F.trim(alias))
    return (
        F.when(n.contains("cas12f"), F.lit("cas12f")).when(n.contains("cas12") | n.contains("cpf1"), F.lit("cas12"))
        .when(n.contains("cas13") | n.contains("c2c2"), F.lit("cas13")).when(n.contains("cas9"), F.lit("cas9"))
        .when(n.contains("iscb"), F.lit("iscb"))
    )


def family_label(alias: Column) -> Column:
    n = F.lower(alias)
    return F.when(n.contains("cas12") | n.contains("cpf1"), F.lit("Cas12")).when(n.contains("cas13"), F.lit("Cas13")).when(
        n.contains("cas9"), F.lit("Cas9")).otherwise(F.lit(""))


def type_label(alias: Column) -> Column:
    return F.coalesce(lookup({"Cas12": "Type V", "Cas13": "Type VI", "Cas9": "Type II"}, family_label(alias)), F.lit(""))


def gene_clause(family: Column) -> Column:
    # Search clauses per family.
    return F.coalesce(lookup({
        "cas9": "(gene:cas9 OR gene:csn1)",
        "cas12": "(gene:cas12a OR gene:cpf1 OR gene:cas12)",
        "cas12f": "(gene:cas12f OR gene:cas14)",
        "cas13": "(gene:cas13)",
        "iscb": "(gene:iscb)",
    }, family), F.lit(""))


def search_queries(alias: Column, species: Column) -> Column:
    """Ordered array<struct(query, kind)> of search attempts for an effector name."""
    cas, named = F.trim(alias), F.trim(F.coalesce(species, F.lit("")))
    term = F.when(named != "", F.concat(F.lit('"'), named, F.lit('"'))).otherwise(F.lit(""))
    gene = gene_clause(family_keyword(alias))
    attempt = lambda query, kind: F.struct(query.alias("query"), F.lit(kind).alias("kind"))
    by_name = attempt(F.concat(gene, F.lit(" AND "), cas), "name_only")
    return (
        F.when((gene != "") & (term != ""), F.array(attempt(F.concat(term, F.lit(" AND "), gene), "species"), by_name))
        .when(gene != "", F.array(by_name))
        .when(term != "", F.array(attempt(F.concat(term, F.lit(" AND ("), cas, F.lit(")")), "species")))
        .otherwise(F.array(attempt(F.concat(F.lit('gene:"'), cas, F.lit('" OR protein_name:"'), cas, F.lit('"')), "name_only")))
    )


def best_search_hit(hits: DataFrame, keys: list[str], minimum_length: int = 200) -> DataFrame:
    """One entry per key: long enough, of the family where any is, "reviewed" first, then longest, then earliest.

    The preference tests for the text "reviewed", which "unreviewed" holds too.
    """
    names = F.lower(F.concat_ws(" ", "name", "genes"))
    parts = {"cas9": ["cas9", "csn1"], "cas12": ["cas12", "cpf1"], "cas12f": ["cas12f", "cas14"], "cas13": ["cas13"], "iscb": ["iscb"]}
    fits = F.lit(False)
    for family, words in parts.items():
        fits = fits | ((F.col("family") == family) & tx.contains_any(names, words))
    usable = hits.where((F.coalesce(F.col("sequence"), F.lit("")) != "") & (F.length("sequence") >= minimum_length))
    reviewed = F.when(F.coalesce(F.col("entry_type"), F.lit("")).contains("reviewed"), 0).otherwise(1)
    order = F.struct(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1), reviewed, -F.length("sequence"), F.col("position"))
    return usable.groupBy(*keys).agg(F.min_by(F.struct("accession", "sequence", "entry_type"), order).alias("best")).select(*keys, "best.*")


def motif_statements(documents: DataFrame, *, window: int = 80) -> DataFrame:
    """(doc_id, statement, cas_name, pam, place, raw_place) of every framed motif bound to a Cas name nearby."""
    framed = documents.withColumn("body", tx.strip_markup("xml"))
    framed = framed.select("doc_id", "body", F.posexplode(tx.occurrences(F.col("body"), tx.FRAME_PATTERN)).alias("statement", "m"))
    pam = F.upper("m.inner")
    return framed.select(
        "doc_id", "statement", pam.alias("pam"),
        tx.cas_name_near(F.col("body"), F.col("m.start"), F.col("m.stop"), window).alias("cas_name"),
        F.floor((F.col("m.start") + F.col("m.stop")) / 2).cast("int").alias("center"),
    ).where(F.col("cas_name").isNotNull() & tx.real_motif(F.col("pam")))


def species_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, spans): places of italic binomials in the plain text, in order of the markup."""
    rows = documents.withColumn("body", tx.strip_markup("xml")).withColumn("italics", tx.occurrences(F.col("xml"), tx.ITALIC_PATTERN))

    def span(m: Column) -> Column:
        first, second = F.regexp_extract(m["inner"], tx.BINOMIAL_PATTERN, 1), F.regexp_extract(m["inner"], tx.BINOMIAL_PATTERN, 2)
        name = F.concat(first, F.lit(" "), second)
        guess = F.floor(m["start"] / F.greatest(F.lit(1), F.length("xml")) * F.length("body")).cast("int")
        after = F.expr("0") + F.call_function("locate", name, F.col("body"), F.greatest(F.lit(0), guess - 500) + 1)
        place = F.when(after > 0, after).otherwise(F.call_function("locate", name, F.col("body"), F.lit(1))) - 1
        return F.when((first != "") & (place >= 0), F.struct(
            place.alias("start"), (place + F.length(name)).alias("stop"), name.alias("name")
        ))

    return rows.select("doc_id", F.filter(F.transform("italics", span), lambda s: s.isNotNull()).alias("spans"))


def statement_triples(documents: DataFrame, *, window: int = 80, reach: int = 400) -> DataFrame:
    """(doc_id, statement, cas_name, pam, species): the nearest italic binomial within reach, the first of equals."""
    joined = motif_statements(documents, window=window).join(species_spans(documents), "doc_id", "left")
    distance = lambda s: F.greatest(s["start"] - F.col("center"), F.col("center") - s["stop"], F.lit(0))
    nearest = F.array_min(F.transform("spans", lambda s, i: F.struct(distance(s).alias("d"), i.alias("i"), s["name"].alias("name"))))
    return joined.withColumn("near", nearest).select(
        "doc_id", "statement", "cas_name", "pam",
        F.when(F.col("near.d") <= reach, F.col("near.name")).otherwise(F.lit("")).alias("species"),
    )


def paper_sample(documents: DataFrame) -> DataFrame:
    """One heuristic sample row per full text: first motif, accession, organism, family and type."""
    body = documents.withColumn("body", tx.strip_markup("xml")).withColumn("motifs", tx.phrase_motifs("body"))
    several = F.concat(F.lit("multiple motifs: "), F.array_join("motifs", ", "))
    return body.select(
        "doc_id", F.coalesce(F.get("motifs", F.lit(0)), F.lit("")).alias("pam_consensus"),
        F.coalesce(F.get(tx.accessions("body"), F.lit(0)), F.lit("")).alias("protein_id"),
        tx.organism_hint("body").alias("organism"), tx.cas_family_in("body").alias("cas_family"),
        tx.crispr_type_in("body").alias("crispr_type"), F.lit("fulltext_heuristic").alias("method"),
        F.when(F.size("motifs") > 1, several).otherwise(F.lit("")).alias("notes"),
    )


def supplement_samples(rows: DataFrame) -> DataFrame:
    """Sample rows of a supplementary table with 2 to 10 usable motif letters."""
    motif = tx.sanitize_motif(F.coalesce(F.nullif("pam", F.lit("")), F.col("motif"), F.lit("")))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    return rows.withColumn("_m", motif).where(F.length("_m").between(2, 10)).select(
        F.col("_m").alias("pam_consensus"), first("organism", "species").alias("organism"),
        first("accession", "uniprot").alias("protein_id"), first("sequence").alias("protein_sequence"),
        F.lit("supp_table").alias("method"),
    )


def deduplicate_papers(papers: DataFrame) -> DataFrame:
    """Greedy deduplication in record order by DOI, then PMID/PMCID, then title.

    papers: (position, doi, pmid, pmcid, title). A record whose key was first
    used by an earlier kept record merges into it; only kept records register
    keys. The kept records are the lexicographically first independent set of the
    share-a-key graph, found in rounds: a record earliest under all its keys is
    kept, and whatever shares a key with a kept one is settled. Returns
    (position, kept_position).
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    key = lambda kind, value: F.when(value != "", F.concat(F.lit(kind), value))
    identifier = F.when(blank("pmid") != "", F.concat(F.lit("pmid:"), blank("pmid"))).when(
        blank("pmcid") != "", F.concat(F.lit("pmcid:"), blank("pmcid"))).otherwise(F.lit(""))
    keys = F.array_compact(F.array(
        F.when(blank("doi") != "", F.struct(F.lit(0).alias("rank"), key("d|", F.lower(blank("doi"))).alias("value"))),
        F.when(identifier != "", F.struct(F.lit(1).alias("rank"), key("i|", identifier).alias("value"))),
        F.when(tx.normalized_title(F.coalesce("title", F.lit(""))) != "",
               F.struct(F.lit(2).alias("rank"), key("t|", tx.normalized_title(F.coalesce("title", F.lit("")))).alias("value"))),
    ))
    keyed = papers.select("position", keys.alias("keys"))
    bare = keyed.where(F.size("keys") == 0).select("position", F.col("position").alias("kept_position"))
    long = materialize(keyed.select("position", F.explode("keys").alias("k")).select("position", "k.rank", "k.value"))
    open_rows, heads = long, None
    while True:
        first = open_rows.groupBy("value").agg(F.min("position").alias("first"))
        found = open_rows.join(first, "value").groupBy("position").agg(
            F.bool_and(F.col("position") == F.col("first")).alias("head")
        ).where("head").select("position")
        owned = materialize(open_rows.join(found, "position", "left_semi").select("value", F.col("position").alias("kept_position")))
        heads = owned if heads is None else heads.unionByName(owned)
        settled = open_rows.join(owned, "value").select("position").distinct()
        open_rows = materialize(open_rows.join(settled, "position", "left_anti"))
        if open_rows.isEmpty():
            break
    # A kept record owns its keys alone; a record follows the owner of its best key among earlier ones.
    assigned = long.join(heads, "value").where("kept_position <= position").groupBy("position").agg(
        F.min_by("kept_position", "rank").alias("kept_position")
    )
    return bare.unionByName(assigned)


def merged_papers(papers: DataFrame, kept: DataFrame, labels: str = "matched_query") -> DataFrame:
    """Kept records with the distinct labels of everything merged into them, in order of first use."""
    rows = papers.select("position", labels).join(kept, "position").groupBy("kept_position", labels).agg(F.min("position").alias("at"))
    return rows.groupBy("kept_position").agg(F.array_sort(F.collect_list(F.struct("at", labels))).alias("l")).select(
        F.col("kept_position").alias("position"), F.transform("l", lambda x: x[labels]).alias("labels")
    )


def consensus_filter(rows: DataFrame, *, motif: str = "pam", alias: str = "cas_name") -> DataFrame:
    """Rows with `kept` and `filter_reason`: a known name must carry its consensus or a narrower spelling."""
    name, observed = F.trim(F.col(alias)), F.upper(F.trim(F.col(motif)))
    expected = lookup({k: v[0] for k, v in CONSENSUS.items()}, name)
    spellings = F.split(lookup({k: ",".join(v[1]) for k, v in CONSENSUS.items()}, name), ",")
    rows = rows.withColumn("_e", expected).withColumn("_s", spellings).withColumn("_o", observed)
    fits = (F.col("_o") != "") & (F.array_contains("_s", F.col("_o")) | is_subset("_o", "_e"))
    kept = F.col("_e").isNull() | F.coalesce(fits, F.lit(False))
    reason = F.concat(F.lit("PAM '"), F.trim(F.col(motif)), F.lit("' not consensus '"), F.col("_e"), F.lit("' for "), name)
    return rows.withColumn("kept", kept).withColumn("filter_reason", F.when(~F.col("kept"), reason)).drop("_e", "_s", "_o")


def best_sequences(sequences: DataFrame) -> DataFrame:
    """Most trusted sequence per Cas name: (cas_name, sequence, accession, match, position)."""
    rank = F.coalesce(lookup({k: str(v) for k, v in MATCH_ORDER.items()}, F.coalesce("match", F.lit("none"))).cast("int"), F.lit(99))
    rows = sequences.withColumn("cas_name", F.trim("cas_name")).where((F.col("cas_name") != "") & (F.coalesce("sequence", F.lit("")) != ""))
    return rows.groupBy("cas_name").agg(
        F.min_by(F.struct("sequence", "accession", "match"), F.struct(rank, "position")).alias("b")
    ).select("cas_name", "b.*")


def gold_merge(pairs: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) pairs. Resolved ones keep the first row per (name, motif, accession)."""
    joined = pairs.withColumn("cas_name", F.trim("cas_name")).withColumn("pam", F.trim("pam")).join(
        best_sequences(sequences), "cas_name", "left"
    )
    found = joined.where(F.col("sequence").isNotNull())
    resolved = found.groupBy("cas_name", "pam", F.coalesce("accession", F.lit("")).alias("accession")).agg(
        F.min_by(F.struct("position", "doi", "species", "sequence", "match"), "position").alias("r")
    ).select(
        "cas_name", F.col("pam").alias("pam_consensus"), F.col("accession").alias("protein_id"), "r.*",
        type_label(F.col("cas_name")).alias("crispr_type"), family_label(F.col("cas_name")).alias("cas_family"),
    ).withColumnRenamed("sequence", "protein_sequence").withColumnRenamed("match", "sequence_confidence")
    return resolved, joined.where(F.col("sequence").isNull()).select("cas_name", "pam", "doi", "species", "position")


def gold_review(gold: DataFrame) -> DataFrame:
    """Gold rows with `queue` = clean or review and the reason for a review."""
    rows = consensus_filter(gold, motif="pam_consensus")
    trusted = F.coalesce(F.col("sequence_confidence").isin(TRUSTED), F.lit(False))
    reason = F.when(~F.col("kept"), F.col("filter_reason")).when(
        ~trusted, F.concat(F.lit("sequence_confidence="), F.coalesce("sequence_confidence", F.lit("None"))))
    return rows.withColumn("queue", F.when(F.col("kept") & trusted, F.lit("clean")).otherwise(F.lit("review"))).withColumn(
        "review_reason", reason
    ).drop("kept", "filter_reason")


def alias_queue(gold: DataFrame) -> DataFrame:
    """Names without a curated organism: first species, up to twelve motifs, what to do.

    The sequence flag stays "no": it looks at a column the gold table does not have.
    """
    rows = gold.withColumn("cas_name", F.trim("cas_name")).where((F.col("cas_name") != "") & organism_of(F.col("cas_name")).isNull())
    named = F.coalesce(F.col("species"), F.lit("")) != ""
    per_motif = rows.groupBy("cas_name", F.trim("pam_consensus").alias("pam")).agg(
        F.min(F.when(named, F.struct("position", "species"))).alias("first")
    )
    # Sorted motifs are numbered before they are gathered, so at most twelve are gathered per name.

    n = F.row_number().over(Window.partitionBy("cas_name").orderBy((F.col("pam") == "").cast("int"), "pam"))
    return per_motif.withColumn("n", n).groupBy("cas_name").agg(
        F.coalesce(F.min("first")["species"], F.lit("")).alias("paper_species"),
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("n") <= 12) & (F.col("pam") != ""), F.col("pam")))), ",").alias("pams_seen"),
    ).select(
        "*", F.lit("no").alias("has_seq"), F.lit("").alias("seq_confidence"),
        F.lit("confirm source organism, then re-resolve sequence").alias("suggested_action"),
    )


def priority_order(papers: DataFrame) -> DataFrame:
    """Experimental papers first, then by identifier."""
    return papers.orderBy(F.when(F.col("evidence_status") == "candidate_experimental", 0).otherwise(1), "pmcid")
