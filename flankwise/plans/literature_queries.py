"""Queries over whole texts: statements, classification, deduplication, gold rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import literature as li
from ..session import materialize, spread
from . import derive as d
from .registry import registry

# Names and species the derived statements are made of.
NAMES = ["SpCas9", "SaCas9", "NmeCas9", "CjCas9", "AsCas12a", "XyCas9", "LbCpf1", "QzCas13a"]
SPECIES = ["Streptococcus pyogenes", "Staphylococcus aureus", "Neisseria meningitidis", "Moraxella bovis"]
PHRASES = ["", " a review of", " the pam screen and", " a machine learning model after the pam screen and", " an in silico", " the cleavage assay and", " its", " one"]


def pick(choices, prefix, key, place):
    return F.get(F.array(*[F.lit(c) for c in choices]), d.nibble(prefix, key, place) % len(choices))


def statement_motif(prefix, key):
    """NGG every other time, else a degenerate six-mer."""
    dna = F.substring(d.dna_of(prefix, key), 1, 6)
    return F.when(d.nibble(prefix, key, 32) % 2 == 0, F.lit("NGG")).otherwise(F.translate(dna, "ACGT", "NNGR"))


def papers(spark, sf_dir):
    """Every document in full with two statements set into it."""
    k = F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    first = F.concat(F.lit(" <p>Here"), pick(PHRASES, "h", k, 1), F.lit(" <italic>"), pick(SPECIES, "h", k, 2), F.lit("</italic> "),
                     pick(NAMES, "h", k, 3), F.lit(" needs a 5'-"), statement_motif("h", k), F.lit("-3' PAM.</p> "))
    second = F.concat(F.lit(" <p>PAM is "), statement_motif("i", k), F.lit(" or 5′-"), statement_motif("j", k), F.lit("-3′ for "), pick(NAMES, "i", k, 2),
                      F.lit(" Type "), pick(["I", "II", "V"], "i", k, 3), F.lit(" Q99ZW2</p>"))
    docs = spread(d.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    xml = F.concat(F.expr("substring(text, 1, int(floor(length(text) / 2)))"), first, F.expr("substring(text, int(floor(length(text) / 2)) + 1)"), second)
    return docs.select("doc_id", "source", xml.alias("xml"))


def sql_pick(choices, prefix, place):
    items = ", ".join("'" + c + "'" for c in choices)
    return f"([{items}])[1 + {d.SQL['nibble'](prefix, 'doc_id', place)} % {len(choices)}]"


def sql_motif(prefix):
    return f"(case when {d.SQL['nibble'](prefix, 'doc_id', 32)} % 2 = 0 then 'NGG' else translate(substr({d.SQL['dna'](prefix, 'doc_id')}, 1, 6), 'ACGT', 'NNGR') end)"


SQL_PAPERS = f"""papers as (select doc_id, source, substr(text, 1, length(text) // 2) || ' <p>Here' || {sql_pick(PHRASES, 'h', 1)} || ' <italic>' || {sql_pick(SPECIES, 'h', 2)} || '</italic> '
      || {sql_pick(NAMES, 'h', 3)} || ' needs a 5''-' || {sql_motif('h')} || '-3'' PAM.</p> ' || substr(text, length(text) // 2 + 1)
      || ' <p>PAM is ' || {sql_motif('i')} || ' or 5′-' || {sql_motif('j')} || '-3′ for ' || {sql_pick(NAMES, 'i', 2)} || ' Type ' || {sql_pick(['I', 'II', 'V'], 'i', 3)} || ' Q99ZW2</p>' as xml from documents),
    bodies as (select doc_id, source, xml, regexp_replace(regexp_replace(xml, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') as body from papers)"""
SQL_FRAME = tx.FRAME_PATTERN.replace("'", "''")
SQL_CAS = tx.CAS_PATTERN


def sql_places(text: str, pattern: str, source: str, name: str) -> str:
    return f"""{name}_parts as (select doc_id, {text} as t, regexp_extract_all({text}, '{pattern}', 0) as f, regexp_extract_all({text}, '{pattern}', 1) as g, regexp_split_to_array({text}, '{pattern}') as gaps from {source}),
    {name} as (select doc_id, t, i - 1 as idx, g[i] as inner_, cast(coalesce(list_sum(list_transform(gaps[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda s: length(s))), 0) as bigint) as start_,
      length(f[i]) as len_ from (select *, unnest(range(1, len(f) + 1)) as i from {name}_parts))"""


SQL_STATEMENTS = [SQL_PAPERS, sql_places("body", SQL_FRAME, "bodies", "frames"), f"""near as (select doc_id, idx as statement, upper(inner_) as pam, (2 * start_ + len_) // 2 as center,
      regexp_extract_all(substr(t, greatest(start_ - 80, 0) + 1, least(start_, 80)), '{SQL_CAS}', 1) as before_, regexp_extract_all(substr(t, start_ + len_ + 1, 80), '{SQL_CAS}', 1) as after_ from frames),
    bound as (select doc_id, statement, pam, center, coalesce(before_[len(before_)], after_[1]) as cas_name from near),
    statements as (select * from bound where cas_name is not null and length(pam) >= 3 and pam not in ('AND', 'ATG', 'TAG', 'TAA', 'TGA', 'ARE', 'ANY', 'AC', 'CA', 'NOT', 'GAT'))"""]


@registry.add("text_body", d.with_ctes(SQL_PAPERS, final="select doc_id, length(body) as n_chars, md5(body) as digest from bodies"))
def q_text_body(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", tx.strip_markup("xml").alias("b")).select("doc_id", F.length("b").cast("long").alias("n_chars"), F.md5("b").alias("digest"))


@registry.add("page_text", "select page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as digest from pages")
def q_page_text(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", F.md5(tx.strip_markup("html")).alias("digest"))


@registry.add("motif_statements", d.with_ctes(*SQL_STATEMENTS, final="select doc_id, cast(statement as bigint) as statement, cas_name, pam from statements"))
def q_motif_statements(spark, sf_dir):
    return li.motif_statements(papers(spark, sf_dir)).select("doc_id", F.col("statement").cast("long").alias("statement"), "cas_name", "pam")


SQL_TRIPLES = [*SQL_STATEMENTS, sql_places("xml", tx.ITALIC_PATTERN, "papers", "italics"), r"""named as (select doc_id, idx, start_, regexp_extract(inner_, '\b([A-Z][a-z]+)\s+([a-z]{3,})\b', 1) || ' ' || regexp_extract(inner_, '\b([A-Z][a-z]+)\s+([a-z]{3,})\b', 2) as name from italics
      where regexp_matches(inner_, '\b([A-Z][a-z]+)\s+([a-z]{3,})\b')),
    guessed as (select n.*, body, cast(floor(start_ * 1.0::double / greatest(1, length(xml)) * length(body)) as bigint) as guess from named n join bodies b using (doc_id)),
    found as (select *, greatest(guess - 500, 0) as lo from guessed),
    spans as (select doc_id, idx, name, case when instr(substr(body, lo + 1), name) > 0 then lo + instr(substr(body, lo + 1), name) - 1 else instr(body, name) - 1 end as p from found),
    dists as (select s.doc_id, s.statement, n.idx, n.name, greatest(p - center, center - (p + length(name)), 0) as dist from statements s join spans n using (doc_id) where p >= 0),
    nearest as (select doc_id, statement, arg_min(struct_pack(n := name, d := dist), struct_pack(d := dist, i := idx)) as x from dists group by all)"""]


@registry.add("statement_triples", d.with_ctes(*SQL_TRIPLES, final="""select s.doc_id, cast(s.statement as bigint) as statement, cas_name, pam, case when x.d <= 400 then x.n else '' end as species
    from statements s left join nearest n on n.doc_id = s.doc_id and n.statement = s.statement"""))
def q_statement_triples(spark, sf_dir):
    return li.statement_triples(materialize(papers(spark, sf_dir))).withColumn("statement", F.col("statement").cast("long"))


@registry.add("literature_classify", d.with_ctes(SQL_PAPERS, f"""texts as (select doc_id, lower(source) || ' ' || lower(xml) as t from papers),
    marks as (select doc_id, {' or '.join(f"contains(t, '{m}')" for m in tx.REVIEW_MARKERS)} as r, {' or '.join(f"contains(t, '{m}')" for m in tx.COMPUTATIONAL_MARKERS)} as c,
      list_filter([{', '.join(f"'{m}'" for m in tx.ASSAY_TERMS)}], lambda m: contains(t, m)) as a from texts)""",
    final="""select doc_id, case when r then 'review_or_secondary' when len(a) > 0 and not c then 'candidate_experimental' when len(a) > 0 then 'uncertain' when c then 'computational_only' else 'uncertain' end as status,
      array_to_string(a, ';') as assay_terms from marks"""))
def q_classify(spark, sf_dir):
    rows = papers(spark, sf_dir).withColumn("c", tx.classify_paper("source", "xml"))
    return rows.select("doc_id", F.col("c.status").alias("status"), F.array_join("c.assay_terms", ";").alias("assay_terms"))


@registry.add("status_counts", d.with_ctes(SQL_PAPERS, f"""texts as (select doc_id, source, lower(source) || ' ' || lower(xml) as t from papers),
    marks as (select source, {' or '.join(f"contains(t, '{m}')" for m in tx.REVIEW_MARKERS)} as r, {' or '.join(f"contains(t, '{m}')" for m in tx.COMPUTATIONAL_MARKERS)} as c,
      {' or '.join(f"contains(t, '{m}')" for m in tx.ASSAY_TERMS)} as a from texts)""",
    final="""select source, case when r then 'review_or_secondary' when a and not c then 'candidate_experimental' when a then 'uncertain' when c then 'computational_only' else 'uncertain' end as status,
      count(*) as n from marks group by all"""))
def q_status_counts(spark, sf_dir):
    rows = papers(spark, sf_dir).select("source", tx.classify_paper("source", "xml")["status"].alias("status"))
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def phrase_sql() -> str:
    parts = ", ".join("regexp_extract_all(body, '" + p.replace("'", "''") + "', 1)" for p in tx.PHRASE_PATTERNS)
    return f"""phrases as (select doc_id, body, list_filter(list_transform(flatten([{parts}]), lambda m: regexp_replace(upper(m), '[^ACGTRYSWKMBDHVN]', '', 'g')), lambda m: length(m) between 2 and 10) as raw from bodies),
    motifs as (select doc_id, body, list_filter(raw, lambda m, i: list_position(raw, m) = i) as m from phrases)"""


@registry.add("paper_samples", d.with_ctes(SQL_PAPERS, phrase_sql(), final=r"""select doc_id, coalesce(m[1], '') as pam_consensus, case when len(m) > 1 then 'multiple motifs: ' || array_to_string(m, ', ') else '' end as notes,
    coalesce(regexp_extract_all(body, '\b([OPQ][0-9][A-Z0-9]{3}[0-9])\b', 1)[1], '') as protein_id,
    case when regexp_matches(body, '(?i)\bType\s*I\b') then 'Type I' when regexp_matches(body, '(?i)\bType\s*II\b') then 'Type II' when regexp_matches(body, '(?i)\bType\s*V\b') then 'Type V' else '' end as crispr_type,
    regexp_extract(body, '(?i)(Streptococcus|Staphylococcus|Bacillus|Escherichia|Francisella|Lachnospiraceae|Acidaminococcus|Campylobacter|Neisseria|Pseudomonas|Pyrococcus|Sulfolobus|Candidatus)', 1) as organism from motifs"""))
def q_paper_samples(spark, sf_dir):
    return li.paper_sample(papers(spark, sf_dir)).select("doc_id", "pam_consensus", "notes", "protein_id", "crispr_type", "organism")


def statement_rows(spark, sf_dir):
    rows = li.statement_triples(materialize(papers(spark, sf_dir)))
    return rows.select(
        "cas_name", "pam", "species", F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"),
        (F.col("doc_id") * 100 + F.col("statement")).alias("position"),
    )


CONSENSUS_SQL = f"""consensus as (select * from (values {', '.join(f"('{k}', '{v[0]}', [{', '.join(repr(s) for s in v[1])}])" for k, v in li.CONSENSUS.items())}) t(alias, cons, spellings))"""


@registry.add("consensus_filter", d.with_ctes(*SQL_STATEMENTS, CONSENSUS_SQL, final=f"""select doc_id, cast(statement as bigint) as statement, cas_name, pam,
    cons is null or list_contains(spellings, pam) or {d.sql_subset('pam', 'cons')} as kept from statements left join consensus on alias = cas_name"""))
def q_consensus_filter(spark, sf_dir):
    rows = li.consensus_filter(li.motif_statements(papers(spark, sf_dir)))
    return rows.select("doc_id", F.col("statement").cast("long").alias("statement"), "cas_name", "pam", "kept")


def sequence_rows(spark, sf_dir):
    """Candidate sequences of names from suppliers: the name by digest, the match class by nation."""
    s = F.col("s_suppkey")
    return d.table(spark, sf_dir, "supplier").select(
        pick(NAMES, "n", s, 1).alias("cas_name"), d.dna_of("q", s).alias("sequence"), F.concat(F.lit("A"), s.cast("string")).alias("accession"),
        F.get(F.array(*[F.lit(m) for m in ("verified", "species", "species_review", "name_only", "none")]), F.col("s_nationkey") % 5).alias("match"),
        s.alias("position"),
    ).where("cas_name not in ('QzCas13a')")


SQL_GOLD = [*SQL_TRIPLES, f"""pairs as (select cas_name, pam, case when x.d <= 400 then x.n else '' end as species, '10.1/' || cast(s.doc_id as varchar) as doi, s.doc_id * 100 + s.statement as position
      from statements s left join nearest n on n.doc_id = s.doc_id and n.statement = s.statement),
    seqs as (select ([{', '.join(repr(n) for n in NAMES)}])[1 + {d.SQL['nibble']('n', 's_suppkey', 1)} % 8] as cas_name, {d.SQL['dna']('q', 's_suppkey')} as sequence, 'A' || cast(s_suppkey as varchar) as accession,
      s_nationkey % 5 as rank, (['verified', 'species', 'species_review', 'name_only', 'none'])[1 + s_nationkey % 5] as match, s_suppkey from supplier),
    best_seq as (select cas_name, arg_min(struct_pack(sequence := sequence, accession := accession, match := match), struct_pack(r := case when rank = 4 then 99 else rank end, s := s_suppkey)) as b from seqs where cas_name <> 'QzCas13a' group by cas_name),
    gold as (select p.cas_name, p.pam as pam_consensus, b.accession as protein_id, arg_min(struct_pack(doi := doi, species := species, position := position), position) as r, any_value(b.match) as sequence_confidence
      from pairs p join best_seq using (cas_name) group by all)"""]


@registry.add("gold_merge", d.with_ctes(*SQL_GOLD, final="select cas_name, pam_consensus, protein_id, r.doi, r.species, sequence_confidence from gold"))
def q_gold_merge(spark, sf_dir):
    resolved, _ = li.gold_merge(statement_rows(spark, sf_dir), sequence_rows(spark, sf_dir))
    return resolved.select("cas_name", "pam_consensus", "protein_id", "doi", "species", "sequence_confidence")


@registry.add("gold_unresolved", d.with_ctes(*SQL_GOLD, final="select cas_name, pam, doi, species from pairs where cas_name not in (select cas_name from best_seq)"))
def q_gold_unresolved(spark, sf_dir):
    _, unresolved = li.gold_merge(statement_rows(spark, sf_dir), sequence_rows(spark, sf_dir))
    return unresolved.select("cas_name", "pam", "doi", "species")


@registry.add("gold_review", d.with_ctes(*SQL_GOLD, CONSENSUS_SQL, f"""judged as (select g.*, cons, cons is null or list_contains(spellings, pam_consensus) or {d.sql_subset('pam_consensus', 'cons')} as kept from gold g left join consensus on alias = cas_name)""",
    final="""select cas_name, pam_consensus, case when kept and sequence_confidence in ('verified', 'species') then 'clean' else 'review' end as queue,
    case when not kept then 'PAM ''' || pam_consensus || ''' not consensus ''' || cons || ''' for ' || cas_name when sequence_confidence not in ('verified', 'species') then 'sequence_confidence=' || sequence_confidence end as review_reason from judged"""))
def q_gold_review(spark, sf_dir):
    resolved, _ = li.gold_merge(statement_rows(spark, sf_dir), sequence_rows(spark, sf_dir))
    return li.gold_review(resolved).select("cas_name", "pam_consensus", "queue", "review_reason")


@registry.add("alias_queue", d.with_ctes(*SQL_GOLD, f"""open_ as (select * from gold where cas_name not in ({', '.join(repr(n) for n in li.ORGANISM)}))""",
    final="""select cas_name, coalesce(arg_min(r.species, r.position) filter (where r.species <> ''), '') as paper_species,
    array_to_string(list_sort(list_distinct(list(pam_consensus)))[1:12], ',') as pams_seen from open_ group by cas_name"""))
def q_alias_queue(spark, sf_dir):
    resolved, _ = li.gold_merge(statement_rows(spark, sf_dir), sequence_rows(spark, sf_dir))
    return li.alias_queue(resolved).select("cas_name", "paper_species", "pams_seen")


def paper_keys(spark, sf_dir):
    """Publication records from conversations: keys repeat across records in all three ways."""
    c = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
        F.when(d.nibble("d", key, 1) < 8, F.concat(F.lit("10.1/"), F.substring(F.md5(key), 1, 2))).otherwise(F.lit("")).alias("doi"),
        F.when(d.nibble("d", key, 2) < 6, F.substring(F.md5(F.concat(F.lit("p"), key)), 1, 2)).otherwise(F.lit("")).alias("pmid"),
        F.when(d.nibble("d", key, 3) < 4, F.substring(F.md5(F.concat(F.lit("c"), key)), 1, 2)).otherwise(F.lit("")).alias("pmcid"),
        F.col("text").alias("title"), F.col("role").alias("matched_query"),
    )


@registry.add("literature_dedup_sequential")
def q_dedup(spark, sf_dir):
    return li.deduplicate_papers(materialize(paper_keys(spark, sf_dir))).select("position", "kept_position")


@registry.add("literature_merged_labels")
def q_merged(spark, sf_dir):
    rows = materialize(paper_keys(spark, sf_dir))
    return li.merged_papers(rows, li.deduplicate_papers(rows)).select("position", F.array_join("labels", ";").alias("labels"))
