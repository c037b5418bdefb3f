"""Queries over worksheets, annotation tables, manifests, measurements and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..functions import text as tx
from ..operators import annotation as an
from ..operators import contract as co
from ..operators import fusion as fu
from ..operators import grids as gr
from ..operators import quantitative as qu
from ..operators import results as re_
from ..session import materialize, spread
from . import derive as d
from . import ranking_queries as rq
from .evidence_queries import SQL_CANDIDATES
from .registry import registry

MICRO = d.SQL["micro"]


# Worksheets: one sheet per supplier, header rows first, then one row per line item.
def readcount_grid(spark, sf_dir):
    line = d.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 100).alias("row")
    text = lambda c: F.col(c).cast("string")
    data = line.select(F.col("l_suppkey").alias("sheet_id"), row, F.array(
        F.substring(d.dna_of("o", F.col("l_partkey")), 1, 4), (F.col("l_quantity") - 5).cast("string"), text("l_extendedprice")).alias("cells"))
    heads = d.table(spark, sf_dir, "supplier").select("s_suppkey")
    heading = lambda n, *cells: heads.select(F.col("s_suppkey").alias("sheet_id"), F.lit(n).cast("long").alias("row"), F.array(*[F.lit(c) for c in cells]).alias("cells"))
    return heading(0, "", "Read Counts", "").unionByName(heading(1, "PAM", "Bound", "Unbound")).unionByName(data)


@registry.add("readcount_to_freq", f"""with w as (select l_suppkey as sheet_id, substr({d.SQL['dna']('o', 'l_partkey')}, 1, 4) as oligo, greatest(sum(l_quantity - 5), 0) as w from lineitem group by all),
    p as (select sheet_id, i, substr(oligo, i, 1) as b, w from w, (select unnest(range(1, 5)) as i))
    select sheet_id, cast(i as bigint) as position, {', '.join(f"{MICRO(f'''case when sum(w) > 0 then sum(case b when '{b}' then w else 0 end) / sum(w) else 0 end''')} as {b.lower()}" for b in 'ACGT')} from p group by sheet_id, i""")
def q_readcount(spark, sf_dir):
    rows = gr.readcount_frequencies(readcount_grid(spark, sf_dir))
    return rows.select("sheet_id", F.col("position").cast("long").alias("position"), *[d.micro(F.col(b)).alias(b.lower()) for b in "ACGT"])


def position_grid(spark, sf_dir):
    """Per customer nation and status a sheet: header 1 2 3, then a row per base with order counts."""
    o = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    base = F.substring(F.lit("ACGT"), (d.nibble("g", F.col("o_orderkey"), 1) % 4 + 1).cast("int"), F.lit(1))
    place = d.nibble("g", F.col("o_orderkey"), 2) % 3 + 1
    counted = o.groupBy(d.integer_divide(F.col("o_custkey"), 10).alias("sheet_id"), base.alias("base")).agg(
        *[F.count_if(place == k).cast("string").alias(f"p{k}") for k in (1, 2, 3)])
    data = counted.select("sheet_id", (F.ascii("base") + 10).cast("long").alias("row"), F.array("base", "p1", "p2", "p3").alias("cells"))
    heads = counted.select("sheet_id").distinct().select("sheet_id", F.lit(1).cast("long").alias("row"), F.array(*[F.lit(c) for c in ("", "1", "2", "3")]).alias("cells"))
    return heads.unionByName(data)


@registry.add("position_matrix", f"""with c as (select o_custkey // 10 as sheet_id, substr('ACGT', cast({d.SQL['nibble']('g', 'o_orderkey', 1)} % 4 + 1 as int), 1) as b, {d.SQL['nibble']('g', 'o_orderkey', 2)} % 3 + 1 as p from orders),
    s as (select distinct sheet_id from c), g as (select sheet_id, i from s, (select unnest(range(1, 4)) as i))
    select g.sheet_id, cast(g.i as bigint) as position, {', '.join(f"{MICRO(f'''coalesce(count(*) filter (where b = '{b}') * 1.0::double / nullif(count(b), 0), 0)''')} as {b.lower()}" for b in 'ACGT')}
    from g left join c on c.sheet_id = g.sheet_id and c.p = g.i group by g.sheet_id, g.i""")
def q_position_matrix(spark, sf_dir):
    rows = gr.position_matrix(position_grid(spark, sf_dir))
    return rows.select("sheet_id", F.col("position").cast("long").alias("position"), *[d.micro(F.col(b)).alias(b.lower()) for b in "ACGT"])


def kmer_rows(spark, sf_dir):
    """Library k-mers per user: a fixed lead, a noisy motif and a random tail, counted by event."""
    e = d.table(spark, sf_dir, "events").select("event_id", "user_id")
    k = F.col("event_id")
    noise = d.dna_of("e", k)
    motif = F.when(d.nibble("e", k, 30) < 14, F.lit("GG")).otherwise(F.substring(noise, 1, 2))
    return e.select(F.col("user_id").alias("table_id"), F.concat(F.lit("AC"), F.substring(noise, 3, 1), motif, F.substring(noise, 5, 2)).alias("kmer"), F.lit(1).alias("n"))


SQL_KMERS = f"""kmers as (select user_id as table_id, 'AC' || substr({d.SQL['dna']('e', 'event_id')}, 3, 1) || case when {d.SQL['nibble']('e', 'event_id', 30)} < 14 then 'GG' else substr({d.SQL['dna']('e', 'event_id')}, 1, 2) end
      || substr({d.SQL['dna']('e', 'event_id')}, 5, 2) as kmer from events),
    pos as (select table_id, i, substr(kmer, cast(i + 1 as int), 1) as b from kmers, (select unnest(range(0, 7)) as i)),
    cnt as (select table_id, i, count(*) as n, {', '.join(f"count(*) filter (where b = '{b}') * 1.0::double / count(*) as {b.lower()}" for b in 'ACGT')} from pos group by all),
    bits as (select *, 2 + {' + '.join(f'(case when {b} > 0 then {b} * log2({b}) else 0 end)' for b in 'acgt')} as bits from cnt),
    ends as (select *, coalesce(min(i) filter (where bits < 1.0) over w, 7) as s, coalesce(max(i) filter (where bits > 0.25) over w + 1, 0) as e from bits window w as (partition by table_id)),
    letters as (select *, case when greatest(a, c, g, t) >= 0.75 then case greatest(a, c, g, t) when a then 'A' when c then 'C' when g then 'G' else 'T' end
      when a + g >= 0.85 then 'R' when c + t >= 0.85 then 'Y' when c + g >= 0.85 then 'S' when a + t >= 0.85 then 'W' when g + t >= 0.85 then 'K' when a + c >= 0.85 then 'M'
      when a + c + g >= 0.92 then 'V' when a + c + t >= 0.92 then 'H' when a + g + t >= 0.92 then 'D' when c + g + t >= 0.92 then 'B' else 'N' end as l from ends)"""


@registry.add("kmer_count_to_pam", d.with_ctes(SQL_KMERS, final="""select table_id, coalesce(string_agg(l, '' order by i) filter (where i >= s and (i < e or e <= s)), '') as consensus, cast(any_value(s) as bigint) as pam_start,
    cast(any_value(e) as bigint) as pam_end, max(n) as total_counts from letters group by table_id"""))
def q_kmer_counts(spark, sf_dir):
    return gr.kmer_counts_to_motif(kmer_rows(spark, sf_dir))


def motif_grid(spark, sf_dir):
    """Motif tables: one sheet per ten suppliers, a title, a header, then a row per part."""
    p = F.col("p_partkey")
    sheet = d.integer_divide(p, 200).alias("sheet_id")
    pam = F.when(p % 7 == 0, F.lit("NNN")).otherwise(F.concat(F.lit("N"), F.substring(d.dna_of("f", p), 1, 2), F.when(p % 3 == 0, F.lit("(A>G)")).otherwise(F.lit(""))))
    data = d.table(spark, sf_dir, "part").select(sheet, (p + 100).alias("row"), F.array(F.col("p_name"), pam, F.col("p_type")).alias("cells"))
    sheets = d.system_ids(spark, sf_dir)
    heading = lambda n, *cells: sheets.select(F.col("system_id").alias("sheet_id"), F.lit(n).cast("long").alias("row"), F.array(*[F.lit(c) for c in cells]).alias("cells"))
    return heading(0, "Table S1", "", "").unionByName(heading(1, "Effector", "PAM sequence", "Organism")).unionByName(data)


@registry.add("motif_table", f"""with r as (select p_partkey // 200 as sheet_id, p_partkey + 100 as row, case when p_partkey % 7 = 0 then 'NNN' else 'N' || substr({d.SQL['dna']('f', 'p_partkey')}, 1, 2) end as pam_consensus, p_name, p_type from part)
    select sheet_id, row, pam_consensus, trim(p_name) as protein_id, trim(p_name) || ' | org=' || trim(p_type) as raw_ref from r where regexp_matches(pam_consensus, '[ACGT]') and sheet_id in (select s_suppkey // 10 from supplier)""")
def q_motif_table(spark, sf_dir):
    return gr.motif_table_rows(motif_grid(spark, sf_dir)).select("sheet_id", "row", "pam_consensus", "protein_id", "raw_ref")


# Annotation: contigs are suppliers, operons their orders of genes.
def contigs(spark, sf_dir):
    s = F.col("s_suppkey")
    seq = F.concat(d.dna_of("k", s), F.lit("ATG"), F.translate(d.dna_of("l", s), "T", "C"), F.lit("C"), F.lit("TAA"), d.dna_of("w", s))
    return spread(d.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")).select(
        F.concat(F.lit("c"), s.cast("string")).alias("contig"), s.alias("k"), "s_nationkey", seq.alias("contig_sequence"))


def annotation_inputs(spark, sf_dir):
    c = contigs(spark, sf_dir)
    k = F.col("k")
    reverse = k % 4 == 3
    turned = F.when(reverse, dna.reverse_complement("contig_sequence")).otherwise(F.col("contig_sequence"))
    c = c.select("contig", "k", "s_nationkey", turned.alias("contig_sequence"))
    start = F.when(reverse, F.lit(33)).otherwise(F.lit(33))
    genes = c.where("k % 9 <> 8").select(
        F.col("contig").alias("Contig"), F.lit("1").alias("Pos"), start.cast("string").alias("Start"),
        (F.lit(33 + 38) + F.when(k % 5 == 4, 2).otherwise(0)).cast("string").alias("End"), F.when(reverse, F.lit("-1")).otherwise(F.lit("1")).alias("Strand"))
    coding = F.expr("substring(contig_sequence, 33, 39)")
    protein = F.regexp_replace(dna.translate_dna(F.when(reverse, dna.reverse_complement(coding)).otherwise(coding)), r"\*+$", "")
    proteins = c.where("k % 11 <> 10").select(F.concat("contig", F.lit("_1")).alias("record_id"), F.concat(protein, F.when(k % 13 == 12, F.lit("A")).otherwise(F.lit("")), F.lit("*")).alias("sequence"))
    prediction = F.get(F.array(*[F.lit(x) for x in ("II-A", "II-C", "Ambiguous", "V-A", "II-A (Putative)")]), F.col("s_nationkey") % 5)
    operons = c.select(F.col("contig").alias("Contig"), F.concat(F.col("contig"), F.lit("@1")).alias("Operon"), prediction.alias("Prediction"),
                       F.lit("['cas9', 'cas1', 'cas2']").alias("Genes"), F.lit("[1, 2, 3]").alias("Positions"))
    return operons, genes, proteins, c.select("contig", "contig_sequence")


CODON = dna.CODON_RESIDUES
SQL_ANNOTATION = f"""raw as (select 'c' || cast(s_suppkey as varchar) as contig, s_suppkey as k, s_nationkey, {d.SQL['dna']('k', 's_suppkey')} || 'ATG' || translate({d.SQL['dna']('l', 's_suppkey')}, 'T', 'C') || 'CTAA' || {d.SQL['dna']('w', 's_suppkey')} as fwd from supplier),
    cs as (select *, case when k % 4 = 3 then {d.SQL['revcomp']('fwd')} else fwd end as seq from raw),
    genes as (select *, case when k % 9 = 8 then null else 33 end as st, 71 + case when k % 5 = 4 then 2 else 0 end as en from cs),
    coded as (select *, case when k % 4 = 3 then {d.SQL['revcomp']('substr(seq, 33, 39)')} else substr(seq, 33, 39) end as gene39,
      case when k % 4 = 3 then {d.SQL['revcomp']('substr(seq, 33, en - 32)')} else substr(seq, 33, en - 32) end as coding from genes),
    tr as (select *, {{t39}} as p39, {{tc}} as pc from coded),
    prot as (select *, case when k % 11 = 10 then '' else regexp_replace(p39, '\\*+$', '') || case when k % 13 = 12 then 'A' else '' end end as protein, regexp_replace(pc, '\\*+$', '') as made from tr)"""


def sql_translate(s: str) -> str:
    return f"""array_to_string(list_transform(range(0, length({s}) // 3), lambda i: substr('{CODON}', (instr('TCAG', substr({s}, i * 3 + 1, 1)) - 1) * 16
      + (instr('TCAG', substr({s}, i * 3 + 2, 1)) - 1) * 4 + instr('TCAG', substr({s}, i * 3 + 3, 1)), 1)), '')"""


@registry.add("annotation_systems", d.with_ctes(
    SQL_ANNOTATION.format(t39=sql_translate("gene39"), tc=sql_translate("coding")),
    """facts as (select *, contig || '_1' as system_id, regexp_matches(protein, '\\*') as internal, length(coding) % 3 <> 0 as frame,
      substr(coding, 1, 3) in ('ATG', 'GTG', 'TTG', 'CTG', 'ATT', 'ATC', 'ATA') as ok_start, right(coding, 3) in ('TAA', 'TAG', 'TGA') as ok_stop,
      made = protein as same, length(made) = length(protein) and substr(made, 2) = substr(protein, 2) and protein like 'M%' as near from prot),
    verdicts as (select *, coalesce(protein <> '' and st is not null and not internal and not frame and ok_start and ok_stop and (same or (near and ok_start)), false) as verified from facts)""",
    final="""select system_id, length(protein) as protein_length, verified as integrity_verified, array_to_string(list_filter([
      case when s_nationkey % 5 in (0, 1) then null when s_nationkey % 5 = 2 then 'ambiguous_or_putative_subtype' when s_nationkey % 5 = 4 then null else 'unsupported_subtype' end,
      case when protein = '' then 'missing_protein_sequence' end, case when st is null then 'gene_coordinates_missing' end, case when not verified then 'gene_integrity_unverified' end], lambda x: x is not null), ';') as issues from verdicts""",
))
def q_annotation(spark, sf_dir):
    rows = an.collect_systems(*annotation_inputs(spark, sf_dir))
    return rows.select("system_id", F.col("protein_length").cast("long").alias("protein_length"), "integrity_verified", F.array_join("issues", ";").alias("issues"))


@registry.add("system_choice", d.with_ctes(
    SQL_ANNOTATION.format(t39=sql_translate("gene39"), tc=sql_translate("coding")),
    """facts as (select *, length(coding) % 3 <> 0 as frame, substr(coding, 1, 3) in ('ATG', 'GTG', 'TTG', 'CTG', 'ATT', 'ATC', 'ATA') as ok_start,
      right(coding, 3) in ('TAA', 'TAG', 'TGA') as ok_stop, made = protein as same from prot),
    verdicts as (select *, coalesce(protein <> '' and st is not null and not regexp_matches(protein, '\\*') and not frame and ok_start and ok_stop and same, false) as verified from facts)""",
    final="""select contig || '_1' as system_id, case when not verified or st is null or protein = '' then 'blocked' when s_nationkey % 5 in (2, 3) then 'override_only' else 'eligible' end as choice from verdicts""",
))
def q_system_choice(spark, sf_dir):
    return an.system_choice(an.collect_systems(*annotation_inputs(spark, sf_dir))).select("system_id", "choice")


# Manifests: one system per customer with some fields broken by its numbers.
def manifest_rows(spark, sf_dir):
    c = F.col("c_custkey")
    rows = spread(d.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    digest = F.sha2(c.cast("string"), 256)
    entry = lambda bad: F.struct(*[
        F.when(bad, F.lit("short")).otherwise(digest).alias(f) if f == "sha256" else F.lit("x").alias(f) for f in co.PROVENANCE_FIELDS])
    paired = c % 3 == 0
    text = lambda value, name: F.lit(value).alias(name)
    return rows.select(
        F.concat(F.lit("s"), c.cast("string")).alias("system_id"),
        F.when(c % 4 == 0, "strict_independent").when(c % 4 == 1, "retrospective_biological").when(c % 29 == 2, "other").otherwise("engineering_regression").alias("tier"),
        F.when(c % 5 == 4, "curating").otherwise("ready").alias("status"), text("II-A", "crispr_type"), text("Cas9", "cas_family"),
        F.when(paired, F.array(F.lit("protein_only"), F.lit("paired_evidence"))).otherwise(F.array(F.lit("protein_only"))).alias("available_tracks"),
        text("cas9", "protein_model"), F.when(c % 17 == 16, "../up.faa").otherwise("data/p.faa").alias("protein_fasta"), text("r1", "protein_record_id"),
        F.when(c % 19 == 18, "left").otherwise("downstream").alias("pam_side"), F.when(c % 23 == 22, F.array(F.lit(3), F.lit(4))).otherwise(F.array(F.lit(3))).alias("pam_lengths"),
        F.create_map(F.lit("3"), F.array(F.lit("NGG"))).alias("gold_pam_spectrum"), text("experimental_activity", "gold_evidence_type"), text("10.1/x", "gold_doi"),
        F.struct(text("depletion", "assay_type"), F.lit(True).alias("activity_values_available"), text("in vitro", "conditions"), text("Fig 1", "source_locator")).alias("gold_assay"),
        text("exact_protein_or_strain", "gold_system_match"),
        F.when(c % 7 == 6, "near").otherwise("none").alias("protein_training_exposure"),
        F.when(F.col("c_nationkey") % 2 == 0, "virus_clustered").otherwise("contig_only").alias("target_independence"),
        text("taxon", "host_taxon"), text("strain", "host_strain"), F.col("c_mktsegment").alias("split_group"), text("none", "notes"),
        F.when(paired, F.lit("data/s.fna")).alias("spacer_fasta"), F.when(paired, F.lit("forward")).alias("spacer_orientation"),
        F.when(paired, F.array(F.lit("data/t.fna"))).alias("target_fastas"), F.when(paired, F.lit(1)).alias("max_mismatches"),
        F.lit(None).cast("string").alias("published_flanks_tsv"), F.lit(None).cast("int").alias("min_effective_spacers"),
        F.lit(None).cast("string").alias("host_genome_fasta"), F.lit(None).cast("map<string,string>").alias("discovery_policy"),
        F.when(paired, F.struct(*[text("v", f) for f in ("name", "release", "frozen_at", "selection_policy", "cluster_policy")])).alias("target_dataset"),
        F.lit(None).cast("struct<name:string,doi:string,release:string,frozen_at:string,row_selection_policy:string,orientation_policy:string,raw_target_identifiers_available:boolean>").alias("published_flank_dataset"),
        F.struct(
            entry(c % 13 == 12).alias("protein"), F.when(paired, entry(F.lit(False))).alias("spacers"),
            F.when(paired, F.array(entry(F.lit(False)))).alias("targets"),
            F.lit(None).cast(co._ENTRY).alias("published_flanks"), F.lit(None).cast(co._ENTRY).alias("host_genome"),
        ).alias("provenance"),
    )


SQL_MANIFEST = """m as (select c_custkey as c, c_nationkey as n, c_custkey % 3 = 0 as paired, c_custkey % 4 = 0 as strict_tier from customer),
    base as (select *, strict_tier and c % 5 <> 4 and c % 7 <> 6 and c % 13 <> 12 as base_strict, case when paired then 2 else 1 end as tracks from m),
    elig as (select *, (case when base_strict then 1 else 0 end) + (case when base_strict and paired and n % 2 = 0 then 1 else 0 end) as eligible from base),
    audits as (select *, (case when c % 4 in (2, 3) and c % 29 = 2 then 1 else 0 end) + (case when c % 17 = 16 then 1 else 0 end) + (case when c % 19 = 18 then 1 else 0 end) + (case when c % 23 = 22 then 1 else 0 end)
      + (case when c % 13 = 12 then 1 else 0 end) + (case when strict_tier and eligible < tracks then 1 else 0 end) as errors,
      (case when c % 7 = 6 then 1 else 0 end) + (case when paired and n % 2 <> 0 then 1 else 0 end) + (case when c % 5 = 4 then 1 else 0 end) as warnings from elig)"""


@registry.add("contract_violations", d.with_ctes(SQL_MANIFEST, final="select 's' || cast(c as varchar) as system_id, errors::bigint as errors, warnings::bigint as warnings, errors = 0 as valid, errors = 0 and c % 5 <> 4 as runnable, eligible::bigint as strict_tracks from audits"))
def q_contract(spark, sf_dir):
    rows = co.audit_systems(manifest_rows(spark, sf_dir))
    return rows.select("system_id", F.size("errors").cast("long").alias("errors"), F.size("warnings").cast("long").alias("warnings"), "valid", "runnable",
                       F.size("strict_eligible_tracks").cast("long").alias("strict_tracks"))


@registry.add("contract_track_counts", d.with_ctes(SQL_MANIFEST, final="""select 'protein_only' as track, count(*) as systems, count(*) filter (where base_strict) as strict_systems from audits
    union all select 'paired_evidence', count(*) filter (where paired), count(*) filter (where base_strict and paired and n % 2 = 0) from audits"""))
def q_track_counts(spark, sf_dir):
    return co.track_counts(co.audit_systems(manifest_rows(spark, sf_dir)))


@registry.add("provenance_check", """select p_partkey, case when p_partkey % 11 = 10 then 'missing' when p_partkey % 7 = 6 then 'mismatch' else 'ok' end as state from part""")
def q_provenance(spark, sf_dir):
    p = F.col("p_partkey")
    part = d.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    content = F.concat("p_name", p.cast("string"))
    expected = part.select("p_partkey", F.concat(F.lit("f/"), p.cast("string")).alias("path"), F.upper(F.sha2(content, 256)).alias("sha256"))
    actual = part.where("p_partkey % 11 <> 10").select(
        F.concat(F.lit("f/"), p.cast("string")).alias("path"), F.sha2(F.when(p % 7 == 6, F.concat(content, F.lit("!"))).otherwise(content), 256).alias("sha256"))
    return co.verify_files(expected, actual).select("p_partkey", "state")


# Measurements: a variant per part, its 64 groups from digests.
def variants(spark, sf_dir):
    return spread(d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"), "p_size"))


# Variants of one task, each of 64 rows.
VARIANTS_OF_A_TASK = 20_000


def measurements(spark, sf_dir):
    """Rows by variant: variants are dealt before they become 64 rows, so that what is grouped by variant does not move."""
    rows = variants(spark, sf_dir)
    tasks = max(1, rows.count() // VARIANTS_OF_A_TASK, spark.sparkContext.defaultParallelism)
    groups = qu.expected_groups(rows.repartition(tasks, "variant_id"))
    key = F.concat(F.col("variant_id").cast("string"), F.col("pam_group"))
    raw = F.when(F.col("variant_id") % 50 == 49, F.lit(-6.0)).otherwise(d.nibble("v", key, 1) / 2.0 - 7.0)
    return qu.clip(groups.select("variant_id", "pam_group", raw.alias("raw_log10_k")))


SQL_MEASURES = f"""b as (select unnest(['A', 'C', 'G', 'T']) as b), grp as (select 'N' || x.b || y.b || z.b as pam_group from b x, b y, b z),
    meas as (select p_partkey as variant_id, p_size, pam_group, case when p_partkey % 50 = 49 then -6.0::double else {d.SQL['nibble']('v', "cast(p_partkey as varchar) || pam_group", 1)} / 2.0::double - 7.0 end as raw from part, grp)"""


@registry.add("variant_profile", d.with_ctes(SQL_MEASURES, final="""select variant_id, count(distinct pam_group) as groups, count(*) filter (where raw <= -5) as censored, min(greatest(raw, -5)) = max(greatest(raw, -5)) as constant_target from meas group by variant_id"""))
def q_variant_profile(spark, sf_dir):
    return qu.variant_profile(measurements(spark, sf_dir))


SQL_VARIANTS = [SQL_MEASURES, f"""mm as (select variant_id, p_size, pam_group, greatest(raw, -5) as target, {d.SQL['nibble']('y', "cast(variant_id as varchar) || pam_group", 1)} as pred,
      {d.SQL['nibble']('x', 'pam_group', 1)} as ctrl from meas),
    r as (select *, {', '.join(f"rank() over (partition by variant_id order by {c}) + (count(*) over (partition by variant_id, {c}) - 1) / 2.0::double as r_{c}, greatest(0.0::double, least(count(*) over (partition by variant_id, {c}), 5 - (rank() over (partition by variant_id order by {c} desc) - 1))) / count(*) over (partition by variant_id, {c}) as m_{c}" for c in ('target', 'pred', 'ctrl'))} from mm),
    v as (select variant_id, any_value(p_size) as p_size, case when min(target) < max(target) then corr(r_pred, r_target) end as sp, case when min(target) < max(target) then corr(r_ctrl, r_target) end as csp,
      sum(m_pred * m_target) / 5 as ov, sum(m_ctrl * m_target) / 5 as cov from r group by variant_id)"""]


def per_variant(spark, sf_dir):
    from ..operators import metrics as me

    m = measurements(spark, sf_dir)
    key = F.concat(F.col("variant_id").cast("string"), F.col("pam_group"))
    rows = m.select("variant_id", F.col("pam_group").alias("item"), d.nibble("y", key, 1).alias("prediction"), F.col("ranking_target_log10_k").alias("target"))
    # Every variant has the same groups.
    items = qu.expected_groups(variants(spark, sf_dir).limit(1)).select(F.col("pam_group").alias("item"))
    control = items.select("item", d.nibble("x", F.col("item"), 1).alias("control"))
    return me.variant_metrics(rows, control, variant="variant_id", item="item")


@registry.add("variant_metrics", d.with_ctes(*SQL_VARIANTS, final=f"""select variant_id, {MICRO('sp')} as spearman_micro, {MICRO('csp')} as control_micro, {MICRO('ov')} as overlap_micro, {MICRO('ov - cov')} as delta_overlap_micro from v"""))
def q_variant_metrics(spark, sf_dir):
    return per_variant(spark, sf_dir).select(
        "variant_id", d.micro(F.col("spearman")).alias("spearman_micro"), d.micro(F.col("control_spearman")).alias("control_micro"),
        d.micro(F.col("top_overlap")).alias("overlap_micro"), d.micro(F.col("delta_top_overlap")).alias("delta_overlap_micro"))


@registry.add("variant_group_summary", d.with_ctes(*SQL_VARIANTS, final=f"""select coalesce('p_size=' || cast(p_size as varchar), 'all') as "group", count(*) as n, count(sp) as defined_spearman_pairs, count(*) filter (where sp - csp > 0) as positive_spearman_gains,
    {MICRO('avg(sp)')} as mean_spearman_micro, {MICRO('avg(ov)')} as mean_overlap_micro from v group by grouping sets ((), (p_size))"""))
def q_variant_group_summary(spark, sf_dir):
    from ..operators import metrics as me

    rows = me.group_summary(per_variant(spark, sf_dir).join(variants(spark, sf_dir), "variant_id"), ["p_size"])
    return rows.select("group", "n", "defined_spearman_pairs", "positive_spearman_gains", d.micro(F.col("mean_spearman")).alias("mean_spearman_micro"), d.micro(F.col("mean_top_overlap")).alias("mean_overlap_micro"))


@registry.add("measurement_violations", d.with_ctes("""line as (select l_partkey as variant_id, 'N' || substr('ACGT', 1 + cast(l_linenumber as int) % 4, 1) || 'GG' as g from lineitem),
    per as (select variant_id, count(*) as n, count(distinct g) as k from line group by all)""",
    final="""select variant_id, unnest(list_filter(['incomplete_groups', case when n > k then 'repeated_groups' end], lambda x: x is not null)) as problem from per
    union all select p_partkey, unnest(['no_measurements', 'incomplete_groups']) from part where p_partkey not in (select variant_id from per)"""))
def q_measurement_violations(spark, sf_dir):
    line = d.table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity")
    group = F.concat(F.lit("N"), F.substring(F.lit("ACGT"), (F.lit(1) + F.col("l_linenumber") % 4).cast("int"), F.lit(1)), F.lit("GG"))
    rows = qu.clip(line.select(F.col("l_partkey").alias("variant_id"), group.alias("pam_group"), F.col("l_quantity").cast("double").alias("raw_log10_k")))
    return qu.measurement_violations(rows, variants(spark, sf_dir))


# Corpus profile and result rows.
@registry.add("corpus_crosstab", """select lang, source, count(*) as n, cast(grouping(lang) * 2 + grouping(source) as bigint) as grain from documents group by cube (lang, source)""")
def q_crosstab(spark, sf_dir):
    return re_.crosstab_with_margins(d.table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")


@registry.add("corpus_completeness", f"""select 'text' as "column", {MICRO("avg(case when trim(text, ' ') <> '' then 1.0 else 0.0 end)")} as filled_micro from documents union all select 'lang', {MICRO("avg(case when trim(lang, ' ') <> '' then 1.0 else 0.0 end)")} from documents""")
def q_completeness(spark, sf_dir):
    rows = re_.completeness(d.table(spark, sf_dir, "documents").select("text", "lang"), ["text", "lang"])
    return rows.select("column", d.micro(F.col("filled_share")).alias("filled_micro"))


@registry.add("length_histogram", "select length(text) as length, count(*) as n from documents group by 1 order by n desc, length limit 10")
def q_length_histogram(spark, sf_dir):
    return re_.length_histogram(d.table(spark, sf_dir, "documents").select("text"), "text")


@registry.add("stable_row_ids", """with c as (select conv_id, turn, sha256('{"role":"' || role || '"}') as h from conversations),
    n as (select *, cast(row_number() over (partition by h order by conv_id, turn) as varchar) as k from c)
    select conv_id, turn, 'bench-' || substr(h, 1, 16) || '-' || case when length(k) < 3 then lpad(k, 3, '0') else k end as row_id from n""")
def q_stable_row_ids(spark, sf_dir):
    rows = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lit("").alias("row_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"))
    return re_.stable_row_ids(rows, ["role"], "position").select("conv_id", "turn", "row_id")


@registry.add("motif_spectrum", f"""with m as (select l_suppkey, substr({d.SQL['dna']('u', 'l_orderkey')}, 1, 2 + cast(l_linenumber as int) % 2) as pam, min(l_orderkey * 10 + l_linenumber) as pos from lineitem group by all)
    select l_suppkey, length(pam) as length, string_agg(pam, ',' order by pos) as motifs from m group by all""")
def q_spectrum(spark, sf_dir):
    line = d.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    pam = F.substring(d.dna_of("u", F.col("l_orderkey")), F.lit(1), (F.lit(2) + F.col("l_linenumber") % 2).cast("int"))
    rows = line.select("l_suppkey", pam.alias("pam"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return re_.spectrum_by_length(rows, ["l_suppkey"]).select("l_suppkey", F.explode("spectrum").alias("length", "m")).select(
        "l_suppkey", F.col("length").cast("long").alias("length"), F.array_join("m", ",").alias("motifs"))


@registry.add("result_rows", d.with_ctes(*rq.SQL_BOTH, rq.SQL_GOLDS, """wanted as (select *, row_number() over (partition by system_id order by protein_rank, candidate_pam) as n,
      candidate_pam in ('AGG', 'TGG') as listed from statuses)""",
    final="""select system_id, candidate_pam, status as evidence_status, cast(protein_rank as bigint) as protein_rank, cast(system_id as varchar) || '-' || lpad(cast(row_number() over (partition by system_id order by protein_rank, candidate_pam) as varchar), 4, '0') as row_id
    from wanted where n <= 5 or listed"""))
def q_result_rows(spark, sf_dir):
    fused = rq.fused_rows(spark, sf_dir)
    display = d.system_ids(spark, sf_dir).select("system_id", F.explode(F.array(F.lit("AGG"), F.lit("TGG"))).alias("candidate_pam"))
    kept = re_.presentation_subset(fused, display, 5)
    return re_.sequential_ids(kept, ["protein_rank", "candidate_pam"]).select(
        "system_id", "candidate_pam", "evidence_status", F.col("protein_rank").cast("long").alias("protein_rank"), "row_id")


# Every third system has no spacer track, every fourth publishes aggregates only; every fifth lists two candidates.
RESULT_NOTES = {"raw": "counts of targets", "aggregate": "targets unknown"}
NO_TRACK = "no spacer evidence"


@registry.add("results_assembly", d.with_ctes(*rq.SQL_BOTH, """numbered as (select *, system_id % 3 = 0 as alone, system_id % 5 = 0 as chosen, candidate_pam in ('AGG', 'TGG') as listed,
      row_number() over (partition by system_id order by protein_rank, pam_length, candidate_pam) as n, spacer_rank is not null or sc is not null as has_spacer from statuses where ps is not null)""",
    final=f"""select system_id, candidate_pam, cast(system_id as varchar) || '-' || lpad(cast(row_number() over (partition by system_id order by pam_length, protein_rank, candidate_pam) as varchar), 4, '0') as candidate_id,
      {d.SQL['micro']('ps')} as protein_micro, case when not alone then {d.SQL['micro']('ss')} end as spacer_micro, case when not alone then cast(sc as bigint) end as support_spacer_count,
      case when not alone then status end as evidence_status,
      case when alone then '{re_.RANKED_BY_PROTEIN}' when has_spacer then '{re_.RANKED_BY_GATE}' || gate else '{re_.SPACER_MISSING}' end as ranking_basis,
      case when alone then '{NO_TRACK}' when system_id % 4 = 0 then '{RESULT_NOTES['aggregate']}' else '{RESULT_NOTES['raw']}' end as notes
    from numbered where n <= 7 or (chosen and listed)"""))
def q_results_assembly(spark, sf_dir):
    # Each channel is found once for its two readers; of its columns only those that the rows and the gate read are stored.
    protein = materialize(rq.protein_rows(spark, sf_dir).select("system_id", "candidate_pam", "pam_length", "specificity_adjusted_score", "protein_rank"))
    spacer = materialize(rq.spacer_rows(spark, sf_dir).select(
        "system_id", "candidate_pam", "spacer_evidence_score", "spacer_rank", "support_spacer_count", "support_target_count"))
    fused = fu.fuse(protein.select("system_id", "candidate_pam", "specificity_adjusted_score"), spacer)
    system = F.col("system_id")
    systems = d.system_ids(spark, sf_dir).select(
        system, F.when(system % 3 == 0, F.lit("protein_only")).otherwise(F.lit("dual")).alias("evidence_track"),
        F.when(system % 4 == 0, F.lit("aggregate")).otherwise(F.lit("raw")).alias("evidence_source"))
    display = systems.where(system % 5 == 0).select(system, F.explode(F.array(F.lit("AGG"), F.lit("TGG"))).alias("candidate_pam"))
    rows = re_.assemble_results(
        protein, spacer.where(system % 3 != 0), fused, systems, display=display, top=7, notes=RESULT_NOTES, no_track_note=NO_TRACK)
    return rows.select(
        "system_id", "candidate_pam", "candidate_id", d.micro(F.col("specificity_adjusted_score")).alias("protein_micro"),
        d.micro(F.col("spacer_evidence_score")).alias("spacer_micro"), "support_spacer_count", "evidence_status", "ranking_basis", "notes")


@registry.add("optional_numbers", "select event_id, try_cast(nullif(trim(case when event_id % 3 = 0 then '' when event_id % 5 = 0 then 'n/a' else cast(value as varchar) end), '') as double) as value from events")
def q_optional_numbers(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").select("event_id", "value")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", tx.optional_score(text).alias("value"))
