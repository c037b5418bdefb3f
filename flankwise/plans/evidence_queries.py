"""Queries over the spacer channel: hits, flanks, weights, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..operators import evidence as ev
from ..operators.candidates import concrete_candidates
from ..operators.matching import spacer_hits
from ..session import materialize
from . import derive as d
from .registry import registry

KEYS = ["system_id"]
MICRO = d.SQL["micro"]


def hits_of(spark, sf_dir, mismatches: int = 1):
    return spacer_hits(
        d.spacers(spark, sf_dir), d.targets(spark, sf_dir), mismatches=mismatches,
        flank_length=d.FLANK_LENGTH, lengths=[d.SPACER_LENGTH], keys=KEYS,
    )


def flanks_of(spark, sf_dir):
    return ev.eligible_flanks(hits_of(spark, sf_dir), side="downstream", lengths=d.LENGTHS, keys=KEYS)


def candidates_of(spark, sf_dir):
    return concrete_candidates(d.matrices(spark, sf_dir))


def scored_spacer_candidates(spark, sf_dir):
    flanks = materialize(flanks_of(spark, sf_dir))
    background = ev.background_frequencies(d.targets(spark, sf_dir), keys=KEYS)
    return ev.score_spacer_candidates(flanks, candidates_of(spark, sf_dir), background, keys=KEYS)


SQL_HITS = [d.sql_spacers(), d.sql_targets(), d.sql_hits(1)]

# Weights, candidate evidence and ranks by definition: every flank against every candidate of its length.
SQL_WEIGHTS = """weights as (select *, orientation_weight / sum(orientation_weight) over (partition by system_id, motif_length, spacer_sequence) as weight from flanks)"""
SQL_BACKGROUND = """background as (select system_id,
    sum(length(target_sequence) - length(replace(target_sequence, 'A', ''))) * 1.0 / sum(length(target_sequence)) as a,
    sum(length(target_sequence) - length(replace(target_sequence, 'C', ''))) * 1.0 / sum(length(target_sequence)) as c,
    sum(length(target_sequence) - length(replace(target_sequence, 'G', ''))) * 1.0 / sum(length(target_sequence)) as g,
    sum(length(target_sequence) - length(replace(target_sequence, 'T', ''))) * 1.0 / sum(length(target_sequence)) as t
    from targets group by system_id)"""
SQL_CANDIDATES = """bases as (select unnest(['A', 'C', 'G', 'T']) as b),
    system_list as (select distinct s_suppkey // 10 as system_id from supplier),
    motifs3 as (select x.b || y.b || z.b as candidate_pam from bases x, bases y, bases z),
    motifs as (select candidate_pam from motifs3 union all select candidate_pam || b from motifs3, bases),
    candidates as (select system_id, candidate_pam, length(candidate_pam) as motif_length from system_list, motifs)"""
SQL_EVIDENCE = """effective as (select system_id, motif_length, count(distinct spacer_sequence) as w, count(distinct target_id) as et, count(*) as ea from weights group by all),
    supported as (select c.system_id, c.candidate_pam, c.motif_length, round(coalesce(sum(x.weight), 0), 12) as s,
        count(distinct x.spacer_sequence) as sc, count(distinct x.target_id) as tc, count(x.spacer_sequence) as ac
      from candidates c left join weights x on x.system_id = c.system_id and x.motif = c.candidate_pam group by all),
    with_q as (select u.*, coalesce(e.w, 0) as w, coalesce(e.et, 0) as et, coalesce(e.ea, 0) as ea,
        list_reduce(list_transform(range(1, u.motif_length + 1), lambda i: case substr(u.candidate_pam, i, 1)
          when 'A' then b.a when 'C' then b.c when 'G' then b.g else b.t end), lambda x, y: x * y) as q
      from supported u left join effective e using (system_id, motif_length) join background b using (system_id)),
    with_p as (select *, case when w > 0 then (s + 2.0 * q) / (w + 2.0) end as p from with_q),
    evidence as (select *, case when p >= q then 50 * ((p - q) / (1 - q) + 1) else 50 * ((p - q) / q + 1) end as score,
        log2(greatest(p, 1e-12) / greatest(q, 1e-12)) as enrichment from with_p),
    ranked_evidence as (select *, case when score is not null then row_number() over (partition by system_id, motif_length, score is null
        order by score desc, sc desc, tc desc, candidate_pam) end as spacer_rank from evidence)"""

SQL_SPACER_CHANNEL = [*SQL_HITS, d.sql_flanks(), SQL_WEIGHTS, SQL_BACKGROUND, SQL_CANDIDATES, SQL_EVIDENCE]


@registry.add("spacer_hits", d.with_ctes(*SQL_HITS, final='select * from hits'))
def q_spacer_hits(spark, sf_dir):
    return hits_of(spark, sf_dir)


@registry.add("spacer_hits_exact", d.with_ctes(d.sql_spacers(), d.sql_targets(), d.sql_hits(0), final='select * from hits'))
def q_spacer_hits_exact(spark, sf_dir):
    return hits_of(spark, sf_dir, 0)


@registry.add("spacer_hits_two_mismatches", d.with_ctes(
    d.sql_spacers(), d.sql_targets(), d.sql_hits(2),
    final="select system_id, spacer_id, strand, mismatches, count(*) as n from hits group by all",
))
def q_spacer_hits_two(spark, sf_dir):
    return hits_of(spark, sf_dir, 2).groupBy("system_id", "spacer_id", "strand", "mismatches").agg(F.count(F.lit(1)).alias("n"))


@registry.add("contig_hits", d.with_ctes(d.sql_contig_hits(), final="select * from hits"))
def q_contig_hits(spark, sf_dir):
    """Spacers of many lengths on whole texts as contigs, in overlapping tiles."""
    return spacer_hits(d.passage_spacers(spark, sf_dir), d.contigs(spark, sf_dir), mismatches=1, flank_length=d.FLANK_LENGTH)


@registry.add("flank_motifs", d.with_ctes(
    *SQL_HITS, d.sql_flanks(),
    final="select system_id, motif_length as pam_length, motif, count(*) as n from flanks group by all",
))
def q_flank_motifs(spark, sf_dir):
    return ev.motif_histogram(flanks_of(spark, sf_dir), KEYS).select(
        "system_id", F.col("motif_length").alias("pam_length"), "motif", "n"
    )


@registry.add("background_frequencies", d.with_ctes(
    d.sql_spacers(), d.sql_targets(), SQL_BACKGROUND,
    final=f"select system_id, {MICRO('a')} as a, {MICRO('c')} as c, {MICRO('g')} as g, {MICRO('t')} as t from background",
))
def q_background(spark, sf_dir):
    rows = ev.background_frequencies(d.targets(spark, sf_dir), keys=KEYS)
    return rows.select("system_id", *[d.micro(F.col(b)).alias(b) for b in "acgt"])


@registry.add("spacer_weights", d.with_ctes(
    *SQL_HITS, d.sql_flanks(), SQL_WEIGHTS,
    final=f"select system_id, motif_length as pam_length, spacer_sequence, motif, {MICRO('sum(weight)')} as weight_micro, count(*) as alignments from weights group by all",
))
def q_spacer_weights(spark, sf_dir):
    return ev.spacer_weights(flanks_of(spark, sf_dir), KEYS).select(
        "system_id", F.col("motif_length").alias("pam_length"), "spacer_sequence", "motif",
        d.micro(F.col("weight")).alias("weight_micro"), "alignments",
    )


@registry.add("spacer_candidate_evidence", d.with_ctes(
    *SQL_SPACER_CHANNEL,
    final=f"""select system_id, candidate_pam, {MICRO('score')} as score_micro, {MICRO('p')} as posterior_micro, {MICRO('q')} as background_micro,
      {MICRO('enrichment')} as enrichment_micro, w as effective_spacer_count, sc as support_spacer_count, tc as support_target_count,
      ac as support_alignment_count, et as eligible_target_count, ea as eligible_alignment_count, spacer_rank from ranked_evidence""",
))
def q_spacer_candidate_evidence(spark, sf_dir):
    return scored_spacer_candidates(spark, sf_dir).select(
        "system_id", "candidate_pam",
        d.micro(F.col("spacer_evidence_score")).alias("score_micro"),
        d.micro(F.col("posterior_support")).alias("posterior_micro"),
        d.micro(F.col("background_probability")).alias("background_micro"),
        d.micro(F.col("log2_enrichment")).alias("enrichment_micro"),
        "effective_spacer_count", "support_spacer_count", "support_target_count", "support_alignment_count",
        "eligible_target_count", "eligible_alignment_count", F.col("spacer_rank").cast("long").alias("spacer_rank"),
    )


# Degenerate motifs scored over all systems together, by a position-wise test of every flank.
SQL_DEGENERATE = f"""motif_list as (select distinct {{motif}} as candidate_pam from part),
    pooled as (select spacer_sequence, target_id, motif, n_weight as weight, motif_length from (
      select *, orientation_weight / sum(orientation_weight) over (partition by motif_length, spacer_sequence) as n_weight from flanks)),
    pairs as (select m.candidate_pam, p.* from motif_list m join pooled p on {d.sql_subset('p.motif', 'm.candidate_pam')})"""


def degenerate_sql(key: str = "p_partkey") -> str:
    dna = d.SQL["dna"]("x", key)
    return f"translate(substr({dna}, 1, 1), 'ACGT', 'RYNN') || translate(substr({dna}, 2, 1), 'ACGT', 'SGKN') || translate(substr({dna}, 3, 1), 'ACGT', 'ABGV')"


def degenerate_motif(key):
    x = d.dna_of("x", key)
    return F.concat(
        F.translate(F.substring(x, 1, 1), "ACGT", "RYNN"),
        F.translate(F.substring(x, 2, 1), "ACGT", "SGKN"),
        F.translate(F.substring(x, 3, 1), "ACGT", "ABGV"),
    )


@registry.add("degenerate_motif_support", d.with_ctes(
    *SQL_HITS, d.sql_flanks(), SQL_DEGENERATE.format(motif=degenerate_sql()),
    final=f"""select candidate_pam, {MICRO('sum(weight)')} as support_micro, count(distinct spacer_sequence) as support_spacer_count,
      count(distinct target_id) as support_target_count, count(*) as support_alignment_count from pairs group by all""",
))
def q_degenerate_motif_support(spark, sf_dir):
    motifs = d.table(spark, sf_dir, "part").select(degenerate_motif(F.col("p_partkey")).alias("candidate_pam")).distinct()
    flanks = materialize(ev.eligible_flanks(hits_of(spark, sf_dir), side="downstream", lengths=d.LENGTHS))
    background = ev.background_frequencies(d.targets(spark, sf_dir))
    scored = ev.score_spacer_candidates(flanks, motifs, background)
    return scored.where("support_alignment_count > 0").select(
        "candidate_pam", d.micro(F.col("support")).alias("support_micro"),
        "support_spacer_count", "support_target_count", "support_alignment_count",
    )


SQL_MATRIX = """placed as (select system_id, motif_length, i, substr(motif, i, 1) as base, weight from weights cross join (select unnest(range(1, 5)) as i) where i <= motif_length),
    shares as (select system_id, motif_length, i, sum(case base when 'A' then weight else 0 end) / sum(weight) as a, sum(case base when 'C' then weight else 0 end) / sum(weight) as c,
      sum(case base when 'G' then weight else 0 end) / sum(weight) as g, sum(case base when 'T' then weight else 0 end) / sum(weight) as t from placed group by all)"""


@registry.add("flank_probability_matrix", d.with_ctes(
    *SQL_HITS, d.sql_flanks(), SQL_WEIGHTS, SQL_MATRIX,
    final=f"""select system_id, cast(motif_length as bigint) as pam_length, cast(i as bigint) as position,
      {MICRO('a')} as a, {MICRO('c')} as c, {MICRO('g')} as g, {MICRO('t')} as t from shares""",
))
def q_flank_probability_matrix(spark, sf_dir):
    rows = ev.flank_probability_matrix(flanks_of(spark, sf_dir), KEYS)
    return rows.select(
        "system_id", F.col("motif_length").cast("long").alias("pam_length"), "position",
        *[d.micro(F.col(b)).alias(b.lower()) for b in "ACGT"],
    )


def side_sql(column: str, n: int, spacer_expr: str) -> str:
    cut = f"substr({column}, 1, {n})" if column == "downstream_flank" else f"substr({column}, greatest(length({column}) - {n} + 1, 1), {n})"
    return d.with_ctes(
        d.sql_spacers(), d.sql_targets(), d.sql_hits(1, spacer_expr),
        f"side as (select system_id, {cut} as motif from hits where length({cut}) = {n} and regexp_full_match({cut}, '[ACGT]+'))",
        f"placed as (select system_id, i, substr(motif, i, 1) as base from side cross join (select unnest(range(1, {n + 1})) as i))",
        "counts as (select system_id, i, base, count(*) as n from placed group by all)",
        "shares as (select *, n * 1.0 / sum(n) over (partition by system_id, i) as p from counts)",
        "bits as (select system_id, i, 2 + sum(p * log2(p)) as b from shares group by all)",
        final="select system_id, sum(b) as bits from bits group by all",
    )


def orientation_sql() -> str:
    parts = []
    for label, expr in (("as_provided", "spacer_sequence"), ("reverse_complemented", d.SQL["revcomp"]("spacer_sequence"))):
        up, down = side_sql("upstream_flank", 3, expr), side_sql("downstream_flank", 3, expr)
        parts.append(f"""select '{label}' as orientation, u.system_id, {MICRO('u.bits')} as upstream_micro, {MICRO('w.bits')} as downstream_micro,
          case when w.bits >= u.bits then 'downstream' else 'upstream' end as stronger_side from ({up}) u join ({down}) w on u.system_id = w.system_id""")
    return "\nunion all\n".join(parts)


@registry.add("orientation_probe", orientation_sql())
def q_orientation_probe(spark, sf_dir):
    out = None
    given = d.spacers(spark, sf_dir)
    turned = given.withColumn("spacer_sequence", reverse_complement("spacer_sequence"))
    for label, spacer_rows in (("as_provided", given), ("reverse_complemented", turned)):
        hits = materialize(spacer_hits(spacer_rows, d.targets(spark, sf_dir), mismatches=1, flank_length=d.FLANK_LENGTH,
                                       lengths=[d.SPACER_LENGTH], keys=KEYS))
        sides = [
            ev.side_information(ev.eligible_flanks(hits, side=side, lengths=[3], keys=KEYS), KEYS).select(
                "system_id", F.col("information_sum").alias(side))
            for side in ("upstream", "downstream")
        ]
        part = sides[0].join(sides[1], "system_id").select(
            F.lit(label).alias("orientation"), "system_id",
            d.micro(F.col("upstream")).alias("upstream_micro"), d.micro(F.col("downstream")).alias("downstream_micro"),
            F.when(F.col("downstream") >= F.col("upstream"), F.lit("downstream")).otherwise(F.lit("upstream")).alias("stronger_side"),
        )
        out = part if out is None else out.unionByName(part)
    return out


SQL_BEST = """best as (select spacer_id, arg_min(struct_pack(mm := mismatches, t := target_id, pam := substr(downstream_flank, 1, 3)),
    struct_pack(mm := mismatches, t := target_id, s := start, st := strand)) as h from hits group by spacer_id),
    best_rows as (select spacer_id, h.t as target_id, h.mm as mismatches,
      case when length(h.pam) = 3 and regexp_full_match(h.pam, '[ACGT]+') then h.pam else '' end as pam from best)"""
SQL_CONTIGS = """contig_counts as (select target_id, pam, count(*) as n, min(spacer_id) as first_seen from best_rows where pam <> '' group by all),
    contigs as (select target_id, arg_min(pam, struct_pack(n := -n, f := first_seen)) as consensus_pam, cast(sum(n) as bigint) as spacers from contig_counts group by all)"""


@registry.add("best_hit_per_spacer", d.with_ctes(*SQL_HITS, SQL_BEST, final="select * from best_rows"))
def q_best_hit(spark, sf_dir):
    return ev.best_hit_per_spacer(hits_of(spark, sf_dir), side="downstream", length=3).select(
        "spacer_id", "target_id", "mismatches", "pam"
    )


@registry.add("contig_consensus", d.with_ctes(*SQL_HITS, SQL_BEST, SQL_CONTIGS, final="select * from contigs"))
def q_contig_consensus(spark, sf_dir):
    return ev.contig_consensus(ev.best_hit_per_spacer(hits_of(spark, sf_dir), side="downstream", length=3))


@registry.add("contig_collapse", d.with_ctes(*SQL_HITS, SQL_BEST, SQL_CONTIGS, final=f"""select count(*) as target_contigs,
    count(distinct consensus_pam) as consensus_types, count(*) filter (where consensus_pam in ('AGG', 'CGG', 'GGG', 'TGG')) as contigs_in_set,
    {MICRO("avg(case when consensus_pam in ('AGG', 'CGG', 'GGG', 'TGG') then 1.0 else 0.0 end)")} as contig_fraction_micro,
    max(spacers) as max_spacers_on_one_contig from contigs"""))
def q_contig_collapse(spark, sf_dir):
    rows = ev.contig_collapse(ev.best_hit_per_spacer(hits_of(spark, sf_dir), side="downstream", length=3))
    return rows.withColumn("contig_fraction_micro", d.micro(F.col("contig_fraction"))).drop("contig_fraction")


def fraction_sql(source: str, column: str, grain: str) -> str:
    value = MICRO(f"avg(case when {column} in ('AGG', 'CGG', 'GGG', 'TGG') then 1.0 else 0.0 end)")
    return f"select '{grain}' as grain, count(*) as n, {value} as fraction_micro from {source}"


@registry.add("set_membership_by_grain", d.with_ctes(*SQL_HITS, d.sql_flanks(), SQL_BEST, SQL_CONTIGS, final=" union all ".join([
    fraction_sql("(select motif from flanks where motif_length = 3)", "motif", "hit"),
    fraction_sql("(select pam from best_rows where pam <> '')", "pam", "spacer"),
    fraction_sql("contigs", "consensus_pam", "contig"),
])))
def q_membership(spark, sf_dir):
    rows = ev.membership_fractions(materialize(hits_of(spark, sf_dir)), side="downstream", length=3)
    return rows.select("grain", "n", d.micro(F.col("fraction")).alias("fraction_micro"))
