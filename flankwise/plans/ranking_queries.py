"""Queries over motifs, matrices, both channels together and the ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, iupac
from ..functions import matrix as mx
from ..operators import fusion as fu
from ..operators import metrics as me
from ..operators.candidates import concrete_candidates, score_protein_candidates
from . import derive as d
from . import evidence_queries as eq
from .registry import registry

MICRO = d.SQL["micro"]


def probability_matrices(spark, sf_dir):
    return d.matrices(spark, sf_dir).select(
        "system_id", mx.normalize_rows("raw_matrix").alias("matrix"), "pam_side", "pam_lengths"
    )


def protein_rows(spark, sf_dir):
    rows = probability_matrices(spark, sf_dir)
    return score_protein_candidates(concrete_candidates(rows), rows)


def spacer_rows(spark, sf_dir):
    return eq.scored_spacer_candidates(spark, sf_dir).drop("motif_length", "a", "c", "g", "t")


# The matrix as long rows (system, position, base, p) in the checking engine.
def sql_matrix(key_table: str = "system_list", key: str = "system_id") -> str:
    n = "(" + d.SQL["nibble"]("m", key, "i * 4 + j + 1") + ")"
    m = "(" + d.SQL["nibble"]("n", key, "(i - 8) * 4 + j + 1") + ")"
    return f"""cells as (select {key}, i + 1 as i, substr('ACGT', j + 1, 1) as base,
        (case when i < 8 then ({n} + 1) * ({n} + 1) else ({m} + 1) * ({m} + 1) end)
        + (case when i in (1, 2) and j = 2 and {key} % 3 <> 0 then 4000.0::double else 0.0::double end) as v
      from {key_table}, (select unnest(range(0, 10)) as i), (select unnest(range(0, 4)) as j)),
    matrix as (select {key}, i, base, v / sum(v) over (partition by {key}, i) as p from cells)"""


SQL_SYSTEMS = "system_list as (select distinct s_suppkey // 10 as system_id from supplier)"
SQL_PROTEIN = """positions as (select c.system_id, c.candidate_pam, c.motif_length, k, m.p as mass
      from candidates c cross join (select unnest(range(1, 5)) as k)
      join matrix m on m.system_id = c.system_id and m.i = k and m.base = substr(c.candidate_pam, k, 1) where k <= c.motif_length),
    protein as (select system_id, candidate_pam, motif_length, count(*) as informative_positions,
        exp(avg(ln(greatest(mass, 1e-12)))) as geomean,
        50 * (avg(case when mass >= 0.25 then (mass - 0.25) / 0.75 else (mass - 0.25) / 0.25 end) + 1) as score,
        avg(log2(greatest(mass, 1e-12) / 0.25)) as bits from positions group by all),
    ranked_protein as (select *, row_number() over (partition by system_id, motif_length order by score desc, geomean desc, candidate_pam) as protein_rank from protein)"""
SQL_CANDIDATES = eq.SQL_CANDIDATES


@registry.add("candidate_scores", d.with_ctes(
    SQL_CANDIDATES, sql_matrix(), SQL_PROTEIN,
    final=f"""select system_id, candidate_pam, motif_length as pam_length, informative_positions, {MICRO('geomean')} as geomean_micro,
      {MICRO('score')} as score_micro, {MICRO('bits')} as bits_micro from protein""",
))
def q_candidate_scores(spark, sf_dir):
    return protein_rows(spark, sf_dir).select(
        "system_id", "candidate_pam", F.col("pam_length").cast("long").alias("pam_length"),
        F.col("informative_positions").cast("long").alias("informative_positions"),
        d.micro(F.col("geometric_mean_probability")).alias("geomean_micro"),
        d.micro(F.col("specificity_adjusted_score")).alias("score_micro"),
        d.micro(F.col("log2_enrichment_bits")).alias("bits_micro"),
    )


@registry.add("candidate_rank", d.with_ctes(
    SQL_CANDIDATES, sql_matrix(), SQL_PROTEIN,
    final="select system_id, candidate_pam, protein_rank from ranked_protein",
))
def q_candidate_rank(spark, sf_dir):
    return protein_rows(spark, sf_dir).select("system_id", "candidate_pam", F.col("protein_rank").cast("long").alias("protein_rank"))


# Degenerate motifs against the matrices: one motif per part, scored with its system's matrix.
SQL_DEGENERATE_SCORES = f"""motifs as (select p_partkey, p_partkey // 200 as system_id, {eq.degenerate_sql()} as motif from part),
    places as (select p_partkey, motif, m.i, bit_count({d.sql_mask('substr(motif, m.i, 1)')}) as n, m.base, m.p,
        ({d.sql_mask('substr(motif, m.i, 1)')} & case m.base when 'A' then 1 when 'C' then 2 when 'G' then 4 else 8 end) <> 0 as allowed
      from motifs join matrix m using (system_id) where m.i <= length(motif)),
    masses as (select p_partkey, motif, i, any_value(n) as n, sum(case when allowed then p else 0 end) as mass from places group by all),
    parts as (select *, log2(4.0 / n) as w, n / 4.0 as b from masses where n < 4),
    scores as (select p_partkey, count(*) as informative_positions, exp(avg(ln(greatest(mass, 1e-12)))) as geomean,
      50 * (sum(w * case when mass >= b then (mass - b) / (1 - b) else (mass - b) / b end) / sum(w) + 1) as score,
      sum(w * log2(greatest(mass, 1e-12) / b)) / sum(w) as bits from parts group by p_partkey)"""


@registry.add("degenerate_candidate_scores", d.with_ctes(
    SQL_SYSTEMS, sql_matrix(), SQL_DEGENERATE_SCORES,
    final=f"""select p_partkey, motif, coalesce(informative_positions, 0) as informative_positions, {MICRO('score')} as score_micro,
      {MICRO('geomean')} as geomean_micro, {MICRO('bits')} as bits_micro from motifs left join scores using (p_partkey)
      where system_id in (select system_id from system_list)""",
))
def q_degenerate_candidate_scores(spark, sf_dir):
    p = F.col("p_partkey")
    motifs = d.table(spark, sf_dir, "part").select("p_partkey", d.integer_divide(p, 200).alias("system_id"), eq.degenerate_motif(p).alias("motif"))
    rows = motifs.join(probability_matrices(spark, sf_dir), "system_id").withColumn(
        "s", mx.score_candidate("matrix", "motif", F.col("pam_side"))
    )
    return rows.select(
        "p_partkey", "motif", F.col("s.informative_positions").cast("long").alias("informative_positions"),
        d.micro(F.col("s.score")).alias("score_micro"), d.micro(F.col("s.geomean")).alias("geomean_micro"),
        d.micro(F.col("s.bits")).alias("bits_micro"),
    )


SQL_INFO = """rows_ as (select system_id, i, -sum(p * log2(p)) as h, max(p) as pk,
      arg_max(base, struct_pack(p := p, o := -instr('ACGT', base))) as top,
      sum(p * (ln(p + 1e-12) + ln(4.0))) / ln(2.0) as content from matrix group by all)"""


@registry.add("matrix_information", d.with_ctes(
    SQL_SYSTEMS, sql_matrix(), SQL_INFO,
    final=f"""select system_id, {MICRO('avg(2 - h)')} as mean_bits_micro, {MICRO('coalesce(avg(2 - h) filter (where 2 - h >= 0.15), avg(2 - h))')} as signal_bits_micro,
      count(*) filter (where 2 - h >= 0.15) as signal_positions, {MICRO('sum(content)')} as content_micro from rows_ group by system_id""",
))
def q_matrix_information(spark, sf_dir):
    rows = probability_matrices(spark, sf_dir).withColumn("s", mx.information_stats("matrix")).withColumn(
        "content", mx.total(F.flatten(mx.probability_to_information("matrix")))
    )
    return rows.select(
        "system_id", d.micro(F.col("s.mean_bits")).alias("mean_bits_micro"), d.micro(F.col("s.mean_signal_bits")).alias("signal_bits_micro"),
        F.size("s.signal_positions").cast("long").alias("signal_positions"), d.micro(F.col("content")).alias("content_micro"),
    )


SQL_CALLS = """calls as (select system_id, regexp_replace(string_agg(case when pk * content >= 0.70 then top else 'N' end, '' order by i), 'N+$', '') as consensus from rows_ group by system_id),
    cuts as (select m.system_id, m.i, r.h, sum(case when m.p >= greatest(0.25, r.pk / 2) then case m.base when 'A' then 1 when 'C' then 2 when 'G' then 4 else 8 end else 0 end) as mask
      from matrix m join rows_ r using (system_id, i) group by all),
    wide as (select system_id, string_agg(case when 2 - h < 0.15 or mask = 0 then 'N' else substr('ACMGRSVTWYHKDBN', cast(mask as int), 1) end, '' order by i) as flank_consensus from cuts group by system_id)"""


@registry.add("consensus_call", d.with_ctes(
    SQL_SYSTEMS, sql_matrix(), SQL_INFO, SQL_CALLS,
    final="""select system_id, consensus, case when consensus = '' then 'unresolved' when contains(consensus, 'N') then 'partial' else 'resolved' end as resolution,
      flank_consensus from calls join wide using (system_id)""",
))
def q_consensus_call(spark, sf_dir):
    rows = probability_matrices(spark, sf_dir).select(
        "system_id", "matrix", mx.probability_to_information("matrix").alias("info")
    ).select(
        "system_id", mx.consensus_from_information("info", "downstream").alias("consensus"),
        mx.probability_consensus("matrix").alias("flank_consensus"),
    )
    return rows.withColumn("resolution", mx.resolution_status("consensus"))


SQL_LEVEL = """conf as (select system_id, coalesce(avg(2 - h) filter (where 2 - h >= 0.15), avg(2 - h)) / 2 * ((system_id % 11) / 10.0) as confidence,
      (system_id % 11) / 10.0 as novelty, avg(2 - h) as mean_bits, count(*) filter (where 2 - h < 0.70) as weak,
      string_agg(case when 2 - h >= 0.70 then top else 'N' end, '' order by i) as consensus from rows_ group by system_id)"""


@registry.add("reliability_level", d.with_ctes(
    SQL_SYSTEMS, sql_matrix(), SQL_INFO, SQL_LEVEL,
    final=f"""select system_id, case when confidence <= 0.010 or novelty < 0.30 then 'low' when confidence <= 0.063 then 'med' else 'high' end as level,
      {MICRO('confidence')} as confidence_micro, {MICRO('mean_bits')} as mean_bits_micro, weak as weak_positions, consensus from conf""",
))
def q_reliability(spark, sf_dir):
    rows = probability_matrices(spark, sf_dir).withColumn("similarity", (F.col("system_id") % 11) / 10.0)
    rows = rows.withColumn("s", mx.reliability("matrix", "similarity"))
    return rows.select(
        "system_id", F.col("s.level").alias("level"), d.micro(F.col("s.confidence")).alias("confidence_micro"),
        d.micro(F.col("s.mean_bits")).alias("mean_bits_micro"), F.size("s.weak_positions").cast("long").alias("weak_positions"),
        F.col("s.consensus").alias("consensus"),
    )


def motif_pair_sql(final: str) -> str:
    return d.with_ctes(f"""motifs as (select p_partkey, {eq.degenerate_sql()} as m, translate(substr({d.SQL['dna']('y', 'p_partkey')}, 1, 3), 'ACGT', 'NRGV') as g from part)""", final=final)


def motif_pairs(spark, sf_dir):
    p = F.col("p_partkey")
    return d.table(spark, sf_dir, "part").select(
        "p_partkey", eq.degenerate_motif(p).alias("m"),
        F.translate(F.substring(d.dna_of("y", p), 1, 3), "ACGT", "NRGV").alias("g"),
    )


def _mask_at(name: str) -> str:
    return d.sql_mask(f"substr({name}, i, 1)")


@registry.add("motif_relations", motif_pair_sql(f"""select p_partkey, m, g, {d.sql_subset('m', 'g')} as subset,
    len(list_filter(range(1, 4), lambda i: ({_mask_at('m')} & {_mask_at('g')}) = 0)) = 0 as overlap,
    {MICRO(f"list_sum(list_transform(range(1, 4), lambda i: 2 - log2(bit_count({_mask_at('m')})))) / 3")} as information_micro,
    cast(list_product(list_transform(range(1, 4), lambda i: cast(bit_count({_mask_at('m')}) as bigint))) as bigint) as spellings from motifs"""))
def q_motif_relations(spark, sf_dir):
    return motif_pairs(spark, sf_dir).select(
        "p_partkey", "m", "g", iupac.is_subset("m", "g").alias("subset"), iupac.motifs_overlap("m", "g").alias("overlap"),
        d.micro(iupac.information("m")).alias("information_micro"), iupac.expansion_size("m").alias("spellings"),
    )


@registry.add("motif_match_join", d.with_ctes(
    f"motifs as (select distinct {eq.degenerate_sql()} as motif from part)",
    f"strings as (select distinct substr({d.SQL['dna']('z', 'p_partkey')}, 1, 3) as pam from part)",
    final=f"select pam, motif from strings join motifs on {d.sql_subset('pam', 'motif')}",
))
def q_motif_match_join(spark, sf_dir):
    from ..operators.matching import motif_match_join

    p = F.col("p_partkey")
    part = d.table(spark, sf_dir, "part")
    return motif_match_join(
        part.select(F.substring(d.dna_of("z", p), 1, 3).alias("pam")), part.select(eq.degenerate_motif(p).alias("motif")), "pam", "motif"
    )


@registry.add("motif_subset_join", d.with_ctes(
    f"motifs as (select distinct {eq.degenerate_sql()} as motif from part)",
    f"golds as (select distinct translate(substr({d.SQL['dna']('y', 'p_partkey')}, 1, 3), 'ACGT', 'NRGV') as gold from part)",
    final=f"select motif, gold from motifs join golds on {d.sql_subset('motif', 'gold')}",
))
def q_motif_subset_join(spark, sf_dir):
    from ..operators.matching import motif_subset_join

    pairs = motif_pairs(spark, sf_dir)
    return motif_subset_join(pairs.select(F.col("m").alias("motif")), pairs.select(F.col("g").alias("gold")), "motif", "gold")


SQL_AUGMENT = f"""cells as (select p_partkey, side, i, j, {d.sql_mask('substr(motif, i, 1)')} as mk, bit_count({d.sql_mask('substr(motif, i, 1)')}) as n
      from (select p_partkey, 'm' as side, m as motif from motifs union all select p_partkey, 'g', g from motifs),
        (select unnest(range(1, 4)) as i), (select unnest(range(0, 5)) as j)),
    vals as (select p_partkey, side, i, j, case when j = 4 then case when n = 1 then 0 when n = 4 then 1 else 2 * (1 - 1.0 / n) end
      when n = 4 or (mk & (1 << j)) = 0 then 0 else 2.0 / n end as v from cells)"""


@registry.add("motif_matrix_cosine", d.with_ctes(
    motif_pair_sql("")[5:], SQL_AUGMENT,
    final=f"""select a.p_partkey, {MICRO('sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v))')} as cosine_micro
      from vals a join vals b on a.p_partkey = b.p_partkey and a.i = b.i and a.j = b.j and a.side = 'm' and b.side = 'g' group by a.p_partkey""",
))
def q_motif_matrix_cosine(spark, sf_dir):
    rows = motif_pairs(spark, sf_dir).select("p_partkey", iupac.augmented_matrix("m").alias("a"), iupac.augmented_matrix("g").alias("b"))
    return rows.select("p_partkey", d.micro(mx.matrix_cosine("a", "b")).alias("cosine_micro"))


CODON_SQL = f"""case when regexp_full_match(substr(s, i * 3 + 1, 3), '[ACGT]+') then
    substr('{dna.CODON_RESIDUES}', (instr('TCAG', substr(s, i * 3 + 1, 1)) - 1) * 16 + (instr('TCAG', substr(s, i * 3 + 2, 1)) - 1) * 4 + instr('TCAG', substr(s, i * 3 + 3, 1)), 1) else 'X' end"""


@registry.add("dna_expressions", f"""select p_partkey, {d.SQL['revcomp']('s')} as turned,
    array_to_string(list_transform(range(0, length(s) // 3), lambda i: {CODON_SQL}), '') as protein
    from (select p_partkey, translate({d.SQL['dna']('t', 'p_partkey')}, '', '') || case when p_partkey % 7 = 0 then 'NRY' else '' end as s from part)""")
def q_dna_expressions(spark, sf_dir):
    p = F.col("p_partkey")
    s = F.concat(d.dna_of("t", p), F.when(p % 7 == 0, F.lit("NRY")).otherwise(F.lit("")))
    return d.table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select(
        "p_partkey", dna.reverse_complement("s").alias("turned"), dna.translate_dna("s").alias("protein")
    )


# Both channels joined, gated and ranked.
SQL_BOTH = [*eq.SQL_SPACER_CHANNEL, sql_matrix(), SQL_PROTEIN, """fused as (select p.system_id, p.candidate_pam, p.motif_length as pam_length,
      p.score as ps, e.score as ss, e.sc, e.tc, p.protein_rank, e.spacer_rank,
      case when p.score > 60 then 'support' when p.score < 40 then 'conflict' else 'neutral' end as pstate,
      case when e.score > 60 then 'support' when e.score < 40 then 'conflict' else 'neutral' end as sstate
      from ranked_protein p left join ranked_evidence e using (system_id, candidate_pam)),
    tops as (select *, max(ps) over w as pmax, max(ss) over w as smax from fused window w as (partition by system_id, pam_length)),
    gaps as (select a.system_id, a.pam_length, min(hamming(a.candidate_pam, b.candidate_pam)) as gap
      from tops a join tops b on a.system_id = b.system_id and a.pam_length = b.pam_length
        and abs(a.ps - a.pmax) <= 1e-12 and abs(b.ss - b.smax) <= 1e-12
        and hamming(a.candidate_pam, b.candidate_pam) <= greatest(1, a.pam_length // 4) group by all),
    present as (select system_id, pam_length, count(ps) as np, count(ss) as ns, greatest(1, pam_length // 4) as tolerance from fused group by all),
    gates as (select system_id, pam_length, cast(tolerance as bigint) as tolerance, np, ns, case when np = 0 or ns = 0 then null else cast(gap as bigint) end as gap from present left join gaps using (system_id, pam_length)),
    gated as (select f.*, g.tolerance, g.gap, case when np = 0 or ns = 0 then 'abstain_missing_scored_source'
        when gap is not null then 'joint_ranking_top_agreement' else 'abstain_severe_top_disagreement' end as gate
      from fused f join gates g using (system_id, pam_length)),
    statuses as (select *, case
        when ps is null and ss is null then 'no_scored_evidence' when ss is null then 'protein_only_unverified' when ps is null then 'spacer_only_unverified'
        when pstate = 'support' and sstate = 'support' and sc >= 2 and tc >= 2 then 'concordant_support'
        when pstate = 'support' and sstate = 'support' then 'concordant_support_limited_independence'
        when pstate = 'conflict' and sstate = 'conflict' then 'concordant_conflict'
        when pstate <> sstate and pstate <> 'neutral' and sstate <> 'neutral' then 'discordant_' || pstate || '_protein_' || sstate || '_spacer'
        else 'protein_' || pstate || '_spacer_' || sstate end as status from gated)"""]


def fused_rows(spark, sf_dir, policy: str = "abstain"):
    return fu.fuse(protein_rows(spark, sf_dir), spacer_rows(spark, sf_dir), policy=policy)


PRIORITY_SQL = """case when status = 'no_scored_evidence' then 'insufficient_evidence' when status = 'protein_only_unverified' then 'needs_spacer_evidence'
    when status = 'spacer_only_unverified' then 'needs_protein_evidence' when status = 'concordant_support' then 'high_priority'
    when status = 'concordant_support_limited_independence' then 'medium_priority' when status = 'concordant_conflict' then 'low_priority'
    when status like 'discordant%' then 'manual_review' else 'uncertain' end"""


@registry.add("fusion_join", d.with_ctes(*SQL_BOTH, final=f"""select system_id, candidate_pam, {MICRO('ps')} as protein_micro, {MICRO('ss')} as spacer_micro,
    sc as spacer_support_spacer_count, tc as spacer_support_target_count, status as evidence_status, {PRIORITY_SQL} as evidence_priority from statuses"""))
def q_fusion_join(spark, sf_dir):
    return fused_rows(spark, sf_dir).select(
        "system_id", "candidate_pam", d.micro(F.col("specificity_adjusted_score")).alias("protein_micro"),
        d.micro(F.col("spacer_evidence_score")).alias("spacer_micro"),
        "spacer_support_spacer_count", "spacer_support_target_count", "evidence_status", "evidence_priority",
    )


@registry.add("fusion_gate", d.with_ctes(*SQL_BOTH, final="""select distinct system_id, pam_length, gate as fusion_gate, tolerance as fusion_top_hamming_tolerance,
    gap as fusion_top_distance from gated"""))
def q_fusion_gate(spark, sf_dir):
    rows = fused_rows(spark, sf_dir)
    return rows.select(
        "system_id", F.col("pam_length").cast("long").alias("pam_length"), "fusion_gate",
        F.col("fusion_top_hamming_tolerance").cast("long").alias("fusion_top_hamming_tolerance"),
        F.col("fusion_top_distance_within_tolerance").cast("long").alias("fusion_top_distance"),
    ).distinct()


RANK_KEY_SQL = """case when ps is null or ss is null or gate like 'abstain%' then null
    else case when pstate = 'support' and sstate = 'support' then 5 when pstate in ('support', 'neutral') and sstate in ('support', 'neutral') and pstate <> sstate then 4
      when pstate = 'neutral' and sstate = 'neutral' then 3 when pstate in ('support', 'conflict') and sstate in ('support', 'conflict') and pstate <> sstate then 2
      when pstate = 'conflict' and sstate = 'conflict' then 0 else 1 end * 1000000.0::double + least(ps, ss) * 1000 + greatest(ps, ss) end"""


@registry.add("fusion_rank_key", d.with_ctes(*SQL_BOTH, final=f"""select system_id, candidate_pam, cast(floor(({RANK_KEY_SQL}) * 1000 + 0.5003) as bigint) as rank_milli from statuses"""))
def q_fusion_rank_key(spark, sf_dir):
    rows = fused_rows(spark, sf_dir)
    key = fu.fusion_rank_score(F.col("specificity_adjusted_score"), F.col("spacer_evidence_score"), F.col("fusion_gate"))
    return rows.select("system_id", "candidate_pam", F.floor(key * 1000 + 0.5003).cast("long").alias("rank_milli"))


SQL_GOLDS = """golds as (select system_id, unnest(case when system_id % 5 = 4 then ['NAG', 'NRGN'] else ['NGG', 'NGGN'] end) as gold from system_list)"""


def method_rank_sql() -> list[str]:
    is_gold = d.sql_subset("r.candidate_pam", "g.gold")
    return [f"""method_scores as (select system_id, candidate_pam, pam_length, 'protein_only' as method, ps as score from statuses where ps is not null
      union all select system_id, candidate_pam, pam_length, 'spacer_only', ss from statuses where ss is not null
      union all select system_id, candidate_pam, pam_length, 'fusion', k from (select *, {RANK_KEY_SQL} as k from statuses) where k is not null),
    flagged as (select r.*, exists (select 1 from golds g where g.system_id = r.system_id and {is_gold}) as gold from method_scores r),
    best as (select system_id, method, pam_length, max(score) filter (where gold) as best, count(*) as n from flagged group by all),
    counted as (select f.system_id, f.method, f.pam_length, any_value(b.n) as n, any_value(b.best) as best,
        1 + count(*) filter (where f.score > b.best + 1e-12) as optimistic,
        1 + count(*) filter (where f.score > b.best + 1e-12) + count(*) filter (where not f.gold and abs(f.score - b.best) <= 1e-12) as gold_rank
      from flagged f join best b using (system_id, method, pam_length) group by all),
    wanted as (select distinct system_id, length(gold) as pam_length, method from golds, (select unnest(['protein_only', 'spacer_only', 'fusion']) as method)),
    by_length as (select w.system_id, w.method, w.pam_length, coalesce(n, 0) as scored_candidates, case when best is not null then optimistic end as optimistic_rank,
        case when best is not null then gold_rank end as gold_rank from wanted w left join counted c using (system_id, method, pam_length)),
    per_system as (select system_id, method, avg(case when scored_candidates > 0 then 1.0 else 0.0 end) as coverage, avg(coalesce(1.0 / gold_rank, 0)) as mrr,
        avg(case when gold_rank <= 1 then 1.0 else 0.0 end) as r1, avg(case when gold_rank <= 3 then 1.0 else 0.0 end) as r3, avg(case when gold_rank <= 5 then 1.0 else 0.0 end) as r5
      from by_length group by all)"""]


SQL_METRICS = [*SQL_BOTH, SQL_GOLDS, *method_rank_sql()]


def method_scores(spark, sf_dir):
    """Long rows (system, method, candidate, score) of the three methods from one fused table."""
    fused = fused_rows(spark, sf_dir)
    key = fu.fusion_rank_score(F.col("specificity_adjusted_score"), F.col("spacer_evidence_score"), F.col("fusion_gate"))
    pair = lambda method, score: F.struct(F.lit(method).alias("method"), score.alias("score"))
    return fused.select("system_id", "candidate_pam", F.explode(F.array(
        pair("protein_only", F.col("specificity_adjusted_score")), pair("spacer_only", F.col("spacer_evidence_score")), pair("fusion", key),
    )).alias("x")).select("system_id", "candidate_pam", "x.method", "x.score")


def method_ranks(spark, sf_dir):
    methods = F.explode(F.array(*[F.lit(m) for m in ("protein_only", "spacer_only", "fusion")]))
    golds = d.golds(spark, sf_dir).withColumn("method", methods)
    return me.gold_rank_by_length(method_scores(spark, sf_dir), golds, score="score", keys=["system_id", "method"])


def per_system_metrics(spark, sf_dir):
    return me.system_metrics(method_ranks(spark, sf_dir), ["system_id", "method"])


@registry.add("tie_safe_gold_rank", d.with_ctes(*SQL_METRICS, final="select system_id, method, pam_length, scored_candidates, optimistic_rank, gold_rank from by_length"))
def q_gold_rank(spark, sf_dir):
    return method_ranks(spark, sf_dir).select(
        "system_id", "method", F.col("pam_length").cast("long").alias("pam_length"), "scored_candidates", "optimistic_rank", "gold_rank"
    )


@registry.add("method_metrics", d.with_ctes(*SQL_METRICS, final=f"""select system_id, method, {MICRO('coverage')} as coverage_micro, {MICRO('mrr')} as mrr_micro,
    {MICRO('r1')} as recall_at_1_micro, {MICRO('r3')} as recall_at_3_micro, {MICRO('r5')} as recall_at_5_micro from per_system"""))
def q_method_metrics(spark, sf_dir):
    return per_system_metrics(spark, sf_dir).select(
        "system_id", "method", *[d.micro(F.col(c)).alias(f"{c}_micro") for c in ("coverage", *me.METRICS)]
    )
