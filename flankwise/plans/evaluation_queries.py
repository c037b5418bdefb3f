"""Queries over controls, priors, policies, reports and diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import accession_tokens
from ..operators import evidence as ev
from ..operators import exposure as ex
from ..operators import fusion as fu
from ..operators import metrics as me
from ..operators.annotation import token_set_join
from ..operators.candidates import concrete_candidates
from ..operators.matching import motif_match_join
from ..session import materialize, spread
from . import derive as d
from . import evidence_queries as eq
from . import ranking_queries as rq
from .registry import registry

MICRO = d.SQL["micro"]
SEED = 7


# Negative controls: the same search with sequences whose homology or strand is broken.
def sql_shuffled(text: str, key: str) -> str:
    """Letters in the order of the digests of (seed, key, place)."""
    return (f"array_to_string(list_transform(list_sort(list_transform(range(0, length({text})), lambda i: struct_pack(d := md5('{SEED}-' || {key} || '-' || i), "
            f"i := i, c := substr({text}, cast(i + 1 as int), 1)))), lambda x: x.c), '')")


def sql_random(text: str, key: str) -> str:
    digit = f"('0x' || substr(md5('{SEED}-' || {key} || '-r-' || i), 1, 1))::int"
    return f"array_to_string(list_transform(range(0, length({text})), lambda i: substr('ACGT', {digit} % 4 + 1, 1)), '')"


def control_sql() -> list[str]:
    given, rc = "(select * from plain_spacers)", d.SQL["revcomp"]("spacer_sequence")
    changed = lambda value: f"(select system_id, spacer_id, {value} as spacer_sequence from plain_spacers)"
    queries = {
        ev.CONTROLS[0]: (given, "plain_targets"), ev.CONTROLS[1]: (changed(rc), "plain_targets"),
        ev.CONTROLS[2]: (changed(sql_shuffled("spacer_sequence", "spacer_id")), "plain_targets"),
        ev.CONTROLS[3]: (given, f"(select system_id, target_id, {sql_shuffled('target_sequence', 'target_id')} as target_sequence from plain_targets)"),
        ev.CONTROLS[4]: (changed(sql_random("spacer_sequence", "spacer_id")), "plain_targets"),
    }
    parts = [f"select '{name}' as control, * from (" + d.with_ctes(
        f"spacers as (select * from {s})", f"targets as (select * from {t})", d.sql_hits(1), final="select * from hits") + ")" for name, (s, t) in queries.items()]
    inside = lambda c: f"coalesce(avg(case when {c} in ('AGG', 'CGG', 'GGG', 'TGG') then 1.0 when {c} is not null then 0.0 end), 0)"
    return [
        d.sql_spacers().replace("spacers as", "plain_spacers as", 1), d.sql_targets().replace("    targets as", "    plain_targets as", 1),
        "all_hits as (" + " union all ".join(parts) + ")",
        """with_pam as (select *, case when length(downstream_flank) >= 3 and regexp_full_match(substr(downstream_flank, 1, 3), '[ACGT]+')
          then substr(downstream_flank, 1, 3) end as pam from all_hits)""",
        f"by_hit as (select control, count(*) as alignments, count(pam) as scored_flanks, count(distinct spacer_id) as mapped, {inside('pam')} as xgg from with_pam group by control)",
        """best as (select control, spacer_id, arg_min(struct_pack(t := target_id, pam := pam), struct_pack(mm := mismatches, t := target_id, s := start, st := strand)) as h
          from with_pam where pam is not null group by all)""",
        f"by_spacer as (select control, count(*) as best_hits, {inside('h.pam')} as spacer_xgg from best group by control)",
        "counted as (select control, h.t as target_id, h.pam as pam, count(*) as n, min(spacer_id) as first_seen from best group by all)",
        "contigs as (select control, target_id, arg_min(pam, struct_pack(n := -n, f := first_seen)) as pam, sum(n) as spacers from counted group by all)",
        f"by_contig as (select control, count(*) as contigs, {inside('pam')} as contig_xgg, cast(max(spacers) as bigint) as busiest from contigs group by control)",
        f"names as (select unnest([{', '.join(repr(c) for c in ev.CONTROLS)}]) as control)",
        "measures as (select * from names left join by_hit using (control) left join by_spacer using (control) left join by_contig using (control))",
    ]


def controls(spark, sf_dir):
    return ev.negative_controls(
        d.spacers(spark, sf_dir), d.targets(spark, sf_dir), side="downstream", length=3, mismatches=1, flank_length=d.FLANK_LENGTH, keys=eq.KEYS, seed=SEED)


@registry.add("negative_controls", d.with_ctes(*control_sql(), final=f"""select control, coalesce(alignments, 0) as alignments, coalesce(scored_flanks, 0) as scored_flanks,
    coalesce(mapped, 0) as mapped_spacers, {MICRO('coalesce(xgg, 0)')} as xgg_micro, coalesce(best_hits, 0) as spacer_best_hits_with_pam, {MICRO('coalesce(spacer_xgg, 0)')} as spacer_xgg_micro,
    coalesce(contigs, 0) as distinct_target_contigs, {MICRO('coalesce(contig_xgg, 0)')} as contig_xgg_micro, coalesce(busiest, 0) as max_spacers_on_one_contig from measures"""))
def q_negative_controls(spark, sf_dir):
    return controls(spark, sf_dir).select(
        "control", "alignments", "scored_flanks", "mapped_spacers", d.micro(F.col("xgg_fraction")).alias("xgg_micro"), "spacer_best_hits_with_pam",
        d.micro(F.col("spacer_level_xgg_fraction")).alias("spacer_xgg_micro"), "distinct_target_contigs",
        d.micro(F.col("contig_level_xgg_fraction")).alias("contig_xgg_micro"), "max_spacers_on_one_contig")


def _of(control: str, column: str) -> str:
    return f"coalesce(max({column}) filter (where control = '{control}'), 0)"


@registry.add("control_verdict", d.with_ctes(*control_sql(), final=f"""select {_of(ev.CONTROLS[0], 'xgg')} > 0.5 as signal_survives_positive, {_of(ev.CONTROLS[1], 'xgg')} < 0.1 as collapses_under_wrong_orientation,
    coalesce(max(alignments) filter (where control in ({', '.join(repr(c) for c in ev.CONTROLS[2:])})), 0) = 0 as collapses_under_homology_destroying_nulls,
    {_of(ev.CONTROLS[0], 'busiest')} as contig_redundancy_max_spacers_on_one_contig, {MICRO(_of(ev.CONTROLS[0], 'contig_xgg'))} as contig_xgg_micro from measures"""))
def q_control_verdict(spark, sf_dir):
    verdict = ev.control_verdict(controls(spark, sf_dir))
    return verdict.withColumn("contig_xgg_micro", d.micro(F.col("contig_level_xgg_fraction"))).drop("contig_level_xgg_fraction")


# Motifs of 20 letters, also with sets of three bases, against spelled and changed strings.
LONG_MOTIF = [("ACGT", "ACGT"), ("ACGT", "BNGR"), ("ACGT", "DNCH"), ("ACGT", "NVTN")]


def long_motif(key):
    x, y = d.dna_of("x", key), d.dna_of("y", key)
    pieces = [F.translate(F.substring(x, 1, 3), *LONG_MOTIF[1]), F.substring(x, 4, 4), F.translate(F.substring(x, 8, 4), *LONG_MOTIF[2]),
              F.translate(F.substring(y, 1, 6), *LONG_MOTIF[3]), F.substring(y, 7, 3)]
    return F.concat(*pieces)


def long_string(key):
    """The letters under a motif, one of them changed for every other key."""
    x, y = d.dna_of("x", key), d.dna_of("y", key)
    whole = F.concat(F.substring(x, 1, 11), F.substring(y, 1, 9))
    return F.when(key % 2 == 0, whole).otherwise(F.concat(F.substring(whole, 1, 9), F.lit("A"), F.substring(whole, 11, 10)))


SQL_LONG = f"""letters as (select p_partkey, {d.SQL['dna']('x', 'p_partkey')} as x, {d.SQL['dna']('y', 'p_partkey')} as y from part),
    motifs as (select distinct translate(substr(x, 1, 3), 'ACGT', 'BNGR') || substr(x, 4, 4) || translate(substr(x, 8, 4), 'ACGT', 'DNCH') || translate(substr(y, 1, 6), 'ACGT', 'NVTN') || substr(y, 7, 3) as motif from letters),
    strings as (select distinct case when p_partkey % 2 = 0 then s else substr(s, 1, 9) || 'A' || substr(s, 11, 10) end as pam from (select p_partkey, substr(x, 1, 11) || substr(y, 1, 9) as s from letters)),
    hex_m as (select motif, ('0x' || translate(substr(motif, 1, 10), 'ACMGRSVTWYHKDBN', '123456789ABCDEF'))::bigint as a, ('0x' || translate(substr(motif, 11, 10), 'ACMGRSVTWYHKDBN', '123456789ABCDEF'))::bigint as b from motifs),
    hex_s as (select pam, ('0x' || translate(substr(pam, 1, 10), 'ACGT', '1248'))::bigint as a, ('0x' || translate(substr(pam, 11, 10), 'ACGT', '1248'))::bigint as b from strings)"""


@registry.add("long_motif_join", d.with_ctes(SQL_LONG, final="select pam, motif from hex_s s join hex_m m on (s.a & m.a) = s.a and (s.b & m.b) = s.b"))
def q_long_motif_join(spark, sf_dir):
    p = F.col("p_partkey")
    part = spread(d.table(spark, sf_dir, "part").select("p_partkey"))
    return motif_match_join(part.select(long_string(p).alias("pam")), part.select(long_motif(p).alias("motif")), "pam", "motif")


# Words of a text as a bar-separated list, against the first words of the benchmark passages.
@registry.add("token_set_join", d.with_ctes(
    """listed as (select doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), ' ', '|'), '|'), lambda x: trim(x, ' ')), lambda x: x <> '') as words from documents),
    tokens as (select doc_id, unnest(words) as token, unnest(range(len(words))) as place from listed),
    registry as (select split_part(text, ' ', 1) as accession, min(item_id) as item_id from benchmark group by 1),
    firsts as (select doc_id, token, min(place) as place from tokens group by all),
    matched as (select doc_id, item_id, accession, place from firsts join registry on token = accession)""",
    final="select doc_id, count(*) as matches, arg_min(accession, place) as first_accession, arg_min(item_id, place) as item_id from matched group by doc_id"))
def q_token_set_join(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select("doc_id", accession_tokens(F.translate("text", " ", "|")).alias("tokens"))
    known = d.table(spark, sf_dir, "benchmark").groupBy(F.substring_index("text", " ", 1).alias("accession")).agg(F.min("item_id").alias("item_id"))
    matched = token_set_join(docs, known, tokens="tokens", accession="accession")
    return matched.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("matches"), F.min_by("accession", "token_place").alias("first_accession"), F.min_by("item_id", "token_place").alias("item_id"))


# The fourth method: a family's prior motif alone.
def priors(spark, sf_dir):
    return d.system_ids(spark, sf_dir).select("system_id", F.when(F.col("system_id") % 2 == 0, F.lit("NGG")).otherwise(F.lit("NRGN")).alias("prior_pam"))


def prior_sql() -> list[str]:
    ranks = rq.method_rank_sql()[0]
    ranks = ranks[ranks.index("flagged as"):].replace("['protein_only', 'spacer_only', 'fusion']", "['family_prior']")
    return [rq.SQL_CANDIDATES, rq.SQL_GOLDS, "priors as (select system_id, case when system_id % 2 = 0 then 'NGG' else 'NRGN' end as prior from system_list)",
            f"""method_scores as (select system_id, candidate_pam, motif_length as pam_length, 'family_prior' as method,
              case when {d.sql_subset('candidate_pam', 'prior')} then 1.0::double else 0.0::double end as score from candidates join priors using (system_id) where motif_length = length(prior))""", ranks]


@registry.add("family_prior", d.with_ctes(*prior_sql(), final=f"""select b.system_id, method, pam_length, scored_candidates, optimistic_rank, gold_rank, {MICRO('mrr')} as mrr_micro, {MICRO('coverage')} as coverage_micro
    from by_length b join per_system using (system_id, method)"""))
def q_family_prior(spark, sf_dir):
    candidates = concrete_candidates(d.matrices(spark, sf_dir))
    scored = me.prior_scores(candidates, priors(spark, sf_dir)).withColumn("method", F.lit("family_prior"))
    keys = ["system_id", "method"]
    ranks = materialize(me.gold_rank_by_length(scored, d.golds(spark, sf_dir).withColumn("method", F.lit("family_prior")), score="score", keys=keys))
    return ranks.join(me.system_metrics(ranks, keys), keys).select(
        *keys, F.col("pam_length").cast("long").alias("pam_length"), "scored_candidates", "optimistic_rank", "gold_rank",
        d.micro(F.col("mrr")).alias("mrr_micro"), d.micro(F.col("coverage")).alias("coverage_micro"))


# The two policies beside abstaining.
POLICY_GATES = {
    "spacer_fallback": "case when gate = 'abstain_severe_top_disagreement' then 'spacer_fallback_severe_top_disagreement' else gate end",
    "legacy": "case when gate = 'abstain_missing_scored_source' then gate else 'legacy_joint_ranking' end",
}


@registry.add("fusion_policies", d.with_ctes(
    *rq.SQL_BOTH, "by_policy as (" + " union all ".join(f"select '{name}' as policy, * exclude (gate), {gate} as gate from statuses" for name, gate in POLICY_GATES.items()) + ")",
    f"keyed as (select *, case when gate like 'spacer_fallback%' and ps is not null then ss else {rq.RANK_KEY_SQL} end as k from by_policy)",
    final="select policy, system_id, candidate_pam, gate as fusion_gate, cast(floor(k * 1000 + 0.5003) as bigint) as rank_milli from keyed"))
def q_fusion_policies(spark, sf_dir):
    protein, spacer = materialize(rq.protein_rows(spark, sf_dir)), materialize(rq.spacer_rows(spark, sf_dir))
    out = None
    for policy in POLICY_GATES:
        rows = fu.fuse(protein, spacer, policy=policy)
        key = fu.fusion_rank_score(F.col("specificity_adjusted_score"), F.col("spacer_evidence_score"), F.col("fusion_gate"))
        part = rows.select(F.lit(policy).alias("policy"), "system_id", "candidate_pam", "fusion_gate", F.floor(key * 1000 + 0.5003).cast("long").alias("rank_milli"))
        out = part if out is None else out.unionByName(part)
    return out


SQL_VECTOR = lambda m: f"""list_transform(range(0, 15), lambda x: case when x % 5 = 4 then case bit_count({d.sql_mask(f'substr({m}, cast(x // 5 + 1 as int), 1)')}) when 1 then 0.0 when 4 then 1.0
    else 2 * (1 - 1.0 / bit_count({d.sql_mask(f'substr({m}, cast(x // 5 + 1 as int), 1)')})) end
    when bit_count({d.sql_mask(f'substr({m}, cast(x // 5 + 1 as int), 1)')}) = 4 or ({d.sql_mask(f'substr({m}, cast(x // 5 + 1 as int), 1)')} & cast(1 << cast(x % 5 as int) as bigint)) = 0 then 0.0
    else 2.0 / bit_count({d.sql_mask(f'substr({m}, cast(x // 5 + 1 as int), 1)')}) end::double)"""


@registry.add("spectrum_cosine", d.with_ctes(
    rq.SQL_SYSTEMS, rq.SQL_GOLDS, f"preds as (select distinct p_partkey // 200 as system_id, {eq.degenerate_sql()} as m from part)",
    f"cosines as (select p.system_id, m, max(list_cosine_similarity({SQL_VECTOR('m')}, {SQL_VECTOR('gold')})) as c from preds p join golds g on p.system_id = g.system_id and length(gold) = 3 group by all)",
    final=f"select system_id, m as predicted_pam, {MICRO('coalesce(c, 0)')} as cosine_micro from preds left join cosines using (system_id, m)"))
def q_spectrum_cosine(spark, sf_dir):
    p = F.col("p_partkey")
    predictions = d.table(spark, sf_dir, "part").select(d.integer_divide(p, 200).alias("system_id"), eq.degenerate_motif(p).alias("predicted_pam"))
    return me.best_spectrum_cosine(predictions, d.golds(spark, sf_dir)).select("system_id", "predicted_pam", d.micro(F.col("spectrum_cosine")).alias("cosine_micro"))


# Registry, ranks and replay of training labels of every system.
@registry.add("failure_lookup", d.with_ctes(
    rq.SQL_SYSTEMS, rq.SQL_GOLDS,
    f"""replay as (select p_partkey // 200 as system_id, {eq.degenerate_sql()} as label, ({d.SQL['nibble']('r', 'p_partkey', 1)} + 1) / 17.0::double as cosine from part where p_partkey % 60 < 2 and p_partkey // 200 % 4 <> 3),
    labels as (select system_id, count(distinct label) as n, max(cosine) as best from replay group by system_id),
    agreeing as (select r.system_id, bool_or(length(label) = length(gold) and len(list_filter(range(1, 4), lambda i: ({d.sql_mask('substr(label, i, 1)')} & {d.sql_mask('substr(gold, i, 1)')}) = 0)) = 0) as o
      from replay r join golds g using (system_id) group by r.system_id),
    ranks as (select p_partkey // 200 as system_id, min({d.SQL['nibble']('k', 'p_partkey', 2)} + 1) filter (where p_partkey % 50 = 1) as pr, min({d.SQL['nibble']('k', 'p_partkey', 3)} + 1) filter (where p_partkey % 50 = 2) as sr from part group by 1)""",
    final=f"""select s.system_id, coalesce(n, 0) as training_labels, {MICRO('best')} as best_micro, coalesce(o, false) as label_gold_overlap, cast(pr as bigint) as protein_rank, cast(sr as bigint) as spacer_rank,
      case when coalesce(n, 0) = 0 then 'no_exact_training_label' when best < 0.5 then 'checkpoint_replay_failure' when not coalesce(o, false) then 'training_label_vs_experimental_gold_mismatch'
        when best < 0.75 then 'weak_checkpoint_replay' when pr > 5 and sr <= 5 then 'protein_ranking_failure_despite_label_alignment' else 'no_primary_failure_detected' end as failure_mode
      from system_list s left join labels using (system_id) left join agreeing using (system_id) left join ranks using (system_id)"""))
def q_failure_lookup(spark, sf_dir):
    p = F.col("p_partkey")
    part = d.table(spark, sf_dir, "part").select("p_partkey", d.integer_divide(p, 200).alias("system_id"))
    replay = part.where((p % 60 < 2) & (F.col("system_id") % 4 != 3)).select(
        "system_id", eq.degenerate_motif(p).alias("label"), ((d.nibble("r", p, 1) + 1) / 17.0).alias("cosine"))
    rank = lambda method, rest, place: part.where(p % 50 == rest).select("system_id", F.lit(method).alias("method"), (d.nibble("k", p, place) + 1).cast("long").alias("gold_rank"))
    ranks = rank("protein_only", 1, 2).unionByName(rank("spacer_only", 2, 3))
    rows = ex.failure_lookup(d.system_ids(spark, sf_dir), d.golds(spark, sf_dir), ranks, replay)
    return rows.select("system_id", "training_labels", d.micro(F.col("best_replay_cosine")).alias("best_micro"), "label_gold_overlap", "protein_rank", "spacer_rank", "failure_mode")


LABEL = {k: "'" + v + "'" for k, v in fu.REPORT_LABELS.items()}


@registry.add("report_candidates", d.with_ctes(*rq.SQL_BOTH, final=f"""select f.system_id, f.candidate_pam, {MICRO('ps')} as protein_micro, f.protein_rank as rank_within_length, {MICRO('ss')} as spacer_micro,
    e.w as effective_spacers, f.sc as support_spacers, f.tc as support_target_contigs, case when e.w < 2 then {LABEL['few_spacers']} when ps is null or ss is null then {LABEL['insufficient']}
      when pstate <> sstate and pstate <> 'neutral' and sstate <> 'neutral' then {LABEL['conflict']} when pstate = 'support' and sstate = 'support' then {LABEL['both_support']} else {LABEL['neutral']} end as status
    from fused f join ranked_evidence e using (system_id, candidate_pam)"""))
def q_report_candidates(spark, sf_dir):
    rows = fu.report_candidates(rq.protein_rows(spark, sf_dir), rq.spacer_rows(spark, sf_dir))
    return rows.select(
        "system_id", "candidate_pam", d.micro(F.col("protein_score")).alias("protein_micro"), F.col("rank_within_length").cast("long").alias("rank_within_length"),
        d.micro(F.col("spacer_score")).alias("spacer_micro"), "effective_spacers", "support_spacers", "support_target_contigs", "status")
