"""Queries over replay audits, diagnoses, search hits, published flanks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import exposure as ex
from ..operators import fusion as fu
from ..operators import literature as li
from ..operators import quantitative as qu
from . import derive as d
from . import ranking_queries as rq
from .registry import registry

MICRO = d.SQL["micro"]


@registry.add("failure_mode", """select c_custkey, case when c_custkey % 6 = 0 then 'no_exact_training_label' when c_acctbal / 10000 < 0.5 then 'checkpoint_replay_failure'
    when c_nationkey % 4 = 0 then 'training_label_vs_experimental_gold_mismatch' when c_acctbal / 10000 < 0.75 then 'weak_checkpoint_replay'
    when c_nationkey > 5 and c_custkey % 9 <= 5 then 'protein_ranking_failure_despite_label_alignment' else 'no_primary_failure_detected' end as mode from customer""")
def q_failure_mode(spark, sf_dir):
    c = F.col("c_custkey")
    rows = d.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rows.select("c_custkey", ex.failure_mode(c % 6, F.col("c_acctbal") / 10000, F.col("c_nationkey") % 4 != 0, F.col("c_nationkey"), c % 9).alias("mode"))


@registry.add("replay_summary", f"""with centers as (select label, [{', '.join(f'avg(embedding[{i}]::double)' for i in range(1, 65))}] as center from embeddings group by label),
    a as (select e.label, list_cosine_similarity(list_transform(embedding, lambda x: x::double), center) as c, vec_id % 3 = 0 as same from embeddings e join centers using (label))
    select cast(label as varchar) as source, count(*) as n, {MICRO('avg(c)')} as mean_micro, {MICRO('quantile_cont(c, 0.5)')} as median_micro, {MICRO('avg(case when same then 1.0 else 0.0 end)')} as consensus_micro,
      count(*) filter (where c < 0.5) as below_half, count(*) filter (where c < 0.75) as below_three_quarters from a group by rollup (label)""")
def q_replay_summary(spark, sf_dir):
    rows = d.table(spark, sf_dir, "embeddings")
    centers = rows.groupBy("label").agg(F.array(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)])).alias("center"))
    key = F.sha2(F.col("vec_id").cast("string"), 256)
    predicted = rows.select(key.alias("sequence_sha256"), F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("predicted"),
                            F.when(F.col("vec_id") % 3 == 0, "NGG").otherwise("NAG").alias("consensus"))
    labels = rows.join(centers, "label").select(key.alias("sequence_sha256"), F.col("center").alias("label"), F.lit("NGG").alias("label_consensus"), F.col("label").cast("string").alias("source"))
    out = qu.replay_summary(qu.replay_audit(predicted, labels))
    return out.select("source", "n", d.micro(F.col("mean_cosine")).alias("mean_micro"), d.micro(F.col("median_cosine")).alias("median_micro"),
                      d.micro(F.col("exact_consensus_rate")).alias("consensus_micro"), "below_half", "below_three_quarters")


@registry.add("best_search_hit", f"""with h as (select c_nationkey, c_custkey, (['cas9', 'cas12', null])[1 + c_nationkey % 3] as family, (['Cas9 protein', 'csn1 like', 'Cpf1', 'helicase'])[1 + c_custkey % 4] as name,
      150 + {d.SQL['nibble']('e', 'c_custkey', 1)} * 10 as n, case when c_custkey % 5 = 0 then '' when c_custkey % 2 = 0 then 'UniProtKB unreviewed' else 'UniProtKB reviewed' end as entry from customer),
    s as (select *, case when family = 'cas9' and regexp_matches(lower(name), 'cas9|csn1') or family = 'cas12' and regexp_matches(lower(name), 'cas12|cpf1') then 0 else 1 end as off from h where n >= 200)
    select c_nationkey, arg_min('A' || cast(c_custkey as varchar), struct_pack(o := off, r := case when contains(entry, 'reviewed') then 0 else 1 end, l := -n, p := c_custkey)) as accession from s group by c_nationkey""")
def q_best_search_hit(spark, sf_dir):
    c = F.col("c_custkey")
    rows = d.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    hits = rows.select(
        "c_nationkey", c.alias("position"), F.concat(F.lit("A"), c.cast("string")).alias("accession"),
        F.get(F.array(F.lit("cas9"), F.lit("cas12"), F.lit(None)), F.col("c_nationkey") % 3).alias("family"),
        F.get(F.array(*[F.lit(x) for x in ("Cas9 protein", "csn1 like", "Cpf1", "helicase")]), (c % 4).cast("int")).alias("name"), F.lit("").alias("genes"),
        F.repeat(F.lit("M"), (d.nibble("e", c, 1) * 10 + 150).cast("int")).alias("sequence"),
        F.when(c % 5 == 0, "").when(c % 2 == 0, "UniProtKB unreviewed").otherwise("UniProtKB reviewed").alias("entry_type"),
    )
    return li.best_search_hit(hits, ["c_nationkey"]).select("c_nationkey", "accession")


SQL_PUBLISHED = f"""p as (select p_partkey as id, substr({d.SQL['dna']('t', 'p_partkey')}, 1, 12) as sp, p_partkey % 5 <> 4 as hit, substr({d.SQL['dna']('u', 'p_partkey')}, 1, 8) as l0, case when p_partkey % 11 = 10 then '' else substr({d.SQL['dna']('w', 'p_partkey')}, 1, 8) end as r0,
      case p_partkey % 3 when 0 then 'forward' when 1 then 'reverse' end as o from part),
    q as (select *, case when hit then l0 else '' end as l, case when hit then r0 else '' end as r from p),
    o as (select id, o, case when o = 'reverse' then {d.SQL['revcomp']('sp')} else sp end as spacer, case when o = 'reverse' then {d.SQL['revcomp']('r')} else l end as up, case when o = 'reverse' then {d.SQL['revcomp']('l')} else r end as dn from q)"""


def published_rows(spark, sf_dir):
    p = F.col("p_partkey")
    hit = p % 5 != 4
    flank = lambda prefix: F.when(hit, F.substring(d.dna_of(prefix, p), 1, 8)).otherwise(F.lit(""))
    return d.table(spark, sf_dir, "part").select(
        p.alias("id"), p.cast("string").alias("spacer_id"), F.substring(d.dna_of("t", p), 1, 12).alias("source_spacer"), F.when(hit, "1").otherwise("0").alias("hit"),
        flank("u").alias("raw_left_flank"), F.when(p % 11 == 10, F.lit("")).otherwise(flank("w")).alias("raw_right_flank"),
        F.when(p % 3 == 0, "Forward").when(p % 3 == 1, "forward|reverse").otherwise("").alias("orientation_PAMbased"),
        F.when(p % 3 == 1, "Reverse").otherwise("").alias("orientation_CRISPRCasdb"),
    )


@registry.add("published_orientation", d.with_ctes(SQL_PUBLISHED, final="""select id, o as orientation, spacer as oriented_spacer, substr(up, 1, greatest(length(up) - 3, 0)) as upstream, substr(dn, 4) as downstream,
    case when o is null then 'no_unambiguous_orientation' end as orientation_error from o"""))
def q_published_orientation(spark, sf_dir):
    return ev.orient_published_rows(published_rows(spark, sf_dir)).select(
        "id", "orientation", "oriented_spacer", F.col("oriented_upstream_flank").alias("upstream"), F.col("oriented_downstream_flank").alias("downstream"), "orientation_error")


@registry.add("published_flank_split", d.with_ctes(SQL_PUBLISHED, final="""select case when id % 13 = 12 then 'error_unknown_spacer' when id % 5 = 4 then 'no_hit' when substr(dn, 4) = '' then 'excluded_no_flank' else 'used' end as status, count(*) as n from o where o is not null group by all"""))
def q_published_split(spark, sf_dir):
    rows = ev.orient_published_rows(published_rows(spark, sf_dir)).where("orientation_error is null")
    known = rows.where("id % 13 <> 12").select("spacer_id", F.col("oriented_spacer").alias("spacer_sequence"))
    return ev.published_flank_split(rows, known, side="downstream").groupBy(F.col("flank_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("channel_interpretation", d.with_ctes(*rq.SQL_BOTH, rq.SQL_GOLDS, final="""select system_id, arg_min(candidate_pam, struct_pack(s := -coalesce(ps, 1e9), c := candidate_pam)) as protein_top, arg_min(candidate_pam, struct_pack(s := -coalesce(ss, 1e9), c := candidate_pam)) as spacer_top,
    count(*) filter (where status like 'discordant%' or status = 'concordant_conflict') as conflicting_candidates, count(*) filter (where status like '%neutral') as neutral_candidates from statuses group by system_id"""))
def q_interpretation(spark, sf_dir):
    spacer = rq.spacer_rows(spark, sf_dir).withColumn("evidence_kind", F.lit("raw_targets")).withColumn("row_order", F.col("candidate_pam"))
    slim = fu.slim_fusion(rq.protein_rows(spark, sf_dir), spacer)
    return fu.interpretation(slim, d.golds(spark, sf_dir)).select("system_id", "protein_top", "spacer_top", "conflicting_candidates", "neutral_candidates")
