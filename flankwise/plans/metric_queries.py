"""Queries over rank statistics, benchmark aggregates and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matrix as mx
from ..operators import metrics as me
from . import derive as d
from .registry import registry

MICRO = d.SQL["micro"]


def order_methods(spark, sf_dir):
    """(system_id, method, tier, role, coverage, metrics, not_applicable) from customers and their orders.

    A system is a customer, a method the priority of its orders; the mean rank of
    a method stands for its quality, and systems of one nation lack a channel.
    """
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customers = d.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rank = d.nibble("q", F.col("o_orderkey"), 1) + 1
    rows = orders.groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("digit")).agg(
        F.avg((F.col("o_orderstatus") != "P").cast("double")).alias("coverage"),
        F.avg(1.0 / rank).alias("mrr"), *[F.avg((rank <= k).cast("double")).alias(f"recall_at_{k}") for k in me.RECALL_AT],
    )
    method = F.when(F.col("digit") == "1", "fusion").when(F.col("digit") == "2", "protein_only").when(
        F.col("digit") == "3", "spacer_only").otherwise("family_prior")
    # Priorities 4 and 5 are one method, so their customers' rows are averaged.
    rows = rows.withColumn("method", method).groupBy("o_custkey", "method").agg(*[F.avg(c).alias(c) for c in ("coverage", *me.METRICS)])
    joined = rows.join(customers, rows["o_custkey"] == customers["c_custkey"])
    absent = (F.col("c_nationkey") % 7 == 0) & (F.col("method") == "spacer_only")
    return joined.select(
        F.col("o_custkey").alias("system_id"), "method", F.col("c_mktsegment").alias("tier"), F.col("c_nationkey").alias("role"),
        "coverage", *[F.when(~absent, F.col(m)).alias(m) for m in me.METRICS], absent.alias("not_applicable"),
    )


SQL_METHODS = f"""ranks as (select o_custkey, substr(o_orderpriority, 1, 1) as digit, o_orderstatus, {d.SQL['nibble']('q', 'o_orderkey', 1)} + 1 as rank from orders),
    by_digit as (select o_custkey, digit, avg(case when o_orderstatus <> 'P' then 1.0 else 0.0 end) as coverage, avg(1.0::double / rank) as mrr,
      avg(case when rank <= 1 then 1.0 else 0.0 end) as r1, avg(case when rank <= 3 then 1.0 else 0.0 end) as r3, avg(case when rank <= 5 then 1.0 else 0.0 end) as r5 from ranks group by all),
    by_method as (select o_custkey, case digit when '1' then 'fusion' when '2' then 'protein_only' when '3' then 'spacer_only' else 'family_prior' end as method,
      avg(coverage) as coverage, avg(mrr) as mrr, avg(r1) as r1, avg(r3) as r3, avg(r5) as r5 from by_digit group by all),
    methods as (select o_custkey as system_id, method, c_mktsegment as tier, c_nationkey as role, coverage, c_nationkey % 7 = 0 and method = 'spacer_only' as na,
      mrr, r1, r3, r5 from by_method join customer on c_custkey = o_custkey)"""
SUMMARY_SQL = f"""count(*) filter (where not na) as systems_total, count(*) filter (where na) as systems_not_applicable,
    count(*) filter (where not na and coverage > 0) as systems_scored, {MICRO('avg(mrr) filter (where not na)')} as mrr_all_micro,
    {MICRO('avg(mrr) filter (where not na and coverage > 0)')} as mrr_eligible_micro, {MICRO('avg(r5) filter (where not na)')} as recall_at_5_all_micro"""


def summary_columns(rows, *extra):
    return rows.select(
        *extra, "systems_total", "systems_not_applicable", "systems_scored",
        d.micro(F.col("mrr_all_systems")).alias("mrr_all_micro"), d.micro(F.col("mrr_eligible_systems")).alias("mrr_eligible_micro"),
        d.micro(F.col("recall_at_5_all_systems")).alias("recall_at_5_all_micro"),
    )


@registry.add("benchmark_aggregate", d.with_ctes(SQL_METHODS, final=f"select method, {SUMMARY_SQL} from methods group by method"))
def q_benchmark_aggregate(spark, sf_dir):
    return summary_columns(me.aggregate_benchmark(order_methods(spark, sf_dir)), "method")


@registry.add("benchmark_grouping_sets", d.with_ctes(SQL_METHODS, final=f"""select method, tier, role, {SUMMARY_SQL} from methods
    group by grouping sets ((method), (method, tier), (method, role)) having count(*) filter (where not na) > 0"""))
def q_benchmark_grouping_sets(spark, sf_dir):
    rows = me.aggregate_benchmark(order_methods(spark, sf_dir), grains=[[], ["tier"], ["role"]])
    return summary_columns(rows, "method", "tier", "role")


SQL_DELTAS = """usable as (select * from methods where not na and coverage > 0),
    deltas as (select b.system_id, 'fusion_minus_' || b.method as comparison, f.mrr - b.mrr as delta from usable b join usable f on f.system_id = b.system_id and f.method = 'fusion'
      where b.method in ('protein_only', 'spacer_only'))"""


@registry.add("paired_delta", d.with_ctes(SQL_METHODS, SQL_DELTAS, final=f"select comparison, count(*) as n, {MICRO('avg(delta)')} as mean_micro from deltas group by comparison"))
def q_paired_delta(spark, sf_dir):
    rows = me.paired_summary(me.paired_deltas(order_methods(spark, sf_dir)))
    return rows.select("comparison", "n", d.micro(F.col("mean_mrr_delta")).alias("mean_micro"))


# Each draw of each of the 2,000 resamples as a row: dealt to a block of 65,536 places, then to a place of the block.
def sql_draws(seed: int, key: str, iterations: int = 2000) -> str:
    number = lambda text, n: f"('0x' || substr(md5({text} || cast({n} // 2 as varchar)), cast(1 + 16 * ({n} % 2) as int), 15))::bigint"
    return f"""dealt as (select {key} as k, it, place as j, size, case when size <= 65536 then 0
        else {number(f"'{seed}-' || it || '-' || place // 262144 || '-'", "(place % 262144)")} % size // 65536 end as block
      from placed, (select unnest(range(0, {iterations})) as it)),
    numbered as (select *, row_number() over (partition by k, it, block order by j) - 1 as r from dealt),
    draws as (select k, it, block * 65536 + {number(f"'{seed}-' || it || '-' || block || '-' || r // 1048576 || '-'", "(r % 1048576)")} % least(65536, size - block * 65536) as place from numbered)"""


@registry.add("bootstrap_ci_hashed", d.with_ctes(
    SQL_METHODS, SQL_DELTAS,
    """placed as (select *, row_number() over (partition by comparison order by substr(md5(cast(system_id as varchar)), 1, 3), system_id) - 1 as place,
      count(*) over (partition by comparison) as size from deltas)""",
    sql_draws(17, "comparison"),
    """means as (select comparison, it, avg(delta) as m from draws d join placed p on p.comparison = d.k and p.place = d.place group by all),
    ordered as (select *, row_number() over (partition by comparison order by m, it) as n from means)""",
    final=f"""select comparison, {MICRO('max(m) filter (where n = 50)')} as low_micro, {MICRO('max(m) filter (where n = 1951)')} as high_micro from ordered group by comparison""",
))
def q_bootstrap(spark, sf_dir):
    deltas = me.paired_deltas(order_methods(spark, sf_dir))
    rows = me.bootstrap_mean_interval(deltas, value="mrr_delta", identity=["system_id"], keys=["comparison"])
    return rows.select("comparison", d.micro(F.col("ci_low")).alias("low_micro"), d.micro(F.col("ci_high")).alias("high_micro"))


@registry.add("cluster_bootstrap", d.with_ctes(
    SQL_METHODS, SQL_DELTAS,
    """clusters as (select system_id // 10 as cluster, sum(delta) as total, count(*) as items from deltas group by all),
    placed as (select *, row_number() over (order by substr(md5(cast(cluster as varchar)), 1, 3), cluster) - 1 as place, count(*) over () as size from clusters)""",
    sql_draws(20260927, "0"),
    "ratios as (select it, sum(total) / sum(items) as ratio from draws join placed using (place) group by it)",
    final=f"select {MICRO('quantile_cont(ratio, 0.025)')} as low_micro, {MICRO('quantile_cont(ratio, 0.975)')} as high_micro from ratios",
))
def q_cluster_bootstrap(spark, sf_dir):
    deltas = me.paired_deltas(order_methods(spark, sf_dir)).withColumn("cluster", d.integer_divide(F.col("system_id"), 10))
    rows = me.cluster_bootstrap_ratio(deltas, cluster="cluster", value="mrr_delta")
    return rows.select(d.micro(F.col("ci_low")).alias("low_micro"), d.micro(F.col("ci_high")).alias("high_micro"))


def lines(spark, sf_dir):
    return d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax")


@registry.add("average_rank", """select l_suppkey, l_quantity, cast(2 * (rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0) as bigint) as twice_rank,
    l_orderkey, l_linenumber from lineitem""")
def q_average_rank(spark, sf_dir):
    rows = me.average_rank(lines(spark, sf_dir), value="l_quantity", keys=["l_suppkey"])
    return rows.select("l_suppkey", "l_quantity", (F.col("mid_rank") * 2).cast("long").alias("twice_rank"), "l_orderkey", "l_linenumber")


@registry.add("spearman_by_group", f"""with r as (select l_suppkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0::double as x,
      rank() over (partition by l_suppkey order by l_discount) + (count(*) over (partition by l_suppkey, l_discount) - 1) / 2.0::double as y from lineitem)
    select l_suppkey, count(*) as n, {MICRO('case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end')} as spearman_micro from r group by l_suppkey""")
def q_spearman(spark, sf_dir):
    rows = me.spearman(lines(spark, sf_dir), left="l_quantity", right="l_discount", keys=["l_suppkey"])
    return rows.select("l_suppkey", "n", d.micro(F.col("spearman")).alias("spearman_micro"))


@registry.add("fractional_topk", f"""with r as (select l_suppkey, l_quantity, l_discount, rank() over (partition by l_suppkey order by l_quantity desc) - 1 as bx, count(*) over (partition by l_suppkey, l_quantity) as nx,
      rank() over (partition by l_suppkey order by l_discount desc) - 1 as by_, count(*) over (partition by l_suppkey, l_discount) as ny from lineitem),
    m as (select l_suppkey, greatest(0.0::double, least(nx, 5 - bx)) / nx as a, greatest(0.0::double, least(ny, 5 - by_)) / ny as b from r)
    select l_suppkey, {MICRO('sum(a * b) / 5')} as overlap_micro from m group by l_suppkey""")
def q_fractional_topk(spark, sf_dir):
    rows = me.top_overlap(lines(spark, sf_dir), left="l_quantity", right="l_discount", keys=["l_suppkey"], k=5)
    return rows.select("l_suppkey", d.micro(F.col("overlap")).alias("overlap_micro"))


@registry.add("key_coverage", """select l_orderkey as key, case when o.o_orderkey is null then 'unexpected_prediction' when l_orderkey is null then 'missing_prediction' else 'duplicate_prediction' end as problem
    from (select l_orderkey, count(*) as n from lineitem group by 1) full join orders o on o.o_orderkey = l_orderkey where o.o_orderkey is null or n > 1 and l_orderkey is not null
    union all select o_orderkey, 'missing_prediction' from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def q_key_coverage(spark, sf_dir):
    predictions = d.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    targets = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return me.key_differences(predictions, targets, ["key"])


@registry.add("embedding_change", f"""with a as (select e.vec_id, list_transform(e.embedding, lambda x: x::double) as x, list_transform(c.center, lambda x: x::double) as c from embeddings e
      join (select label, [{', '.join(f'avg(embedding[{i}]::double)' for i in range(1, 65))}] as center from embeddings group by label) c using (label))
    select vec_id, {MICRO('list_cosine_similarity(x, c)')} as cosine_micro, {MICRO('list_distance(x, c)')} as l2_micro,
      {MICRO('list_distance(x, c) / sqrt(list_inner_product(c, c))')} as relative_micro from a""")
def q_embedding_change(spark, sf_dir):
    rows = d.table(spark, sf_dir, "embeddings")
    centers = rows.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("center"))
    joined = rows.join(centers, "label").withColumn("v", mx.vector_change("embedding", "center"))
    return joined.select(
        "vec_id", d.micro(F.col("v.cosine")).alias("cosine_micro"), d.micro(F.col("v.l2")).alias("l2_micro"),
        d.micro(F.col("v.relative_l2")).alias("relative_micro"),
    )
