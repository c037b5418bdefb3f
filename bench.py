"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flankwise.plans import load_queries
from flankwise.session import build_session

HEADLINE = [
    "spacer_hits", "spacer_candidate_evidence", "flank_probability_matrix", "contig_collapse", "candidate_rank",
    "degenerate_candidate_scores", "fusion_gate", "method_metrics", "benchmark_grouping_sets", "spearman_by_group",
    "fractional_topk", "bootstrap_ci_hashed", "edit_identity_neighbors", "kmer_jaccard_topk", "hamming_components",
    "independence_audit", "statement_triples", "literature_classify", "gold_merge", "readcount_to_freq",
    "annotation_systems", "contract_violations", "variant_metrics", "motif_spectrum",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    queries = load_queries().queries
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
