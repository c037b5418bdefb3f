"""Some registered queries against their SQL at the smallest scale; `tools/check.py` runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["spacer_hits", "method_metrics", "motif_subset_join", "edit_identity_neighbors", "cluster_split", "spearman_by_group",
         "bootstrap_ci_hashed", "statement_triples", "gold_review", "kmer_count_to_pam", "annotation_systems", "contract_violations", "record_coding", "record_cores", "run_diagnosis", "column_roles"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    relation = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in relation.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=key)
    right = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=key)
    assert left == right


def test_every_query_has_its_own_name():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
