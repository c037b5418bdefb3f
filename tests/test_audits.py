from math import isclose
from random import Random

import pytest
from pyspark.sql import functions as F

from flankwise.functions.protein import kmer_counts, sparse_cosine
from flankwise.operators import clusters as cl, contract as co, exposure as ex, ordering as od, quantitative as qu, results as rs, similarity as si


def seqs(spark, values):
    return si.distinct_sequences(spark.createDataFrame([(v,) for v in values], "sequence string"), "sequence")


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("identity", [0.9, 0.8, 0.6])
def test_identity_pairs_equal_brute_force(spark, identity):
    rng = Random(5)
    word = lambda n: "".join(rng.choice("ACDEF") for _ in range(n))
    base = [word(rng.randint(3, 40)) for _ in range(15)]
    def mutate(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s))
            kind = rng.randrange(3)
            s[at:at + 1] = [rng.choice("ACDEF")] if kind == 0 else [] if kind == 1 and len(s) > 2 else [s[at], rng.choice("ACDEF")]
        return "".join(s)
    left, right = base + [mutate(b) for b in base], [mutate(b) for b in base for _ in range(3)]
    got = {(r.query, r.reference): r.edit_distance for r in si.identity_pairs(seqs(spark, left), seqs(spark, right), identity).collect()}
    want = {}
    for a in set(left):
        for b in set(right):
            longer, distance = max(len(a), len(b)), edit(a, b)
            if distance <= int((1 - identity) * longer + 1e-9):
                want[a, b] = distance
    assert got == want


def test_near_neighbors(spark):
    base = "ACDEFGHIKLMNPQRSTVWY" * 5
    one = base[:50] + "W" + base[51:]
    rows = si.near_neighbors(seqs(spark, [base]), seqs(spark, [base, base, one, base[:84]])).collect()
    assert {(r.reference, r.edit_distance) for r in rows} == {(base, 0), (one, 1)}
    cosine = {r.reference: r.kmer_cosine for r in rows}
    assert isclose(cosine[one], sparse_cosine(kmer_counts(base, 3), kmer_counts(one, 3)))


@pytest.mark.parametrize("minimum", [0.0, 0.2, 0.6])
def test_jaccard_equals_brute_force(spark, minimum):
    rng = Random(8)
    words = ["".join(rng.choice("ACD") for _ in range(rng.randint(3, 14))) for _ in range(40)] + ["AAAAAAAAAA", "AAAAAAAAAAC"]
    grams = lambda s: {s[i:i + 4] for i in range(len(s) - 3)} or {s}
    want = {}
    for a in set(words[:20] + words[-1:]):
        for b in set(words):
            x, y = grams(a), grams(b)
            if x & y and len(x & y) / len(x | y) >= minimum:
                want[a, b] = round(len(x & y) / len(x | y), 9)
    got = {(r.query, r.reference): round(r.similarity, 9) for r in si.jaccard_pairs(seqs(spark, words[:20] + words[-1:]), seqs(spark, words), minimum=minimum).collect()}
    assert got == want


def test_components(spark):
    names = ["AAAAAA", "CCAAAA", "CCCCAA", "TTTTTT"]
    rows = cl.hamming_components(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r["name"]: r.component for r in rows.collect()} == {"AAAAAA": "AAAAAA", "CCAAAA": "AAAAAA", "CCCCAA": "AAAAAA", "TTTTTT": "TTTTTT"}
    rng = Random(3)
    names = sorted({"".join(rng.choice("ACDE") for _ in range(6)) for _ in range(60)})
    parent = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if sum(x != y for x, y in zip(a, b)) <= 2 and parent[b] < parent[a]:
                    parent[a], changed = parent[b], True
    got = {r["name"]: r.component for r in cl.hamming_components(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == parent


def test_chain_contracts(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "u string, v string")
    assert {(r.u, r.v) for r in cl.contract(edges).collect()} == {(f"n{i:03d}", "n000") for i in range(1, 61)}


def test_fingerprint_has_one_rule(spark):
    from hashlib import sha256

    names = [f"N{i:05d}" for i in range(60_000)]
    rows = spark.createDataFrame([(n, "N00000") for n in reversed(names)] + [("TTTTTT", "TTTTTT")], "name string, component string")
    prints = {r.component: r.fingerprint for r in cl.component_fingerprints(rows).collect()}
    assert prints == {"N00000": sha256("|".join(names).encode()).hexdigest(), "TTTTTT": sha256(b"TTTTTT").hexdigest()}


def test_family_predicates_differ(spark):
    row = spark.createDataFrame([("V", "Cas9"), ("", "Cas9x"), ("Type II", "Cas12")], "t string, f string")
    got = row.select(ex.is_cas9_by_type(F.col("t"), F.col("f")).alias("a"), ex.is_cas9_by_either(F.col("t"), F.col("f")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (True, True)]


def test_leakage_guard(spark):
    a = spark.createDataFrame([("x",), ("y",)], "sequence string")
    b = spark.createDataFrame([("y",)], "sequence string")
    with pytest.raises(ValueError, match="leakage: 1"):
        ex.assert_no_leakage(a, b, "sequence")
    assert tuple(ex.net_new_counts(a, b, "sequence").first()) == (1, 2, 1, 1)


def test_positions_are_dense(spark):
    rows = spark.range(500).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    for k, n in rows.groupBy("k").count().collect():
        got = [r.p for r in od.dense_position(rows, ["id"], ["k"], "p").where(F.col("k") == k).collect()]
        assert sorted(got) == list(range(n))
    ordered = od.ordered_position(rows, "id", [], ["k"], "p").where("k = 1").orderBy("id").collect()
    assert [r.p for r in ordered] == list(range(1, len(ordered) + 1))


def good_system(**changes):
    entry = dict(source_name="n", source_uri="u", source_version="1", license="CC0", sha256="a" * 64, sha256_scope="file")
    row = dict(
        system_id="s1", tier="strict_independent", status="ready", crispr_type="II-A", cas_family="Cas9", available_tracks=["protein_only", "paired_evidence"],
        protein_model="m", protein_fasta="p.faa", protein_record_id="r", pam_side="downstream", pam_lengths=[3], gold_pam_spectrum={"3": ["NGG"]},
        gold_evidence_type="experimental_activity", gold_doi="10.1/x", gold_assay=dict(assay_type="depletion", activity_values_available=True, conditions="c", source_locator="l"),
        gold_system_match="exact_protein_or_strain", protein_training_exposure="none", target_independence="virus_clustered", host_taxon="t", host_strain="s",
        split_group="g", notes="n", spacer_fasta="s.fna", spacer_orientation="forward", target_fastas=["t.fna"], max_mismatches=1,
        target_dataset=dict(name="n", release="1", frozen_at="d", selection_policy="p", cluster_policy="vcluster"),
        provenance=dict(protein=entry, spacers=entry, targets=[entry]),
    )
    row.update(changes)
    return row


def audit(spark, **changes):
    import json
    text = json.dumps(good_system(**changes))
    return co.audit_systems(spark.createDataFrame([(text,)], "t string").select(F.from_json("t", co.SYSTEM_SCHEMA).alias("s")).select("s.*")).first()


def test_valid_strict_system(spark):
    r = audit(spark)
    assert r.errors == [] and r.valid and r.runnable and r.strict_eligible_tracks == ["protein_only", "paired_evidence"]


@pytest.mark.parametrize("changes,message", [
    (dict(tier="x"), "tier must be one of"), (dict(pam_lengths=[4]), "pam_lengths must equal"), (dict(gold_pam_spectrum={"3": ["NGGG"]}), "not a valid spectrum"),
    (dict(protein_fasta="../p"), "safe path"), (dict(max_mismatches=-1), "non-negative max_mismatches"), (dict(target_fastas=[]), "non-empty target_fastas"),
    (dict(protein_training_exposure="near"), "every declared track"), (dict(target_independence="contig_only"), "every declared track"),
    (dict(available_tracks=["protein_only", "protein_only"]), "duplicates"), (dict(host_strain=" "), "host_strain"),
])
def test_broken_systems(spark, changes, message):
    r = audit(spark, **changes)
    assert any(message in e for e in r.errors) and not r.valid


def test_document_rules(spark):
    import json
    doc = dict(format_version=2, benchmark_name="b", frozen_at="d", candidate_policy="p", minimum_strict_systems=5, systems=[good_system(), good_system()])
    document = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.from_json("t", co.DOCUMENT_SCHEMA).alias("d")).select("d.*")
    audits = co.audit_systems(document.select(F.explode("systems").alias("s")).select("s.*"))
    got = {(r.kind, r.message) for r in co.document_violations(document, audits).collect()}
    assert ("error", "duplicate system_id value: s1") in got and any(k == "warning" for k, _ in got)


def test_measurement_rules(spark):
    groups = qu.expected_groups(spark.createDataFrame([("v",)], "variant_id string")).withColumn("raw_log10_k", F.lit(-6.0))
    good = qu.clip(groups)
    variants = spark.createDataFrame([("v",)], "variant_id string")
    assert qu.measurement_violations(good, variants).count() == 0
    assert qu.variant_profile(good).first().constant_target
    bad = qu.measurement_violations(good.limit(63).unionByName(good.limit(1)), variants.unionByName(spark.createDataFrame([("w",)], "variant_id string")))
    assert {(r.variant_id, r.problem) for r in bad.collect()} >= {("v", "incomplete_groups"), ("w", "no_measurements")}


def test_stable_ids_and_ingest(spark):
    rows = spark.createDataFrame([(i, "x", "") for i in range(3)] + [(3, "y", "own")], "position long, a string, row_id string")
    ids = [r.row_id for r in rs.stable_row_ids(rows, ["a"], "position").orderBy("position").collect()]
    assert [i[-4:] for i in ids[:3]] == ["-001", "-002", "-003"] and ids[3] == "own"
    norm = rs.normalize_for_corpus(spark.createDataFrame([("NGG",)], "pam_consensus string"))
    assert norm.columns == rs.CORPUS_COLUMNS and tuple(rs.ingest_counts(norm).first()) == (1, 1, 0, 0)
    co.column_contract(norm, rs.CORPUS_COLUMNS)
    with pytest.raises(ValueError):
        co.column_contract(norm.select("source"), rs.CORPUS_COLUMNS)
