"""Motifs of any length, token sets, controls, priors, scopes and diagnoses against brute force."""

from itertools import product
from random import Random

import pytest
from pyspark.sql import functions as F

from flankwise.functions import dna, iupac
from flankwise.functions.text import accession_tokens
from flankwise.operators import evidence as ev, exposure as ex, matching as ma, metrics as me
from flankwise.operators.annotation import token_set_join

SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
        "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


@pytest.mark.parametrize("copied", [True, False])
def test_motifs_of_any_length(spark, monkeypatch, copied):
    if not copied:
        monkeypatch.setattr(ma, "MAX_COPIED_QUERIES", 0)
    rng = Random(3)
    motifs = ["N" * 20, "B" * 17, "NNNNNNNNNNNNNNNNNNNNACGT", "ACGT" * 9, "ngg", "XX", ""] + ["".join(rng.choice("ACGTRYSWKMBDHVN") for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 16, 17, 24, 31) for _ in range(6)]
    strings = ["AC", "acg", "ANG"] + ["".join(x) for x in product("ACGT", repeat=3)]
    for m in motifs:
        if m and m != "XX":
            spelled = [rng.choice(SETS[c.upper()]) for c in m]
            strings.append("".join(spelled))
            spelled[rng.randrange(len(m))] = rng.choice("ACGT")
            strings.append("".join(spelled))
    found = ma.motif_match_join(spark.createDataFrame([(s,) for s in strings], "s string"), spark.createDataFrame([(m,) for m in motifs], "m string"), "s", "m").collect()
    expected = {(s, m) for s in set(strings) if set(s) <= set("ACGT") for m in set(motifs) if m and m != "XX" and len(m) == len(s) and all(a in SETS[c.upper()] for a, c in zip(s, m))}
    assert len(found) == len(set(found)) and {(r.s, r.m) for r in found} == expected


def test_packed_masks(spark):
    row = spark.range(1).select(iupac.packed_masks(F.lit("ACGTN" * 4)).alias("p"), iupac.key_window(F.lit("NNNNACGTACGTNN")).alias("w")).first()
    assert row.p == [int("1248F" * 3, 16), int("1248F", 16)] and (row.w["at"], row.w["shape"]) == (5, "xxxxxxxx")


def test_token_sets(spark):
    rows = spark.createDataFrame([(1, " b | a |b||"), (2, "c"), (3, None), (4, "a|c")], "id int, listed string").withColumn("tokens", accession_tokens("listed"))
    assert [r.tokens for r in rows.orderBy("id").collect()] == [["b", "a"], ["c"], [], ["a", "c"]]
    registry = spark.createDataFrame([("a", "one"), ("b", "two"), ("z", "none")], "accession string, system string")
    found = token_set_join(rows, registry, tokens="tokens", accession="accession").collect()
    assert {(r.id, r.system, r.token_place) for r in found} == {(1, "two", 0), (1, "one", 1), (4, "one", 0)}
    first = token_set_join(rows, registry, tokens="tokens", accession="accession", first_only=True).collect()
    assert {(r.id, r.system) for r in first} == {(1, "two"), (4, "one")}


def test_shuffles_keep_the_letters(spark):
    rows = spark.createDataFrame([(i, "ACGT" * 10 + "GGGCC") for i in range(30)], "id int, s string")
    got = rows.select("s", dna.shuffled_letters("s", 1, "id").alias("t"), dna.random_bases(F.length("s"), 1, "id").alias("r")).collect()
    assert all(sorted(r.t) == sorted(r.s) and r.t != r.s and len(r.r) == 45 and set(r.r) <= set("ACGT") for r in got)
    assert len({r.t for r in got}) == 30 == len({r.r for r in got})


def test_controls_lose_the_signal(spark):
    rng = Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    cores = [word(24) for _ in range(6)]
    spacers = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(cores)], "spacer_id string, spacer_sequence string")
    targets = spark.createDataFrame([(f"t{i // 2}{i % 2}", word(30) + c + "AGG" + word(30)) for i, c in enumerate(cores)], "target_id string, target_sequence string")
    measures = ev.negative_controls(spacers, targets, side="downstream", length=3, mismatches=1)
    rows = {r.control: r for r in measures.collect()}
    assert set(rows) == set(ev.CONTROLS) and rows[ev.CONTROLS[0]].alignments == 6 and rows[ev.CONTROLS[0]].xgg_fraction == 1.0
    assert rows[ev.CONTROLS[1]].alignments == 6 and all(rows[c].alignments == 0 and rows[c].distinct_target_contigs == 0 for c in ev.CONTROLS[2:])
    verdict = ev.control_verdict(measures).first()
    assert verdict.signal_survives_positive and verdict.collapses_under_homology_destroying_nulls and verdict.contig_level_xgg_fraction == 1.0


def test_prior_and_spectrum_cosine_and_scope(spark):
    candidates = spark.createDataFrame([("x", c) for c in ("AGG", "agt", "AGGA", "NGG")], "system_id string, candidate_pam string")
    prior = spark.createDataFrame([("x", "ngg")], "system_id string, prior_pam string")
    assert {r.candidate_pam: r.score for r in me.prior_scores(candidates, prior).collect()} == {"AGG": 1.0, "AGT": 0.0, "AGGA": None, "NGG": 1.0}
    predictions = spark.createDataFrame([("x", "NGG"), ("x", "AG"), ("x", "??"), ("y", "NGG")], "system_id string, predicted_pam string")
    golds = spark.createDataFrame([("x", "NGG"), ("x", "TTTT"), ("x", "bad!")], "system_id string, gold_pam string")
    got = {(r.system_id, r.predicted_pam): r.spectrum_cosine for r in me.best_spectrum_cosine(predictions, golds).collect()}
    assert got[("x", "NGG")] == pytest.approx(1.0) and got[("x", "AG")] == got[("x", "??")] == got[("y", "NGG")] == 0.0
    loose = {(r.system_id, r.predicted_pam): r.spectrum_cosine for r in me.best_spectrum_cosine(predictions, golds, same_length=False).collect()}
    assert 0 < loose[("x", "AG")] < 1
    variants = spark.createDataFrame([("W", "development"), ("a", "development"), ("b", "future")], "variant_id string, future_task_split string")
    assert me.select_scope(variants, "development", control="W").count() == 2 and me.select_scope(variants, "all", control="W").count() == 3
    with pytest.raises(ValueError, match="unknown scope"):
        me.select_scope(variants, "some", control="W")
    with pytest.raises(ValueError, match="control variant"):
        me.select_scope(variants, "development", control="b")


def test_failure_lookup(spark):
    systems = spark.createDataFrame([(s,) for s in "abcdef"], "system_id string")
    golds = spark.createDataFrame([(s, g) for s in "abcdef" for g in ("NGG", "NAGN")], "system_id string, gold_pam string")
    replay = spark.createDataFrame([("b", "NGG", 0.2), ("c", "TTT", 0.9), ("d", "RGG", 0.6), ("e", "AGG", 0.9), ("e", "CCC", 0.1), ("f", "AGG", 0.9)], "system_id string, label string, cosine double")
    ranks = spark.createDataFrame([(s, m, r) for s in "abcde" for m, r in (("protein_only", 9), ("protein_only", 7), ("spacer_only", 2))] + [("f", "protein_only", 1), ("f", "fusion", 9)], "system_id string, method string, gold_rank int")
    got = {r.system_id: r for r in ex.failure_lookup(systems, golds, ranks, replay).collect()}
    assert {k: r.failure_mode for k, r in got.items()} == {
        "a": "no_exact_training_label", "b": "checkpoint_replay_failure", "c": "training_label_vs_experimental_gold_mismatch", "d": "weak_checkpoint_replay",
        "e": "protein_ranking_failure_despite_label_alignment", "f": "no_primary_failure_detected"}
    assert got["e"].protein_rank == 7 and got["f"].spacer_rank is None


def test_results_assembly_keeps_unknown_apart_from_zero(spark):
    from flankwise.operators.results import assemble_results

    protein = spark.createDataFrame(
        [(s, p, 3, r, 50.0 - r) for s in (1, 2, 3) for r, p in enumerate(("AAA", "CCC", "GGG"), 1)],
        "system_id long, candidate_pam string, pam_length int, protein_rank int, specificity_adjusted_score double")
    spacer = spark.createDataFrame(
        [(1, "AAA", None, None, 0, None), (1, "GGG", 70.0, 1, 2, 3)],
        "system_id long, candidate_pam string, spacer_evidence_score double, spacer_rank int, support_spacer_count long, support_target_count long")
    fusion = spark.createDataFrame(
        [(1, "AAA", "protein_only_unverified", " "), (1, "CCC", "x", "g"), (1, "GGG", "concordant_support", "g")],
        "system_id long, candidate_pam string, evidence_status string, fusion_gate string")
    systems = spark.createDataFrame(
        [(1, "dual", "raw"), (2, "protein_only", "raw")], "system_id long, evidence_track string, evidence_source string")
    display = spark.createDataFrame([(2, "GGG"), (2, "GGG"), (2, "TTT")], "system_id long, candidate_pam string")

    def found(**options):
        rows = assemble_results(protein, spacer, fusion, systems, notes={"raw": "n"}, no_track_note="none", **options)
        assert not [c for c in rows.columns if c.startswith("_")]
        return {r.candidate_id: r for r in rows.collect()}

    rows = found(display=display)
    assert {k: r.candidate_pam for k, r in rows.items()} == {"1-0001": "AAA", "1-0002": "CCC", "1-0003": "GGG", "2-0001": "GGG"}
    assert [rows[k].ranking_basis for k in sorted(rows)] == [
        "fusion gate not recorded", "spacer evidence unavailable for this candidate", "fusion gate=g",
        "protein_only: ranked by protein compatibility within PAM length"]
    assert (rows["1-0001"].support_spacer_count, rows["1-0002"].support_spacer_count, rows["1-0002"].evidence_status) == (0, None, None)
    assert (rows["1-0003"].notes, rows["2-0001"].notes) == ("n", "none")
    assert {r.candidate_pam for r in found(display=display, top=1).values() if r.system_id == 2} == {"AAA", "GGG"}
    assert len(found(top=2)) == 4 and len(found()) == 6
