"""Cases of the second review that the search operators used to cut short."""

import pytest
from pyspark.sql import functions as F

from flankwise.functions.matrix import normalize_rows
from flankwise.operators.candidates import score_protein_candidates
from flankwise.operators.fusion import interpretation
from flankwise.operators import matching, similarity
from flankwise.operators.matching import hamming_matches, spacer_hits
from flankwise.operators.similarity import nearest_partner
from flankwise.plans.derive import matrix_of


def test_spacers_of_every_length_are_placed_or_refused(spark):
    target = "ACGTTGCAAGGCTTACCGATTTGACCATGG"
    spacers = spark.createDataFrame([(i, target[4:4 + n].lower()) for i, n in enumerate((10, 12, 15))], "spacer_id int, spacer_sequence string")
    targets = spark.createDataFrame([(1, target)], "target_id int, target_sequence string")
    hits = spacer_hits(spacers, targets, mismatches=0, flank_length=3).collect()
    assert {h.spacer_id for h in hits} == {0, 1, 2}
    assert {h.spacer_id for h in spacer_hits(spacers, targets, mismatches=0, flank_length=3, lengths=[10, 12, 15]).collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="15"):
        spacer_hits(spacers, targets, mismatches=0, flank_length=3, lengths=[10, 12])
    assert spacer_hits(spacers.limit(0), targets, mismatches=0, flank_length=3).count() == 0

    queries = spacers.selectExpr("upper(spacer_sequence) as query")
    assert {len(r.query) for r in hamming_matches(queries, targets, 0).collect()} == {10, 12, 15}
    with pytest.raises(ValueError, match="10"):
        hamming_matches(queries, targets, 0, [12, 15])


def test_candidates_of_equal_score_rank_by_mean_whatever_the_order_of_addition(spark):
    """0.54 + 0.2743 and 0.3267 + 0.4876 add up to one score, whose sums differ in their last bits; the mean of the second is larger."""
    matrices = spark.range(195, 196).select(
        F.col("id").alias("system_id"), normalize_rows(matrix_of(F.col("id"), F.lit(False))).alias("matrix"), F.lit("downstream").alias("pam_side"))
    candidates = spark.createDataFrame([(195, "CCG"), (195, "TGG")], "system_id long, candidate_pam string")
    ranks = {r.candidate_pam: r.protein_rank for r in score_protein_candidates(candidates, matrices).collect()}
    assert ranks == {"TGG": 1, "CCG": 2}


def test_the_top_of_equal_scores_is_the_first_motif(spark):
    """0.1 + 0.2 and 0.3 are one score, although their doubles differ."""
    rows = [(1, "CCG", 0.3, 1.0, "neutral"), (1, "TGG", 0.1 + 0.2, 2.0, "neutral")]
    slim = spark.createDataFrame(rows, "system_id long, candidate_pam string, protein_score double, spacer_score double, evidence_status string")
    golds = spark.createDataFrame([(1, "NGG")], "system_id long, gold_pam string")
    top = interpretation(slim, golds).first()
    assert (top.protein_top, top.spacer_top) == ("CCG", "TGG")


def test_partners_of_equal_kmer_sets_are_equally_near(spark):
    """AAAAA and AAAAAA have one 4-mer: the copy 3 is no nearer to 1 than 2 is."""
    rows = [(1, "AAAAA", "A"), (2, "AAAAAA", "C"), (3, "AAAAA", "A"), (4, "CDEFGA", "A"), (5, "CDEFGH", "A")]
    got = nearest_partner(spark.createDataFrame(rows, "protein_id long, sequence string, pam string")).collect()
    assert {r.protein_id: (r.partner_id, r.similarity) for r in got} == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (5, 0.5), 5: (4, 0.5)}


def test_the_blocks_of_a_top_search_list_no_pair_that_is_not_among_the_best(spark, monkeypatch):
    """Of 300 sequences that share a k-mer with all others, each block passes on its best ones; the result is that of all pairs."""
    words = ["ACDE" + "".join("FGHIKLMNPQ"[(i // 10 ** j) % 10] for j in range(5)) for i in range(300)] + ["ACD", "AC", "ACD"]
    sets = {w: {w[i:i + 4] for i in range(max(1, len(w) - 3))} for w in words}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    monkeypatch.setattr(similarity, "BLOCK_LETTERS", 700)
    rows = spark.createDataFrame([(w, 1) for w in sets], "sequence string, copies long")
    got = {}
    for r in similarity.top_pairs(rows, rows, top=3, others_only=True).collect():
        got.setdefault(r.query, {})[r.reference] = round(r.similarity, 12)
    for word in sets:
        scores = {o: round(near(word, o), 12) for o in sets if o != word and near(word, o) > 0}
        least = sorted(scores.values(), reverse=True)[:3][-1:] or [0]
        assert got.get(word, {}) == {o: s for o, s in scores.items() if s >= least[0]}


@pytest.mark.parametrize("copied", [800_000, 0])
def test_small_groups_of_spacers_need_few_keys(spark, monkeypatch, copied):
    """20 strands of one system are told apart by 4 bases: 3 keys each at two mismatches, where 9 bases took 55."""
    strands = spark.range(40).select((F.col("id") % 2).alias("system_id"), F.col("id").cast("string").alias("query"))
    assert len(matching.block_masks(12, 2, matching.enough_key_bases(strands, ["system_id"], matching.KEY_BASES))) == 3
    monkeypatch.setattr(matching, "MAX_COPIED_KEYS", copied)
    target = "ACGTTGCAAGGCTTACCGATTTGACCATGG"
    places = {}
    for system, at in ((1, 3), (2, 9)):
        s = target[at:at + 12]
        places[system, at] = s[:2] + ("A" if s[2] != "A" else "C") + s[3:9] + ("G" if s[9] != "G" else "T") + s[10:]
    spacers = spark.createDataFrame([(k[0], i, s) for i, (k, s) in enumerate(places.items())], "system_id int, spacer_id int, spacer_sequence string")
    targets = spark.createDataFrame([(1, 1, target), (2, 2, target)], "system_id int, target_id int, target_sequence string")
    hits = spacer_hits(spacers, targets, mismatches=2, flank_length=3, keys=["system_id"]).where("mismatches = 2 and strand = '+'").collect()
    assert {(h.system_id, h.start) for h in hits} == set(places)
