from math import isclose, log2

from pyspark.sql import functions as F

from flankwise.functions import dna, iupac, matrix as mx, protein, text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.from_json(F.lit(str(v)), "array<array<double>>").alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first()["x"]


UNIFORM = [[0.25] * 4 for _ in range(10)]


def peaked(places, mass=0.94):
    rest = (1 - mass) / 3
    m = [[0.25] * 4 for _ in range(10)]
    for position, base in places.items():
        m[position] = [mass if b == base else rest for b in "ACGT"]
    return m


def test_subset_is_asymmetric(spark):
    assert one(spark, iupac.is_subset("a", "b"), a="AGG", b="NGG")
    assert not one(spark, iupac.is_subset("a", "b"), a="NGG", b="AGG")
    assert not one(spark, iupac.is_subset("a", "b"), a="NGGN", b="NGG")
    assert not one(spark, iupac.is_subset("a", "b"), a="", b="")
    assert not one(spark, iupac.is_subset("a", "b"), a="AXG", b="NNN")


def test_motif_numbers(spark):
    assert one(spark, iupac.expansion_size("a"), a="NGG") == 4
    assert isclose(one(spark, iupac.information("a"), a="NGR"), (0 + 2 + 1) / 3)
    assert one(spark, iupac.motifs_overlap("a", "b"), a="RGG", b="NGK")
    assert not one(spark, iupac.motifs_overlap("a", "b"), a="RGG", b="YGG")
    assert sorted(one(spark, iupac.restricted_keys("a"), a="NRG")) == [".AG", ".GG"]
    assert not one(spark, iupac.concrete_matches("a", "b"), a="NGG", b="NGG")


def test_reverse_complement_and_translation(spark):
    assert one(spark, dna.reverse_complement("a"), a="AACCGR") == "YCGGTT"
    assert one(spark, dna.normalize_dna("a"), a=" acg u\n") == "ACGT"
    assert one(spark, dna.translate_dna("a"), a="ATGGCNTAATG") == "MX*"


def test_flank_motif(spark):
    for side, n, want in (("downstream", 3, "AGG"), ("upstream", 3, "TTC"), ("downstream", 9, None)):
        assert one(spark, dna.flank_motif("u", "d", side, n), u="TTTTC", d="AGGTT") == want
    assert one(spark, dna.flank_motif("u", "d", "downstream", 2), u="A", d="NGG") is None


def test_verify_protein(spark):
    def check(protein_, contig, start, end, strand):
        v = one(spark, dna.verify_protein("p", "c", "s", "e", "t"), p=protein_, c=contig, s=start, e=end, t=strand)
        return v["verified"], v["notes"]

    gene = "ATGGCTGCATAA"
    assert check("MAA", "CC" + gene + "GG", 3, 14, "1") == (True, ["translation_matches_exactly"])
    back = one(spark, dna.reverse_complement("a"), a=gene)
    assert check("MAA", "CC" + back + "GG", 3, 14, "-")[0]
    assert check("MAA", "CCGTGGCTGCATAAGG", 3, 14, "+") == (True, ["translation_matches_with_alternative_start_codon"])
    assert check("MAA", "CC" + gene + "GG", 3, 13, "1")[1][:1] == ["gene_length_not_multiple_of_three"]
    assert check("MAA", "CC" + gene + "GG", 3, 99, "1") == (False, ["gene_coordinates_out_of_range"])
    assert check("MAA", "CC" + gene + "GG", 3, 14, "?") == (False, ["unknown_strand"])
    assert check("", "CC" + gene, 3, 14, "1") == (False, ["protein_sequence_missing"])
    assert "internal_stop_codon" in check("M*A", "CC" + gene + "GG", 3, 14, "1")[1]


def test_candidate_scores(spark):
    def score(m, motif, side="downstream"):
        return one(spark, mx.score_candidate(mx.normalize_rows("m"), "a", side), m=m, a=motif)

    flat = score(UNIFORM, "NGG")
    assert isclose(flat["score"], 50.0) and isclose(flat["bits"], 0.0, abs_tol=1e-12)
    sharp = peaked({1: "G", 2: "G"})
    assert score(sharp, "NGG")["score"] > 90 and score(sharp, "NAA")["score"] < 10
    assert score(sharp, "NNN")["score"] is None and score(sharp, "NNN")["informative_positions"] == 0
    up = peaked({7: "T", 8: "T"})
    assert score(up, "TTN", "upstream")["score"] > 90 and isclose(score(up, "TTN")["score"], 50.0)
    assert score(sharp, "N" * 11) is None or score(sharp, "N" * 11)["score"] is None
    for position in (0, 4, 9):
        for base, other in zip("ACGT", "CGTA"):
            m = peaked({position: base}, 0.97)
            motif = lambda b: "N" * position + b
            assert score(m, motif(base))["score"] > 95 and score(m, motif(other))["score"] < 5


def test_matrix_calls(spark):
    m = peaked({1: "G", 2: "G"}, 0.97)
    info = mx.probability_to_information("m")
    assert one(spark, mx.consensus_from_information(info, "downstream"), m=m) == "NGG"
    assert one(spark, mx.consensus_from_information(info, "upstream"), m=m) == "GGNNNNNNN"
    assert one(spark, mx.probability_consensus("m"), m=m) == "NGGNNNNNNN"
    assert one(spark, mx.probability_consensus("m"), m=[[0.5, 0.0, 0.5, 0.0]]) == "R"
    assert one(spark, mx.normalize_rows("m"), m=[[0.0] * 4] * 10) is None
    level = one(spark, mx.reliability("m", "s"), m=m, s=1.0)
    assert level["level"] == "high" and level["consensus"] == "NGGNNNNNNN"
    assert one(spark, mx.reliability("m", "s"), m=m, s=0.2)["level"] == "low"
    assert one(spark, mx.reliability("m", "s"), m=UNIFORM, s=1.0)["level"] == "low"
    signed = one(spark, mx.signed_information("m"), m=[[0.1, 0.9, 0.0, 0.0]])
    assert isclose(signed[0][0], 0.1 * (log2(0.1) + 2)) and signed[0][2] == 0


def test_logo_codec(spark):
    assert one(spark, mx.valid_logo("a"), a=str(UNIFORM))
    assert not one(spark, mx.valid_logo("a"), a="[[1,2,3,4]]")
    assert not one(spark, mx.valid_logo("a"), a="no json")
    assert one(spark, mx.training_logo("a", "b"), a="", b="AN")[0] == [1.0, 0.0, 0.0, 0.0]
    zero = [[0.0] * 4] + [[2.0, 0, 0, 0]] * 9
    assert one(spark, mx.training_logo("a", "b"), a=str(zero), b="")[0] == [0.25] * 4
    assert one(spark, mx.position_weights("a"), a="") == [1.0] * 10


def test_protein_functions(spark):
    assert isclose(one(spark, protein.jaccard(protein.kmer_set("a", 3), protein.kmer_set("b", 3)), a="ABCDE", b="ABCDE"), 1.0)
    assert one(spark, protein.jaccard(protein.kmer_set("a", 3), protein.kmer_set("b", 3)), a="AAAA", b="CCCC") == 0.0
    assert one(spark, protein.kmer_set("a", 4), a="AB") == ["AB"]
    assert isclose(one(spark, protein.edit_identity("a", "b", 0.9), a="A" * 19 + "C", b="A" * 20), 0.95)
    assert one(spark, protein.edit_identity("a", "b", 0.9), a="AAAA", b="CCCC") is None


def test_text_functions(spark):
    assert one(spark, tx.phrase_motifs("a"), a="The PAM is NGG here, and a TTTN PAM elsewhere") [:1] == ["NGG"]
    assert "TTTN" in one(spark, tx.phrase_motifs("a"), a="a TTTN PAM")
    assert one(spark, tx.framed_motifs("a"), a="5'-NGG-3' then 5 ’ - NRRWC - 3 ’ then 5'-ATG-3' and 5'-NGG-3'") == ["NGG", "NRRWC"]
    status = lambda title, abstract: one(spark, tx.classify_paper("t", "a"), t=title, a=abstract)["status"]
    assert status("A review", "pam screen") == "review_or_secondary"
    assert status("x", "pam screen") == "candidate_experimental"
    assert status("x", "pam screen in silico") == "uncertain"
    assert status("x", "in silico") == "computational_only" and status("x", "y") == "uncertain"
    assert one(spark, tx.normalize_doi("a"), a="https://doi.org/10.1/AB..") == "10.1/ab"
    assert one(spark, tx.literal_list("a"), a="['a', 'b']") == ["a", "b"] and one(spark, tx.literal_list("a"), a="[]") == []
    assert one(spark, tx.optional_double("a"), a=" ") is None and one(spark, tx.optional_score("a"), a="inf") is None
    assert one(spark, tx.safe_identifier("a"), a="x.1") and not one(spark, tx.safe_identifier("a"), a="..")
    assert not one(spark, tx.safe_relative_path("a"), a="a/../b") and one(spark, tx.safe_relative_path("a"), a="a/b..c")
    links = one(spark, tx.supplement_links("a", "b"), b="https://h.org/x/y",
                a='<supplementary-material xlink:href="s1"><media xlink:href="/f.xlsx"/></supplementary-material>')
    assert [tuple(l) for l in links] == [("https://h.org/f.xlsx", "s1")]
