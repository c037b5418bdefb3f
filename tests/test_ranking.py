from itertools import product
from math import isclose
from random import Random

import pytest
from pyspark.sql import functions as F

from flankwise.operators import candidates as ca, evidence as ev, fusion as fu, matching as ma, metrics as me


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute_hits(spacers, targets, k, flank):
    first = {}
    for name, seq in spacers:
        first.setdefault(seq, name)
    out = set()
    for seq, name in first.items():
        for strand, query in (("+", seq), ("-", revcomp(seq))):
            for target, text in targets:
                for at in range(len(text) - len(seq) + 1):
                    window = text[at:at + len(seq)]
                    mm = sum(a != b or b not in "ACGT" for a, b in zip(query, window))
                    if mm <= k:
                        left, right = text[max(0, at - flank):at], text[at + len(seq):at + len(seq) + flank]
                        up, down = (left, right) if strand == "+" else (revcomp(right), revcomp(left))
                        out.add((name, target, at, strand, mm, up, down))
    return out


@pytest.mark.parametrize("length,k,copied", [(6, 0, True), (6, 1, True), (7, 2, True), (9, 1, False), (24, 3, True), (30, 2, False)])
def test_hits_equal_brute_force(spark, monkeypatch, length, k, copied):
    if not copied:
        monkeypatch.setattr(ma, "MAX_COPIED_QUERIES", 0)
    rng = Random(length * 10 + k)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = [(f"t{i}", dna(60)) for i in range(8)] + [("poly", "A" * 60), ("n", dna(20) + "N" + dna(30))]
    spacers = [(f"s{i}", targets[i][1][5:5 + length]) for i in range(6)] + [("a", "A" * length), ("b", "A" * length)]
    spacers += [(f"m{i}", dna(2) + targets[i][1][7:5 + length]) for i in range(3)]
    hits = ma.spacer_hits(
        spark.createDataFrame(spacers, "spacer_id string, spacer_sequence string"),
        spark.createDataFrame(targets, "target_id string, target_sequence string"),
        mismatches=k, flank_length=4, lengths=[length],
    )
    got = [(r.spacer_id, r.target_id, r.start, r.strand, r.mismatches, r.upstream_flank, r.downstream_flank) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_hits(spacers, targets, k, 4)


def test_reverse_hit_and_palindrome(spark):
    hits = lambda s, t: ma.spacer_hits(
        spark.createDataFrame([("s", s)], "spacer_id string, spacer_sequence string"),
        spark.createDataFrame([("t", t)], "target_id string, target_sequence string"), mismatches=0, flank_length=3, lengths=[len(s)]).collect()
    (hit,) = hits("AACCG", "TTCCT" + revcomp("AACCG") + "TTT")
    assert hit.strand == "-" and hit.downstream_flank == "AGG" and hit.protospacer == "AACCG"
    both = hits("ACGT", "TTTACGTTTT")
    assert sorted(h.strand for h in both) == ["+", "-"] and all(h.orientation_weight == 0.5 for h in both)


def flank_rows(spark, rows):
    return spark.createDataFrame(rows, "spacer_sequence string, target_id string, orientation_weight double, motif_length int, motif string")


def test_candidate_evidence(spark):
    flanks = flank_rows(spark, [("A", "t1", 1.0, 3, "AGG"), ("C", "t2", 1.0, 3, "AGG"), ("C", "t3", 1.0, 3, "CGG")])
    names = spark.createDataFrame([("NGG",), ("NAA",), ("NNN",)], "candidate_pam string")
    background = spark.createDataFrame([(0.25, 0.25, 0.25, 0.25)], "a double, c double, g double, t double")
    rows = {r.candidate_pam: r for r in ev.score_spacer_candidates(flanks, names, background).collect()}
    assert rows["NGG"].support_spacer_count == 2 and rows["NGG"].spacer_rank == 1 and isclose(rows["NGG"].support, 2.0)
    assert rows["NAA"].spacer_rank == 2 and rows["NNN"].spacer_evidence_score is None and rows["NNN"].spacer_rank is None
    p = (2 + 2 / 16) / 4
    assert isclose(rows["NGG"].spacer_evidence_score, 50 * ((p - 1 / 16) / (15 / 16) + 1))
    few = ev.score_spacer_candidates(flanks, names, background, minimum_spacers=5).collect()
    assert all(r.spacer_evidence_score is None for r in few)


def test_contig_ratio_divides_by_contigs(spark):
    rows = spark.createDataFrame([(f"s{i}", f"t{i}", p) for i, p in enumerate(["AGG", "AGG", "AGG", "CGG", "TTT"])], "spacer_id string, target_id string, pam string")
    r = ev.contig_collapse(rows).first()
    assert (r.target_contigs, r.consensus_types, r.contigs_in_set) == (5, 3, 4) and isclose(r.contig_fraction, 0.8)


def test_published_rows(spark):
    rows = spark.createDataFrame(
        [("s1", "ACGT", "1", "AAACCC", "GGGTTT", "Forward", ""), ("s2", "ACGG", "1", "AAACCC", "GGGTTT", "forward|reverse", "Reverse"), ("s3", "AC", "0", "", "", "", "")],
        "spacer_id string, source_spacer string, hit string, raw_left_flank string, raw_right_flank string, orientation_PAMbased string, orientation_CRISPRCasdb string")
    got = {r.spacer_id: r for r in ev.orient_published_rows(rows).collect()}
    assert (got["s1"].oriented_upstream_flank, got["s1"].oriented_downstream_flank) == ("AAA", "TTT")
    assert got["s2"].orientation == "reverse" and got["s2"].oriented_spacer == "CCGT" and got["s2"].oriented_upstream_flank == "AAA"
    assert got["s3"].orientation_error == "no_unambiguous_orientation"


def channels(spark, protein, spacer, n=5):
    p = spark.createDataFrame([("x", c, s) for c, s in protein], "system_id string, candidate_pam string, specificity_adjusted_score double")
    s = spark.createDataFrame([("x", c, v, n, n) for c, v in spacer], "system_id string, candidate_pam string, spacer_evidence_score double, support_spacer_count int, support_target_count int")
    return p, s


def test_fusion_gates(spark):
    far = channels(spark, [("AAA", 90.0), ("TTT", 20.0)], [("AAA", 10.0), ("TTT", 95.0)])
    gate = lambda pair, policy: fu.fuse(*pair, policy=policy)
    assert {r.fusion_gate for r in gate(far, "abstain").collect()} == {"abstain_severe_top_disagreement"}
    assert {r.fusion_gate for r in gate(far, "legacy").collect()} == {"legacy_joint_ranking"}
    back = gate(far, "spacer_fallback").withColumn("k", fu.fusion_rank_score(F.col("specificity_adjusted_score"), F.col("spacer_evidence_score"), F.col("fusion_gate")))
    assert {r.candidate_pam: r.k for r in back.collect()} == {"AAA": 10.0, "TTT": 95.0}
    near = channels(spark, [("AGG", 90.0), ("TTT", 20.0)], [("CGG", 95.0), ("AGG", 80.0)])
    rows = {r.candidate_pam: r for r in gate(near, "abstain").collect()}
    assert rows["AGG"].fusion_gate == "joint_ranking_top_agreement" or rows["AGG"].fusion_top_distance_within_tolerance is None
    assert rows["AGG"].evidence_status == "concordant_support" and rows["TTT"].evidence_status == "protein_only_unverified"
    none = channels(spark, [("AAA", 90.0)], [("CCC", 1.0)])
    assert gate(none, "abstain").first().fusion_gate == "abstain_missing_scored_source"


@pytest.mark.parametrize("protein, spacer, distance", [
    (["NNGRRT"], ["NNGRRT"], 0), (["NNGRRT"], ["NNGRAT"], 1), (["NNGRRT"], ["NNGRYT"], None), (["NNGRAT"], ["NNGRRT"], None),
    (["NNGRAT", "CCCCCC"], ["NNGRRT"], 1), (["ACGTACGTACG"], ["ACGTTCGTACC"], 2), (["ACGTACGTACG"], ["TCGTTCGTACC"], None),
])
def test_gate_of_degenerate_and_long_tops(spark, protein, spacer, distance):
    # Differing letters of the larger set must be plain bases.
    rows = [("x", m, 90.0, None) for m in protein] + [("x", m, None, 90.0) for m in spacer]
    fused = spark.createDataFrame(rows, "system_id string, candidate_pam string, specificity_adjusted_score double, spacer_evidence_score double")
    got = fu.fusion_gate(fused.withColumn("pam_length", F.length("candidate_pam"))).first()
    assert got.fusion_top_distance_within_tolerance == distance


def test_fusion_refuses_duplicates_and_policies(spark):
    p, s = channels(spark, [("AAA", 90.0)], [("AAA", 1.0), ("aaa ", 2.0)])
    with pytest.raises(Exception, match="duplicate spacer evidence"):
        fu.fuse(p, s)
    with pytest.raises(ValueError):
        fu.fuse(p, s, policy="other")


def test_all_tied_is_pessimistic(spark):
    rows = [("x", "".join(m), 1.0) for m in product("ACGT", repeat=3)]
    scored = spark.createDataFrame(rows, "system_id string, candidate_pam string, score double")
    golds = spark.createDataFrame([("x", "NGG"), ("x", "TTTN")], "system_id string, gold_pam string")
    got = {r.pam_length: r for r in me.gold_rank_by_length(scored, golds, score="score").collect()}
    assert got[3].optimistic_rank == 1 and got[3].gold_rank == 61 and not got[3].recall_at_5
    assert got[4].gold_rank is None and got[4].reciprocal_rank == 0.0 and got[4].scored_candidates == 0
    m = me.system_metrics(me.gold_rank_by_length(scored, golds, score="score")).first()
    assert isclose(m.coverage, 0.5) and isclose(m.mrr, 1 / 61 / 2)


def test_not_applicable_leaves_the_denominator(spark):
    schema = "system_id string, method string, coverage double, mrr double, recall_at_1 double, recall_at_3 double, recall_at_5 double, not_applicable boolean"
    rows = spark.createDataFrame([
        ("a", "fusion", 1.0, 1.0, 1.0, 1.0, 1.0, False), ("b", "fusion", 0.0, 0.0, 0.0, 0.0, 0.0, False), ("c", "fusion", 0.0, None, None, None, None, True),
        ("a", "protein_only", 1.0, 0.5, 0.0, 1.0, 1.0, False), ("b", "protein_only", 1.0, 0.25, 0.0, 0.0, 1.0, False), ("c", "spacer_only", 0.0, None, None, None, None, True),
    ], schema)
    got = {r.method: r for r in me.aggregate_benchmark(rows).collect()}
    assert set(got) == {"fusion", "protein_only"}
    f = got["fusion"]
    assert (f.systems_total, f.systems_not_applicable, f.systems_scored) == (2, 1, 1) and f.mrr_all_systems == 0.5 and f.mrr_eligible_systems == 1.0
    (delta,) = me.paired_deltas(rows).collect()
    assert delta.comparison == "fusion_minus_protein_only" and delta.mrr_delta == 0.5


@pytest.mark.parametrize("whole", [2_000_000, 0])
def test_rank_statistics(spark, monkeypatch, whole):
    monkeypatch.setattr(me, "MAX_WINDOW_VALUES", whole)
    rows = spark.createDataFrame([("g", i, float(v), float(w)) for i, (v, w) in enumerate([(1, 1), (2, 3), (2, 2), (4, 4)])] + [("c", 9, 1.0, 1.0), ("c", 10, 1.0, 2.0)],
                                 "k string, i int, x double, y double")
    ranks = {r.i: r.mid_rank for r in me.average_rank(rows, value="x", keys=["k"]).collect()}
    assert [ranks[i] for i in range(4)] == [1.0, 2.5, 2.5, 4.0]
    rho = {r.k: r.spearman for r in me.spearman(rows, left="x", right="y", keys=["k"]).collect()}
    assert rho["c"] is None and isclose(rho["g"], 0.9486832980505138)
    tied = spark.createDataFrame([("g", i, 1.0) for i in range(64)], "k string, i int, x double")
    assert isclose(me.top_membership(tied, value="x", keys=["k"], k=5).first().membership, 5 / 64)


def test_candidates(spark):
    systems = spark.createDataFrame([("x", [3, 2])], "system_id string, pam_lengths array<int>")
    got = [r.candidate_pam for r in ca.concrete_candidates(systems).collect()]
    assert sorted(got) == sorted("".join(m) for n in (2, 3) for m in product("ACGT", repeat=n))
    assert len(spark.range(1).select(F.explode(ca.triplet_groups())).collect()) == 64
    with pytest.raises(Exception, match="larger than"):
        ca.concrete_candidates(spark.createDataFrame([("x", [9])], "system_id string, pam_lengths array<int>")).collect()


def plain_resamples(values, seed, iterations, block, dealt, held):
    """Sums of each resample of values in place order, every draw by itself."""
    from hashlib import md5

    def number(prefix, n):
        return int(md5(f"{prefix}{n // 2}".encode()).hexdigest()[16 * (n % 2):16 * (n % 2) + 15], 16)

    n, sums = len(values), []
    for i in range(iterations):
        counts = [0] * -(-n // block)
        for j in range(n):
            counts[number(f"{seed}-{i}-{j // dealt}-", j % dealt) % n // block if len(counts) > 1 else 0] += 1
        sums.append(sum(
            values[b * block + number(f"{seed}-{i}-{b}-{r // held}-", r % held) % min(block, n - b * block)]
            for b, count in enumerate(counts) for r in range(count)))
    return sums


@pytest.mark.parametrize("n,block,dealt,held,resamples", [(5, 1 << 16, 1 << 18, 1 << 20, 250), (47, 10, 16, 6, 30), (40, 8, 4, 100, 7)])
def test_bootstrap_matches_plain_python(spark, monkeypatch, n, block, dealt, held, resamples):
    from hashlib import md5

    for name, value in (("BLOCK", block), ("DEALT", dealt), ("HELD", held), ("RESAMPLES", resamples)):
        monkeypatch.setattr(me, name, value)
    rng = Random(n)
    values = [rng.random() for _ in range(n)]
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("other", i, 1.0) for i in range(3)] + [("k", 99, None)], "key string, id long, v double")
    got = {r.key: r for r in me.bootstrap_mean_interval(rows, value="v", identity=["id"], keys=["key"], iterations=100, seed=3).collect()}
    order = sorted(range(n), key=lambda i: (md5(str(i).encode()).hexdigest()[:3], i))
    means = sorted(s / n for s in plain_resamples([values[i] for i in order], 3, 100, block, dealt, held))
    assert isclose(got["k"].ci_low, means[1]) and isclose(got["k"].ci_high, means[97])
    assert (got["other"].ci_low, got["other"].ci_high) == (1.0, 1.0)


def test_bootstrap_counts_are_a_multinomial(spark, monkeypatch):
    monkeypatch.setattr(me, "BLOCK", 50)
    monkeypatch.setattr(me, "DEALT", 64)
    placed = spark.range(500).select(F.col("id").alias("place"), F.lit(1.0).alias("v"))
    dealt = me.dealt_draws(placed, [], 300, 9).collect()
    counts = {}
    for r in dealt:
        for i, c in enumerate(r["counts"]):
            counts[r.run * me.RESAMPLES + i, r.block] = counts.get((r.run * me.RESAMPLES + i, r.block), 0) + c
    by_iteration = [[counts[i, b] for b in range(10)] for i in range(300)]
    assert all(sum(row) == 500 for row in by_iteration)
    ones = [row[0] for row in by_iteration]
    mean = sum(ones) / 300
    assert abs(mean - 50) < 2 and 30 < sum((x - mean) ** 2 for x in ones) / 299 < 62
    assert {r.v for r in me.resample_sums(placed, ["v"], [], 300, 9).collect()} == {500.0}


@pytest.mark.parametrize("levels", [(0.0,), (0.5, 0.2, 0.0), (0.9, 0.0)])
def test_top_neighbours_need_no_minimum(spark, levels):
    from flankwise.operators import similarity as si

    rng = Random(4)
    base = ["".join(rng.choice("ACDEFGHIK") for _ in range(30)) for _ in range(12)]
    words = base + [w[:15] + "".join(rng.choice("ACDEFGHIK") for _ in range(15)) for w in base] + [base[0][:20] + "WWWWWWWWWW", "LLLLLLLL", "MM"]
    words += [base[1], base[1]]
    grams = lambda t: {t[i:i + 4] for i in range(len(t) - 3)} if len(t) >= 4 else {t}
    sim = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    table = lambda rows: spark.createDataFrame([(w, rows.count(w)) for w in sorted(set(rows))], "sequence string, copies long")
    queries = words[5:20] + words[-5:-2] + ["WWWWKKKKLL", "QQQQQ"]
    got = {r.query: r.mean_similarity for r in si.mean_top_similarity(table(queries), table(words), top=5, levels=levels).collect()}
    for query in set(queries):
        best = sorted((sim(query, w) for w in words if grams(query) & grams(w)), reverse=True)[:5]
        assert isclose(got[query], sum(best) / len(best) if best else 0.0, abs_tol=1e-12), query
    proteins = spark.createDataFrame([(i, w, w[0]) for i, w in enumerate(words)], "protein_id long, sequence string, pam string")
    partner = {r.protein_id: (r.partner_id, r.similarity) for r in si.nearest_partner(proteins, levels=levels).collect()}
    for i, w in enumerate(words):
        others = [(-sim(w, o), j) for j, o in enumerate(words) if j != i and grams(w) & grams(o)]
        if others:
            score, j = min(others)
            assert isclose(partner[i][1], -score) and partner[i][0] == j, i
        else:
            assert i not in partner


@pytest.mark.parametrize("k,copied,tile", [(0, True, 40), (1, False, 40), (2, True, 64)])
def test_hits_on_tile_borders_equal_brute_force(spark, monkeypatch, k, copied, tile):
    monkeypatch.setattr(ma, "TILE", tile)
    if not copied:
        monkeypatch.setattr(ma, "MAX_COPIED_QUERIES", 0)
    rng = Random(tile + k)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = [(f"t{i}", dna(rng.randint(1, 400))) for i in range(6)] + [("poly", "A" * 130), ("n", dna(70) + "N" + dna(70)), ("edge", dna(tile)), ("two", dna(2 * tile))]
    texts = dict(targets)
    spacers = []
    for n in (7, 9, 12, 19, 25, 33):
        for name in ("t1", "n", "two"):
            for at in range(0, max(1, len(texts[name]) - n), 17):
                core = list(texts[name][at:at + n].replace("N", "A"))
                if k:
                    core[rng.randrange(n)] = rng.choice("ACGT")
                spacers.append((f"s{len(spacers):03}", "".join(core) if at % 2 else revcomp("".join(core))))
    spacers = [s for s in spacers if len(s[1]) > k] + [("poly", "A" * 30)]
    hits = ma.spacer_hits(
        spark.createDataFrame(spacers, "spacer_id string, spacer_sequence string"), spark.createDataFrame(targets, "target_id string, target_sequence string"),
        mismatches=k, flank_length=5).collect()
    got = [(r.spacer_id, r.target_id, r.start, r.strand, r.mismatches, r.upstream_flank, r.downstream_flank) for r in hits]
    assert len(got) == len(set(got)) and set(got) == brute_hits(spacers, targets, k, 5)


def test_hit_search_refuses_bad_input(spark):
    spacers = lambda *s: spark.createDataFrame(list(enumerate(s)), "spacer_id int, spacer_sequence string")
    targets = lambda *t: spark.createDataFrame(list(t), "target_id string, target_sequence string")
    search = lambda s, t, **given: ma.spacer_hits(s, t, **{"mismatches": 0, "flank_length": 3, **given}).collect()
    good = targets(("a", "ACGTNACGT"))
    assert len(search(spacers("acgu", "ACGT "), good)) == 4
    for bad in ("ACRT", "", "AC-T"):
        with pytest.raises(Exception, match="must contain only A/C/G/T"):
            search(spacers(bad, "ACGT"), good)
    for bad in ("ACGTR", "", None):
        with pytest.raises(Exception, match="must contain only A/C/G/T/N"):
            search(spacers("ACGT"), targets(("a", bad), ("b", "ACGT")))
    with pytest.raises(ValueError, match="repeated target id: a"):
        search(spacers("ACGT"), targets(("a", "ACGT"), ("b", "ACG"), ("a", "TTT")))
    with pytest.raises(ValueError, match="flank_length"):
        search(spacers("ACGT"), good, flank_length=0)
    with pytest.raises(ValueError, match="4 mismatches"):
        search(spacers("ACGT"), good, mismatches=4)
