"""Steps whose work grew faster than their input, or stood in too few tasks."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from flankwise.operators import clusters, packaging
from flankwise.operators.similarity import identity_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_pairs_of_shifted_and_edited_texts_are_all_verified_in_the_join(spark, capsys):
    """Edits of every kind at either end; pairs meet by text and place, and distances fill a band."""
    pick = random.Random(5)
    bases = ["".join(pick.choice("ACDEFG") for _ in range(pick.choice((9, 20, 40)))) for _ in range(8)]
    texts = set(bases)
    for base in bases:
        for n in range(1, 8):
            text = list(base)
            for _ in range(n):
                at = pick.choice((0, len(text) - 1, pick.randrange(len(text))))
                text[at:at + 1] = pick.choice(([], [text[at], "W"], ["W", text[at]], ["H"]))
            texts.add("".join(text))
    texts = sorted(texts)
    queries, references = texts[::2], texts
    rows = lambda values: spark.createDataFrame([(v,) for v in values], "sequence string")
    for identity in (0.8, 0.9):
        expected = {(q, r) for q in queries for r in references if distance(q, r) <= int((1 - identity) * max(len(q), len(r)) + 1e-9)}
        pairs = identity_pairs(rows(queries), rows(references), identity)
        got = [(p.query, p.reference) for p in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    capsys.readouterr()
    pairs.explain()
    join = next(line for line in capsys.readouterr().out.splitlines() if "Join" in line)
    assert "bucket" in join and "levenshtein" in join and ", None)" not in join


def test_draws_of_few_values_are_spread_over_many_tasks(spark):
    """The rows that describe draws are small, so that adaptive execution put them all into one task."""
    import numpy as np
    from hashlib import md5
    from pyspark.sql import functions as F
    from flankwise.operators import metrics as me

    for prefix in ("17-3-0-", "20260927-1234-11-0-", "x" * 52, ""):
        for count in (0, 1, 19, 20, 21, 2001, 20011):
            words = b"".join(md5(f"{prefix}{n}".encode()).digest() for n in range((count + 1) // 2))
            assert (me.hashed_numbers(prefix, count) == (np.frombuffer(words, ">u8")[:count] >> np.uint64(4)).astype(np.int64)).all()

    placed = spark.range(40).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("place"), F.col("id").cast("double").alias("v"))
    sums = me.resample_sums(placed, ["v"], ["k"], 2000, 7)
    assert sums.count() == 4000
    exchange = [p for p in sums._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in p]
    assert len(exchange) == 3


def test_a_scan_of_tiles_finds_what_the_join_finds_without_a_row_per_place(spark, monkeypatch):
    """Queries of several lengths, unknown bases, borders of tiles, both strands; searches without keys list no windows."""
    from flankwise.operators import matching

    pick = random.Random(3)
    letters = lambda n, of="ACGT": "".join(pick.choice(of) for _ in range(n))
    texts = [letters(pick.choice((7, 40, 700, 1100)), "ACGTACGTACGTN") for _ in range(6)]
    spacers, n = [], 0
    for text in texts:
        for length in (9, 13, 18, 25, 33):
            for at in (0, 505, len(text) - length):
                piece = text[max(at, 0):max(at, 0) + length].replace("N", "A")
                if len(piece) == length:
                    spot = pick.randrange(length)
                    spacers.append((n, piece[:spot] + pick.choice("ACGT") + piece[spot + 1:]))
                    n += 1
    s = spark.createDataFrame(spacers, "spacer_id int, spacer_sequence string")
    t = spark.createDataFrame(list(enumerate(texts)), "target_id int, target_sequence string")
    for mismatches in (0, 1, 2):
        search = lambda: sorted(map(str, matching.spacer_hits(s, t, mismatches=mismatches, flank_length=4).collect()))
        with monkeypatch.context() as patch:
            patch.setattr(matching, "windows", None)
            scanned = search()
        with monkeypatch.context() as patch:
            patch.setattr(matching, "MAX_SCANNED_QUERIES", -1)
            joined = search()
        assert scanned == joined and scanned


def test_rows_that_lie_by_variant_do_not_move_again_to_be_ranked(spark, monkeypatch, capsys):
    """Windows of small keys give what ranks of stored combinations give, for missing and undefined values too, without a shuffle."""
    from pyspark.sql import functions as F
    from flankwise.operators import metrics as me

    pick = random.Random(9)
    values = [None, float("nan"), 1.0, 2.0, 2.5, 3.0]
    rows = spark.createDataFrame([(pick.choice("abcde"), i % 8, pick.choice(values), pick.choice(values)) for i in range(300)], "variant string, item long, prediction double, target double")
    columns = ["variant", "prediction", "target", "_n", "_total", *[f"_{kind}_{c}" for kind in ("rank", "below", "copies") for c in ("prediction", "target")]]
    ranked = lambda: sorted(map(str, me.ranked_columns(rows, ["prediction", "target"], ["variant"]).select(columns).collect()))
    small = ranked()
    with monkeypatch.context() as patch:
        patch.setattr(me, "MAX_KEY_ROWS", -1)
        assert small == ranked() and small

    control = spark.range(8).select(F.col("id").alias("item"), (F.col("id") % 3).cast("double").alias("control"))
    capsys.readouterr()
    me.variant_metrics(rows.repartition(4, "variant"), control, variant="variant", item="item").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_keys_of_long_motifs_take_their_places_anywhere_and_few_shapes_serve_all(spark):
    """Places of one base may lie far apart; a window of neighbours said too little and had a shape for nearly every motif."""
    from flankwise.operators import matching

    sets = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "N": "ACGT", "V": "ACG"}
    pick = random.Random(13)
    draw = lambda letters, n: "".join(pick.choice(letters) for _ in range(n))
    motifs = sorted({draw("ACGT", 3) + draw("RNVVVVVT", 14) + draw("ACGT", 4) for _ in range(300)} | {"R" * 21, "N" * 21})
    strings = sorted({"".join(pick.choice(sets[c]) for c in m) for m in motifs} | {draw("ACGT", 21) for _ in range(300)})
    rows = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    found = matching.motif_match_join(rows(strings, "s"), rows(motifs, "m"), "s", "m").collect()
    expected = {(s, m) for m in motifs for s in strings if all(x in sets[y] for x, y in zip(s, m))}
    assert len(found) == len(set(found)) and {(r.s, r.m) for r in found} == expected

    lengths = spark.createDataFrame([(21, len(strings))], "_len int, strings long")
    keyed = matching.keyed_motifs(rows(motifs, "_motif").withColumn("_len", F.lit(21)), lengths, F.broadcast).collect()
    ends = {1, 2, 3, 18, 19, 20, 21}
    assert len(keyed) == len(motifs) and len({tuple(r.places) for r in keyed}) <= 10
    assert all(ends >= set(r.places) and len(r.places) >= 4 and r.places[-1] - r.places[0] > 8 for r in keyed if "R" * 21 != r._motif != "N" * 21)


def test_records_are_read_once_and_cores_are_searched_by_their_bytes(spark, capsys):
    """A filter that moves below the parser repeats all of it; places equal a translation letter by letter."""
    from flankwise.functions.dna import translate_dna
    from flankwise.sources import genbank as gb

    text = F.concat(F.lit("LOCUS  r"), F.col("id").cast("string"), F.lit('  9 bp\nFEATURES  Location\n     CDS             1..9\n                     /translation="MKV"\nORIGIN\n  1 atgaaagtt\n'))
    features = gb.coding_features(gb.parsed_records(spark.range(3).select("id", text.alias("text"))))
    assert [(r.protein, r.verified) for r in features.collect()] == [("MKV", True)] * 3
    capsys.readouterr()
    features.explain()
    assert not [line for line in capsys.readouterr().out.splitlines() if "Filter" in line and "size(" in line]

    pick = random.Random(16)
    rows = [("".join(pick.choice("ACGTACGTACGTNnü") for _ in range(pick.choice((0, 2, 3, 60, 400)))), pick.choice(("K", "KK", "X", "XX", "L*", "ü", ""))) for _ in range(80)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, sequence string, protein string")
    readings = frame.select("k", "sequence", "protein", *[translate_dna(F.substring("sequence", f, F.lit(1000))).alias(f"f{f}") for f in (1, 2, 3)]).collect()
    expected = []
    for r in readings:
        for f in range(3):
            at = r[f"f{f + 1}"].find(r.protein) if r.protein else -1
            while at >= 0:
                expected.append((r.k, f, f + 3 * at + 1, f + 3 * (at + len(r.protein))))
                at = r[f"f{f + 1}"].find(r.protein, at + len(r.protein))
    found = gb.core_places(frame, frame.select("k", "sequence"), ["k"]).collect()
    assert expected and sorted(tuple(r) for r in found) == sorted(expected)


def test_gates_are_found_once_for_all_readers_of_a_fused_table(spark, capsys):
    from flankwise.operators import fusion

    scores = lambda name, first: spark.createDataFrame([(s, m, float((first + n) % 5 * 20)) for s in (1, 2) for n, m in enumerate(("AGG", "CGG", "AAT", "TTTT"))], f"system_id int, candidate_pam string, {name} double")
    fused = fusion.fuse(scores("specificity_adjusted_score", 0), scores("evidence_score", 3))
    assert fused.count() == 8
    capsys.readouterr()
    fused.explain()
    assert "Window" not in capsys.readouterr().out


def test_components_tie_groups_of_names_not_every_name_to_every_signature(spark, monkeypatch):
    """Dense codes: each name joins the smallest near it, and only these groups are contracted."""
    pick = random.Random(9)
    names = sorted({"".join(pick.choice("ACDE") for _ in range(6)) for _ in range(1500)})
    names += ["WWWWWW", "WWWWYY", "YYWWYY"]
    tied = []
    whole = clusters.contract
    monkeypatch.setattr(clusters, "contract", lambda edges: (tied.append(edges.count()), whole(edges))[1])
    got = {r.name: r.component for r in clusters.hamming_components(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    root = {n: n for n in names}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if sum(x != y for x, y in zip(a, b)) <= 2:
                one, other = sorted((top(a), top(b)))
                root[other] = one
    assert got == {n: top(n) for n in names} and len(set(got.values())) >= 2
    hide = lambda n, places: "".join("_" if i in places else c for i, c in enumerate(n))
    lowest = {}
    for n in sorted(names, reverse=True):
        lowest |= {hide(n, places): n for places in combinations(range(6), 2)}
    assert tied[0] < len({(n, lowest[hide(n, places)]) for n in names for places in combinations(range(6), 2)}) / 2


def test_packaged_variants_do_not_spread_their_values_over_rows(spark):
    """Whether a variant's target is constant is read from its own row."""
    groups = [f"N{i}" for i in range(64)]
    rows = [("KVAHEW", "six", "good", "no", *"KVAHEW", *[-6.0 - i for i in range(64)]), ("KVAHEY", "six", "good", "no", *"KVAHEY", *[-6.0] * 63, -4.5)]
    kinds = "name string, source_library string, status string, extra_mutations string, " + ", ".join(
        [*[f"r{i} string" for i in range(1, 7)], *[f"{g} double" for g in groups]])
    out = packaging.package_variants(
        spark.createDataFrame(rows, kinds), "MKVLATGHEDRW", spark.createDataFrame([], "name string"), positions=[2, 3, 5, 8, 9, 12],
        named_by=[f"r{i}" for i in range(1, 7)], groups=groups, library="six", wild_type="KVAHEW")["variants"]
    assert {r.variant_id: r.constant_target for r in out.collect()} == {"KVAHEW": True, "KVAHEY": False}
    assert "Expand " not in out._jdf.queryExecution().toString()


def test_a_search_within_groups_moves_tiles_and_no_windows(spark, monkeypatch, capsys):
    """Many strands in small groups of two keys meet their group's tiles in a task; null keys meet nothing, a large group is dealt to several tasks."""
    from flankwise.operators import matching

    pick = random.Random(21)
    letters = lambda n, of="ACGT": "".join(pick.choice(of) for _ in range(n))
    targets = [(g, n % 2 == 0, f"t{i}", letters(pick.choice((30, 700)), "ACGTACGTACGTN")) for i, (g, n) in enumerate((g, n) for g in (1, 2, None) for n in range(6))]
    targets += [(1, True, f"u{i}", letters(30)) for i in range(5)]
    spacers = []
    for i, (g, even, _, text) in enumerate(targets):
        for length in (9, 12, 26):
            piece = text[3:3 + length].replace("N", "A")
            spacers.append((g, even, i * 100 + length if i else None, piece[:4] + pick.choice("ACGT") + piece[5:]))
    s = spark.createDataFrame(spacers, "g int, even boolean, spacer_id long, spacer_sequence string")
    t = spark.createDataFrame(targets, "g int, even boolean, target_id string, target_sequence string")
    for mismatches in (0, 1, 2):
        search = lambda: matching.spacer_hits(s, t, mismatches=mismatches, flank_length=4, keys=["g", "even"])
        rows = lambda: sorted(map(str, search().collect()))
        scanned = rows()
        with monkeypatch.context() as patch:
            patch.setattr(matching, "TASK_TARGETS", 2)
            patch.setattr(matching, "READ_TILES", 3)
            assert rows() == scanned
        with monkeypatch.context() as patch:
            patch.setattr(matching, "MAX_GROUP_QUERIES", -1)
            patch.setattr(matching, "MAX_COPIED_QUERIES", -1)
            assert rows() == scanned and scanned
    capsys.readouterr()
    with monkeypatch.context() as patch:
        patch.setattr(matching, "MAX_COPIED_QUERIES", -1)
        search().explain()
    plan = capsys.readouterr().out
    assert "xxhash64(0" not in plan and "window" not in [w for line in plan.splitlines() if "Exchange" in line for w in line.split()] and plan.count("MapInArrow") == 1


def test_a_few_systems_become_many_rows_in_many_tasks(spark, tmp_path):
    from flankwise.plans import derive

    spark.range(400).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    systems = derive.system_ids(spark, str(tmp_path))
    assert systems.count() == 40 and systems.select(F.spark_partition_id()).distinct().count() > 1


def test_blocks_of_a_top_search_are_stored_once_and_keep_no_pair_below_the_floor(spark, monkeypatch):
    """Every pair of blocks read copies of both, and each passed on its best for every query, however far from the best of all."""
    from flankwise.operators import similarity

    pick = random.Random(31)
    draw = lambda letters, n: "".join(pick.choice(letters) for _ in range(n))
    words = {draw("ACDEFG", pick.choice((2, 3, 4, 9, 30))) for _ in range(60)} | {chr(0x1F600 + i) + "AÜC" * 3 for i in range(4)}
    for base in [draw("ACDEFGHIKLMN", 60) for _ in range(40)]:
        words |= {base, base[:10] + "W" + base[11:], base[:30] + base[31:], "".join("W" if i % 10 == 5 else c for i, c in enumerate(base))}
    words = sorted(words)
    sets = {w: {w[i:i + 4] for i in range(max(1, len(w) - 3))} for w in words}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    monkeypatch.setattr(similarity, "BLOCK_LETTERS", 900)
    stored, whole = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df: (stored.append((df._jdf.queryExecution().optimizedPlan().toString(), out := whole(df), out.count())), out)[1])
    rows = spark.createDataFrame([(w, 1) for w in words], "sequence string, copies long")
    for top, others in ((1, True), (3, False)):
        del stored[:]
        got = {}
        for r in similarity.block_top_pairs(rows, rows, top=top, others_only=others).collect():
            got.setdefault(r.query, {})[r.reference] = round(r.similarity, 12)
        kept = 0
        for word in words:
            scores = {o: round(near(word, o), 12) for o in words if near(word, o) > 0 and not (others and o == word)}
            least = sorted(scores.values(), reverse=True)[:top][-1:] or [0]
            best = {o: s for o, s in scores.items() if s >= least[0]}
            assert got.get(word, {}) == best
            kept += len(best)
        crossed = [n for plan, _, n in stored if "Join Cross" in plan or "Join Inner" in plan]
        assert len(crossed) == 1 and not [plan for plan, _, _ in stored if "explode" in plan]
        assert kept <= crossed[0] < 8 * kept


def test_numbers_of_kmers_too_many_for_an_integer_are_texts():
    from flankwise.functions.kmers import KmerIndex, QueryBlock
    import numpy as np

    pick = random.Random(4)
    words = sorted({"".join(pick.choice("ACDEF") for _ in range(pick.choice((5, 19, 30)))) for _ in range(60)} | {"A" * 30, "A" * 29 + "C"})
    for k in (3, 18, 30):
        sets = {w: {w[i:i + k] for i in range(max(1, len(w) - k + 1))} for w in words}
        index = KmerIndex.of(words[::2], k)
        index = KmerIndex.from_parts(index.parts(), index.count, k)
        for floor in (0.0, 0.2):
            at, hit, similarity = QueryBlock(words, k).top(index, words[::2], 100, False, np.full(len(words), floor))
            want = {(a, b) for a, w in enumerate(words) for b, v in enumerate(words[::2]) if sets[w] & sets[v] and len(sets[w] & sets[v]) / len(sets[w] | sets[v]) >= floor}
            assert set(zip(at.tolist(), hit.tolist())) == want and len(want) == len(at)
