"""Flat-file records, training tables, variant packages and run diagnoses."""

import hashlib
import itertools
from random import Random

import pytest
from pyspark.sql import functions as F

from flankwise.functions.dna import CODON_RESIDUES
from flankwise.operators import annotation as an, packaging as pk
from flankwise.sources import genbank as gb, training as tr

CODE = dict(zip(map("".join, itertools.product("TCAG", repeat=3)), CODON_RESIDUES))
PAIR = str.maketrans("ACGT", "TGCA")


def residues(dna):
    return "".join(CODE.get(dna[i:i + 3], "X") for i in range(0, len(dna) - 2, 3))


def record(name, sequence, features, newline="\n"):
    lines = [f"LOCUS       {name}   {len(sequence)} bp    DNA", "DEFINITION  made up", "FEATURES             Location/Qualifiers"]
    for kind, location, qualifiers in features:
        lines.append(f"     {kind:<16}{location[0]}")
        lines += [" " * 21 + more for more in location[1:]]
        for q in qualifiers:
            lines += [" " * 21 + part for part in q.split("\n")]
    lines.append("ORIGIN")
    for i in range(0, len(sequence), 60):
        row = sequence[i:i + 60].lower()
        lines.append(f"{i + 1:>9} " + " ".join(row[j:j + 10] for j in range(0, len(row), 10)))
    return newline.join([*lines, "//", ""])


def test_records_of_files(spark, tmp_path):
    one = "ATGGCATGGTAA" + "ACGT" * 40
    features = [
        ("source", ["1..172"], ['/organism="Testis\nminor"', "/pseudo", '/note="a ""quoted"" word\n/label=no qualifier"']),
        ("CDS", ["join(1..6,", "7..12)"], ['/label=Core', '/translation="MA\nW"']),
    ]
    for newline in ("\n", "\r\n"):
        folder = tmp_path / f"f{len(newline)}"
        folder.mkdir()
        (folder / "a.gb").write_bytes((record("R1", one, features, newline) + record("R2", "ACGT", [], newline)).encode())
        rows = {r.record_id: r for r in gb.read_genbank(spark, str(folder)).collect()}
        assert set(rows) == {"R1", "R2"} and rows["R1"].sequence == one and rows["R1"].declared_length == 172
        assert rows["R2"].sequence == "ACGT" and rows["R2"].features == []
        source, cds = rows["R1"].features
        assert [q.name for q in source.qualifiers] == ["organism", "pseudo", "note"]
        assert source.qualifiers[0].value == "Testis minor" and source.qualifiers[2].value == 'a "quoted" word /label=no qualifier'
        assert (cds.kind, cds.location) == ("CDS", "join(1..6,7..12)")
        got = gb.coding_features(gb.read_genbank(spark, str(folder))).collect()
        assert [(r.record_id, r.feature_number, r.label, r.protein, r.annotation, r.verified) for r in got] == [("R1", 1, "Core", "MAW", "MAW", True)]
    with pytest.raises(Exception, match="LOCUS"):
        gb.parsed_records(spark.createDataFrame([("ORIGIN\n 1 acgt",)], "text string")).collect()
    assert gb.parsed_records(spark.createDataFrame([], "text string, sequence_of int")).count() == 0


def test_long_tables_of_features(spark):
    features = [("gene", [f"{i}..{i + 2}"], [f'/gene="g{i}"', '/note="' + "\n".join(["word"] * 40) + '"']) for i in range(1, 3001)]
    row = gb.parsed_records(spark.createDataFrame([(record("big", "ACGT" * 5000, features),)], "text string")).select(
        F.size("features").alias("n"), F.length("sequence").alias("bases"), F.expr("features[2999].location").alias("last")).first()
    assert tuple(row) == (3000, 20000, "3000..3002")


def spliced(sequence, parts):
    return "".join(sequence[a - 1:b] if not reverse else sequence[a - 1:b][::-1].translate(PAIR) for a, b, reverse in parts)


@pytest.mark.parametrize("location,parts", [
    ("3..8", [(3, 8, False)]), ("5", [(5, 5, False)]), ("<1..>9", [(1, 9, False)]), ("complement(2..7)", [(2, 7, True)]),
    ("join(1..3,7..9,12)", [(1, 3, False), (7, 9, False), (12, 12, False)]),
    ("complement(join(1..3,7..9))", [(7, 9, True), (1, 3, True)]),
    ("join(complement(7..9),complement(1..3))", [(7, 9, True), (1, 3, True)]),
    ("complement(join(1..3,complement(7..9)))", [(7, 9, False), (1, 3, True)]),
    ("order(1..3,5..6)", None), ("J00194.1:1..3", None), ("5^6", None), ("", None), ("join(1..3", None), ("complement(1..99999999999)", None),
])
def test_locations(spark, location, parts):
    sequence = "ACGGTTACCATGAA"
    df = spark.createDataFrame([(location, sequence)], "location string, sequence string").withColumn("parts", gb.location_parts("location"))
    row = df.select("parts", gb.spliced("sequence", "parts").alias("bases")).first()
    if parts is None:
        assert row.parts is None
    else:
        assert [tuple(p) for p in row.parts] == parts and row.bases == spliced(sequence, parts)


def coded(spark, sequence, location, *qualifiers):
    text = record("r", sequence, [("CDS", [location], list(qualifiers))])
    return gb.coding_features(gb.parsed_records(spark.createDataFrame([(text,)], "text string"))).first()


@pytest.mark.parametrize("sequence,location,qualifiers,notes", [
    ("ATGGCATGG", "1..9", ['/translation="MAW"'], []),
    ("TTGGCATGG", "1..9", ['/translation="MAW"'], []),
    ("CCATGGCATGG", "1..11", ["/codon_start=3", '/translation="MAW"'], []),
    ("ATGTAATGG", "1..9", ['/translation="M"'], ["internal_stop_codon", "translation_mismatch"]),
    ("ATGGCATG", "1..8", ['/translation="MA"'], ["length_not_multiple_of_three"]),
    ("ATGNCATGG", "1..9", ['/translation="MXW"'], ["not_acgt"]),
    ("ATGGCATGG", "1..12", ['/translation="MAW"'], ["location_out_of_range"]),
    ("ATGGCATGG", "order(1..9)", [], ["unsupported_location", "no_annotation"]),
    ("ATGGCATGG", "1..9", ["/transl_table=4", '/translation="MAW"'], ["unsupported_code_table"]),
    ("CCATGCCAT", "complement(1..9)", ['/translation="MAW"'], []),
])
def test_coding_features(spark, sequence, location, qualifiers, notes):
    row = coded(spark, sequence, location, *qualifiers)
    # CCATGCCAT turned is ATGGCATGG.
    assert row.notes == notes and row.verified == (notes == [])


def test_core_places_against_brute_force(spark):
    rng = Random(5)
    cores, references = [], []
    for i in range(60):
        core = "".join(rng.choice("ATGGCA") for _ in range(6 * rng.randint(1, 2)))
        pieces = ["".join(rng.choice("ACGTN" if i % 7 == 0 else "ACGT") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        references.append((i, core.join(pieces)))
        cores.append((i, residues(core)))
    references.append((99, ""))
    cores += [(99, "M"), (7, ""), (8, None)]
    df_c = spark.createDataFrame(cores, "k int, protein string")
    places = gb.core_places(df_c, spark.createDataFrame(references, "k int, sequence string"), ["k"])
    wanted = set()
    sequences = dict(references)
    for k, core in cores:
        for frame in (0, 1, 2):
            reading, at = residues(sequences[k][frame:]), 0
            while core and (at := reading.find(core, at)) >= 0:
                wanted.add((k, frame, frame + 3 * at + 1, frame + 3 * (at + len(core))))
                at += len(core)
    got = [tuple(r) for r in places.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 60
    verdicts = {r.k: (r.places, r.verdict) for r in gb.core_verdict(df_c, places, ["k"]).collect()}
    for k in sequences:
        n = sum(w[0] == k for w in wanted)
        assert verdicts[k] == (n, "absent" if n == 0 else "unique" if n == 1 else "repeated")


def test_residues_and_substitution(spark):
    row = spark.createDataFrame([("ABCDEFGH", "xyz")], "core string, new string").select(
        gb.residues_at("core", [2, 3, 8]).alias("old"), pk.substituted(F.col("core"), [2, 3, 8], F.col("new")).alias("changed"),
        pk.substituted(F.col("core"), [1, 5, 6], F.col("new")).alias("other")).first()
    assert tuple(row) == ("BCH", "AxyDEFGz", "xBCDyzGH")


LOGO = "[" + ",".join(["[1,0,0,1]"] * 10) + "]"


def test_training_tables(spark, tmp_path):
    path = tmp_path / "train.tsv"
    header = "﻿protein_sequence \tcrispr_type\tlogo_json\tpam_consensus\tposition_weights\n"
    path.write_text(header + f"MKV\ttype ii\t{LOGO}\t\t\n MKL\tII\t\tNGG\t[1,1,1,1,1,1,1,1,1,2]\n", encoding="utf-8")
    rows = tr.training_rows(tr.read_training(spark, str(path)), "cas9_full").collect()
    assert [r.sequence for r in rows] == ["MKV", "MKL"] and rows[0].target[0] == [0.5, 0.0, 0.0, 0.5]
    assert rows[1].target[1] == [0.0, 0.0, 1.0, 0.0] and rows[1].weights[-1] == 2.0 and rows[0].weights == [1.0] * 10
    stamp = tr.training_fingerprint(spark, str(path), "cas9_full").first()
    assert (stamp.sha256, stamp.rows, stamp.required_family) == (hashlib.sha256(path.read_bytes()).hexdigest(), 2, "Type II")
    assert stamp.schema[0] == "protein_sequence" and stamp.sequence_column == "protein_sequence"
    with pytest.raises(ValueError, match="pid_sequence"):
        tr.training_rows(tr.read_training(spark, str(path)), "cas9")
    with pytest.raises(Exception, match="wrong_family"):
        tr.training_rows(tr.read_training(spark, str(path)), "cas12").collect()


def test_training_violations(spark):
    zero = LOGO.replace("[1,0,0,1]", "[0,0,0,0]", 1)
    rows = spark.createDataFrame([
        ("MK", "II", LOGO, "", ""), ("", "V", "", "", ""), ("MK", "Type II", zero, "", "[1]"), ("MK", None, "[[1]]", "NGG", None), (None, "TYPEII", None, "NGG", None),
        ("MK", "II", "{", "NGG", "x"),
    ], "protein_sequence string, crispr_type string, logo_json string, pam_consensus string, position_weights string")
    got = [r[0] for r in rows.select(tr.training_violations(rows, "cas9_full")).collect()]
    assert got == [[], ["wrong_family", "empty_sequence", "missing_target"], ["invalid_logo", "invalid_weights"], ["wrong_family", "invalid_logo"],
                   ["empty_sequence"], ["invalid_logo", "invalid_weights"]]
    held = spark.createDataFrame([("MK", "II"), ("MV", "II"), ("MQ", "V")], "protein_sequence string, crispr_type string")
    more = spark.createDataFrame([(" MK ",), ("MQ",), ("MK",)], "protein_sequence string")
    assert [r.sequence for r in tr.leaked_sequences(more, held, "cas9_full").collect()] == ["MK"]


def wide(name, library="six", status="good", extra="no", value="-1.5", residues=None):
    letters = residues or name
    return (name, library, status, extra, *letters, value, "-9", "0.25")


WIDE = "name string, source_library string, status string, extra_mutations string, r1 string, r2 string, r3 string, r4 string, r5 string, r6 string, NAAA string, NAAC string, NAAG string"


def packed(spark, rows, used=()):
    return pk.package_variants(
        spark.createDataFrame(rows, WIDE), "MKVLATGHEDRW", spark.createDataFrame([(u,) for u in used], "name string"), positions=[2, 3, 5, 8, 9, 12],
        named_by=[f"r{i}" for i in range(1, 7)], groups=["NAAA", "NAAC", "NAAG"], library="six", wild_type="KVAHEW")


def test_package_against_brute_force(spark):
    rng = Random(3)
    names = ["KVAHEW"]
    while len(names) < 60:
        name = "".join(rng.choice("ACDEFGHIKL" if len(names) % 2 else "KVAHEW") for _ in range(6))
        names += [name] * (name not in names)
    out = packed(spark, [wide(n) for n in names] + [wide("AAAAAA", library="other"), wide("CCCCCC", library=None)], names[3:5])
    variants = {r.variant_id: r for r in out["variants"].collect()}
    assert set(variants) == set(names)
    for n, r in variants.items():
        assert r.protein_sequence == f"M{n[0]}{n[1]}L{n[2]}TG{n[3]}{n[4]}DR{n[5]}" and r.distance_from_wt == sum(a != b for a, b in zip(n, "KVAHEW"))
        assert r.is_wt == (n == "KVAHEW") and r.previously_evaluated == (n in names[3:5]) and not r.constant_target
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    reserved = [n for n in names if variants[n].future_split == "reserved_evaluation"]
    rest = [n for n in names if n not in reserved]
    row = out["manifest"].first()
    assert reserved and row.smallest_distance_between_roles == min(far(a, b) for a in reserved for b in rest) >= 3
    assert (row.variants, row.measurements, row.censored_measurements, row.quarantined, row.reserved, row.development) == (
        60, 180, 60, 2, len(reserved), len(rest))
    measured = {(r.variant_id, r.pam_group): r.ranking_target_log10_k for r in out["measurements"].collect()}
    assert measured[names[0], "NAAC"] == -5.0 and measured[names[0], "NAAA"] == -1.5 and len(measured) == 180


@pytest.mark.parametrize("row,message", [
    (wide("KVAHEW", status="bad"), "status_not_good"), (wide("KVAHEW", extra="yes"), "extra_mutations"), (wide("KVAHEW", residues="KVAHEE"), "name_differs"),
    (wide("KVAHEX"), "nonstandard"), (wide("KVAHEW", value="nan"), "finite"), (wide("KVAHEW", value=None), "finite"),
])
def test_package_refuses(spark, row, message):
    with pytest.raises(Exception, match=message):
        packed(spark, [row])["measurements"].collect()


def test_run_diagnosis(spark):
    crash = "x\nKeyError: \"['Hmm', 'ORF'] not in index\""
    runs = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (5, True), (6, True), (7, None)], "run_id int, succeeded boolean")
    files = spark.createDataFrame([
        (1, "genes.tab"), (2, "hmmer/a.tab"), (3, "genes.tab"), (4, "genes.tab"), (4, "proteins.faa"), (4, "cas_operons_orphan.tab"), (5, "genes.tab"),
        (5, "sub/proteins.faa"), (5, "cas_operons.tab"), (6, None)], "run_id int, path string")
    logs = spark.createDataFrame([(1, crash), (2, crash), (3, "KeyError"), (4, crash), (7, None)], "run_id int, text string")
    got = {r.run_id: (r.state, r.missing, r.upstream_crash) for r in an.run_diagnosis(runs, files, logs).collect()}
    assert got == {
        1: ("failed", [], True), 2: ("failed", [], False), 3: ("failed", [], False), 4: ("usable", [], False), 5: ("no_usable_output", ["proteins.faa"], False),
        6: ("no_usable_output", ["genes.tab", "proteins.faa", "operon table"], False), 7: ("failed", [], False)}
