import io
import json
import zipfile
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flankwise.operators import annotation as an, grids as gr, literature as li
from flankwise.sources import archives as ar, fasta as fa, model as mo, tables as ta
from flankwise.streaming import incremental as inc


def grid(spark, rows, sheet="s"):
    return spark.createDataFrame([(sheet, i, r) for i, r in enumerate(rows)], "sheet_id string, row long, cells array<string>")


def shares(rows):
    return {r.position: [round(r[b], 6) for b in "ACGT"] for r in rows.collect()}


def test_readcount_sheets(spark):
    rows = [["", "Read Counts", ""], ["PAM", "Bound", "Unbound"], ["GA", "3", "9"], ["GC", "1", "9"], ["GCC", "50", "1"], ["GA", "-8", "0"]]
    got = gr.readcount_frequencies(grid(spark, rows))
    assert shares(got) == {1: [0, 0, 1, 0], 2: [0, 1, 0, 0]} and got.first().weight_mode == "selected_counts"
    mean = [["", "Enrichment", ""], ["PAM", "Bound", "Mean"], ["GA", "9", "3"], ["GC", "9", "1"]]
    got = gr.readcount_frequencies(grid(spark, mean))
    assert shares(got)[2] == [0.75, 0.25, 0, 0] and got.first().weight_mode == "mean_enrichment"
    assert gr.readcount_frequencies(grid(spark, [["x", "y"], ["GA", "1"]])).count() == 0


def test_position_and_logo_sheets(spark):
    rows = [["Counts"], ["", "1", "2", "3"], ["A", "25", "0", "0"], ["C", "25", "0", "0"], ["G", "25", "1,000", "7"], ["T", "25", "0", "0"]]
    assert shares(gr.position_matrix(grid(spark, rows))) == {1: [0.25] * 4, 2: [0, 0, 1, 0], 3: [0, 0, 1, 0]}
    logo = [["Base", "1", "2"], ["A", "0.1", "0"], ["C", "0.2", "0"], ["G", "0.3", "1"], ["T", "0.4", "0"], ["A", "9", "9"]]
    got = {r.base: r["values"] for r in gr.sequence_logo(grid(spark, logo)).collect()}
    assert got["A"] == [0.1, 0.0] and set(got) == set("ACGT")
    assert gr.sheet_matrices(grid(spark, logo)).first().kind == "sequence_logo"
    assert gr.sheet_matrices(grid(spark, rows)).first().kind == "position_matrix"


def test_motif_tables(spark):
    rows = [["Table S1", "", ""], ["Effector", "PAM sequence", "Organism"], ["X1", "NR(A>G)TC", "E. coli"], ["X2", "NNN", "E. coli"], ["X3", "\"ugg\"", ""]]
    got = gr.motif_table_rows(grid(spark, rows)).orderBy("row").collect()
    assert [(r.pam_consensus, r.protein_id, r.raw_ref) for r in got] == [("NRTC", "X1", "X1 | org=E. coli"), ("GG", "X3", "X3")]
    assert gr.motif_table_headers(grid(spark, [["NES", "Pam", "0.7"], ["row_5", "PAM", "2"]])).count() == 0
    truncated = [["Degenerate consensus TAM (if functional)", "Species"], ["TTTA", "x"]]
    assert gr.motif_table_rows(grid(spark, truncated)).first().pam_consensus == "TTTA"


def test_column_roles(spark):
    heads = spark.createDataFrame([("s", ["Name", "Predicted PAM", "PAM", "Organism", "AA sequence"]), ("t", ["PAM", "x"])], "sheet_id string, cells array<string>")
    got = {(r.sheet_id, r.role): r.column for r in gr.column_roles(heads).collect()}
    assert got == {("s", "id"): 0, ("s", "pam"): 2, ("s", "organism"): 3, ("s", "aa"): 4}
    rows = [["a", "b", "c"], ["n1", "short", "M" * 90], ["n2", "", "K" * 90]]
    assert tuple(gr.detected_columns(grid(spark, rows)).first()) == ("s", 2, 1)


def test_kmer_counts(spark):
    rows = [("t", "AC" + x + "GG" + y, 1) for x in "ACGT" for y in "ACGT"]
    r = gr.kmer_counts_to_motif(spark.createDataFrame(rows, "table_id string, kmer string, n long")).first()
    assert (r.consensus, r.pam_start, r.pam_end, r.total_counts) == ("NGG", 2, 5, 16)


def plain_dedup(rows):
    """Record by record: DOI, then identifier, then title; only kept records register keys."""
    seen, out = {}, {}
    for position, doi, pmid, pmcid, title in rows:
        ident = f"pmid:{pmid}" if pmid else f"pmcid:{pmcid}" if pmcid else ""
        name = "".join(c for c in title.lower() if c.isascii() and c.isalnum())
        keys = [("d", doi.lower()), ("i", ident), ("t", name)]
        owner = next((seen[k] for k in keys if k[1] and k in seen), None)
        out[position] = position if owner is None else owner
        if owner is None:
            seen.update({k: position for k in keys if k[1]})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paper_dedup_equals_sequential(spark, seed):
    rng = Random(seed)
    pick = lambda n, p: str(rng.randrange(n)) if rng.random() < p else ""
    rows = [(i, "D" + pick(30, 1) if rng.random() < 0.5 else "", pick(30, 0.4), pick(20, 0.3), "Title " + pick(40, 0.8)) for i in range(150)]
    df = spark.createDataFrame(rows, "position long, doi string, pmid string, pmcid string, title string")
    kept = li.deduplicate_papers(df)
    assert {r.position: r.kept_position for r in kept.collect()} == plain_dedup(rows)
    merged = li.merged_papers(df.withColumn("matched_query", F.concat(F.lit("q"), F.col("position").cast("string"))), kept)
    assert merged.count() == len(set(plain_dedup(rows).values()))


def test_statements(spark):
    xml = ("<p>In <italic>Streptococcus pyogenes</italic> the SpCas9 protein requires a 5'-NGG-3' PAM.</p>" + " filler" * 100
           + "<p>5'-TTTN-3' is read by AsCas12a of <italic>Moraxella bovis</italic>; 5'-ATG-3' is a start.</p>")
    rows = li.statement_triples(spark.createDataFrame([("d", xml)], "doc_id string, xml string")).orderBy("statement").collect()
    assert [(r.cas_name, r.pam, r.species) for r in rows] == [("SpCas9", "NGG", "Streptococcus pyogenes"), ("AsCas12a", "TTTN", "Moraxella bovis")]


def test_consensus_and_gold(spark):
    pairs = spark.createDataFrame([("SpCas9", "AGG", "d", "s", 1), ("SpCas9", "TTTN", "d", "s", 2), ("OddCas9", "TTTT", "d", "", 3), ("SpCas9", "AGG", "e", "s", 4)],
                                  "cas_name string, pam string, doi string, species string, position long")
    kept = {r.position: r.kept for r in li.consensus_filter(pairs).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True}
    sequences = spark.createDataFrame([("SpCas9", "MA", "A1", "species", 1), ("SpCas9", "MK", "A2", "verified", 2)], "cas_name string, sequence string, accession string, match string, position long")
    gold, open_ = li.gold_merge(pairs, sequences)
    assert {(r.pam_consensus, r.protein_id, r.doi) for r in gold.collect()} == {("AGG", "A2", "d"), ("TTTN", "A2", "d")} and open_.count() == 1
    assert {r.pam_consensus: r.queue for r in li.gold_review(gold).collect()} == {"AGG": "clean", "TTTN": "review"}
    queries = spark.range(1).select(li.search_queries(F.lit("SpCas9"), F.lit("S. p")).alias("q")).first()["q"]
    assert [q.kind for q in queries] == ["species", "name_only"] and queries[0].query == '"S. p" AND (gene:cas9 OR gene:csn1)'


def test_annotation(spark):
    gene = "ATGGCTGCATAA"
    operons = an.union_with_precedence([
        spark.createDataFrame([("c1", "o1", "II-A", "['cas1', 'cas9']", "[1, 2]")], "Contig string, Operon string, Prediction string, Genes string, Positions string"),
        spark.createDataFrame([("c1", "o1", "V-A", "['cas9']", "[2]"), ("c2", "o2", "Ambiguous", "['Csn1_x']", "['1']")], "Contig string, Operon string, Prediction string, Genes string, Positions string"),
    ], "Operon")
    genes = spark.createDataFrame([("c1", "2", "3", "14", "1"), ("c2", "1", "3", "14", "1")], "Contig string, Pos string, Start string, End string, Strand string")
    proteins = spark.createDataFrame([("c1_2", "MAA*"), ("c2_1", "MAA")], "record_id string, sequence string")
    contigs = spark.createDataFrame([("c1", "CC" + gene), ("c2", "CC" + gene)], "contig string, contig_sequence string")
    systems = an.collect_systems(operons, genes, proteins, contigs).cache()
    assert {r.system_id: r.issues for r in systems.collect()} == {"c1_2": [], "c2_1": ["ambiguous_or_putative_subtype"]}
    assert an.select_system(systems).first().system_id == "c1_2"
    assert an.select_system(systems, "c2_1", allow_flagged=True).first().system_id == "c2_1"
    with pytest.raises(ValueError):
        an.select_system(systems, "c2_1")
    with pytest.raises(ValueError):
        an.select_system(systems, "none")
    loci = spark.createDataFrame([("o1", "['a1', 'a2']")], "Operon string, CRISPRs string")
    arrays = spark.createDataFrame([("a1", "c1", "1", "5", "acgt", "True"), ("a2", "c1", "1", "99", "AC-T", "True")], "CRISPR string, Contig string, Start string, End string, Consensus_repeat string, Trusted string")
    linked = an.linked_arrays(systems, loci, arrays, contigs, spark.createDataFrame([("a1",)], "array_id string"))
    assert {r.array_id: r.issues for r in linked.collect()} == {"a1": [], "a2": ["array_coordinates_out_of_range", "spacer_file_missing", "invalid_consensus_repeat"]}
    assert an.trusted_arrays(linked).count() == 1


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fna"
    path.write_text(">r1 first\nacgu\nAC\n\n>r2\nGG\n")
    rows = {r.record_id: r.sequence for r in fa.read_fasta(spark, str(path)).collect()}
    assert rows == {"r1": "ACGTAC", "r2": "GG"}
    records = fa.read_fasta(spark, str(path))
    assert fa.fasta_record(records, "r2").first().sequence == "GG" and fa.fasta_record(records).first().record_id == "r1"
    with pytest.raises(ValueError):
        fa.fasta_record(records, "r9")
    assert tuple(fa.check_genome(records, max_bases=100).first()) == (2, 8, 6, 0)
    (tmp_path / "b.fna").write_text(">r1\nAAA\n>r1\nCCC\n")
    both = fa.read_fasta(spark, [str(path), str(tmp_path / "b.fna")])
    assert {r.target_id for r in fa.union_targets(both).collect()} == {"r1", "r2", "b:r1", "b:r1:2"}
    with pytest.raises(Exception, match="duplicate"):
        fa.unique_records(both).collect()
    assert fa.unique_records(fa.read_fasta(spark, str(tmp_path / "b.fna")), allow_duplicates=True).first().sequence == "AAACCC"
    (tmp_path / "c.fna").write_text(">x\n\n>y\nAC\n")
    with pytest.raises(Exception, match="empty FASTA"):
        fa.read_fasta(spark, str(tmp_path / "c.fna")).collect()
    with pytest.raises(Exception, match="illegal"):
        fa.checked_alphabet(records.withColumn("sequence", F.lit("AZ")), "ACGT").collect()
    out = str(tmp_path / "out")
    fa.write_fasta(records.withColumn("sequence", F.repeat(F.lit("A"), 100)), out)
    assert {r.sequence for r in fa.read_fasta(spark, out).collect()} == {"A" * 100}


def test_tables_and_reports(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.createDataFrame([("x", 1.5), ("y", None)], "a string, b double")
    ta.write_tsv(rows, out)
    back = ta.read_tsv(spark, out, ["a", "b"])
    assert {tuple(r) for r in back.collect()} == {("x", "1.5"), ("y", "")}
    with pytest.raises(ValueError):
        ta.read_tsv(spark, out, ["z"])
    with pytest.raises(ValueError):
        ta.exactly_one(back, "row")
    with pytest.raises(ValueError):
        ta.write_tsv(rows.limit(0), str(tmp_path / "e"), allow_empty=False)
    ta.write_candidates_csv(rows, str(tmp_path / "c"), ["a", "b", "missing"])
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).fillna("").collect()} == {("x", "1.5", ""), ("y", "", "")}
    order = ["a"]
    assert ta.markdown_report(rows, str(tmp_path / "r.md"), order) == 2 and "| y | n/a |" in (tmp_path / "r.md").read_text()
    assert ta.html_report(rows, str(tmp_path / "r.html"), order, "t") == 2 and "<td>1.5</td>" in (tmp_path / "r.html").read_text()
    assert ta.json_report(rows, str(tmp_path / "r.json"), order, {"k": 1}) == 2
    assert json.loads((tmp_path / "r.json").read_text()) == {"k": 1, "rows": [{"a": "x", "b": 1.5}, {"a": "y", "b": None}]}
    ta.html_report(rows.limit(0), str(tmp_path / "n.html"), order, "t", nothing="none <here>")
    assert '<td colspan="2">none &lt;here&gt;</td>' in (tmp_path / "n.html").read_text()
    assert spark.range(1).select(ta.six_digits(F.lit(0.1234567)).alias("x")).first().x == "0.123457"
    path = tmp_path / "list.txt"
    path.write_text("# note\nngg\nTTTN\nNGG\n")
    assert {r.candidate_pam for r in ta.read_candidates(spark, ["ngg", "AAA"], str(path)).collect()} == {"NGG", "AAA", "TTTN"}
    with pytest.raises(Exception, match="invalid motif"):
        ta.read_candidates(spark, ["NXG"]).collect()
    case = dict(case_id="c", system_id="s", candidate_pams=["NGG", "NGGG"], pam_side="downstream", pam_length=3, max_mismatches=1)
    (tmp_path / "case.json").write_text(json.dumps(case))
    problems = {r.problem for r in ta.case_violations(ta.read_cases(spark, str(tmp_path / "case.json"))).collect()}
    assert {"candidates of mixed width", "spacer_orientation undeclared", "orientation without evidence"} <= problems


def workbook(rows):
    shared = sorted({c for r in rows for c in r if c})
    cells = lambda i, r: "".join(f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{shared.index(c)}</v></c>' for j, c in enumerate(r) if c)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(f'<row r="{i + 1}">{cells(i, r)}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>")
    return data.getvalue()


def test_archives(spark, tmp_path):
    book = workbook([["PAM", "", "Organism"], ["ACGTACG", "x", ""]])
    (tmp_path / "b.xlsx").write_bytes(book)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.xlsx", book)
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("t.csv", "﻿a,b\n1,\"x,y\"\n")
    rows = ar.xlsx_grid(spark, str(tmp_path)).orderBy("row").collect()
    assert [r.cells for r in rows] == [["PAM", "", "Organism"], ["ACGTACG", "x", ""]]
    nested = ar.xlsx_grid(spark, str(tmp_path), nested=True)
    assert nested.count() == 2 and nested.first().file.endswith("s.zip::inner.zip::deep.xlsx")
    assert [r.cells for r in ar.zip_csv_rows(spark, str(tmp_path), "t.csv").orderBy("row").collect()] == [["a", "b"], ["1", "x,y"]]
    (tmp_path / "m.xlsx").write_bytes(workbook([["PAMs"], ["ACGTACG"], ["TTTTTTT"]]))
    cells = ar.motif_cells(ar.xlsx_grid(spark, str(tmp_path / "m.xlsx")))
    assert {(r.address, r.motif) for r in cells.collect()} == {("A2", "ACGTACG"), ("A3", "TTTTTTT")}
    (tmp_path / "m.xlsx").write_bytes(workbook([["PAMs"], ["ACGTACG"], ["ACGTACG"]]))
    with pytest.raises(Exception, match="not a distinct motif"):
        ar.motif_cells(ar.xlsx_grid(spark, str(tmp_path / "m.xlsx"))).collect()
    (tmp_path / "m.xlsx").write_bytes(workbook([["PAMs"], ["ACGTACG"], ["TTTTTTT"]]))
    assert ar.motif_cells(ar.xlsx_grid(spark, str(tmp_path / "m.xlsx")), expected=2).count() == 2
    with pytest.raises(Exception, match="expected 3 motifs, found 2"):
        ar.motif_cells(ar.xlsx_grid(spark, str(tmp_path / "m.xlsx")), expected=3).collect()
    assert ar.missing_files(ar.file_digests(spark, str(tmp_path)), spark.createDataFrame([("b.xlsx",), ("no.tab",)], "name string")).first().name == "no.tab"


def test_predictor_and_resume(spark, tmp_path):
    def load_stub():
        def predict(sequences):
            out = np.full((len(sequences), 10, 4), 0.25)
            out[:, 1:3] = [0.01, 0.01, 0.97, 0.01]
            return out
        return predict

    proteins = spark.createDataFrame([("MA",), ("MA",), ("MK",)], "sequence string")
    rows = mo.predictions(proteins, load_stub, "cas9_full").collect()
    assert len(rows) == 2 and {r.consensus for r in rows} == {"NGG"}
    calls = []
    def compute(left):
        calls.append(left.count())
        return left.select("sequence")
    path = str(tmp_path / "cache")
    distinct = proteins.distinct()
    assert inc.resume(spark, distinct.where("sequence = 'MA'"), path, "sequence", "r1", compute).count() == 1
    assert inc.resume(spark, distinct, path, "sequence", "r1", compute).count() == 2
    assert inc.resume(spark, distinct, path, "sequence", "r2", compute).count() == 2 and calls == [1, 1, 2]


def test_marks_inside_headers_and_argument_order(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p1 variant A>G note\r\nAC\r\nGT\r\n>p2\nGG\n")
    (tmp_path / "b.fa").write_text(">p1\nTT\n>a:p1\nCC\n")
    rows = fa.read_fasta(spark, [str(tmp_path / "b.fa"), str(tmp_path / "a.fa")])
    assert {(r.record_id, r.header, r.sequence) for r in rows.collect()} == {
        ("p1", "p1 variant A>G note", "ACGT"), ("p2", "p2", "GG"), ("p1", "p1", "TT"), ("a:p1", "a:p1", "CC")}
    named = {r.target_id: r.target_sequence for r in fa.union_targets(rows).collect()}
    assert named == {"p1": "TT", "a:p1": "CC", "p2": "GG", "a:p1:2": "ACGT"}


def test_column_letters(spark):
    df = spark.createDataFrame([(c,) for c in (0, 25, 26, 51, 52, 701, 702, 16383)], "c int")
    assert [r[0] for r in df.select(ar.column_letters(df["c"])).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]


def test_quoted_commas_stay_in_list_items(spark):
    from flankwise.functions.text import literal_list

    df = spark.createDataFrame([("['a, b', \"c,d\", e]",), ("[]",), ("('x',)",)], "t string")
    assert [r[0] for r in df.select(literal_list("t")).collect()] == [["a, b", "c,d", "e"], [], ["x"]]


def test_reports_print_every_row(spark, tmp_path):
    path = tmp_path / "r.md"
    assert ta.markdown_report(spark.range(65_536).repartition(8), str(path), ["id"]) == 65_536
    lines = path.read_text().splitlines()
    assert len(lines) == 65_538 and lines[2] == "| 0 |" and lines[-1] == "| 65535 |"


def test_candidate_report(spark, tmp_path):
    from flankwise.operators.fusion import report_candidates

    protein = spark.createDataFrame([("s", "NGG", 90.0, 1), ("s", "NAG", 50.0, 2), ("s", "N<G", 10.0, 3)], "system_id string, candidate_pam string, specificity_adjusted_score double, protein_rank int")
    spacer = spark.createDataFrame([("s", "NGG", 95.0, 5, 4, 3), ("s", "NAG", 10.0, 1, 0, 0)], "system_id string, candidate_pam string, spacer_evidence_score double, effective_spacer_count long, support_spacer_count long, support_target_count long")
    rows = report_candidates(protein, spacer)
    proteins = spark.createDataFrame([("p", "NNGN", True, "3", False)], "protein_id string, predicted_pam string, partial_consensus boolean, determined_positions string, no_clear_pam boolean")
    fields = ta.candidate_report(rows, proteins, str(tmp_path), model="m", limitations=["l1"])
    document = json.loads((tmp_path / "report.json").read_text())
    assert {k: document[k] for k in fields} == fields and fields["partial_consensus"] == ["NNGN"] and not fields["no_clear_pam"]
    assert [(c["candidate_pam"], c["spacer_score"], c["status"]) for c in document["candidates"]] == [
        ("NGG", 95.0, "两路均支持（非独立验证）"), ("NAG", 10.0, "spacer 证据不足（少于 2 条有效 spacer）"), ("N<G", None, "仅蛋白预测；未提供 spacer 证据")]
    assert (tmp_path / "candidates.tsv").read_text().splitlines()[2] == "NAG\t50.0\t2\t10.0\t1\t0\t0\tspacer 证据不足（少于 2 条有效 spacer）"
    assert "<td>N&lt;G</td>" in (tmp_path / "report.html").read_text()
    alone = report_candidates(protein, None).limit(0)
    fields = ta.candidate_report(alone, proteins.withColumn("no_clear_pam", F.lit(True)), str(tmp_path), model="m", limitations=[])
    assert fields["no_clear_pam"] and fields["no_candidate_rows"] and ta.NO_CANDIDATE_ROWS in (tmp_path / "report.html").read_text()


def test_tables_are_written_once(spark, tmp_path):
    path = tmp_path / "once"
    rows = spark.range(100).select("id", F.concat(F.lit("x\ty "), "id").alias("t"), F.when(F.col("id") > 50, F.col("id")).alias("n")).repartition(5)
    ta.write_once(rows, str(path))
    ta.write_once(rows.repartition(3).orderBy(F.desc("id")), str(path))
    names = sorted(p.name for p in path.iterdir())
    assert len([n for n in names if n.startswith("part-")]) == 5 and not [n for n in names if n.startswith("_aside")]
    back = ta.read_tsv(spark, str(path / "part-*"))
    assert sorted((r.id, r.t, r.n) for r in back.collect()) == sorted((str(i), f"x\ty {i}", str(i) if i > 50 else "") for i in range(100))
    for other in (rows.limit(99), rows.withColumnRenamed("t", "u"), rows.withColumn("n", F.lit(1)), rows.unionByName(rows)):
        with pytest.raises(Exception, match="different content"):
            ta.write_once(other, str(path))
    assert sorted(p.name for p in path.iterdir()) == names
    broken = tmp_path / "broken"
    failing = rows.withColumn("t", F.when(F.col("id") == 77, F.raise_error(F.lit("no such row")).cast("string")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="no such row"):
        ta.write_once(failing, str(broken))
    assert not [p for p in broken.rglob("*") if p.is_file()]
    ta.write_once(rows, str(broken))
    assert ta.read_tsv(spark, str(broken / "part-*")).count() == 100
    with pytest.raises(ValueError, match="nested"):
        ta.write_once(spark.sql("select array(1) as a"), str(tmp_path / "nested"))


def test_each_sheet_is_a_task_and_can_be_chosen(spark, tmp_path):
    data = io.BytesIO()
    sheet = lambda rows: "<worksheet><sheetData>" + "".join(
        f'<row r="{r}">' + "".join(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' for ref, v in cells) + "</row>" for r, cells in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="one" r:id="a"/><sheet name="two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([(2, [("A2", "x"), ("C2", "y")]), (4, [("B4", "z")])]))
        z.writestr("xl/worksheets/s2.xml", sheet([(1, [("A1", "only")])]))
    (tmp_path / "b.xlsx").write_bytes(data.getvalue())
    both = ar.xlsx_grid(spark, str(tmp_path))
    assert both.rdd.getNumPartitions() == 2
    assert [r.cells for r in both.where("sheet = 'one'").orderBy("row").collect()] == [["", "", ""], ["x", "", "y"], ["", "", ""], ["", "z", ""]]
    assert [r.cells for r in ar.xlsx_grid(spark, str(tmp_path), sheet="two").collect()] == [["only"]]
    assert {r.sheet for r in ar.xlsx_grid(spark, str(tmp_path), first_only=True).collect()} == {"one"}
    with pytest.raises(Exception, match="nowhere"):
        ar.xlsx_grid(spark, str(tmp_path / "nowhere")).count()


def test_a_large_member_streams(tmp_path):
    import tracemalloc

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("t.csv", "w") as out:
            for i in range(4000):
                out.write((f"{i}," + "ACGT" * 2500 + "\n").encode())
        with z.open("inner.xlsx", "w") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
            with book.open("xl/worksheets/s.xml", "w") as sheet:
                sheet.write(b"<worksheet><sheetData>")
                for i in range(3000):
                    sheet.write(b"<row><c t='inlineStr'><is><t>" + b"x" * 10_000 + b"</t></is></c></row>")
                sheet.write(b"</sheetData></worksheet>")
    tracemalloc.start()
    reader = ar.ZipCsvReader({"path": str(tmp_path), "member": "t.csv"})
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 4000
    sheets = ar.SheetReader({"path": str(tmp_path), "nested": "true"})
    (planned,) = sheets.partitions()
    assert sum(len(cells[0]) for _, _, _, cells in sheets.read(planned)) == 30_000_000
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_a_missing_annotator_table_is_empty(spark, tmp_path):
    none = ta.optional_tsv(spark, str(tmp_path / "crisprs_all.tab"), ["Contig", "CRISPR"])
    assert none.columns == ["Contig", "CRISPR"] and none.count() == 0
    (tmp_path / "crisprs_all.tab").write_text("Contig\tCRISPR\tx\nc1\ta1\t\n")
    assert [tuple(r) for r in ta.optional_tsv(spark, str(tmp_path / "crisprs_all.tab"), ["Contig", "CRISPR"]).collect()] == [("c1", "a1", "")]
    with pytest.raises(ValueError, match="lacks columns"):
        ta.optional_tsv(spark, str(tmp_path / "crisprs_all.tab"), ["Operon"])
