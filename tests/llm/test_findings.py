"""Cases of the second review that the operators used to cut short."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flankwise.llm import graph_search, license_scan, range_coder
from flankwise.llm.graph_search import graph_nearest
from flankwise.llm.packing import harmonic_packing
from flankwise.llm.token_files import document_digests, read_token_files, write_token_files
from flankwise.llm.tokens import Encoder


# licences

def plain_places(text, base):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return sorted((label, i, i + len(p.split())) for p, label in base.items()
                  for i in range(len(own)) if own[i:i + len(p.split())] == p.split())


def test_base_places_inside_template_sentences():
    scanner = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    sentences = [t for _, t in license_scan.TEMPLATES]
    rng = random.Random(3)
    pairs = [" ".join([*rng.sample(sentences, 2), rng.choice(["", "all rights reserved", "cc by"])]) for _ in range(200)]
    found = 0
    for text in [*sentences, *pairs, "the GNU General Public License", "x licensed under cc by"]:
        places = scanner.scan(text)[1]
        assert sorted(places) == plain_places(text, license_scan.BASE)
        found += len(places)
    assert found > 100


def test_nested_and_one_word_base_phrases():
    base = {"by": "one", "cc by": "two", "under cc by": "three", "x cc by": "four"}
    templates = [("t", "licensed under cc by nc"), ("u", "granted y by all"), ("v", "x by all")]
    scanner = license_scan.Scanner(base, templates)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("by cc under x y nc licensed all z".split(), k=40)) for _ in range(200)]
    for text in [*texts, "by", "z by z", "granted y by", "x by"]:
        assert sorted(scanner.scan(text)[1]) == plain_places(text, base)


def spans_of(text):
    return {s[0] for s in license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES).scan(text)[2]}


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License.", {"gpl"}),
    ("This work is licensed under the GNU General Public License, version 4", {"gpl"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("Licensed under the Apache License, Version 1.1", {"apache"}),
    ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
    ("This work is not licensed under the GNU General Public License, version 3.", set()),
    ("It was never released under the MIT License.", set()),
    ("Released under the MIT License. Not all of it.", {"mit"}),
    ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0"}),
    ("Licensed under CC BY-SA 3.0.", set()),
])
def test_versions_and_denials_decide_the_label(text, labels):
    assert spans_of(f"some words {text} more words") == labels


def test_every_template_has_its_label_and_a_cover_of_one():
    scanner = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    for label, text in license_scan.TEMPLATES:
        spans = scanner.scan("x " + text + " y")[2]
        assert (label, 1, 1 + len(license_scan.words_of(text)), 1.0) in spans
        assert all(0.75 <= s[3] <= 1 for s in spans)


def test_matching_statistics_equal_a_plain_search():
    templates = ["a b c a b d", "b c a", "a a b", "d c b a b c"]
    words = {w: i + 1 for i, w in enumerate("abcd")}
    coded = [[words[w] for w in t.split()] for t in templates]
    parts = {tuple(t[i:j]) for t in coded for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    automaton = license_scan.Automaton(coded)
    rng = random.Random(6)
    for _ in range(200):
        text = rng.choices([0, 1, 2, 3, 4], k=40)
        for place, state, length in automaton.stream(text):
            plain = max([n for n in range(1, place + 2) if tuple(text[place + 1 - n:place + 1]) in parts], default=0)
            assert length == plain
            ends = {(t, i + length - 1) for t, own in enumerate(coded) for i in range(len(own) - length + 1)
                    if length and own[i:i + length] == text[place + 1 - length:place + 1]}
            assert ends == {e for e in automaton.states[state].ends} or not length


def test_licence_scan_of_awkward_tables(spark):
    schema = "doc_id long, text string, row string, scan string"
    long = "x " * 200_000 + "Released under the MIT License. " + "y " * 200_000
    rows = [(1, None, "r", "s"), (2, "", "r", "s"), (3, long, "r", "s"), (3, long, "r", "s"), (4, "cc by", "r", None)]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.row.doc_id, r.scan.n_words, len(r.scan.places), tuple(s.label for s in r.scan.spans)) for r in found) == [
        (1, 0, 0, ()), (2, 0, 0, ()), (3, 400_005, 0, ("mit",)), (3, 400_005, 0, ("mit",)), (4, 2, 1, ())]
    assert {r.row.row for r in found} == {"r"}
    assert license_scan.scan_licenses(spark.createDataFrame([], schema)).count() == 0


# nearest neighbours

@pytest.mark.parametrize("norms", [[1e3], [1e4], [3e38, -3e38, 2e19], [10.0 ** k for k in range(-30, 31, 6) for _ in range(30)]])
def test_graph_keeps_its_digits_beside_long_vectors(spark, norms):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(1500, 16))
    data /= np.linalg.norm(data, axis=1)[:, None]
    data[:len(norms)] = data[:len(norms)] * np.array(norms)[:, None] if max(norms) < 1e38 else np.eye(16)[0] * np.array(norms)[:, None]
    data = data.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(3)
    found = graph_nearest(df, df.where("vec_id % 20 = 0"), neighbours=20).collect()
    hits = 0
    for q in range(0, 1500, 20):
        scores = data @ data[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        own = [r.vec_id for r in found if r.query_id == q]
        assert len(own) == 20
        hits += len(set(best) & set(own))
    assert hits / 1500 >= 0.95


# tokens

CONTROLS = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>y", "a  <|endoftext|>  b", "é 你 <|endoftext|> \x00",
            "<|ENDOFTEXT|> <|endof text|>", "plain words only"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_control_strings_get_the_ids_of_the_library_as_loaded(name):
    path = public_tokenizers.path(name)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "word", " ", "  ", "\n", "İ", "9", "'s", "<|", "|>"]
    rng = random.Random(5)
    texts = CONTROLS + ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(500)]
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in Encoder(path).encode(texts)] == [e.ids for e in expected]


def test_control_strings_in_token_files_and_packing(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(CONTROLS)), "doc_id long, text string").repartition(2)
    ids = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(CONTROLS, add_special_tokens=False)
        ids[name] = [e.ids for e in found]
    write_token_files(df, f"file://{tmp_path}/tokens", public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    digests = {r.doc: r for r in document_digests(read_token_files(spark, f"file://{tmp_path}/tokens")).collect()}
    for doc, own in enumerate(ids["byte_bpe_50k.json"]):
        own = np.array([*own, 0], "<u4")
        assert (digests[doc].n_tokens, digests[doc].ids_crc32) == (len(own), zlib.crc32(own.tobytes()))
    packed = harmonic_packing(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    totals = {r.doc: r.doc_tokens for r in packed}
    assert all(totals[doc] - len(own) == totals[6] - len(ids["word_bpe_49k.json"][6]) for doc, own in enumerate(ids["word_bpe_49k.json"]))


def test_row_keys_name_id_and_text(spark):
    from flankwise.llm.common import row_key

    rows = [(1, "a"), (1, "b"), (11, "a"), (None, "a"), (None, None), (1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [bytes(r.k) for r in df.select(row_key("doc_id", "text").alias("k")).collect()]
    assert len(set(keys)) == 6 and keys[5] == keys[6] and {len(k) for k in keys} == {16}


def test_empty_rows_before_the_cut_stay_in_the_mix(spark):
    from flankwise.llm.mixing import mix_sources

    rows = [(i, "big", "w " * 9 if i % 2 else None) for i in range(400)] + [(1000 + i, "small", "w") for i in range(5)] + [(2000, "none", "")]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.5).select("row.source", "size", "copies").collect()
    empty = [r.copies for r in found if r.source == "big" and r.size == 0]
    assert 40 < sum(empty) < 160 and max(empty) == 1
    assert [r.copies for r in found if r.source == "none"] == [0]


@pytest.mark.parametrize("shape", ["gaussian", "unit", "clusters"])
def test_recall_at_every_shape_over_two_shards(spark, monkeypatch, shape):
    monkeypatch.setattr(graph_search, "SHARD_ROWS", 2500)
    rng = np.random.default_rng(12)
    data = rng.normal(size=(5000, 64))
    if shape == "unit":
        data /= np.linalg.norm(data, axis=1)[:, None]
    if shape == "clusters":
        centres = rng.normal(size=(40, 64)) * rng.uniform(0.5, 2, size=(40, 1))
        data = centres[rng.integers(0, 40, 5000)] + 0.3 * data
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    asked = range(0, 5000, 20)
    found = {(r.query_id, r.vec_id) for r in graph_nearest(df, df.where("vec_id % 20 = 0"), neighbours=20).collect()}
    assert len(found) == 20 * len(asked)
    hits = 0
    for q in asked:
        scores = data @ data[q]
        scores[q] = -np.inf
        hits += sum((q, int(v)) in found for v in np.argsort(-scores)[:20])
    assert hits / len(found) >= 0.93


def test_lanes_of_a_block_advance_together_and_learn_from_each_other(monkeypatch):
    """Work per step is spread over many lanes, and what one lane has seen serves all."""
    rng = np.random.default_rng(7)
    follow, common = rng.integers(0, 50_000, 3000), rng.zipf(1.3, 120_000) % 3000
    known = np.zeros(120_000, np.uint32)
    for i in range(1, len(known)):
        known[i] = follow[known[i - 1] % 3000] if rng.random() < 0.6 else follow[common[i]]
    steps = []
    narrow = range_coder.Coder.narrow
    monkeypatch.setattr(range_coder.Coder, "narrow", lambda self, *a: (steps.append(1), narrow(self, *a))[1])
    blocks = [known[at:at + range_coder.BLOCK] for at in range(0, len(known), range_coder.BLOCK)]
    coded = range_coder.encode_blocks(blocks)
    assert len(steps) * 50 < len(known)
    assert sum(map(len, coded)) < 0.9 * len(zlib.compress(known.astype("<u2").tobytes(), 9))
    assert np.array_equal(np.concatenate(range_coder.decode_blocks(coded)), known)
    with pytest.raises(ValueError):
        range_coder.decode_blocks([coded[0][:-2]])
