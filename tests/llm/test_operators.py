"""The training-data operators against brute force, on rows with nulls, ties, repeats, long texts and clashing names."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from flankwise.llm import exact_dedup, near_dup, range_coder, toxicity
from flankwise.llm.chat import escape, prefix_target_examples, read_loss, read_turns, unescape
from flankwise.llm.graph_search import graph_nearest
from flankwise.llm.license_scan import scan_licenses
from flankwise.llm.mixing import mix_sources
from flankwise.llm.packing import harmonic_packing
from flankwise.llm.sharding import communication_matrix, hypergeometric, hypergeometric_shards
from flankwise.llm.token_files import document_digests, joined_crc, part_starts, read_token_files, write_token_files

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, source string, key string, row string, digest string, _flag int, id string, part int"


def library_ids(name, texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids + [end], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Texts with nulls, empties, repeats, copies in other case, a very long one, and columns named like inner ones."""
    long = " ".join(f"wörd{i % 977} x{i}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near = base.replace("twenty", "thirty")
    texts = [None, "", "", "!!!", "!!!", "a b", "A b", base, base, base.upper(), near, long, long + " end", "İ ß 你好 \x00 é", "x"]
    rows = [(i, t, ["s1", "s0", None][i % 3], "k", "r", "d", 1, "i", 2) for i, t in enumerate(texts)]
    rows += [(7, base, "s1", "k", "r", "d", 1, "i", 2), (None, "y y", "s1", "k", "r", "d", 1, "i", 2)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def texts_of(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.collect()]


# chat

def test_escape_is_reversible_and_leaves_no_control_string(spark):
    bits = ["<", "s>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\-", "\\.", "[", "é", "<</s>"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_every_assistant_turn_is_trained_once(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] ok"), (1, 3, "user", "q"), (1, 4, "assistant", "b\\"),
            (1, 5, "user", "tail"), (2, 0, "user", "only"), (None, None, None, "z"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    found = prefix_target_examples(df)
    read = found.select("*", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).collect()
    one = sorted((r for r in read if r.conversation == 1), key=lambda r: r.example)
    assert [r.loss for r in one] == ["</s>[INST] ok", "b\\", ""]
    assert [len(r.turns) for r in one] == [3, 5, 6]
    assert [(t.role, t.text) for t in one[-1].turns] == [(r[2], r[3] or "") for r in rows[:6]]
    assert sorted(len(r.turns) for r in read if r.conversation == 3) == [1, 2]
    assert [(r.loss, len(r.turns)) for r in read if r.conversation in (2, None)] == [("", 1)] * 2
    assert prefix_target_examples(df.limit(0)).count() == 0


# licences

def test_base_places_equal_a_plain_search(spark):
    rng = random.Random(2)
    words = "cc by all rights reserved general public license the of BY-NC x9 ñ".split()
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(150)] + [None, "", "CC-BY", "cc by" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    import re
    for row in scan_licenses(df).select("row.*", "scan.*").collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        expected = sorted((label, i) for p, label in phrases.items() for i in range(len(own)) if tuple(own[i:i + len(p)]) == p)
        assert row.n_words == len(own)
        assert sorted((p.label, p.first) for p in row.places) == expected


def test_long_matches_chain_into_template_spans(spark):
    text = "intro Licensed under the (old) Apache License, Version 2.0. then Licensed under CC BY-NC 4.0. end"
    spans = scan_licenses(spark.createDataFrame([(text,)], "text string")).select("scan.spans").first().spans
    assert {"apache-2.0", "cc-by-nc-4.0"} <= {s.label for s in spans} and all(0.75 <= s.cover <= 1 for s in spans)


# token files

def test_blocks_round_trip_and_damage_is_found():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 60_000, n).astype(np.uint32) % k for n, k in ((4096, 70_000), (1, 9), (0, 9), (3000, 5), (4096, 300))]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(range_coder.decode_blocks(coded), blocks))
    assert len(coded[3]) < 3000
    with pytest.raises(ValueError):
        range_coder.decode_blocks([coded[0][:-40] + bytes(40)])


def test_crcs_of_pieces_join():
    data = random.Random(4).randbytes(5000)
    assert joined_crc([(zlib.crc32(data[a:b]), b - a) for a, b in ((0, 7), (7, 7), (7, 4000), (4000, 5000))]) == zlib.crc32(data)


def test_token_files_hold_every_document_in_order(spark, awkward, tmp_path):
    path = str(tmp_path / "tokens")
    write_token_files(awkward, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    found = document_digests(read_token_files(spark, path)).join(part_starts(spark, path), "part").collect()
    given = texts_of(awkward)
    expected = Counter((d, zlib.crc32(i.tobytes()), len(i)) for (d, _, _), i in zip(given, library_ids("byte_bpe_50k.json", [t for _, t, _ in given], 0)))
    assert Counter((r.doc, r.ids_crc32, r.n_tokens) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r.part_start + r.place):
        assert r.part_start + r.place == at
        at += r.n_tokens
    ids = [r.doc for r in sorted(found, key=lambda r: r.part_start + r.place)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


# packing

def test_pieces_cover_documents_and_fill_sequences(spark, awkward):
    rows = harmonic_packing(awkward, public_tokenizers.path("word_bpe_49k.json")).collect()
    given = texts_of(awkward)
    expected = Counter((d, i.tobytes()) for (d, _, _), i in zip(given, library_ids("word_bpe_49k.json", [t for _, t, _ in given], 1)))
    total = sum(len(b) // 4 * n for (_, b), n in expected.items())
    assert sum(r.length for r in rows) == total
    single = [d for d, n in Counter(d for d, _ in expected.elements()).items() if n == 1]
    for doc in single:
        own = sorted((r for r in rows if r.doc == doc), key=lambda r: r.start)
        assert (doc, b"".join(bytes(r.ids) for r in own)) in expected
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) <= 2048
    assert harmonic_packing(awkward.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# toxicity

def test_classifier_separates_held_out_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices(["the", "an", "er", "on", "ou", "in"], k=2)) for _ in range(50)]
    rows = []
    for i in range(500):
        own = rng.choices(words, k=rng.randint(3, 80))
        if i % 5 == 0:
            own.insert(rng.randrange(len(own)), rng.choice(["worthless", "pathetic", "trash"]))
        rows.append((i, " ".join(own), i % 5 == 0))
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows] + [(900, None, "a"), (None, "x", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scored = toxicity.toxicity_scores(docs, labels, usable=F.col("doc_id") % 4 != 0).select("row.doc_id", "score").collect()
    assert len(scored) == 502 and all(0 <= r.score <= 1 for r in scored)
    held = [(r.score >= 0.5, rows[r.doc_id][2]) for r in scored if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 4 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    blank = toxicity.toxicity_scores(docs, labels.limit(0), usable=F.lit(True)).select("score").distinct().collect()
    assert [r.score for r in blank] == [0.5]
    assert toxicity.toxicity_scores(docs.limit(0), labels, usable=F.lit(True)).count() == 0


# exact deduplication

def expected_verdicts(given):
    groups = {}
    for d, t, _ in given:
        groups.setdefault(t.encode().lower(), []).append(d)
    best = {t: max(g, key=lambda d: (d is not None, d)) for t, g in groups.items()}
    return Counter((d, best[t.encode().lower()], len(groups[t.encode().lower()])) for d, t, _ in given), len(groups)


@F.pandas_udf(T.StringType())
def poor_digest(text):
    return text.map(lambda t: "same")


@pytest.mark.parametrize("digest", [exact_dedup.text_sha256, poor_digest])
def test_exact_verdicts_also_when_digests_collide(awkward, digest):
    found = exact_dedup.stream_exact_dedup(awkward, digest=digest).collect()
    expected, groups = expected_verdicts(texts_of(awkward))
    assert Counter((r.id, r.keep_id, r.group_size) for r in found) == expected
    assert sum(r.kept for r in found) == groups and all(r.id == r.keep_id for r in found if r.kept)


def test_exact_survivors_keep_all_columns(awkward):
    rows = exact_dedup.exact_survivors(awkward)
    assert rows.columns == awkward.columns and rows.count() == expected_verdicts(texts_of(awkward))[1]
    assert exact_dedup.exact_survivors(awkward.limit(0)).count() == 0


# near duplicates

def similarity(x, y):
    """Probability Jaccard similarity of two Counters."""
    if x.keys().isdisjoint(y):
        return 0.0
    kinds = Counter((x[e], y[e]) for e in x | y)
    return sum(n / sum(m * max(u / p, v / q) for (u, v), m in kinds.items()) for (p, q), n in kinds.items() if p and q)


def brute_classes(given):
    texts = [t.encode() for _, t, _ in given]
    owner, hashes, counts = near_dup.weighted(*near_dup.shingles(texts))
    sets = [Counter(dict(zip(hashes[owner == i].tolist(), counts[owner == i].tolist()))) for i in range(len(texts))]
    top = list(range(len(texts)))

    def find(i):
        return i if top[i] == i else find(top[i])

    for i in range(len(texts)):
        for j in range(i):
            alike = texts[i] == texts[j] if not (len(sets[i]) and len(sets[j])) else similarity(sets[i], sets[j]) >= 0.8 - 1e-9
            if alike:
                top[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_probability_jaccard_by_definition(spark):
    rng = random.Random(6)
    pairs = [tuple(dict(Counter(rng.choices(range(-6, 6), k=rng.randint(1, 25)))) for _ in range(2)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a map<int,int>, b map<int,int>")
    for r in df.withColumn("s", near_dup.probability_jaccard(F.col("a"), F.col("b"))).collect():
        x, y = Counter(r.a), Counter(r.b)
        plain = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x | y) for d in x if d in y)
        assert r.s == pytest.approx(plain) and similarity(x, y) == pytest.approx(plain)


def test_near_misses_with_repeats_make_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    own = lambda i: " ".join(words + ["again and again and again and again"] + [f"n{i}x{j}" for j in range(12)])
    df = spark.createDataFrame([(i, own(i)) for i in range(40)], "doc_id long, text string")
    assert near_dup.near_duplicates(df).where("class_size = 1 and kept").count() == 40


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(7)
    given = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for copy in range(rng.choice([1, 2, 9])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 3, 6])):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10_000)}"
            given.append((len(given), " ".join(own) + (" again and again" * rng.choice([0, 4])), "s"))
    df = spark.createDataFrame(given, "doc_id long, text string, class_id string").repartition(4)
    found = {r.id: r for r in near_dup.near_duplicates(df).collect()}
    top = brute_classes(given)
    for i, _, _ in given:
        members = [j for j, t in enumerate(top) if t == top[i]]
        assert (found[i].class_id, found[i].class_size, found[i].kept) == (min(members), len(members), i == min(members))


def test_near_survivors_with_awkward_rows(awkward):
    classes = len(set(brute_classes(texts_of(awkward))))
    rows = near_dup.near_survivors(awkward)
    assert rows.columns == awkward.columns and rows.count() == classes
    assert near_dup.near_survivors(awkward.limit(0)).count() == 0


# sharding

def test_hypergeometric_draws_have_the_right_mean_and_exact_margins():
    rng = random.Random(8)
    draws = [hypergeometric(30, 100, 20, rng.random()) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.15) and np.var(draws) == pytest.approx(20 * .3 * .7 * 80 / 99, rel=0.1)
    parts, shards = [5, 0, 17, 100], [41, 41, 40]
    matrix = communication_matrix(parts, shards, 1)
    assert [sum(r) for r in matrix] == parts and [sum(c) for c in zip(*matrix)] == shards
    assert hypergeometric(10**10, 24 * 10**10, 10**6, 0.5) == pytest.approx(10**6 / 24, rel=0.01)


def test_shards_are_even_and_slots_gapless(awkward):
    rows = hypergeometric_shards(awkward, shards=5).select("row.doc_id", "row.text", "shard", "slot").collect()
    given = texts_of(awkward)
    assert Counter((r.doc_id, r.text or "") for r in rows) == Counter((d, t) for d, t, _ in given)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 5
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert hypergeometric_shards(awkward.limit(0)).count() == 0


# mixing

def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(30)) or None, rng.choice(["b", "a", "a", "a", "c", None, "d"]), 1) for i in range(600)]
    rows += [(7, "same row twice", "tiny", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(3)
    found = mix_sources(df).select("row.doc_id", "row.source", "row.text", "size", "source_size", F.col("target"), "taken").collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while True:  # by the definition: what is above 3 times a source is shared again
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    taken = Counter()
    for r in found:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in names)
    again = mix_sources(df.repartition(5)).select("row.doc_id", "taken").collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in found)
    assert mix_sources(df.limit(0)).count() == 0


# nearest neighbours

def test_graph_finds_the_nearest(spark):
    rng = np.random.default_rng(10)
    vectors = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(900)]
    vectors[100:400] = [vectors[100]] * 300
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score double").repartition(3)
    found = graph_nearest(df, df.where("vec_id % 20 = 0"), neighbours=20).collect()
    data = np.array(vectors[:900], dtype=np.float64)
    hits = total = 0
    for q in range(0, 900, 20):
        scores = data @ data[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:20]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len(set(best) & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9 and {r.query_id for r in found} == set(range(0, 900, 20))
    assert graph_nearest(df.limit(0), df.limit(0)).count() == 0


# queries and pipeline

@pytest.mark.parametrize("name", ["op1_prefix_target_chat", "op6_stream_exact_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = entry.queries()[name](spark, SF)
    relation = con.execute(entry.oracle_sql()[name])
    order = [ours.columns.index(d[0]) for d in relation.description]
    assert Counter(tuple(r[i] for i in order) for r in ours.collect()) == Counter(relation.fetchall())


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = corpus_pipeline.stored(stage(spark, left, SF), name)
        assert after.columns == docs.columns
        before, rows = left.collect(), after.collect()
        kept = {r.doc_id for r in rows}
        if name == "exact_dedup":
            assert len(rows) == len({r.text.encode().lower() for r in before})
        if name == "near_dedup":
            top = brute_classes([(r.doc_id, r.text, r.source) for r in before])
            assert kept == {min(before[j].doc_id for j in range(len(top)) if top[j] == t) for t in set(top)}
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            assert len(kept & toxic) <= 1 and len(rows) > 0.8 * len(before)
        left = after
    mixed = corpus_pipeline.mixing(spark, left, SF)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.packing(spark, mixed, SF).where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packed} == Counter(r.doc_id for r in mixed.collect())
