"""Line runs, source divergence and lexical search against brute force, on nulls, ties, repeats, long texts and clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flankwise.llm import impact_search
from flankwise.llm.common import term_bytes, terms
from flankwise.llm.divergence import divergence_audit, document_vectors
from flankwise.llm.impact_search import item_of, lexical_search
from flankwise.llm.line_dedup import dedup_lines

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# lines

def line_rows(seed=5):
    rng = random.Random(seed)
    pool = [f"Line number {i} that is long enough to count here" for i in range(30)] + ["short", "", "  ", "x" * 39, "ü" * 40, "\x0b" + "y" * 40 + " \r"]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 9))]
        lines = [line.upper() if rng.random() < 0.2 else f" \t{line} " if rng.random() < 0.2 else line for line in lines]
        rows.append((i, "\n".join(lines)))
    hot = "This very line is found in every one of the documents"
    rows = [(i, hot + "\n" + t) for i, t in rows]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (200, None), (201, ""), (202, "\n"), (203, "\n".join(f"{hot} {i % 7}" for i in range(40_000)) + "\n" + hot)]
    return rows


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            holders[k].append(doc)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (key(line) in top and top[key(line)] != doc)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fan,hot_share", [(6, 2, 10_000), (1, 2, 10_000), (5, 3, 10_000), (4, 2, 20)])
def test_lines_go_but_in_the_largest_id(spark, monkeypatch, batches, fan, hot_share):
    from flankwise.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT_LINES", hot_share)
    rows = line_rows()
    clash = "doc_id long, text string, row string, hash string, doc long, body string, _flag int, kept string, batch int, drops int"
    df = spark.createDataFrame([(*r, "r", "h", 1, "b", 2, "k", 3, 4) for r in rows], clash).repartition(3)
    found = dedup_lines(df, batches=batches, fan=fan)
    assert found.select("row.*").columns == df.columns
    assert sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in found.select("row.doc_id", "kept", "n_lines", "n_dropped").collect()), key=str) == plain_lines(rows)


def test_lines_of_an_empty_table_and_of_short_lines_only(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (None, None)], "doc_id long, text string")
    assert dedup_lines(df.limit(0)).count() == 0
    assert sorted((r.kept, r.n_lines, r.n_dropped) for r in dedup_lines(df).collect()) == [("", 1, 0), ("a\nb", 2, 0), ("a\nb", 2, 0)]
    assert {r.kept for r in dedup_lines(df, min_chars=1, min_docs=2).collect()} == {"", "a\nb"}


def test_runs_leave_no_table_behind(spark):
    dedup_lines(spark.createDataFrame(line_rows(), "doc_id long, text string")).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


# divergence

def group_rows(seed=6, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)] + ["É", "é", "中文", "ABC"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s10", "é", None])
        shift = len(source or "") * 9
        text = " ".join(words[min(int(rng.expovariate(0.06)) + shift, 83)] for _ in range(rng.randint(0, 30))) + rng.choice(["", "9x!", " \x00 y"])
        rows.append((lang, source, text))
    return rows + [("en", "only-null", None), ("fr", "few", "a b c"), ("fr", "none", None), ("xx", "one", "a"), (None, "s1", "long " * 300_000 + "longer")]


def plain_audit(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        count[lang, source].update(found)
        df[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (sum(count[lang, s][x] for x in kept) + 2 * len(kept)) for t in kept} for s in sources}
        total = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (total[t] + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("held", [300_000, 40])
def test_divergence_equals_dense_integers(spark, monkeypatch, held):
    from flankwise.llm import divergence

    monkeypatch.setattr(divergence, "HELD", held)
    rows = group_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, count int, term string, p int").repartition(3)
    found = divergence_audit(df)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows)


def test_divergence_of_an_empty_table_and_without_kept_terms(spark):
    df = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two"), ("en", "c", None)], "lang string, source string, text string")
    assert divergence_audit(df.limit(0)).count() == 0
    assert sorted(map(tuple, divergence_audit(df).where("source = 'c'").collect())) == [("en", "c", "pair", "a", 0, 1), ("en", "c", "pair", "b", 0, 2)]


def test_document_vectors_equal_count_vectorizer(spark):
    rows = [(i, "en", s, re.sub(r"[^A-Za-zÉé中文 ]", " ", t or "")) for i, (_, s, t) in enumerate(group_rows(7, 150)[:150])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    split = df.select("doc_id", F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " +"), lambda w: w != "").alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="vector", minDF=10.0, vocabSize=2**31 - 1).fit(split)
    theirs = {r.doc_id: sorted(int(v) for v in r.vector.values) for r in model.transform(split).collect()}
    ours = document_vectors(df, min_docs=10).collect()
    assert {r.doc: sorted(r["values"]) for r in ours} == theirs
    used = {i for r in ours for i in r.indices}
    assert used == set(range(len(model.vocabulary))) and all(list(r.indices) == sorted(set(r.indices)) for r in ours)


# search

def plain_search(docs, items, top=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    vectors = [(doc, Counter(word.findall((text or "").translate(LOWER)))) for doc, text in docs]
    vectors = [v for v in vectors if v[1]]
    n, total = len(vectors), sum(v.total() for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(word.findall((text or "").translate(LOWER)))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, v in vectors:
            m = 10 + (90 * v.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * v[t]) // (1000 * v[t] + 8 * m)) for t in words if t in v)
            if score > 0:
                scored.append((-score, -(1 << 63) if doc is None else doc, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:top])]
    return sorted(out, key=str)


def search_rows(seed=8, n=700):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(300)] + ["É", "中文"]
    pick = lambda: words[min(int(rng.expovariate(0.02)), 301)]
    docs = [(i, " ".join(pick() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(pick() for _ in range(rng.randint(1, 25)))) for i in range(30)]
    docs += [(1000 + i, items[1][1]) for i in range(15)] + [(2000 + i, items[2][1] + " " + items[3][1].upper()) for i in range(4)]
    docs += [(None, items[1][1]), (5, docs[5][1]), (3000, None), (3001, "?!"), (3002, "t1 t2 " * 100_000 + items[4][1])]
    return docs, items + [(40, None), (41, "nowhere-found"), (41, "t7"), (None, "t3 t4"), (42, "t1 T1 t1")]


@pytest.mark.parametrize("bucket,block", [(2048, 1000), (16, 1000), (64, 7)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(impact_search, "BUCKET", bucket)
    docs, items = search_rows()
    left = spark.createDataFrame([(*d, "x", 1, 2.0) for d in docs], "doc_id long, text string, item string, k int, norm double").repartition(3)
    right = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    found = lexical_search(left, right, block_items=block)
    assert sorted(((r["item"], r["rank"], r.doc, r.score) for r in found.collect()), key=str) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search(docs.limit(0), items).count() == 0 == lexical_search(docs, items.limit(0)).count() == lexical_search(docs.where("doc_id = 2"), items).count()
    assert [tuple(r) for r in lexical_search(docs, items).select("item", "rank", "doc").collect()] in ([(1, 1, 1)], [])


def test_bounds_lose_nothing_and_prune():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 30, 500)
    ids = np.concatenate([np.sort(rng.choice(400, s, replace=False)) for s in sizes]).astype(np.int32)
    impacts = rng.integers(1, 10**6, sizes.sum())
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, offsets[:-1]))
    bucket = impact_search.Bucket(np.arange(500), norms, ids, impacts, offsets)
    pruned = 0
    for _ in range(40):
        n = rng.integers(1, 40)
        item = item_of(list(rng.choice(400, n, replace=False)), list(rng.integers(0, 26_000, n)))
        dense = np.zeros(400, np.int64)
        dense[item.ids] = item.weights
        exact = bucket.scores(np.arange(500), dense)
        least = np.sort(exact)[-10]
        kept = bucket.survivors(item, float(least))
        assert set(np.flatnonzero(exact >= least)) <= set(kept) and item.norm * bucket.longest >= exact.max() * (1 - 1e-9)
        pruned += 500 - len(kept)
    assert pruned > 40 * 100


def test_terms_are_cut_between_terms():
    table = term_bytes("ab")
    text = ("ab c" * 50 + "É" * 30 + " a").encode()
    assert [t for piece in terms(text, table, 7) for t in piece] == text.translate(table).split()


@pytest.mark.parametrize("name,columns", [
    ("op11_levelled_line_runs", {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}),
    ("op12_sparse_group_vectors", {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}),
    ("op13_norm_bucket_search", {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}),
])
def test_registered_queries_equal_their_sql(spark, name, columns):
    ours = entry.queries()[name](spark, SF)
    assert dict(ours.dtypes) == columns
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in theirs.description]
    assert sorted((tuple(r[c] for c in order) for r in ours.collect()), key=str) == sorted(theirs.fetchall(), key=str)
