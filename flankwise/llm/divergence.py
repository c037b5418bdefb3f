"""Divergence of sources inside a language, from exact sparse term vectors."""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_position
from .common import row_key, small_batches, stored, term_bytes, terms, text_or_empty, tidy

LETTERS = term_bytes(string.ascii_lowercase)
#: Smoothing and scale of a term's share.
PRIOR, SCALE = 2, 1_000_000_000
#: Entries (group, term) or pairs that a task sums up before it passes them on.
HELD = 300_000
#: Up to so many groups their totals are copied to all tasks; more are joined.
COPIED_GROUPS = 50_000

SUMS = "lang string, source string, term string, count bigint, docs bigint"
PAIRS = "lang string, a string, b string, value bigint"


def vector(text: bytes) -> Counter:
    """A document's sparse term vector."""
    counts: Counter = Counter()
    for piece in terms(text, LETTERS):
        counts.update(piece)
    return counts


def _sums(held: dict) -> pa.RecordBatch:
    columns = ([], [], [], [], [])
    for (lang, source), (counts, docs, n) in held.items():
        for name, entries in ((None, {None: (0, n)}), ("", {t: (c, docs[t]) for t, c in counts.items()})):
            for term, (count, seen) in entries.items():
                for column, value in zip(columns, (lang, source, term, count, seen)):
                    column.append(value)
    return pa.record_batch([
        pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()),
        pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "source", "term", "count", "docs"])


@tidy
def add_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' vectors, summed per (lang, source) inside the task: term counts and documents per term.

    A row without a term counts the documents of its group. Sums go on when HELD entries are held.
    """
    held: dict = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts, docs, n = held.get((lang, source), (Counter(), Counter(), 0))
            size -= len(counts)
            own: set = set()
            for piece in terms(text.as_buffer().to_pybytes(), LETTERS):
                counts.update(piece)
                own.update(piece)
            docs.update(own)
            held[lang, source] = counts, docs, n + 1
            size += len(counts)
            if size > HELD:
                yield _sums(held)
                held, size = {}, 0
    if held:
        yield _sums(held)


def group_sums(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): the sum of the documents' vectors per group, stored; null term: documents of the group."""
    read = small_batches(docs).select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).alias("text"))
    parts = read.mapInArrow(add_vectors, SUMS)
    return stored(parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "audit-sums")


def vocabulary(sums: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, docs): each language's terms in at least `min_docs` of its documents, none cut by their number."""
    found = sums.where("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
    return found.where(F.col("docs") >= min_docs)


def document_vectors(docs: DataFrame, min_docs: int = 10, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc, row_key, lang, indices, values): the exact sparse vector of each document over its language's vocabulary.

    Indices number a language's terms from 0 in digest order, without gaps or limit. Documents without kept terms have empty
    arrays; rows equal in id and text have one vector row. The vocabulary stays a distributed table.
    """
    index = dense_position(vocabulary(group_sums(docs, text, lang, source), min_docs), ["term"], ["lang"], "index").select("lang", "term", "index")

    @tidy
    def count(batches):
        for batch in batches:
            rows = [(key, own, t, c) for key, own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
                    for t, c in vector(body.as_buffer().to_pybytes()).items()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string()),
                                   pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[3] for r in rows], pa.int64())],
                                  names=["row_key", "lang", "term", "count"])

    rows = small_batches(docs).select(F.col(doc).alias("doc"), row_key(doc, text).alias("row_key"), text_or_empty(lang).alias("lang"), text_or_empty(text).alias("text"))
    entries = rows.select("row_key", "lang", "text").mapInArrow(count, "row_key binary, lang string, term string, count bigint")
    held = entries.distinct().join(index, ["lang", "term"]).groupBy("row_key", "lang").agg(F.array_sort(F.collect_list(F.struct("index", "count"))).alias("held"))
    return rows.select("doc", "row_key", "lang").distinct().join(held, ["row_key", "lang"], "left").select(
        "doc", "row_key", "lang", F.coalesce("held.index", F.array().cast("array<bigint>")).alias("indices"),
        F.coalesce("held.count", F.array().cast("array<bigint>")).alias("values"))


def share(count: str, total: str, terms_kept: str = "v") -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), exact; null where no term is kept."""
    return F.expr(f"CASE WHEN {terms_kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(20,0)) * CAST({count} + {PRIOR} AS DECIMAL(18,0))) "
                  f"div CAST({total} + {PRIOR} * {terms_kept} AS DECIMAL(20,0)) END")


def distance(p: str, q: str) -> str:
    """f of two shares; both are at most SCALE + 1, so 64 bits hold it."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_sums(sources: np.ndarray, p: np.ndarray, p0: np.ndarray, term: np.ndarray, n_terms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per group the later groups that share terms with it, and what these terms add beyond the one-sided sums."""
    groups, place = np.unique(sources, return_inverse=True)
    share, absent, has = (np.zeros((n_terms, len(groups)), np.int64) for _ in range(3))
    share[term, place], absent[term, place], has[term, place] = p, p0, 1
    for a in range(len(groups) - 1):
        own = np.flatnonzero(has[:, a])
        pa_, pa0 = share[own, a, None], absent[own, a, None]
        pb, pb0, both = share[own, a + 1:], absent[own, a + 1:], has[own, a + 1:] > 0
        pb, pb0 = np.where(both, pb, 1), np.where(both, pb0, 1)
        value = np.where(both, _f(pa_, pb) - _f(pa_, pb0) - _f(pa0, pb) + _f(pa0, pb0), 0).sum(axis=0)
        met = np.flatnonzero(both.any(axis=0))
        yield groups[a], groups[a + 1:][met], value[met]


@tidy
def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) per task from rows (lang, entries [source, p, p0]): pairs are summed here, never listed per term."""
    held: defaultdict = defaultdict(int)

    def rows():
        return pa.record_batch([pa.array([k[i] for k in held], pa.string()) for i in range(3)] + [pa.array(list(held.values()), pa.int64())],
                               names=["lang", "a", "b", "value"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        entries = lists.values
        names = entries.field("source").dictionary_encode()
        # Codes follow the names' byte order, so that a < b holds for the pair.
        known = names.dictionary.to_pylist()
        order = sorted(range(len(known)), key=lambda i: known[i].encode())
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        code = rank[names.indices.to_numpy(zero_copy_only=False)]
        name = [known[i] for i in order]
        p, p0 = entries.field("p").to_numpy(), entries.field("p0").to_numpy()
        start = 0
        while start < len(langs):
            end = start + 1
            while end < len(langs) and end - start < 256 and langs[end] == langs[start] and offsets[end + 1] - offsets[start] <= 1 << 15:
                end += 1
            part = slice(offsets[start], offsets[end])
            term = np.repeat(np.arange(end - start), np.diff(offsets[start:end + 1]))
            for a, others, values in _pair_sums(code[part], p[part], p0[part], term, end - start):
                for b, value in zip(others.tolist(), values.tolist()):
                    held[langs[start], name[a], name[b]] += value
            if len(held) > HELD:
                yield rows()
                held.clear()
            start = end
    if held:
        yield rows()


def divergence_audit(
    docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's terms lie from other sources and from its language.

    Part `pair`: every other source of the language, by the summed distance f over all kept terms. Part `term`: the `top` kept
    terms that the source uses more than its language. Terms are runs of letters and non-ASCII characters, A-Z lower-cased;
    a language keeps the terms in at least `min_docs` of its documents, however many. f compares smoothed shares in
    integers; sums over terms that only one or neither of two sources has come from histograms of counts, so only terms of both are
    visited, inside tasks that pass on one sum per pair.

    Null text, lang and source are ''. Groups without terms take part. Repeated rows count again; a language of one source has no
    pairs; an empty table gives an empty result. Other columns are not read. Texts of any length are read in pieces.
    """
    sums = group_sums(docs, text, lang, source)
    kept_terms = stored(vocabulary(sums, min_docs), "audit-terms")
    kept = stored(sums.where("term is not null").drop("docs").join(kept_terms.drop("docs"), ["lang", "term"]), "audit-kept")
    langs = kept_terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))
    groups = sums.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("p0", share("0", "n")), "audit-groups")
    few = F.broadcast if groups.count() <= COPIED_GROUPS else lambda df: df

    shares = kept.join(few(groups), ["lang", "source"]).withColumn("p", share("count", "n"))
    window = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).cast("int")
    over = shares.withColumn("q", share("total", "lang_n")).where("p > q").withColumn("value", F.expr(distance("p", "q")))
    term = over.withColumn("rank", window(F.desc("value"), "term")).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    listed = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where(F.size("entries") > 1)
    met = listed.select("lang", "entries").mapInArrow(shared_terms, PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")).groupBy("lang", "source").agg(
        F.collect_list(F.struct("p", "times")).alias("seen"))
    side = stored(groups.join(histogram, ["lang", "source"], "left").select(
        "lang", "source", "v", "k", "p0", F.coalesce("seen", F.array().cast("array<struct<p: bigint, times: bigint>>")).alias("seen")), "audit-sides")
    left = side.select("lang", "v", *[F.col(c).alias(f"a_{c}") for c in ("source", "k", "p0", "seen")])
    right = side.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "k", "p0", "seen")])
    # The result itself has a row per pair of sources of a language.
    pairs = left.join(few(right), "lang").where("a_source < b_source").join(
        met.withColumnsRenamed({"a": "a_source", "b": "b_source"}), ["lang", "a_source", "b_source"], "left")
    alone = lambda seen, p0: f"aggregate({seen}, 0L, (s, x) -> s + x.times * ({distance('x.p', p0)}))"
    value = F.when(F.col("v") > 0, F.expr(
        f"{alone('a_seen', 'b_p0')} + {alone('b_seen', 'a_p0')} + (v - a_k - b_k) * ({distance('a_p0', 'b_p0')}) + coalesce(both, 0L)")).otherwise(F.lit(0))
    valued = pairs.select("lang", "a_source", "b_source", value.cast("long").alias("value"))
    each = valued.select("lang", F.explode(F.array(
        F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")),
        F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    pair = each.withColumn("rank", window(F.desc("value"), "item")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pair.unionByName(term)
