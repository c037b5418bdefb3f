"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import prefix_target_examples, read_loss, read_turns
from .common import shared_path
from .divergence import divergence_audit
from .exact_dedup import stream_exact_dedup
from .graph_search import graph_nearest
from .impact_search import lexical_search
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import harmonic_packing
from .sharding import hypergeometric_shards
from .token_files import document_digests, part_starts, read_token_files, write_token_files
from .toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc):
    """Documents whose label is never learned: the checksum of the id as text, divisible by 5."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query
def op1_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of turns and loss text, read back from the formatted examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    examples = prefix_target_examples(turns.unionByName(extra))
    read = examples.select(
        "conversation", "example", F.length("formatted").alias("chars"), F.col("loss_start").isNotNull().alias("trains"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"), "formatted")
    whole = read.groupBy("conversation").agg(
        F.max_by("formatted", "example").alias("longest"), F.sum("chars").alias("formatted_chars"),
        F.sum(F.col("trains").cast("long")).alias("n_examples"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    spoken = F.transform(read_turns(F.col("longest")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole.withColumn("spoken", spoken).select(
        F.col("conversation").alias("conv_id"), F.size("spoken").cast("long").alias("n_turns"),
        F.sha2(F.array_join("spoken", ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


SQL["op1_prefix_target_chat"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 19 + length(role) + length(regexp_replace(replace(text, '\', '\-'), '</?s>|\[/?INST\]', '\0..', 'g')) AS chars,
         row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY nth) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY nth)) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR nth = n THEN upto + 3 ELSE 0 END)::BIGINT AS formatted_chars,
       sum((role = 'assistant')::INT)::BIGINT AS n_examples
FROM summed GROUP BY conv_id
"""


@query
def op2_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places, spans = F.col("scan.places"), F.col("scan.spans")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    # A base place is full cover of a short template; longer evidence counts more.
    best = F.greatest(
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["cover"] * (s["end"] - s["first"]) / (s["end"] - s["first"] + 2))), F.lit(0.0)),
        F.coalesce(F.array_max(F.transform(places, lambda p: (p["end"] - p["first"]) / (p["end"] - p["first"] + 2))), F.lit(0.0)))
    return scans.select(
        "row.doc_id", "scan.n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places["first"]).alias("first_word"),
        F.array_max(places["first"]).alias("last_word"), labels(places["label"]).alias("base_labels"),
        labels(F.concat(places["label"], spans["label"])).alias("labels"), best.alias("score"))


@query
def op3_mixing_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    digests = document_digests(read_token_files(spark, path))
    return digests.join(part_starts(spark, path), "part").select(
        F.col("doc").alias("doc_id"), (F.col("part_start") + F.col("place")).cast("long").alias("start"), "n_tokens", "ids_crc32")


@query
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = harmonic_packing(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        F.col("doc").alias("doc_id"), "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", F.col("slot").cast("long").alias("slot"))


@query
def op5_nb_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), usable=~held_out(F.col("doc_id")))
    return scored.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stream_exact_dedup(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL["op6_stream_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


@query
def op7_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query
def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return hypergeometric_shards(docs, shards=24).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_prefix_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op10_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_nearest(vectors, vectors.where("vec_id % 20 = 0"), neighbours=20)


@query
def op11_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op11_levelled_line_runs"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS nth
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, line, nth, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op12_sparse_group_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL["op12_sparse_group_vectors"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), vocab AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM vocab GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN vocab USING (lang, term) GROUP BY ALL
), sizes AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
         (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (v.total + 2)) // (l.n + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN vocab v USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN sizes s USING (lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op13_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


SQL["op13_norm_bucket_search"] = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL
), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM lengths, whole
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
