"""Near duplicates by ProbMinHash sketches of weighted word shingles, banding and exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import contract
from .common import WORD_BYTES, flagged, mix64, row_key, rows_kept, runs, small_batches, stored, text_or_empty, tidy

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Equal registers a candidate needs before it is verified: 4.8 standard errors below the expected 0.8 of 144.
LEAST_EQUAL = 92
PAD = np.uint64(0x5851F42D4C957F2D)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end); words as in WORD_BYTES, A-Z lower-cased."""
    cleaned = [t.translate(WORD_BYTES) + b" " for t in texts]
    data = np.frombuffer(b"".join(cleaned), dtype=np.uint8)
    letter = data != 32
    edge = np.diff(letter.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(starts, np.cumsum([0, *map(len, cleaned)]))
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    place = np.zeros(len(data), dtype=np.int64)
    place[starts[0]:] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int((ends - starts).max())
    powers = np.multiply.accumulate(np.full(longest + 1, 0x100000001B3, dtype=np.uint64))
    place[~letter] = 0
    value = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[~letter] = 0
    return mix64(np.add.reduceat(value, starts)), bounds


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of five words; a text of one to four words has one shingle of all of them."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - bounds[:-1][owner]
    starts = np.flatnonzero((place <= counts[owner] - SHINGLE) | (place == 0))
    mixed = np.zeros(len(starts), dtype=np.uint64)
    last = bounds[1:][owner[starts]]
    for i in range(SHINGLE):
        at = starts + i
        word = np.where(at < last, words[np.minimum(at, len(words) - 1)], PAD) if len(words) else words
        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + word)
    return owner[starts], mixed


def weighted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(owner) else order
    return owner[new], hashes[new], np.diff(np.append(new, len(owner)))


def prob_min_hash(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """Sketches, one row per text: register k holds the shingle whose exponential arrival there is the earliest.

    Each shingle is a Poisson process of rate weight whose arrivals fall on random
    registers, both drawn from its hash alone. All shingles of a batch advance by one
    arrival per round; one is finished as soon as it is later than every register of
    its text. Two sketches agree in a register with the probability Jaccard similarity.
    """
    earliest = np.full(texts * REGISTERS, np.inf)
    sketch = np.zeros(texts * REGISTERS, dtype=np.uint64)
    time = np.zeros(len(owner))
    step = 0
    while len(owner):
        step = (step + 0x9E3779B97F4A7C15) % (1 << 64)
        draw = mix64(hashes + np.uint64(step))
        time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)) / weights
        slot = owner * REGISTERS + (mix64(draw) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        sketch[slot[won]] = hashes[won]
        latest = earliest.reshape(texts, REGISTERS).max(axis=1)
        go = time < latest[owner]
        owner, hashes, weights, time = owner[go], hashes[go], weights[go], time[go]
    return sketch.reshape(texts, REGISTERS)


SKETCH = "id long, key binary, digest string, sketch array<int>, bands array<long>, members array<int>, counts array<int>, plain boolean"


def sketch_batches(batches):
    """(id, key, text) -> sketch rows. `digest` names the multiset of shingles, of a text without words its bytes.

    `members` are the distinct shingles in 32 bits, `counts` how often each occurs; `plain` is a text without repeats.
    """
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        for part in runs(texts):
            owner, hashes, counts = weighted(*shingles(texts[part]))
            n = part.stop - part.start
            found = prob_min_hash(owner, hashes, counts.astype(float), n)
            wide = mix64(found.reshape(n, BANDS, ROWS) + np.arange(BANDS, dtype=np.uint64)[None, :, None])
            bands = np.zeros((n, BANDS), dtype=np.uint64)
            for i in range(ROWS):
                bands = mix64(bands * np.uint64(0x100000001B3) + wide[:, :, i])
            cuts = np.searchsorted(owner, np.arange(n + 1))
            digests, members, numbers, banded, plain = [], [], [], [], []
            for i in range(n):
                own = slice(cuts[i], cuts[i + 1])
                full = np.repeat(hashes[own], counts[own])
                digests.append(hashlib.sha256(full.tobytes() if len(full) else b"text:" + texts[part.start + i]).hexdigest())
                distinct, often = np.unique((full >> np.uint64(32)).astype(np.uint32).view(np.int32), return_counts=True)
                members.append(distinct)
                numbers.append(often.astype(np.int32))
                plain.append(bool((often == 1).all()))
                banded.append(bands[i].view(np.int64) if len(full) else [])
            small = (found >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[part], pa.int64()), pa.array(keys[part], pa.binary()), pa.array(digests), pa.array(list(small), pa.list_(pa.int32())),
                pa.array(banded, pa.list_(pa.int64())), pa.array(members, pa.list_(pa.int32())),
                pa.array(numbers, pa.list_(pa.int32())), pa.array(plain),
            ], names=["id", "key", "digest", "sketch", "bands", "members", "counts", "plain"])


def promising(a: Column, b: Column) -> Column:
    """Whether two sketches agree in enough registers to be worth the exact check."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return agree >= LEAST_EQUAL


def close_sets(a: Column, b: Column) -> Column:
    """Whether two arrays without repeats have a Jaccard similarity of 0.8 or more."""
    both = F.size(F.array_intersect(a, b))
    return both >= (SIMILARITY - 1e-9) * (F.size(a) + F.size(b) - both)


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def probability_jaccard(a: Column, b: Column) -> Column:
    """Exact probability Jaccard similarity of two maps of shingle counts.

    A common shingle of counts x and y adds 1 / sum(max(x' / x, y' / y)) over all shingles; shingles of
    the same two counts are one class, and only classes are compared with each other.
    """
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.shiftleft(count(x), 32).bitwiseOR(count(y))))

    def classes(all_: Column) -> Column:
        return F.transform(F.array_distinct(all_), lambda c: F.struct(
            F.shiftright(c, 32).cast("double").alias("x"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("double").alias("y"),
            F.size(F.filter(all_, lambda other: other == c)).cast("double").alias("n")))

    def total(found: Column) -> Column:
        wide = lambda c: F.aggregate(found, F.lit(0.0), lambda s, o: s + o["n"] * F.greatest(o["x"] / c["x"], o["y"] / c["y"]))
        common = lambda c: (c["x"] > 0) & (c["y"] > 0)
        return F.aggregate(found, F.lit(0.0), lambda s, c: s + F.when(common(c), c["n"] / wide(c)).otherwise(F.lit(0.0)))

    return bound(bound(both, classes), total)


def linked(u: str, v: str) -> Column:
    """The whole check of a pair inside a join: enough equal registers, then the exact similarity.

    Where no shingle repeats in either text all weights are one and the probability Jaccard similarity is the plain one.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    weights = lambda side: F.coalesce(c(side, "weights"), F.map_from_arrays(
        c(side, "members"), F.transform(c(side, "members"), lambda x: F.lit(1))))
    exact = F.when(c(u, "plain") & c(v, "plain"), close_sets(c(u, "members"), c(v, "members"))).otherwise(
        probability_jaccard(weights(u), weights(v)) >= SIMILARITY - 1e-9)
    return promising(c(u, "sketch"), c(v, "sketch")) & exact


def verified(pairs: DataFrame, busy: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle multisets have a probability Jaccard similarity of 0.8 or more."""
    p, a, b = pairs.alias("p"), busy.alias("a"), busy.alias("b")
    near = p.join(a, F.col("p.u") == F.col("a.node")).join(b, (F.col("p.v") == F.col("b.node")) & linked("a", "b"))
    return near.select("u", "v")


def open_members(shared: DataFrame, ties: DataFrame, busy: DataFrame) -> DataFrame:
    """The members, but for the hubs, of buckets that hold several parts; `main` is the part with most members there.

    A hub has been checked against its whole bucket, so it has no open pair.
    """
    parts = contract(ties)
    labelled = shared.join(parts.select(F.col("u").alias("node"), F.col("v").alias("top")), "node", "left").select(
        "bucket", "node", "hub", F.coalesce("top", "node").alias("part")).where("node <> hub")
    sizes = labelled.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("n", "part")).alias("main")).where("parts > 1")
    return stored(labelled.join(mixed.select("bucket", "main"), "bucket").join(busy, "node"), "near-open")


def open_pair(a: str, b: str) -> Column:
    """A pair of different parts in the first bucket the two share, near enough to be linked."""
    c = lambda side, name: F.col(f"{side}.{name}")
    first = F.element_at(F.filter(
        F.zip_with(c(a, "bands"), c(b, "bands"), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1)
    return (c(a, "bucket") == c(b, "bucket")) & (c(a, "part") != c(b, "part")) & (first == c(a, "bucket")) & linked(a, b)


def ties_to_main_part(members: DataFrame) -> DataFrame:
    """(u, v) for members with any link into the main part of a bucket: u is the main part, one row a member."""
    a, b = members.where("part <> main").alias("a"), members.where("part = main").alias("b")
    found = a.join(b, open_pair("a", "b"), "left_semi")
    return found.select(F.col("main").alias("u"), F.col("node").alias("v")).distinct()


def links_between_parts(members: DataFrame) -> DataFrame:
    """(u, v): every linked pair of members of different parts."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, open_pair("a", "b") & (F.col("a.node") < F.col("b.node"))).select(
        F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Verdict per row: (id, key, class_id, class_size, kept); `near_survivors` applies them.

    Texts of equal shingle multisets are one node; the sketches of nodes fall into 24 bands of
    6 registers. In a bucket every node is checked first against the hub, the node with the most
    company over all its buckets, which ties tight groups together without pairs. Only in buckets that still hold several
    components are nodes of different components compared: first each with the bucket's
    largest component until one link is found, then all that are still apart. A pair
    inside a component cannot change it, so no link between classes is lost. Components are the classes; class_id is the
    smallest id, and its row stays. Sketches and shingles move only for nodes that share a bucket.

    The sketch of a pair at similarity 0.8 meets in a band with probability 0.9993. Weights are
    the counts of a shingle. Null text is empty; texts without words are alike only
    if equal; texts of one to four words are one shingle. Null ids come first, repeated rows
    are one class of which one row stays, an empty table has no verdicts. Other columns of `docs` are not
    read, so none can clash.
    """
    rows = small_batches(docs).select(F.col(doc).cast("long").alias("id"), row_key(doc, text).alias("key"), text_or_empty(text).alias("text"))
    features = stored(rows.mapInArrow(tidy(sketch_batches), SKETCH).withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    copies = stored(features.groupBy("digest").agg(
        F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")), "near-copies")
    nodes = copies.select(F.col("first.row").alias("node"))

    banded = features.select(F.col("row").alias("node"), "bands").join(nodes, "node")
    placed = banded.select("node", F.explode("bands").alias("bucket"))
    filled = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    company = stored(placed.join(filled, "bucket"), "near-buckets")
    weight = company.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = company.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("node"))).alias("most"))
    shared = stored(company.join(hubs, "bucket").select("bucket", "node", (-F.col("most")["col2"]).alias("hub")), "near-shared")
    wanted = shared.select("node").distinct()
    # Counts go along only where a shingle repeats.
    weights = F.when(~F.col("plain"), F.map_from_arrays("members", "counts")).alias("weights")
    wide = features.select(F.col("row").alias("node"), "sketch", "bands", "members", weights, "plain")
    busy = stored(flagged(wide, F.col("node"), wanted).where("_flag").drop("_flag").join(wanted, "node"), "near-busy")

    stars = shared.where("node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    tied = stored(verified(stars, busy), "near-stars")
    joined = stored(tied.unionByName(ties_to_main_part(open_members(shared, tied, busy))), "near-joined")
    rest = links_between_parts(open_members(shared, joined, busy))
    components = contract(joined.unionByName(rest))

    tops = copies.join(components.select(F.col("u").alias("node"), "v"), F.col("first.row") == F.col("node"), "left").select(
        "digest", "first", "n", F.coalesce("v", "first.row").alias("top"))
    best = tops.groupBy("top").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    verdicts = tops.join(best, "top").select("digest", "best", "class_size")
    return features.select("id", "key", "row", "digest").join(verdicts, "digest").select(
        "id", "key", F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def near_survivors(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all their columns."""
    verdicts = stored(near_duplicates(docs, doc, text).select("key", "kept"), "near-verdicts")
    return rows_kept(docs, verdicts, doc, text)
