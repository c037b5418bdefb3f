"""Sequence matching with bounded mismatches, and motif matching.

Both joins are rewritten as equi-joins on keys, so that nothing is compared
with everything. The mismatch join works on the distinct windows of the
targets: a repeated window, however often it occurs, is compared once and only
meets its positions again in the output.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.dna import normalize_dna, reverse_complement
from ..functions.iupac import (
    PACKED, chars, is_subset, normalize_motif, packed_masks, packed_subset, restricted_keys, set_sizes, symbol_mask, valid_motif,
)
from ..functions.scan import TileScanner
from ..session import at_most, materialize


# Wanted length of a join key: long enough to be selective, short enough for few keys per window.
KEY_BASES = 9


def block_count(length: int, mismatches: int, key_bases: int) -> int:
    """Fewest blocks such that the exact ones jointly hold at least `key_bases` bases.

    With b blocks and k mismatches some b - k blocks are exact. b = k + 1 is the
    plain pigeonhole seed; more blocks give longer, more selective keys.
    """
    best = min(mismatches + 1, length)
    for blocks in range(best, length + 1):
        best = blocks
        if (blocks - mismatches) * (length // blocks) >= min(key_bases, length - mismatches):
            break
    return best


# Bases per packed integer: three bits each, 63 bits in all.
CHUNK = 21


def packed(digits: Column, length: int) -> list[Column]:
    """Octal digit text as integers of `CHUNK` digits, so that places compare by bit operations."""
    return [
        F.conv(F.substring(digits, at + 1, min(CHUNK, length - at)), 8, 10).cast("long") for at in range(0, length, CHUNK)
    ]


def digits_of(sequence: Column, other: str) -> Column:
    """A, C, G, T as 0..3 and anything else as `other` (4 in windows, 5 in queries: equal to nothing)."""
    return F.regexp_replace(F.translate(sequence, "ACGT", "0123"), "[^0-3]", other)


def block_masks(length: int, mismatches: int, key_bases: int) -> list[list[int]]:
    """Per key and packed integer, the bits of the blocks that key compares."""
    if length <= mismatches:
        return [[0] * len(range(0, length, CHUNK))]
    blocks = block_count(length, mismatches, key_bases)
    edges = [i * length // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - mismatches):
        wanted = {place for b in chosen for place in range(edges[b], edges[b + 1])}
        row = []
        for at in range(0, length, CHUNK):
            width = min(CHUNK, length - at)
            row.append(sum(7 << (3 * (width - 1 - k)) for k in range(width) if at + k in wanted))
        masks.append(row)
    return masks


def places_of_keys(length: int, mismatches: int, key_bases: int) -> list[list[int]]:
    """Per key, the places of a seed that it compares, at most 31 of them."""
    blocks = block_count(length, mismatches, key_bases)
    edges = [i * length // blocks for i in range(blocks + 1)]
    return [
        [place for b in chosen for place in range(edges[b], edges[b + 1])][:31] for chosen in combinations(range(blocks), blocks - mismatches)
    ]


def with_keys(rows: DataFrame, digits: Column, length: int, masks: list[list[int]], prefix: str) -> DataFrame:
    """One row per key: (`key_number`, `key`) plus the packed integers `prefix`0, `prefix`1, ..."""
    names = [f"{prefix}{i}" for i in range(len(masks[0]))]
    for name, value in zip(names, packed(digits, length)):
        rows = rows.withColumn(name, value)
    keys = F.array(*[
        F.xxhash64(F.lit(n), *[F.col(name).bitwiseAND(F.lit(bits)) for name, bits in zip(names, row)])
        for n, row in enumerate(masks)
    ])
    return rows.select("*", F.posexplode(keys).alias("key_number", "key"))


def verified_pairs(pairs: DataFrame, length: int, mismatches: int, masks: list[list[int]]) -> DataFrame:
    """Count mismatches of joined rows by bits; a pair stays under the first key it shares only."""
    chunks = range(len(masks[0]))
    for i in chunks:
        pairs = pairs.withColumn(f"d{i}", F.col(f"q{i}").bitwiseXOR(F.col(f"w{i}")))
    ones = lambda i: sum(1 << (3 * k) for k in range(min(CHUNK, length - i * CHUNK)))
    differing = lambda i: F.bit_count(
        F.expr(f"(d{i} | shiftright(d{i}, 1) | shiftright(d{i}, 2)) & {ones(i)}L")
    )
    first = None
    for n, row in enumerate(masks):
        shared = F.lit(True)
        for i, bits in enumerate(row):
            shared = shared & (F.col(f"d{i}").bitwiseAND(F.lit(bits)) == 0)
        first = F.when(shared, n) if first is None else first.when(shared, n)
    return (
        pairs.withColumn("mismatches", sum((differing(i) for i in chunks), F.lit(0)))
        .where((F.col("mismatches") <= mismatches) & (F.col("key_number") == first))
        .drop("key_number", "key", *[f"{c}{i}" for i in chunks for c in "qwd"])
    )


# Bases of a target that one tile owns.
TILE = 512


def tiles(targets: DataFrame, longest: int, flank: int, keys: list[str] = [], tile: int = TILE) -> DataFrame:
    """Targets as overlapping tiles: (keys, target_id, tile_start, lead, owned, tile_text).

    A tile owns the `owned` starts from `tile_start` on. Its text begins `lead` bases earlier and goes on behind, so that every
    placement of up to `longest` bases at an owned start lies in it with both flanks: a hit at a border is found by
    the owner of its start and by no other tile. The sequence is cut once; no row holds more than a tile.
    """
    halo = longest - 1 + flank
    tile = max(tile, halo)
    parts = F.regexp_extract_all(F.col("target_sequence"), F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))
    cut = targets.select(*keys, "target_id", parts.alias("_parts"))
    before = lambda i: F.when(i > 0, F.right(F.get("_parts", i - 1), F.lit(flank))).otherwise(F.lit(""))
    after = lambda i: F.substring(F.coalesce(F.get("_parts", i + 1), F.lit("")), F.lit(1), F.lit(halo))
    framed = F.transform("_parts", lambda part, i: F.struct(
        F.length(before(i)).alias("lead"), F.length(part).alias("owned"), F.concat(before(i), part, after(i)).alias("tile_text")))
    return cut.select(*keys, "target_id", F.posexplode(framed).alias("_number", "_tile")).select(
        *keys, "target_id", (F.col("_number").cast("long") * tile).alias("tile_start"), "_tile.*")


def windows(tile_rows: DataFrame, length: int) -> DataFrame:
    """Every owned placement of `length` bases as (columns of the tiles, at, window, window_digits); `at` counts in the tile's text."""
    last = F.least(F.col("lead") + F.col("owned"), F.length("tile_text") - length + 1) - 1
    return (
        tile_rows.where(last >= F.col("lead"))
        .withColumn("_digits", digits_of(F.col("tile_text"), "4"))
        .withColumn("at", F.explode(F.sequence(F.col("lead"), last)))
        .withColumn("window", F.expr(f"substring(tile_text, at + 1, {length})"))
        .withColumn("window_digits", F.expr(f"substring(_digits, at + 1, {length})"))
        .drop("_digits")
    )


def matched_windows(
    queries: DataFrame, window_rows: DataFrame, length: int, mismatches: int, key_bases: int = KEY_BASES, keys: list[str] = []
) -> DataFrame:
    """Distinct (keys, query, window, mismatches) within the bound. Queries all have `length` bases."""
    distinct_queries = queries.select(*keys, "query").distinct()
    distinct_windows = window_rows.select(*keys, "window").distinct()
    masks = block_masks(length, mismatches, key_bases)
    left = with_keys(distinct_queries, digits_of(F.col("query"), "5"), length, masks, "q")
    right = with_keys(distinct_windows, digits_of(F.col("window"), "4"), length, masks, "w")
    pairs = left.join(right, [*keys, "key_number", "key"])
    return verified_pairs(pairs, length, mismatches, masks).select(*keys, "query", "window", "mismatches")


def searched_lengths(sequences: DataFrame, sequence: Column, lengths: list[int] | None, mismatches: int) -> list[int]:
    """The lengths to search: by default those of the sequences; given ones must list them all, so that none is lost."""
    if mismatches < 0:
        raise ValueError("mismatches must not be negative")
    found = sequences.select(F.length(sequence).alias("n")).where("n > 0").distinct().collect()
    found = sorted(row.n for row in found)
    if found and found[0] <= mismatches:
        raise ValueError(f"{mismatches} mismatches leave nothing of a sequence of {found[0]} bases")
    if lengths is None:
        return found or [mismatches + 1]
    unlisted = sorted(set(found) - set(lengths))
    if unlisted:
        raise ValueError(f"sequences of lengths {unlisted} would be lost, only {sorted(lengths)} are searched")
    return lengths


# Lengths of the seeds that are searched. A longer query is found by the first bases of it, a shorter one by all of them.
SEEDS = (24, 16, 12, 8)


def seed_length(length: int) -> int:
    return next((n for n in SEEDS if n <= length), length)


def refused(condition: Column, name: Column | str, message: str, value: Column) -> Column:
    """`value`, or an error that names the row."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(condition, F.raise_error(F.concat(name.cast("string"), F.lit(f": {message}"))).cast("string")).otherwise(value)


def checked_query(sequence: Column, name: Column | str) -> Column:
    only = F.coalesce((sequence != "") & (F.translate(sequence, "ACGT", "") == ""), F.lit(False))
    return refused(~only, name, "must contain only A/C/G/T", sequence)


def checked_targets(targets: DataFrame, keys: list[str] = []) -> DataFrame:
    """Targets with normalised sequences; a repeated id raises ValueError now, a letter outside ACGTN when its row is read."""
    repeated = duplicate_targets(targets, keys).first()
    if repeated is not None:
        raise ValueError(f"repeated target id: {repeated['target_id']}")
    sequence = normalize_dna("target_sequence")
    only = F.coalesce((sequence != "") & sequence.rlike("^[ACGTN]+$"), F.lit(False))
    return targets.select(*keys, "target_id", refused(~only, "target_id", "must contain only A/C/G/T/N", sequence).alias("target_sequence"))


def differing_bases(left: Column, right: Column, longest: int) -> Column:
    """Places where two texts of equal length differ; a letter of `right` outside ACGT differs from all."""
    ones = sum(1 << (3 * k) for k in range(CHUNK))
    total = F.lit(0)
    for at in range(0, longest, CHUNK):
        piece = lambda text, other: F.coalesce(F.conv(digits_of(F.substring(text, at + 1, CHUNK), other), 8, 10).cast("long"), F.lit(0))
        d = piece(left, "5").bitwiseXOR(piece(right, "4"))
        total = total + F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseAND(F.lit(ones)))
    return total


def largest_group(rows: DataFrame, keys: list[str]) -> int:
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1


def enough_key_bases(strands: DataFrame, keys: list[str], key_bases: int) -> int:
    """Key length that leaves a window some chance pairs at most: one base more than the largest group of `keys` needs to tell its strands apart.

    Longer keys only cost more keys per strand and window, as each comes with a choice of blocks.
    """
    if not keys:
        return key_bases
    return min(key_bases, 1 + ceil(log(largest_group(strands, keys), 4)))


def placed_matches(
    strands: DataFrame, targets: DataFrame, lengths: list[int], mismatches: int, flank: int, keys: list[str], key_bases: int
) -> DataFrame:
    """(columns of strands, target_id, start, at, window, mismatches, tile_text) of all placements of `query` in the targets.

    Queries that share a seed length are searched together: the targets are read once per seed length (at most
    eleven, mostly one or two), whatever the number of query lengths, and the rest of a longer query is compared where its seed fits.
    """
    tile_rows = tiles(targets, max(lengths), flank, keys)
    place = ["target_id", "tile_start"]
    wanted = [n for n in lengths if n > 0]
    if not keys and at_most(strands, MAX_SCANNED_QUERIES):
        return _scan_tiles(strands.where(F.length("query").isin(wanted)), tile_rows, mismatches, key_bases)
    if keys and all(strands.schema[k].dataType == targets.schema[k].dataType for k in keys):
        fitting = strands.where(F.length("query").isin(wanted))
        largest = largest_group(fitting, keys)
        if largest <= MAX_GROUP_QUERIES:
            return _scan_groups(fitting, tile_rows, targets, mismatches, keys, min(key_bases, 1 + ceil(log(largest, 4))))
    parts = []
    for seed in sorted({seed_length(n) for n in lengths}):
        members = [n for n in lengths if seed_length(n) == seed]
        fitting = strands.where(F.length("query").isin(members)).withColumn("full", F.col("query")).withColumn("query", F.substring("full", 1, seed))
        window_rows = windows(tile_rows, seed)
        bases = enough_key_bases(fitting, keys, key_bases)
        if at_most(fitting, min(MAX_COPIED_QUERIES, MAX_COPIED_KEYS // len(block_masks(seed, mismatches, bases)))):
            found = _scan_windows(fitting, window_rows, seed, mismatches, keys, bases).drop("window")
        else:
            # Windows meet their pairs without their tile, which is fetched for the hits alone.
            slim = window_rows.select(*keys, *place, "at", "window")
            pairs = matched_windows(fitting, slim, seed, mismatches, bases, keys)
            found = slim.join(pairs.join(fitting, [*keys, "query"]), [*keys, "window"]).drop("window").join(tile_rows, [*keys, *place])
        found = found.withColumn("window", F.substring(F.col("tile_text"), F.col("at") + 1, F.length("full"))).where(F.length("window") == F.length("full"))
        if members != [seed]:
            found = found.withColumn("mismatches", differing_bases(F.col("full"), F.col("window"), max(members))).where(F.col("mismatches") <= mismatches)
        parts.append(found.withColumn("start", F.col("tile_start") + F.col("at") - F.col("lead")).drop("query", "owned", "lead", "tile_start").withColumnRenamed("full", "query"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hamming_matches(
    queries: DataFrame, targets: DataFrame, mismatches: int, lengths: list[int] | None = None, key_bases: int = KEY_BASES
) -> DataFrame:
    """All ungapped placements (target_id, start, window, query, mismatches) of `queries(query)` in `targets(target_id, target_sequence)`."""
    lengths = searched_lengths(queries, F.col("query"), lengths, mismatches)
    rows = queries.select(checked_query(F.col("query"), "query").alias("query")).distinct()
    found = placed_matches(rows, targets.select("target_id", "target_sequence"), lengths, mismatches, 0, [], key_bases)
    return found.select("target_id", "start", "window", "query", "mismatches")


def first_spacers(spacers: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row per distinct sequence with its first id; first = lowest `spacer_order`, else lowest id."""
    order = "spacer_order" if "spacer_order" in spacers.columns else "spacer_id"
    return (
        spacers.withColumn("spacer_sequence", checked_query(normalize_dna("spacer_sequence"), "spacer_id"))
        .groupBy(*keys, "spacer_sequence")
        .agg(F.min_by("spacer_id", order).alias("spacer_id"))
    )


def spacer_hits(
    spacers: DataFrame,
    targets: DataFrame,
    *,
    mismatches: int,
    flank_length: int,
    lengths: list[int] | None = None,
    keys: list[str] = [],
    key_bases: int = KEY_BASES,
) -> DataFrame:
    """Both-strand placements of spacers in targets, of any length, with flanks turned to the spacer's strand.

    spacers: (keys, spacer_id, spacer_sequence[, spacer_order]); targets: (keys,
    target_id, target_sequence). `lengths` are the spacer lengths to search,
    by default all that the spacers have; a spacer of a length not listed raises ValueError. `keys` are
    the columns within which spacers and targets belong together. A palindromic
    spacer is reported on both strands at weight 0.5 each. Refused with an error: spacer letters outside ACGT, target letters
    outside ACGTN, empty sequences, repeated target ids within their keys.
    """
    if flank_length <= 0:
        raise ValueError("flank_length must be positive")
    lengths = searched_lengths(spacers, normalize_dna("spacer_sequence"), lengths, mismatches)
    spacers = first_spacers(spacers, keys)
    turned = reverse_complement("spacer_sequence")
    strands = spacers.withColumn(
        "orientation_weight", F.when(turned == F.col("spacer_sequence"), 0.5).otherwise(1.0)
    ).withColumn(
        "side",
        F.explode(F.array(
            F.struct(F.lit("+").alias("strand"), F.col("spacer_sequence").alias("query")),
            F.struct(F.lit("-").alias("strand"), turned.alias("query")),
        )),
    ).select(*keys, "spacer_id", "spacer_sequence", "orientation_weight", "side.*")
    found = placed_matches(strands, checked_targets(targets, keys), lengths, mismatches, flank_length, keys, key_bases)
    length = F.length("query")
    plus = F.col("strand") == "+"
    left = F.expr(f"substring(tile_text, greatest(at - {flank_length}, 0) + 1, least(at, {flank_length}))")
    right = F.substring(F.col("tile_text"), F.col("at") + length + 1, F.lit(flank_length))
    return found.select(
        *keys,
        "spacer_id",
        "spacer_sequence",
        "target_id",
        F.col("start").cast("long").alias("start"),
        (F.col("start") + length).cast("long").alias("end"),
        "strand",
        F.col("mismatches").cast("long").alias("mismatches"),
        F.when(plus, F.col("window")).otherwise(reverse_complement("window")).alias("protospacer"),
        F.when(plus, left).otherwise(reverse_complement(right)).alias("upstream_flank"),
        F.when(plus, right).otherwise(reverse_complement(left)).alias("downstream_flank"),
        "orientation_weight",
    )


# Distinct spacer strands that may be copied to every executor, and their keys in all: some 200 bytes each.
MAX_COPIED_QUERIES = 200_000
MAX_COPIED_KEYS = 800_000


def _scan_windows(fitting, window_rows, length, mismatches, keys, key_bases) -> DataFrame:
    """Few queries (counted): their keys go to every executor and the targets are read once, unshuffled."""
    masks = block_masks(length, mismatches, key_bases)
    queries = with_keys(fitting, digits_of(F.col("query"), "5"), length, masks, "q")
    placed = with_keys(window_rows, F.col("window_digits"), length, masks, "w").drop("window_digits")
    pairs = placed.join(F.broadcast(queries), [*keys, "key_number", "key"])
    return verified_pairs(pairs, length, mismatches, masks)


# Distinct strands that one scan of the tiles holds.
MAX_SCANNED_QUERIES = 20_000


def _scan_tiles(strands: DataFrame, tile_rows: DataFrame, mismatches: int, key_bases: int) -> DataFrame:
    """Few queries without keys (counted): each batch of tiles is read once for all lengths, as an array of bases; a row is a place of a query."""
    queries = sorted(row.query for row in strands.select("query").distinct().collect())
    kinds = {f.name: f.dataType.simpleString() for f in tile_rows.schema}

    def scan(frames):
        scanner = TileScanner(queries, {n: places_of_keys(seed_length(n), mismatches, key_bases) for n in {len(q) for q in queries}}, mismatches)
        for frame in frames:
            tile, at, query, differing = scanner.places(frame["tile_text"].tolist(), frame["lead"].to_numpy(), frame["owned"].to_numpy())
            if not len(tile):
                continue
            texts = frame["tile_text"].to_numpy(dtype=object)[tile]
            words = lambda values: pd.Series(list(values), dtype=object)
            yield pd.DataFrame({
                "target_id": frame["target_id"].to_numpy()[tile], "start": frame["tile_start"].to_numpy()[tile] + at - frame["lead"].to_numpy()[tile],
                "at": at, "query": words(queries[q] for q in query), "mismatches": differing, "tile_text": words(texts),
                "window": words(text[a:a + len(queries[q])] for text, a, q in zip(texts, at, query)),
            })

    found = tile_rows.mapInPandas(
        scan, f"target_id {kinds['target_id']}, start long, at int, query string, mismatches long, tile_text string, window string")
    return found.join(F.broadcast(strands), "query")


# Strands of one group that a task may hold, targets of a task, and tiles that it reads at once.
MAX_GROUP_QUERIES = 200_000
TASK_TARGETS = 50_000
READ_TILES = 4_000


def group_numbers(columns: list[pa.Array], known: dict[tuple, int] | None = None) -> tuple[np.ndarray, dict[tuple, int]]:
    """Number of each row's values, -1 for a null or, with `known` numbers, for values without one; and the numbers."""
    encoded = [c.dictionary_encode() for c in columns]
    codes = np.stack([e.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for e in encoded], axis=1)
    distinct, row = np.unique(codes, axis=0, return_inverse=True)
    words = [e.dictionary.to_pylist() for e in encoded]
    values = [None if (d < 0).any() else tuple(w[i] for w, i in zip(words, d.tolist())) for d in distinct]
    if known is None:
        known = {v: n for n, v in enumerate(v for v in values if v is not None)}
    return np.array([known.get(v, -1) for v in values], np.int64)[row.reshape(-1)], known


def _scan_groups(strands: DataFrame, tile_rows: DataFrame, targets: DataFrame, mismatches: int, keys: list[str], key_bases: int) -> DataFrame:
    """Strands and tiles of one group of `keys` meet in a task, which reads the tiles as arrays of bases: tiles move once, windows never.

    A group of very many targets (counted) is dealt to several tasks, each with the group's strands. A task holds its strands
    and some tiles at a time.
    """
    counts = targets.groupBy(*keys).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    shares = F.lit(1)
    if (most or 0) > TASK_TARGETS:
        heavy = counts.where(F.col("count") > TASK_TARGETS).select(*keys, F.ceil(F.col("count") / TASK_TARGETS).cast("int").alias("_shares"))
        strands, tile_rows = (rows.join(F.broadcast(heavy), keys, "left") for rows in (strands, tile_rows))
        shares = F.coalesce("_shares", F.lit(1))
    given = [c for c in strands.columns if c not in [*keys, "_shares"]]
    named = [c for c in tile_rows.columns if c not in [*keys, "_shares"]]
    present = lambda rows: rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    left = present(strands).select(
        *keys, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share"), F.struct(*given).alias("_strand"))
    right = present(tile_rows).select(
        *keys, F.pmod(F.xxhash64("target_id", "tile_start"), shares).cast("int").alias("_share"), F.struct(*named).alias("_tile"))
    # As many tasks as the counts say: adaptive execution would see few bytes and leave the work to one of them.
    tasks = min(4096, max(strands.sparkSession.sparkContext.defaultParallelism, 1 + (total or 0) // TASK_TARGETS))
    shared = [*keys, "_share"]
    both = left.unionByName(right, allowMissingColumns=True).repartition(tasks, *shared).sortWithinPartitions(F.col("_tile").isNotNull())
    kept = [*[tile_rows.schema[c] for c in [*keys, "target_id"]], *[strands.schema[c] for c in given], tile_rows.schema["tile_text"]]
    out = StructType([*[StructField(f.name, f.dataType) for f in kept],
                      StructField("start", LongType()), StructField("at", IntegerType()), StructField("mismatches", LongType())])
    names = out.names

    def scan(batches):
        held, scanner, known, queries = [], None, {}, None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            held.extend(whole.filter(whole["_strand"].is_valid()).to_batches())
            tiles_here = whole.filter(whole["_tile"].is_valid())
            for at in range(0, len(tiles_here), READ_TILES):
                if scanner is None:
                    if not held:
                        return
                    table = pa.Table.from_batches(held).combine_chunks()
                    numbers, known = group_numbers([table[k].chunk(0) for k in shared])
                    queries = pa.Table.from_struct_array(table["_strand"].combine_chunks())
                    texts = queries["query"].to_pylist()
                    scanner = TileScanner(texts, {n: places_of_keys(seed_length(n), mismatches, key_bases) for n in {len(q) for q in texts}}, mismatches, numbers)
                some = tiles_here.slice(at, READ_TILES).combine_chunks()
                group, _ = group_numbers([some[k].chunk(0) for k in shared], known)
                some, group = some.filter(pa.array(group >= 0)).combine_chunks(), group[group >= 0]
                if not len(some):
                    continue
                tile = pa.Table.from_struct_array(some["_tile"].combine_chunks())
                text, place, query, differing = scanner.places(tile["tile_text"].to_pylist(), tile["lead"].to_numpy(), tile["owned"].to_numpy(), group)
                if not len(text):
                    continue
                mine, theirs = tile.take(pa.array(text)), queries.take(pa.array(query))
                columns = {k: some[k].take(pa.array(text)) for k in keys} | {c: theirs[c] for c in given} | {
                    "target_id": mine["target_id"], "start": pa.array(mine["tile_start"].to_numpy() + place - mine["lead"].to_numpy()),
                    "at": pa.array(place.astype(np.int32)), "mismatches": pa.array(differing), "tile_text": mine["tile_text"]}
                yield from pa.table({n: columns[n] for n in names}).combine_chunks().to_batches()

    found = both.mapInArrow(scan, out)
    return found.withColumn("window", F.expr("substring(tile_text, at + 1, length(query))"))


def duplicate_targets(targets: DataFrame, keys: list[str] = []) -> DataFrame:
    """Target ids that occur more than once; a hit search refuses them."""
    return targets.groupBy(*keys, "target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def canonical_hit_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy("spacer_id", "target_id", "start", "strand")


# Numbers of places that a key of a motif may have, most spelled places of two bases, and compared pairs that cost as much as one copied row.
KEY_PLACES = (2, 4, 6, 7, 8, 10, 12)
MAX_SPELLED = 8
PAIRS_PER_COPY = 16
# Packed integers that a join compares one by one.
MAX_WORDS = 4


def keyed_motifs(motifs: DataFrame, lengths: DataFrame, by_length: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_motif, _len, _one, places): the places of one base, counted, and the places of each motif that its key spells, as many as is cheapest for its length.

    motifs: (_motif, _len); lengths: (_len, strings); `by_length` marks tables of a row per length that are few enough to be copied. Only places of one or two bases are spelled, those of one first and of these
    the ones that most motifs of the length share, so that few sets of places (shapes) serve all. More places mean fewer pairs
    to compare and more shapes, for each of which every string is copied: both are counted for all motifs, and the least wins.
    """
    rows = materialize(motifs.withColumn("_size", set_sizes("_motif")))
    place = F.explode(F.sequence(F.lit(1), "_len")).alias("p")
    single = rows.select("_len", "_size", place).groupBy("_len", "p").agg(F.count_if(F.substring("_size", F.col("p"), F.lit(1)) == "1").alias("n"))
    order = single.groupBy("_len").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "p"))), lambda x: x["p"]).alias("_order"))
    of_size = lambda n: F.filter("_order", lambda p: F.substring("_size", p, F.lit(1)) == n)
    ranked = F.concat(of_size("1"), F.slice(of_size("2"), 1, MAX_SPELLED))
    one = F.length(F.translate("_size", "234", ""))
    rows = materialize(rows.join(by_length(order), "_len").select("_motif", "_len", ranked.alias("_ranked"), one.alias("_one")))
    places = lambda n: F.sort_array(F.slice("_ranked", 1, n))
    options = F.array(*[F.struct(F.lit(n).alias("n"), places(n).alias("places")) for n in KEY_PLACES])
    spelled = F.greatest(F.size("places") - F.col("_one"), F.lit(0))
    tried = rows.select("_len", "_one", F.explode(options).alias("x")).select("_len", "_one", "x.*").withColumn("_two", spelled)
    shapes = tried.groupBy("_len", "n", "places").agg(
        F.sum(F.pow(F.lit(2.0), "_two")).alias("spellings"), F.sum(F.pow(F.lit(0.25), F.size("places") - F.col("_two")) * F.pow(F.lit(0.5), "_two")).alias("share"))
    costs = shapes.groupBy("_len", "n").agg(F.count(F.lit(1)).alias("shapes"), F.sum("spellings").alias("spellings"), F.sum("share").alias("share"))
    cost = F.col("strings") * (F.col("shapes") + F.col("share") / PAIRS_PER_COPY) + F.col("spellings")
    best = costs.join(lengths, "_len").groupBy("_len").agg(F.min_by("n", F.struct(cost, F.col("n"))).alias("_n"))
    return rows.join(by_length(best), "_len").select("_motif", "_len", "_one", places(F.col("_n")).alias("places"))


def motif_match_join(concrete: DataFrame, motifs: DataFrame, sequence: str, motif: str) -> DataFrame:
    """Pairs (concrete string, motif) where the string spells the motif, of any length.

    A motif is keyed by its letters at some places (see `keyed_motifs`), all that are spelled there; strings are cut to the same places.
    Pairs of one key are verified over all letters by bits. The shapes of keys are copied where they are
    counted to be few, and joined by length otherwise.
    """
    spellings = lambda text: F.array_join(F.transform("places", lambda p: F.substring(text, p, F.lit(1))), "")
    strings = materialize(
        concrete.select(F.col(sequence).alias("_string")).distinct()
        .where(F.col("_string").rlike("^[ACGT]+$"))
        .withColumn("_len", F.length("_string"))
    )
    lengths = materialize(strings.groupBy("_len").agg(F.count(F.lit(1)).alias("strings")))
    listed = motifs.select(F.col(motif).alias("_motif")).distinct().where(valid_motif("_motif")).withColumn("_len", F.length(normalize_motif("_motif")))
    found, longest = lengths.agg(F.count(F.lit(1)), F.coalesce(F.max("_len"), F.lit(0))).first()
    by_length = F.broadcast if found <= MAX_COPIED_QUERIES else lambda rows: rows
    words = range(min(ceil(longest / PACKED), MAX_WORDS))
    keyed = materialize(keyed_motifs(listed.join(by_length(lengths), "_len", "left_semi"), lengths, by_length))
    word = lambda packed, i: F.coalesce(F.get(packed, F.lit(i)), F.lit(0))
    cut = spellings(normalize_motif("_motif"))
    spelled = F.explode(F.when(F.size("places") <= F.col("_one"), F.array(cut)).otherwise(restricted_keys(cut)))
    wanted = keyed.select("_motif", "_len", "places", packed_masks("_motif").alias("_outer"), spelled.alias("_key"))
    shapes = keyed.select("_len", "places").distinct()
    shapes = F.broadcast(shapes) if at_most(shapes, MAX_COPIED_QUERIES) else shapes
    placed = strings.withColumn("_inner", packed_masks("_string")).join(shapes, "_len").withColumn("_key", spellings(F.col("_string")))
    split = lambda rows, packed, prefix: rows.select("*", *[word(packed, i).alias(f"{prefix}{i}") for i in words])
    matched = F.lit(True)
    for i in words:
        matched = matched & (F.col(f"_i{i}").bitwiseAND(F.col(f"_o{i}")) == F.col(f"_i{i}"))
    left, right = split(placed, "_inner", "_i"), split(wanted, "_outer", "_o")
    if longest > PACKED * MAX_WORDS:
        matched = matched & packed_subset("_inner", "_outer")
    else:
        left, right = left.drop("_inner"), right.drop("_outer")
    pairs = left.join(right, ["_len", "places", "_key"]).where(matched)
    return pairs.select(F.col("_string").alias(sequence), F.col("_motif").alias(motif))


def motif_subset_join(candidates: DataFrame, golds: DataFrame, candidate: str, gold: str) -> DataFrame:
    """Pairs where every base set of the candidate lies inside the gold motif's.

    Concrete candidates are plain spellings of the gold. A degenerate one finds
    its golds by one of its own spellings and is then checked letter by letter.
    """
    left = materialize(candidates.select(F.col(candidate).alias("_c")).distinct().where(valid_motif("_c")))
    concrete = left.where(F.col("_c").rlike("^[ACGT]+$"))
    degenerate = left.where(~F.col("_c").rlike("^[ACGT]+$"))
    g = golds.select(F.col(gold).alias("_g")).distinct().where(valid_motif("_g"))
    exact = motif_match_join(concrete, g, "_c", "_g")
    # One spelling of a subset candidate spells the gold too, so it finds its golds by that spelling.
    lowest = F.array_join(F.transform(chars("_c"), lambda c: _lowest_base(symbol_mask(c))), "")
    spelled = degenerate.withColumn("_spell", lowest)
    linked = motif_match_join(spelled.select("_spell"), g, "_spell", "_g")
    loose = spelled.join(linked, "_spell").where(is_subset("_c", "_g")).select("_c", "_g")
    return exact.unionByName(loose).select(F.col("_c").alias(candidate), F.col("_g").alias(gold))


def _lowest_base(mask: Column) -> Column:
    return (
        F.when(mask.bitwiseAND(F.lit(1)) > 0, F.lit("A"))
        .when(mask.bitwiseAND(F.lit(2)) > 0, F.lit("C"))
        .when(mask.bitwiseAND(F.lit(4)) > 0, F.lit("G"))
        .otherwise(F.lit("T"))
    )
