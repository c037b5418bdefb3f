"""Components of the Hamming graph over short codes, and splits that keep components whole."""

from __future__ import annotations

import hashlib
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import at_most, materialize, spread

CODE_LENGTH = 6
#: Roles of so many components are copied to the executors; then a component that holds nearly all names is no one task's work.
COPIED_ROLES = 100_000


def signatures(names: DataFrame, distance: int = 2, length: int = CODE_LENGTH) -> DataFrame:
    """Each row with its name's masked spellings: two names share one exactly when they differ in at most `distance` places."""
    spellings = []
    for hidden in combinations(range(length), distance):
        spellings.append(F.concat(*[F.lit("_") if i in hidden else F.substring("name", i + 1, 1) for i in range(length)]))
    return names.select("*", F.explode(F.array(*spellings)).alias("signature"))


def hamming_components(names: DataFrame, distance: int = 2, length: int = CODE_LENGTH) -> DataFrame:
    """(name, component) with the smallest member as component; names must be unique codes of that length.

    Everybody with one signature is near everybody else, so no pair is listed. Each name first joins the smallest name near it;
    signatures then tie these few groups instead of the names, and the ties are contracted by alternating large-star and
    small-star steps (a logarithmic number of rounds). A signature's names differ in the hidden places only, which bounds them.
    """
    checked = spread(materialize(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "name", F.when((F.col("n") == 1) & (F.length("name") == length), F.col("name")).otherwise(
            F.raise_error(F.concat(F.lit("unique codes of fixed length required: "), F.col("name"))))
    ).select("name")))
    together = Window.partitionBy("signature")
    near = signatures(checked, distance, length).select("name", F.min("name").over(together).alias("low"))
    grouped = spread(materialize(near.groupBy("name").agg(F.min("low").alias("low"))))
    ties = signatures(grouped, distance, length).select(F.col("low").alias("u"), F.min("low").over(together).alias("v"))
    stars = contract(ties.where("u <> v").distinct())
    return grouped.join(stars, grouped["low"] == stars["u"], "left").select("name", F.coalesce("v", "low").alias("component"))


def contract(edges: DataFrame) -> DataFrame:
    """Star per component: (u, v) with v the smallest node, for undirected edges (u, v)."""
    edges = materialize(edges)
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.any_value("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    to_low = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return to_low.unionByName(own).where("u <> v").distinct()


def component_fingerprints(components: DataFrame) -> DataFrame:
    """SHA-256 of a component's sorted names joined by bars, the same rule at every size.

    Names are range-partitioned by (component, name), so a giant component is spread over many sorted runs; one task then
    reads its runs in order as a stream of blocks of names, a running digest at a time. No row holds all names.
    """
    order = ["component", "name"]
    runs = components.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = materialize(runs.mapInArrow(_name_blocks, "component string, first string, names binary"))
    streamed = blocks.repartition("component").sortWithinPartitions("component", "first")
    return streamed.mapInArrow(_running_digests, "component string, fingerprint string")


# Bytes of joined names in one row, a longer single name aside; an Arrow batch holds up to 10,000 rows.
BLOCK_BYTES = 1 << 13


def _rows(batches, *columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _blocks(component: list, first: list, names: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(component, pa.string()), pa.array(first, pa.string()), pa.array(names, pa.binary())], names=["component", "first", "names"])


def _name_blocks(batches):
    """Sorted rows (component, name) as blocks (component, first name, names joined by bars)."""
    now, held, size = None, [], 0
    for component, name in _rows(batches, 0, 1):
        if held and (component != now or size > BLOCK_BYTES):
            yield _blocks([now], [held[0]], ["|".join(held).encode()])
            held, size = [], 0
        now = component
        held.append(name)
        size += len(name) + 1
    if held:
        yield _blocks([now], [held[0]], ["|".join(held).encode()])


def _running_digests(batches):
    """Blocks in order as one digest per component."""
    now, digest = None, None

    def row():
        return pa.record_batch([pa.array([now], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["component", "fingerprint"])

    for component, names in _rows(batches, 0, 2):
        if digest is None or component != now:
            if digest is not None:
                yield row()
            now, digest = component, hashlib.sha256()
        else:
            digest.update(b"|")
        digest.update(names)
    if digest is not None:
        yield row()


def component_split(components: DataFrame, previously_used: DataFrame) -> DataFrame:
    """Role per name: a component is reserved when its digest says so and no member was used before."""
    prints = component_fingerprints(components)
    used = components.join(previously_used.select("name").distinct(), "name", "left_semi").select("component").distinct().withColumn(
        "_used", F.lit(True)
    )
    reserve = (F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long") % 5 == 0) & F.col("_used").isNull()
    roles = prints.join(used, "component", "left").select(
        "component", "fingerprint", F.when(reserve, F.lit("reserved_evaluation")).otherwise(F.lit("development")).alias("role")
    )
    roles = materialize(roles)
    return components.join(F.broadcast(roles) if at_most(roles, COPIED_ROLES) else roles, "component").select("name", "component", "fingerprint", "role")
