"""Inputs derived from the given tables: sequences, matrices, motifs and systems.

A system is ten suppliers with their two hundred parts, so that the number of
systems, and not the size of one, grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..session import spread

PARTS_PER_SUPPLIER = 20
SUPPLIERS_PER_SYSTEM = 10
SPACER_LENGTH = 12
FLANK_LENGTH = 10
LENGTHS = [3, 4]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna_of(prefix: str, key: Column) -> Column:
    """32 bases from the digest of a key."""
    digest = F.md5(F.concat(F.lit(prefix), key.cast("string")))
    return F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT")


def nibble(prefix: str, key: Column, place: int | Column) -> Column:
    """0..15 from one digit of the digest of a key."""
    digest = F.md5(F.concat(F.lit(prefix), key.cast("string")))
    place = F.lit(place) if isinstance(place, int) else place
    return F.instr(F.lit("0123456789abcdef"), F.substring(digest, place, F.lit(1))) - 1


def integer_divide(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("long")


def spacers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(
        integer_divide(s, SUPPLIERS_PER_SYSTEM).alias("system_id"),
        s.alias("spacer_id"),
        F.substring(dna_of("s", s), 1, SPACER_LENGTH).alias("spacer_sequence"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-base target per part: noise, the supplier's core (sometimes mutated), a flank motif, noise.

    Every fourth target is turned to the other strand.
    """
    p = F.col("p_partkey")
    supplier = integer_divide(p, PARTS_PER_SUPPLIER)
    core = F.substring(dna_of("s", supplier), 1, SPACER_LENGTH)
    core = F.when(p % 5 == 2, F.concat(F.substring(core, 1, 4), F.translate(F.substring(core, 5, 1), "ACGT", "CGTA"), F.substring(core, 6, 7))).otherwise(core)
    noise = dna_of("t", p)
    motif = F.when(p % 3 < 2, F.concat(F.substring(dna_of("p", p), 1, 1), F.lit("GG"))).otherwise(F.substring(dna_of("p", p), 1, 3))
    forward = F.concat(F.substring(noise, 1, 20), core, motif, F.substring(dna_of("u", p), 1, 29))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(
        integer_divide(p, PARTS_PER_SUPPLIER * SUPPLIERS_PER_SYSTEM).alias("system_id"),
        p.alias("target_id"),
        F.when(p % 4 == 1, reverse_complement(forward)).otherwise(forward).alias("target_sequence"),
    )


# Letters of a text read as bases; three rare ones are unknown bases.
TEXT_LETTERS = "abcdefghijklmnopqrstuvwxyz"
TEXT_BASES = "ACGTACGTACGTACGTNCGTACGNAN"


def text_bases(text: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), TEXT_LETTERS, TEXT_BASES)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as sequences of any length; texts without letters are none."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc_id").alias("target_id"), text_bases(F.col("text")).alias("target_sequence"), F.col("text").rlike("[A-Za-z]").alias("_some")).where("_some").drop("_some")


def passage_spacers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spacer of 20 to 32 bases from each benchmark passage; some with one base changed, some turned to the other strand."""
    i = F.col("item_id")
    bases = F.translate(text_bases(F.col("text")), "N", "A")
    core = F.substring(bases, (F.lit(5) + i % 11).cast("int"), (F.lit(20) + i % 13).cast("int"))
    changed = F.concat(F.substring(core, 1, 14), F.translate(F.substring(core, 15, 1), "ACGT", "CGTA"), F.substring(core, 16, 100))
    core = F.when(i % 3 == 1, changed).otherwise(core)
    rows = table(spark, sf_dir, "benchmark").where(F.length(bases) >= 48)
    return rows.select(i.alias("spacer_id"), F.when(i % 4 == 2, reverse_complement(core)).otherwise(core).alias("spacer_sequence"))


def system_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems dealt to a fixed number of tasks: their rows are few bytes, which adaptive execution would put into one task, and become many."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, "supplier").select(
        integer_divide(F.col("s_suppkey"), SUPPLIERS_PER_SYSTEM).alias("system_id")
    ).repartition(tasks, "system_id").distinct()


def matrix_of(key: Column, strong: Column) -> Column:
    """Unnormalised 10x4 matrix of small integers; where `strong`, G dominates at positions 2 and 3."""
    rows = []
    for i in range(10):
        cells = []
        for j in range(4):
            prefix, place = ("m", i * 4 + j + 1) if i < 8 else ("n", (i - 8) * 4 + j + 1)
            n = nibble(prefix, key, place)
            value = ((n + 1) * (n + 1)).cast("double")
            if i in (1, 2) and j == 2:
                value = value + F.when(strong, F.lit(4000.0)).otherwise(F.lit(0.0))
            cells.append(value)
        rows.append(F.array(*cells))
    return F.array(*rows)


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system_id, raw matrix, pam_side) of every system."""
    s = F.col("system_id")
    return system_ids(spark, sf_dir).select(
        "system_id", matrix_of(s, s % 3 != 0).alias("raw_matrix"), F.lit("downstream").alias("pam_side"),
        F.array(*[F.lit(n) for n in LENGTHS]).alias("pam_lengths"),
    )


def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold motifs per system: NGG and NGGN, or NAG and NRGN for every fifth system."""
    other = F.col("system_id") % 5 == 4
    return system_ids(spark, sf_dir).select("system_id", F.explode(F.when(
        other, F.array(F.lit("NAG"), F.lit("NRGN"))
    ).otherwise(F.array(F.lit("NGG"), F.lit("NGGN")))).alias("gold_pam"))


def micro(value: Column) -> Column:
    """Millionths as a long. The offset keeps exact halves away from the rounding edge."""
    return F.floor(value * 1_000_000 + 0.5003).cast("long")


# The same derivations for the checking engine.
SQL = {
    "dna": lambda prefix, key: f"translate(md5('{prefix}' || cast({key} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')",
    "revcomp": lambda s: f"reverse(translate({s}, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))",
    "nibble": lambda prefix, key, place: f"(instr('0123456789abcdef', substr(md5('{prefix}' || cast({key} as varchar)), {place}, 1)) - 1)",
    "micro": lambda value: f"cast(floor(({value}) * 1000000 + 0.5003) as bigint)",
}


def sql_core(supplier: str) -> str:
    return f"substr({SQL['dna']('s', supplier)}, 1, {SPACER_LENGTH})"


def sql_spacers() -> str:
    return f"""spacers as (select s_suppkey // {SUPPLIERS_PER_SYSTEM} as system_id, s_suppkey as spacer_id,
      {sql_core('s_suppkey')} as spacer_sequence from supplier)"""


def sql_targets() -> str:
    core = sql_core(f"(p_partkey // {PARTS_PER_SUPPLIER})")
    pam = SQL["dna"]("p", "p_partkey")
    return f"""raw_targets as (select p_partkey // {PARTS_PER_SUPPLIER * SUPPLIERS_PER_SYSTEM} as system_id, p_partkey as target_id,
      substr({SQL['dna']('t', 'p_partkey')}, 1, 20)
      || case when p_partkey % 5 = 2 then substr({core}, 1, 4) || translate(substr({core}, 5, 1), 'ACGT', 'CGTA') || substr({core}, 6, 7) else {core} end
      || case when p_partkey % 3 < 2 then substr({pam}, 1, 1) || 'GG' else substr({pam}, 1, 3) end
      || substr({SQL['dna']('u', 'p_partkey')}, 1, 29) as t from part),
    targets as (select system_id, target_id, case when target_id % 4 = 1 then {SQL['revcomp']('t')} else t end as target_sequence from raw_targets)"""


def sql_hits(mismatches: int = 1, spacer_expr: str = "spacer_sequence") -> str:
    """Brute force: every spacer, strand and placement of its system is compared."""
    n, f = SPACER_LENGTH, FLANK_LENGTH
    rc = SQL["revcomp"]
    return f"""firsts as (select system_id, {spacer_expr} as spacer_sequence, min(spacer_id) as spacer_id from spacers group by all),
    strands as (select *, '+' as strand, spacer_sequence as query from firsts
      union all select *, '-' as strand, {rc('spacer_sequence')} as query from firsts),
    places as (select system_id, target_id, target_sequence, unnest(range(0, length(target_sequence) - {n} + 1)) as start from targets),
    wins as (select *, substr(target_sequence, start + 1, {n}) as win from places),
    raw_hits as (select s.spacer_id, s.spacer_sequence, s.strand, s.query, w.*, hamming(s.query, w.win) as mm
      from strands s join wins w on s.system_id = w.system_id and hamming(s.query, w.win) <= {mismatches}),
    hits as (select system_id, spacer_id, spacer_sequence, target_id, cast(start as bigint) as start, cast(start + {n} as bigint) as "end", strand,
      cast(mm as bigint) as mismatches,
      case when strand = '+' then win else {rc('win')} end as protospacer,
      case when strand = '+' then substr(target_sequence, greatest(start - {f}, 0) + 1, least(start, {f}))
        else {rc(f'substr(target_sequence, start + {n} + 1, {f})')} end as upstream_flank,
      case when strand = '+' then substr(target_sequence, start + {n} + 1, {f})
        else {rc(f'substr(target_sequence, greatest(start - {f}, 0) + 1, least(start, {f}))')} end as downstream_flank,
      case when {rc('spacer_sequence')} = spacer_sequence then 0.5::double else 1.0::double end as orientation_weight
      from raw_hits)"""


def sql_text_bases(text: str) -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{TEXT_LETTERS}', '{TEXT_BASES}')"


def sql_contig_hits() -> str:
    """Every spacer strand against every place where its first or its last ten bases stand: with one mismatch one of them is exact."""
    f, rc = FLANK_LENGTH, SQL["revcomp"]
    return f"""contigs as (select doc_id as target_id, {sql_text_bases('text')} as t from documents where {sql_text_bases('text')} <> ''),
    cores as (select item_id as spacer_id, substr(translate({sql_text_bases('text')}, 'N', 'A'), cast(5 + item_id % 11 as int), cast(20 + item_id % 13 as int)) as c
      from benchmark where length({sql_text_bases('text')}) >= 48),
    changed as (select spacer_id, case when spacer_id % 3 = 1 then substr(c, 1, 14) || translate(substr(c, 15, 1), 'ACGT', 'CGTA') || substr(c, 16) else c end as c from cores),
    firsts as (select s as spacer_sequence, min(spacer_id) as spacer_id from (select spacer_id, case when spacer_id % 4 = 2 then {rc('c')} else c end as s from changed) group by s),
    strands as (select *, '+' as strand, spacer_sequence as q from firsts union all select *, '-', {rc('spacer_sequence')} from firsts),
    seeds as (select *, substr(q, 1, 10) as gram, 0 as shift from strands union all select *, substr(q, length(q) - 9, 10), length(q) - 10 from strands),
    places as (select target_id, t, unnest(range(0, length(t) - 9)) as at from contigs),
    found as (select distinct s.spacer_id, s.spacer_sequence, s.strand, s.q, p.target_id, p.t, p.at - s.shift as start
      from places p join seeds s on substr(p.t, cast(p.at + 1 as int), 10) = s.gram where p.at >= s.shift and p.at - s.shift + length(s.q) <= length(p.t)),
    wins as (select *, length(q) as n, substr(t, cast(start + 1 as int), length(q)) as win from found),
    raw_hits as (select *, hamming(q, win) as mm from wins where hamming(q, win) <= 1),
    hits as (select spacer_id, spacer_sequence, target_id, cast(start as bigint) as start, cast(start + n as bigint) as "end", strand, cast(mm as bigint) as mismatches,
      case when strand = '+' then win else {rc('win')} end as protospacer,
      case when strand = '+' then substr(t, cast(greatest(start - {f}, 0) + 1 as int), cast(least(start, {f}) as int)) else {rc(f'substr(t, cast(start + n + 1 as int), {f})')} end as upstream_flank,
      case when strand = '+' then substr(t, cast(start + n + 1 as int), {f}) else {rc(f'substr(t, cast(greatest(start - {f}, 0) + 1 as int), cast(least(start, {f}) as int))')} end as downstream_flank,
      case when {rc('spacer_sequence')} = spacer_sequence then 0.5::double else 1.0::double end as orientation_weight from raw_hits)"""


def sql_flanks() -> str:
    lengths = ", ".join(str(n) for n in LENGTHS)
    return f"""flanks as (select system_id, spacer_sequence, target_id, orientation_weight, n as motif_length,
      substr(downstream_flank, 1, n) as motif from hits cross join (select unnest([{lengths}]) as n)
      where length(downstream_flank) >= n and regexp_full_match(substr(downstream_flank, 1, n), '[ACGT]+'))"""


MASK_LETTERS = "ACMGRSVTWYHKDBN"


def sql_mask(char: str) -> str:
    return f"instr('{MASK_LETTERS}', {char})"


def sql_subset(candidate: str, gold: str) -> str:
    """Position-wise subset test of two motifs."""
    c = sql_mask(f"substr({candidate}, i, 1)")
    g = sql_mask(f"substr({gold}, i, 1)")
    return (
        f"(length({candidate}) = length({gold}) and len(list_filter(range(1, length({candidate}) + 1), "
        f"lambda i: {c} = 0 or ({c} & ~{g}) <> 0)) = 0)"
    )


def with_ctes(*ctes: str, final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final
