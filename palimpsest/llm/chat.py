"""Chat formatting: logged snapshots of a conversation collapse into the longest one, which is rendered.

A turn's number is its place. Every conversation gets a rolling hash at each turn, over all turns up to it. One whose
whole hash is the hash of a longer conversation at an earlier turn is a snapshot of it, and of equal conversations the
one with the smallest id stays; both are anti-joins against hashes. What remains is rendered turn by turn.

The rolling hash is a running exclusive-or of two 64-bit hashes of (turn, role, text), so it can be put together from
blocks: a window spans 256 turns, blocks of those, and blocks of blocks, each joined with the block above. A
conversation that holds a third of all rows is spread like many small ones. Its text is given in parts of 64 turns,
in order; nearly all conversations have one part. Turns are no bound on rows: if 64 turns hold more than `PART_ROWS`
rows, these are numbered in order over ranges of them and make several parts, and the later parts of that conversation
have higher numbers by as many.

All of it is DataFrame functions.

Defined results: equal rows (conversation, turn, role, text) count once. Different rows at one turn are all part of
the turn, ordered by role and text, nulls first. Rows without a turn come after all others, in a last part. Rows
without a conv_id are one conversation, ordered after all ids where the smallest stays. A null role is rendered as
the default role, a null text as the empty text, and both differ from what they are rendered as. An empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import partitions, stage

LEVEL_BITS, LEVELS = 8, 3
PART_BITS = 6
#: The most rows in a part.
PART_ROWS = 4_096
LAST = (1 << 63) - 1
TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n")
DEFAULT_ROLE = "user"


def _turns(rows: DataFrame) -> DataFrame:
    """Distinct rows with the key of the conversation, the place, and the hashes of the turn."""
    place = F.coalesce(F.col("turn").cast("long"), F.lit(LAST))
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    turns = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key"),
        F.col("conv_id").cast("long").alias("conv_id"),
        place.alias("_at"),
        "role",
        "text",
        *[F.xxhash64(F.lit(seed), place, *parts).alias(f"_h{seed}") for seed in (1, 2)],
    )
    return turns.dropDuplicates(["_key", "_h1", "_h2"])


def _running(items: DataFrame, level: int = 0) -> DataFrame:
    """Items (_key, _at, _h1, _h2) with `_p1` and `_p2`, the exclusive-or of all hashes of the key up to the place."""
    top = level == LEVELS
    above = F.shiftright("_at", LEVEL_BITS)
    items = items.withColumn("_block", F.lit(0) if top else above)
    here = Window.partitionBy("_key", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = items.withColumns({f"_p{i}": F.bit_xor(f"_h{i}").over(here) for i in (1, 2)})
    if top:
        return inside.drop("_block")
    blocks = items.groupBy("_key", "_block").agg(*[F.bit_xor(f"_h{i}").alias(f"_h{i}") for i in (1, 2)])
    before = _running(blocks.withColumnRenamed("_block", "_at"), level + 1).select(
        "_key", F.col("_at").alias("_block"), *[F.col(f"_p{i}").bitwiseXOR(F.col(f"_h{i}")).alias(f"_b{i}") for i in (1, 2)]
    )
    joined = inside.join(before, ["_key", "_block"])
    return joined.withColumns({f"_p{i}": F.col(f"_p{i}").bitwiseXOR(F.col(f"_b{i}")) for i in (1, 2)}).drop("_block", "_b1", "_b2")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(_key, _at, _p1, _p2, _ends): the hash of each conversation at each of its turns, and whether it ends there."""
    places = turns.groupBy("_key", "_at").agg(*[F.bit_xor(f"_h{i}").alias(f"_h{i}") for i in (1, 2)])
    ends = places.groupBy("_key").agg(F.max("_at").alias("_end"))
    return _running(places).join(ends, "_key").select("_key", "_at", "_p1", "_p2", (F.col("_at") == F.col("_end")).alias("_ends"))


def maximal(hashes: DataFrame) -> DataFrame:
    """The keys of the conversations that no other one continues or repeats."""
    whole = (
        hashes.where("_ends")
        .groupBy("_at", "_p1", "_p2")
        .agg(F.min(F.struct((F.col("_key") == "").alias("_none"), F.col("_key").try_cast("long").alias("_id"), "_key")).alias("_first"))
    )
    earlier = hashes.where(~F.col("_ends")).select("_at", "_p1", "_p2").distinct()
    return whole.join(earlier, ["_at", "_p1", "_p2"], "left_anti").select(F.col("_first._key").alias("_key"))


def rendered(role: Column, text: Column, template: tuple[str, str] = TEMPLATE) -> Column:
    before, after = template[0].split("{role}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit(DEFAULT_ROLE)), F.lit(after), F.coalesce(text, F.lit("")), F.lit(template[1]))


def parted(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Turns with `part`, which orders them within their conversation and holds at most so many rows."""
    group = ["_key", "part"]
    turns = turns.withColumn("part", F.shiftright("_at", PART_BITS))
    counts = turns.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    large = stage(counts.where(F.col("_n") > part_rows), "large")
    if large.isEmpty():
        return turns
    order = [F.col(c).asc_nulls_first() for c in ("_at", "role", "text")]
    ranges = turns.join(large.select(*group), group).repartitionByRange(partitions(turns.sparkSession), "_key", *order)
    ranges = stage(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    found = ranges.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    before = found.select(*group, "_range", (upto - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    number = F.floor((F.col("_before") + inside) / F.lit(part_rows)).cast("long")
    cut = ranges.join(before, [*group, "_range"]).withColumn("_piece", number).select(*turns.columns, "_piece")
    rest = turns.join(large.select(*group), group, "left_anti").select(*turns.columns, F.lit(0).cast("long").alias("_piece"))
    more = F.ceil(F.col("_n") / F.lit(part_rows)) - 1
    earlier = F.sum(more).over(Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.join(large.select("_key").distinct(), "_key", "left_semi").select(*group, earlier.alias("_shift"))
    whole = cut.union(rest).join(shifts, group, "left")
    return whole.withColumn("part", F.col("part") + F.coalesce("_shift", F.lit(0)) + F.col("_piece")).drop("_shift", "_piece")


def format_chats(rows: DataFrame, template: tuple[str, str] = TEMPLATE, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, part, n_turns, text of the maximal conversations; parts in order make up a conversation's text."""
    turns = _turns(rows)
    kept = maximal(stage(prefix_hashes(turns), "prefixes"))
    entry = F.struct(F.col("_at"), F.col("role"), F.col("text"))
    return (
        parted(turns.join(stage(kept, "maximal"), "_key"), part_rows)
        .groupBy("_key", "conv_id", "part")
        .agg(F.sort_array(F.collect_list(entry)).alias("_turns"))
        .select(
            "conv_id",
            "part",
            F.size("_turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("_turns", lambda t: rendered(t["role"], t["text"], template)), "").alias("text"),
        )
    )
