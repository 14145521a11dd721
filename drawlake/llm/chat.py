"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant
and the others as named users; the mask lists the character ranges that the assistant wrote, which are
the ones to learn from. System turns stay system turns and are no participants. What texts and names hold of
the markers is escaped (a backslash goes between the two characters), so no text can pose as another turn.

Scale. A turn costs its bytes and ``TURN_BYTES``; a dialogue of at most ``part_bytes`` is one row, whatever its turn
numbers. A longer one is rendered in parts: a turn belongs to the part that the cost of all turns before it, divided by
``part_bytes``, names. The parts of a perspective, in order, are the whole dialogue, and masks count from the start of their
part. Conversations that hold more than one part and more than a ``HOT_SHARE``-th of all cost (fewer than ``HOT_SHARE``, so
their ids can be broadcast) are range-sorted and get their places from one sum for each partition, so no task holds
one of them; all others are ordered by one window, each in its task. Participants are found by a grouped distinct,
which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import materialize

TURN_BYTES = 1024
HOT_SHARE = 1 << 16
OPEN, CLOSE = "<|", "|>"


def escaped(text: Column) -> Column:
    """``text`` without markers: a backslash more goes into whatever looks like one, so that one less gives it back."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|"), r"\|(\\*)>", r"|\\$1>")


def _before(rows: Window) -> Column:
    """The cost of all rows before, within ``rows``."""
    return F.coalesce(F.sum("cost").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _hot_parts(lines: DataFrame, part_bytes: int) -> DataFrame:
    """``lines`` of very long conversations with their part: sorted by ranges, written, and shifted by what stands in the partitions before."""
    order = ["conv_id", "turn", "role", "text"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_piece", F.shiftright("_id", 33)), "long-dialogues")
    sums = rows.groupBy("conv_id", "_piece").agg(F.sum("cost").alias("cost"))
    shift = sums.select(F.col("conv_id").alias("_conv"), F.col("_piece").alias("_at"), _before(Window.partitionBy("conv_id").orderBy("_piece")).alias("_shift"))
    placed = rows.join(shift, rows["conv_id"].eqNullSafe(shift["_conv"]) & (F.col("_piece") == F.col("_at")))
    upto = F.col("_shift") + _before(Window.partitionBy("conv_id", "_piece").orderBy("_id"))
    return placed.withColumn("part", F.floor(upto / part_bytes).cast("long")).select(*lines.columns, "part")


def parts(lines: DataFrame, part_bytes: int, hot_share: int = HOT_SHARE) -> DataFrame:
    """``lines(conv_id, turn, role, text, cost)`` with the part of its dialogue that each belongs to."""
    sizes = materialize(lines.groupBy("conv_id").agg(F.sum("cost").alias("total")), "sizes")
    bound = max(part_bytes, (sizes.agg(F.sum("total")).first()[0] or 0) // hot_share)
    hot = F.broadcast(sizes.where(F.col("total") > bound).select(F.col("conv_id").alias("_hot")))
    same = lines["conv_id"].eqNullSafe(F.col("_hot"))
    place = _before(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    cool = lines.join(hot, same, "left_anti").withColumn("part", F.floor(place / part_bytes).cast("long"))
    if not sizes.where(F.col("total") > bound).isEmpty():
        return cool.unionByName(_hot_parts(lines.join(hot, same, "left_semi"), part_bytes))
    return cool


def rotate(turns: DataFrame, part_bytes: int = 4 << 20, hot_share: int = HOT_SHARE) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` -> one row per conversation, perspective and part.

    Columns: conv_id, perspective, part (0 but for very long dialogues; their order is that of the dialogue), n_turns,
    n_learned (assistant turns), rendered, mask (array of start and end in characters, end exclusive).

    Turns are ordered by turn, then role, then text; repeated rows are kept. A null role is the
    participant ``unknown``, null text is empty, a null turn counts as turn 0, a null conv_id is a
    conversation of its own; negative, repeated and far apart turn numbers only order the turns. A conversation of
    system turns only has no perspective and gives no row, nor does an empty table; very long texts are rendered
    whole. Line breaks in names become blanks where they are shown. Other columns are ignored, whatever their names.
    """
    who = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    lines = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), who.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = lines.withColumn("cost", (F.octet_length("role") + F.octet_length("text") + TURN_BYTES).cast("long"))
    # the window and the grouping need the same partitioning, so rows are shuffled once
    grouped = parts(lines, part_bytes, hot_share).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    people = lines.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    both = grouped.join(people, grouped["conv_id"].eqNullSafe(people["_conv"])).drop("_conv")

    def line(s: Column) -> Column:
        own = s["role"] == F.col("perspective")
        name = F.regexp_replace(escaped(s["role"]), r"[\r\n]", " ")
        head = F.when(own, F.lit("assistant")).when(s["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
        return F.struct(own.alias("own"), F.concat(F.lit(OPEN), head, F.lit(CLOSE + "\n")).alias("head"), escaped(s["text"]).alias("text"))

    both = both.withColumn("lines", F.transform("said", line))
    whole = F.array_join(F.transform("lines", lambda s: F.concat(s["head"], s["text"], F.lit(f"{OPEN}end{CLOSE}\n"))), "")
    tail = len(f"{OPEN}end{CLOSE}\n")
    widths = F.transform("lines", lambda s: F.struct(s["own"].alias("own"), F.length(s["head"]).cast("long").alias("h"), F.length(s["text"]).cast("long").alias("t")))
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"
    start = F.from_json(F.lit('{"at":0,"spans":[]}'), kind)

    def add(s: Column, w: Column) -> Column:
        span = F.struct((s["at"] + w["h"]).alias("start"), (s["at"] + w["h"] + w["t"]).alias("end"))
        return F.struct((s["at"] + w["h"] + w["t"] + tail).alias("at"), F.when(w["own"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    mask = F.aggregate(widths, start, add)["spans"]
    return both.select("conv_id", "perspective", "part", F.size("lines").cast("long").alias("n_turns"), F.size(F.filter("lines", lambda s: s["own"])).cast("long").alias("n_learned"), whole.alias("rendered"), mask.alias("mask"))
