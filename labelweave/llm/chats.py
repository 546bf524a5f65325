"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time with some turns more.
A rolling hash over the turns names every prefix of a conversation; one whose
whole hash is also the hash of a shorter prefix of another is a snapshot of it.
Anti-joins keep the longest conversations, of equal ones one, and those are
rendered in parts of a bounded number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.steps import saved

BLOCK = 256  # turn numbers that are ordered together, and turns in a rendered part
START, END = "<|{}|>\n", "<|end|>\n"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2): turns numbered from 1 and the hashes of the prefixes they end.

    Turns are ordered by turn (null first), role and text; rows equal in all
    of these are one turn. Null roles and texts count as empty. Rows without
    conv_id belong to no conversation and are left out. The prefix hash is the
    exclusive or of hashes of (place, role, text), two of 64 bits each, so
    that blocks of turns can be hashed apart and joined by their totals; no
    task holds a conversation. The two start from different states, so two
    given prefixes of equal length that differ agree by chance once in 2 ** 128.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).filter("conv_id is not null")
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    same = F.struct("turn", "role", "text")
    rows = rows.withColumn("again", F.coalesce(F.lag(same).over(inside) == same, F.lit(False))).filter("not again")
    rows = rows.withColumn("inner", F.row_number().over(inside))
    rows = saved(rows.select("conv_id", "block", "inner", "role", "text"), "chat-turns")
    places = _shifted(rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), {"n": F.sum})
    rows = rows.join(places, ["conv_id", "block"]).withColumn("place", (F.col("inner") + F.col("n")).cast("long"))
    hashes = {f"h{k}": F.xxhash64(F.lit(k), "place", "role", "text") for k in (1, 2)}
    rows = rows.select("conv_id", "block", "place", "role", "text", *[h.alias(k) for k, h in hashes.items()])
    totals = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(k).alias(f"{k}_before") for k in hashes])
    before = _shifted(totals, {f"{k}_before": F.bit_xor for k in hashes})
    running = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(before, ["conv_id", "block"])
    for k in hashes:
        rows = rows.withColumn(k, F.bit_xor(k).over(running).bitwiseXOR(F.col(f"{k}_before")))
    return saved(rows.select("conv_id", "place", "role", "text", *hashes), "chat-prefixes")


def _shifted(blocks: DataFrame, sums: dict) -> DataFrame:
    """For each block of a conversation the totals of the blocks before it, 0 at first."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.coalesce(f(c).over(before), F.lit(0)).alias(c) for c, f in sums.items()]
    return saved(blocks.select("conv_id", "block", *totals), "chat-blocks")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that no longer one begins with.

    Of conversations with the same turns the smallest conv_id stays; n_copies
    counts them. A copy that a third of the log repeats is one row from the
    first count on.
    """
    ends = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("end"))
    ends = ends.select("conv_id", "end.*").groupBy("place", "h1", "h2")
    ends = saved(ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")), "chat-ends")
    last = ends.select("conv_id", F.col("place").alias("n_turns"))
    # Equal conversations have the same prefixes; those of the one that stays are enough.
    proper = prefixes.join(last, "conv_id").filter("place < n_turns").select("place", "h1", "h2").distinct()
    kept = ends.join(proper, ["place", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text) of every maximal conversation.

    A turn reads ``start`` with its role, its text and ``end``; a null or empty
    text gives a turn without text. A part holds up to ``BLOCK`` turns; a
    conversation's parts in order are its whole text, so most have one part.
    Other columns are ignored; an empty table gives no rows.
    """
    prefixes = ordered_turns(turns)
    opening, closing = start.split("{}")
    piece = F.concat(F.lit(opening), F.col("role"), F.lit(closing), F.col("text"), F.lit("\n" + end))
    rows = prefixes.join(maximal(prefixes), "conv_id")
    part: Column = F.floor((F.col("place") - 1) / BLOCK)
    parts = rows.groupBy("conv_id", part.cast("int").alias("part"), "n_turns", "n_copies")
    pieces = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return parts.agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))
