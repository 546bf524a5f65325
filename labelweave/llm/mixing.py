"""Mixing sources to target weights in fixed-length blocks.

The documents of a source lie one behind the other on a line of words, which
is cut into blocks of equal length. The mix is a row of slots in output
shards. Every shard draws its number of slots for each source from a
multinomial distribution with a generator of its own, so shards can be
drawn anywhere and again. The slots of a source are numbered through all
shards, a pseudorandom permutation of the source's block numbers gives each
slot its block, once around before any block comes again, and blocks are joined
to slots by (source, number).

Draws vary, so a source may get a few slots more than its target: these go,
in order, to the sources that got fewer. What a source gives is therefore its
target to within a block, and never more than ``limit`` times its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.steps import saved, text_of

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 13
GROUP_SHARDS = 1024  # shards whose draws are summed together
LINE_ROWS, MAX_LINES = 1_000, 1 << 16
MAX_SOURCES = 100_000  # the driver plans one target for each, and a shard draws one number for each
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words that each source gives: ``share`` of all words by weight, at most ``limit`` times its own; what is over goes by weight to the rest."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, total = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while left:
        each = total / sum(weight[i] for i in left)
        over = [i for i in left if each * weight[i] > limit * sizes[i]]
        if not over:
            for i in left:
                out[i] = each * weight[i]
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            total -= out[i]
        left = [i for i in left if i not in set(over)]
    return out


def _round_keys(key: np.ndarray, rounds: int = 4) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(key + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) for r in range(rounds)]


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of 0 .. size - 1 that the key names.

    A Feistel network over the next even power of two, walked until it falls
    below the size; closed form, so no permutation is ever stored.
    """
    index, size = index.astype(np.uint64), size.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key.astype(np.uint64))
    out = index.copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            low, high = out[todo] & mask[todo], out[todo] >> half[todo]
            for k in keys:
                h = (low + k[todo]) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                low, high = high ^ ((h >> np.uint64(32)) & mask[todo]), low
            out[todo] = (high << half[todo]) | low
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, number, size, start): documents on the line of words of their source, a table.

    number is that of the source by code point, null last, and start counts
    the words of the source before the document. Documents lie in the order of a hash of id and text;
    that cuts every line into even ranges, which are summed apart.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of("text"), F.lit(WORDS)).cast("long").alias("size"), F.xxhash64("doc_id", text_of("text")).alias("key"),
    )
    rows = saved(rows, "mix-sizes")
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted((r["source"] for r in found if r["source"] is not None)) + [None] * any(r["source"] is None for r in found)
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, number int")
    rows = rows.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    parts = max(1, min(MAX_LINES, max([r["n"] for r in found], default=0) // LINE_ROWS))
    rows = rows.withColumn("range", F.pmod("key", F.lit(parts)).cast("int"))
    sums = rows.groupBy("number", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.select("number", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "mix-ranges")
    inside = Window.partitionBy("number", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, ["number", "range"]).withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("shift"))
    return saved(placed.select("doc_id", "source", "number", "size", "start"), "mix-lines")


def _quotas(placed: DataFrame, block: int, **options) -> list[dict]:
    """For each source its words, blocks, target and number of slots."""
    found = placed.groupBy("number").agg(F.sum("size").alias("size")).orderBy("number").collect()  # at most MAX_SOURCES
    sizes = [r["size"] for r in found]
    out = []
    for size, target in zip(sizes, targets(sizes, **options)):
        blocks = -(-size // block)
        # The last block is short: slots are worth its source's mean block.
        slots = min(round(target * blocks / size), int(options.get("limit", LIMIT)) * blocks) if size else 0
        out.append({"size": size, "blocks": blocks, "target": target, "slots": slots})
    return out


def slots(spark, quotas: list[dict], seed: int = SEED) -> DataFrame:
    """(shard, slot, number, epoch, block): the mix as a table of places, without the blocks' words.

    Agrees between runs and with any partitioning.
    """
    wanted = np.array([q["slots"] for q in quotas], np.int64)
    total = int(wanted.sum())
    shards = -(-total // SHARD_SLOTS)
    p = wanted / max(1, total)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                n = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                got = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(n, p)
                at = np.flatnonzero(got)
                first = np.cumsum(got)[at] - got[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard)), pa.array(at.astype(np.int32)), pa.array(got[at]), pa.array(first)],
                    names=["shard", "number", "n", "first"],
                )

    drawn = saved(spark.range(shards).mapInArrow(draw, "shard long, number int, n long, first long"), "mix-draws")
    # Running numbers of a source's slots: sums over groups of shards, then inside each group.
    drawn = drawn.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    before = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = drawn.groupBy("number", "group").agg(F.sum("n").alias("all")).withColumn("shift", F.coalesce(F.sum("all").over(before), F.lit(0)))
    inside = Window.partitionBy("number", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = drawn.join(shifts.drop("all"), ["number", "group"]).withColumn("begin", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("shift"))
    got = {r["number"]: r["n"] for r in drawn.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    each = begun.select("shard", "number", "begin", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    each = each.select("shard", "number", (F.col("first") + F.col("k")).alias("place"), (F.col("begin") + F.col("k")).alias("index"))
    # Slots beyond a source's number are numbered through and fill up the sources that drew too few.
    plan, over, short = [], 0, 0
    for i, q in enumerate(quotas):
        n = got.get(i, 0)
        plan.append((i, q["slots"], q["blocks"], over))
        over += max(0, n - q["slots"])
    gaps = []
    for i, q in enumerate(quotas):
        n = got.get(i, 0)
        if n < q["slots"]:
            gaps.append((len(gaps), short, i, n))
            short += q["slots"] - n
    plan = F.broadcast(spark.createDataFrame(plan, "number int, most long, blocks long, surplus long"))
    begins = np.array([g[1] for g in gaps], np.int64)
    gaps = F.broadcast(spark.createDataFrame(gaps, "gap int, gap_begin long, to int, have long"))

    @F.pandas_udf(T.IntegerType())
    def gap_of(spare: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, spare.to_numpy(), "right").astype(np.int32) - 1)

    known = each.join(plan.select("number", "most", "surplus"), "number")
    own = known.filter("index < most").select("shard", "place", "number", "index")
    lent = known.filter("index >= most").withColumn("spare", F.col("surplus") + F.col("index") - F.col("most"))
    lent = lent.withColumn("gap", gap_of("spare")).join(gaps, "gap")
    lent = lent.select("shard", "place", F.col("to").alias("number"), (F.col("have") + F.col("spare") - F.col("gap_begin")).alias("index"))
    rows = own.union(lent).join(plan.select("number", "blocks"), "number")
    width = F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(total) - F.col("shard") * SHARD_SLOTS)
    key: Column = F.xxhash64(F.lit(seed), "number")
    return rows.select(
        "shard", _permuted("place", width, F.xxhash64(F.lit(seed), F.lit("shard"), "shard")).alias("slot"), "number",
        F.floor(F.col("index") / F.col("blocks")).alias("epoch"),
        _permuted(F.pmod("index", "blocks"), F.col("blocks"), key).alias("block"),
    )


def pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(number, block, doc_id, start, begin, end): the words begin .. end - 1 of a document that lie in a block."""
    spans = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    rows = placed.filter("size > 0").select("number", "doc_id", "start", "size", F.explode(spans).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return rows.select("number", "block", "doc_id", "start", begin.alias("begin"), end.alias("end"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, **options) -> DataFrame:
    """(shard, slot, epoch, source, doc_id, begin, end): the mix, as spans of words of documents in place.

    ``docs`` has doc_id, text and source. Options are those of ``targets``.
    Null texts count as empty; documents without words lie in no block. Null
    is a source like any other. Rows equal in all of these lie one behind
    the other. Other columns are ignored. An empty table gives an empty mix.
    """
    placed = lines(docs)
    table = slots(docs.sparkSession, _quotas(placed, block, **options), seed)
    names = placed.select("number", "source").distinct()
    found = table.join(pieces(placed, block), ["number", "block"]).join(F.broadcast(names), "number")
    return found.select("shard", "slot", "epoch", "source", "doc_id", "begin", "end")


def taken(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): for every row its words, those and the target of its source, and the words the mix takes.

    Words that the mix holds twice count twice. See ``mix`` for odd input.
    """
    placed = lines(docs)
    quotas = _quotas(placed, block, **options)
    spark = docs.sparkSession
    times = slots(spark, quotas, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    held = pieces(placed, block).join(times, ["number", "block"])
    held = held.groupBy("number", "start").agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    plan = [(i, q["size"], q["target"]) for i, q in enumerate(quotas)]
    plan = F.broadcast(spark.createDataFrame(plan, "number int, source_size long, target double"))
    found = placed.filter("size > 0").join(held, ["number", "start"], "left").unionByName(placed.filter("size = 0"), allowMissingColumns=True)
    found = found.join(plan, "number")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
