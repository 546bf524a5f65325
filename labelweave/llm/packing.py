"""Shortest-pack-first packing over the length histogram.

Documents are cut every ``size`` ids; what is left of each is a piece with its
own length. The histogram of the lengths, at most ``size`` rows, is all the
planner sees: it places lengths longest first, each time into the packs that
are shortest so far, and keeps packs of equal content as one pattern with a
count. The plan is a table of (length, range of ranks) -> (range of packs,
offset); pieces join back to it by their rank among pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.order import rank_by_key, shuffle_key
from labelweave.llm.steps import saved, text_of
from labelweave.llm.wordpieces import WordEncoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
PLAN = "piece_length long, first_rank long, n long, first_pack long, offset long"


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows of ``PLAN`` for a histogram {length: count} of lengths 1..size.

    A pattern is a run of packs with equal content, (first pack, count), under
    the number of ids used. Each step uses up a length or a pattern, so the
    plan has at most a few rows per length, however many pieces there are.
    """
    shortest: list[tuple[int, int, int]] = []  # used, first pack, count
    rows, packs = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if shortest and shortest[0][0] + length <= size:
                used, first, count = heapq.heappop(shortest)
            else:
                # As many new packs as the length needs when each takes as many pieces as fit.
                used, first, count = 0, packs, -(-left // (size // length))
                packs += count
            taken = min(count, left)
            rows.append((length, rank, taken, first, used))
            rank, left = rank + taken, left - taken
            if taken < count:
                heapq.heappush(shortest, (used, first + taken, count - taken))
            if used + length < size:
                heapq.heappush(shortest, (used + length, first, taken))
    return rows


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Ids of every text, cut every ``size`` ids, as slim piece rows (``PIECES``).

    A null text counts as empty, so every document has at least its end id. A
    text is encoded whole, however long; a task holds one small batch of texts
    and a bounded cache of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE_NAMES)
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with columns doc_id, start, length.

    Sequences hold at most ``size`` ids, without gaps, and are numbered from 0.
    Pieces of a length that a third of all documents share are ranked in hash
    buckets, so no task holds a length. Equal rows are separate pieces. An
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(plan_packs(histogram, size), PLAN)  # at most a few rows per length
    keyed = pieces.withColumn("_key", shuffle_key(F.col("doc_id"), F.col("start"), F.col("ids_crc32")))
    ranked = rank_by_key(keyed, "_key", ["doc_id", "start"], by=["length"], out="_rank", groups=max(1, len(histogram)))
    fits = (
        (F.col("length") == F.col("piece_length"))
        & (F.col("_rank") >= F.col("first_rank"))
        & (F.col("_rank") < F.col("first_rank") + F.col("n"))
    )
    placed = ranked.join(F.broadcast(plan), fits)
    return placed.withColumn("sequence_id", F.col("first_pack") + F.col("_rank") - F.col("first_rank")).drop(
        "_key", "_rank", "piece_length", "first_rank", "n", "first_pack"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """One row per piece: where it comes from, its checksum, its sequence and offset.

    Nulls in doc_id stay null; columns other than doc_id and text are ignored.
    """
    return pack(saved(encode_pieces(docs, tokenizer, end_id, size), "pieces"), size)
