"""Document fingerprints by one-permutation MinHash with optimal densification.

Each word shingle is hashed once; its top bits name one of ``BINS`` bins, and
the least hash of a bin is its value. A bin without shingles borrows: it walks
over the bins in an order of its own, the same for every text, and takes the
value of the first bin that has one. Of each value only the low ``BITS`` bits
are kept, so two fingerprints also agree by chance in 1 of 2 ** BITS bins, which
``likeness`` takes off again. All of it is built from column expressions.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.shingles import WORDS, let, shingle_hashes, words_of
from labelweave.llm.steps import text_of

BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS
DIGITS = BITS // 4  # hex digits of a value
ROWS_PER_RANGE = 4096
MAX_RANGES = 1 << 16  # bound of the cut points and range starts that are sent to all tasks
SPACE = r"[\x20\x09-\x0D]+"


def _bin(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BIN_BITS).cast("int")


def _least_of_bins(hashes: Column) -> Column:
    """bin * 2 ** BITS + low bits of the least hash, for each bin that has one, in order of the sorted hashes."""

    def first_of_runs(ordered: Column) -> Column:
        starts = F.filter(ordered, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(ordered, i - 1))))
        return F.transform(starts, lambda h: _bin(h) * (1 << BITS) + h.bitwiseAND((1 << BITS) - 1).cast("int"))

    return let(F.sort_array(hashes), first_of_runs)


def _filled(values: Column) -> Column:
    """Low bits for every bin, the empty ones borrowed.

    Bin j looks at bins j, j + s, j + 2s, ... for an odd stride s of its own,
    which reaches every bin. The number of steps to bin i is (i - j) times the
    inverse of s; as any odd number is an inverse, it is drawn directly.
    """

    def borrow(j: Column) -> Column:
        return let(
            F.xxhash64(j).bitwiseAND(BINS - 2).bitwiseOR(1).cast("int"),
            lambda inverse: F.array_min(
                F.transform(
                    values,
                    lambda v: ((F.shiftright(v, BITS) - j) * inverse).bitwiseAND(BINS - 1) * (1 << BITS)
                    + v.bitwiseAND((1 << BITS) - 1),
                )
            ),
        )

    def of_bin(bins: Column, j: Column) -> Column:
        place = F.array_position(bins, j)
        own = let(place, lambda p: F.when(p > 0, F.get(values, (p - 1).cast("int"))))
        return F.coalesce(own, borrow(j)).bitwiseAND((1 << BITS) - 1)

    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))
    return let(
        F.transform(values, lambda v: F.shiftright(v, BITS)), lambda bins: F.transform(numbers, lambda j: of_bin(bins, j))
    )


def fingerprint(text: Column, size: int = WORDS) -> Column:
    """Fingerprint of a whole text, as ``BINS`` * ``DIGITS`` hex digits.

    Words are lower-cased and parted by ASCII white space. Fewer than ``size``
    words make one shingle, no words the shingle of the empty text.
    """

    def of_words(words: Column) -> Column:
        short = F.array(F.xxhash64(F.concat_ws(" ", words)))
        return F.when(F.size(words) >= size, shingle_hashes(words, size)).otherwise(short)

    def digits(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), DIGITS, "0")), "")

    hashes = let(words_of(text, SPACE), of_words)
    return let(_least_of_bins(hashes), lambda values: digits(_filled(values)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles behind two fingerprints, 0 to 1.

    The share of equal bins less what chance gives, scaled back; at least 0.
    """
    places = F.sequence(F.lit(1), F.lit(BINS * DIGITS - DIGITS + 1), F.lit(DIGITS))
    same = F.size(F.filter(places, lambda p: F.substring(a, p, F.lit(DIGITS)) == F.substring(b, p, F.lit(DIGITS))))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, print and those of the row after it, ascending; the last row is followed by the first.

    Rows are dealt by ranges of doc_id. The row a range ends with is followed
    by the first of the next range, which is copied there. At most
    ``MAX_RANGES`` cut points and first rows (id and hash only) are collected.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("at", F.col("doc_id").cast("double"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    fractions = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = rows.agg(F.percentile_approx("at", fractions, 4 * ranges + 100)).first()[0] or [0.0]
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    dealt = Bucketizer(splits=splits, inputCol="at", outputCol="cut", handleInvalid="keep").transform(rows)
    # Rows without an id come last, by their hash.
    unnamed = F.col("doc_id").isNull()
    part = F.when(unnamed, len(splits) + 128 + F.shiftright("hash", 56)).otherwise(F.col("cut")).cast("int")
    dealt = dealt.select("doc_id", "text", "hash", unnamed.alias("unnamed"), part.alias("part"), F.lit(False).alias("copy"))
    order = F.struct("unnamed", "doc_id", "hash")
    firsts = dealt.groupBy("part").agg(F.min(order).alias("first")).orderBy("part").collect()
    follow = [
        (before["part"], row["first"]["doc_id"], row["first"]["hash"])
        for before, row in zip(firsts, firsts[1:] + firsts[:1])
    ]
    starts = spark.createDataFrame(follow, "to long, start_id long, start_hash long")
    starts = starts.select(F.col("to").cast("int").alias("to"), "start_id", "start_hash")
    begins = F.col("doc_id").eqNullSafe(F.col("start_id")) & (F.col("hash") == F.col("start_hash"))
    copies = dealt.join(F.broadcast(starts), begins)
    copies = copies.select("doc_id", "text", "hash", "unnamed", F.col("to").alias("part"), F.lit(True).alias("copy"))
    whole = dealt.unionByName(copies).withColumn("print", fingerprint(F.col("text")))
    along = Window.partitionBy("part").orderBy("copy", "unnamed", "doc_id", "hash")
    whole = whole.withColumn("next_text", F.lead("text").over(along)).withColumn("next_print", F.lead("print").over(along))
    return whole.filter("not copy").select("doc_id", "text", "print", "next_text", "next_print")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text ends with the beginning of the next text instead of its own
    second half. A null text counts as empty; rows with equal doc_id follow each
    other by their hash; rows without doc_id come last. A single row is its own
    next; other columns are ignored.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 2) as int))"),
        F.when(half > 0, F.substring(F.col("next_text"), F.lit(1), half)).otherwise(""),
    )
    rows = _with_next(docs).withColumn("edited", edited)
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        "edited_fingerprint",
        likeness(F.col("print"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
