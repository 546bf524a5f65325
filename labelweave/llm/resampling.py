"""Importance resampling of documents towards a target text.

Runs of words are hashed to buckets by CRC-32. Bucket totals of all documents
and of the target give each bucket a gain, a document weighs the gains of its
features, and a draw without replacement (Gumbel noise that is a function of
the id) takes the highest scores.

The vocabulary has a head and a tail. The head, words that make up a
hundred-thousandth of all words or more, is broadcast with its CRC states, and
so are the CRC states of frequent pairs of head words; neither can have more
than ``HEAD`` entries. Tail features take their CRC directly, from the state
of what comes before. Both give the same numbers, so bucket totals are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.bytewords import GAP, Words, byte_kinds, words_of
from labelweave.llm.steps import saved

MAX_WORDS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
HEAD = 100_000  # most words, and most pairs, that are broadcast
HEAD_BYTES = 64  # of a word of the head; longer ones are tail
RANGE_ROWS, MAX_RANGES = 50_000, 2048
KINDS = byte_kinds([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NEVER = 9  # no byte is of this kind: texts are not cut


@dataclass
class Head:
    """Frequent words in byte order with their CRC states, and frequent pairs (first * words + second) with theirs."""

    words: pa.Array
    states: np.ndarray
    pairs: np.ndarray
    pair_states: np.ndarray

    @classmethod
    def of(cls, words: Sequence[bytes], pairs: Sequence[int] = ()) -> Head:
        words, pairs = sorted(words), np.array(sorted(pairs), np.int64)
        states = [zlib.crc32(w) for w in words]
        both = [zlib.crc32(b" " + words[p % len(words)], states[p // len(words)]) for p in pairs.tolist()]
        return cls(pa.array(words, pa.large_binary()), np.array(states, np.int64), pairs, np.array(both, np.int64))

    def word_states(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """CRC state and head place (-1 in the tail) of distinct words."""
        place = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(distinct), np.int64)
        out[place >= 0] = self.states[place[place >= 0]]
        tail = np.flatnonzero(place < 0)
        out[tail] = [zlib.crc32(w) for w in distinct.take(pa.array(tail)).to_pylist()]
        return out, place

    def states_of_pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC states of pairs by head places, and which of them are known."""
        out, known = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        if len(self.pairs):
            key = first * len(self.words) + second
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            known = (first >= 0) & (second >= 0) & (self.pairs[at] == key)
            out[known] = self.pair_states[at[known]]
        return out, known


def _coded(group: Words) -> tuple[pa.Array, np.ndarray]:
    coded = pc.dictionary_encode(group.text)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def features(group: Words, head: Head, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 .. words the row and the CRC-32 of every run, in order."""
    distinct, word = _coded(group)
    states, place = head.word_states(distinct)
    yield group.row, states[word]
    run, run_states, texts = word, states, None
    for k in range(2, max_words + 1):
        same = group.row[k - 1 :] == group.row[: max(0, len(group.row) - k + 1)]
        pair = (run[: len(same)] * len(distinct) + word[k - 1 :])[same]
        pairs, ids = np.unique(pair, return_inverse=True)
        before, last = pairs // len(distinct), pairs % len(distinct)
        if k == 2:
            found, known = head.states_of_pairs(place[before], place[last])
        else:
            found, known = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        texts = texts or distinct.to_pylist()
        for i in np.flatnonzero(~known).tolist():
            found[i] = zlib.crc32(b" " + texts[last[i]], int(run_states[before[i]]))
        yield group.row[: len(same)][same], found[ids]
        # Runs of k words, numbered; where no run starts, the number is not used.
        run = np.zeros(len(same), np.int64)
        run[same] = ids
        run_states = found if len(found) else np.zeros(1, np.int64)


def _groups(batch: pa.RecordBatch, max_words: int) -> Iterator[Words]:
    return words_of(batch.column("text"), KINDS, GAP if max_words == 1 else NEVER)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def head_of(docs: DataFrame, max_words: int = MAX_WORDS, head: int = HEAD) -> Head:
    """The words that make up 1 / ``head`` of all words or more, and with ``max_words`` over 1 such pairs of them.

    As their counts add up to the total at most, there are at most ``head`` of either.
    """

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch, 1):
                distinct, word = _coded(group)
                n = pa.array(np.bincount(word, minlength=len(distinct)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), n], names=["word", "n"])

    counted = _text(docs).mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = saved(counted, "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter((F.col("n") * head >= total) & (F.octet_length("word") <= HEAD_BYTES))
    found = Head.of([bytes(r["word"]) for r in frequent.select("word").collect()])
    if max_words == 1:
        return found
    words = docs.sparkSession.sparkContext.broadcast(found.words)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch, max_words):
                distinct, word = _coded(group)
                place = pc.index_in(distinct, value_set=words.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
                ok = (group.row[1:] == group.row[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
                pairs, n = np.unique((place[:-1] * len(words.value) + place[1:])[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    pairs = _text(docs).mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = saved(pairs.filter(F.col("n") * head >= total), "pair-counts")
    return Head.of(found.words.to_pylist(), [r["pair"] for r in pairs.select("pair").collect()])


def bucket_totals(docs: DataFrame, head, max_words: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts; a task passes on one row per bucket. ``head`` is a broadcast ``Head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in _groups(batch, max_words):
                for _, crc in features(group, head.value, max_words):
                    sums += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    return _text(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, head, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: thousandths of the logarithm of its smoothed share in the target over that in the documents."""
    spark = docs.sparkSession
    s = bucket_totals(docs, head, max_words, buckets).withColumnRenamed("n", "s")
    t = bucket_totals(target, head, max_words, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    both = saved(both.fillna(0, ["s", "t"]), "bucket-totals")
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    share = ((t + 1) * F.lit(float(sums["s"] + buckets))) / ((s + 1) * F.lit(float(sums["t"] + buckets)))
    rows = both.select("bucket", F.floor(1000 * F.log(share)).alias("gain")).orderBy("bucket").collect()  # one per bucket
    return [r["gain"] for r in rows]


def weighted(
    docs: DataFrame, target: DataFrame, keep: Sequence[str] = ("doc_id",), max_words: int = MAX_WORDS, buckets: int = BUCKETS, head: int = HEAD
) -> DataFrame:
    """The ``keep`` columns of every document with n_words, n_features and weight.

    ``docs`` and ``target`` have a text column; null and empty texts have no
    features and weigh 0. Kept columns of the three names are replaced, repeated
    rows repeat, and tables without words give gains of 0 to all buckets.
    """
    keep = [c for c in keep if c not in ("n_words", "n_features", "weight")]
    send = docs.sparkSession.sparkContext.broadcast
    shared = send(head_of(docs, max_words, head))
    gain = send(np.array(gains(docs, target, shared, max_words, buckets), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            text = batch.column(batch.num_columns - 1)
            for group in words_of(text, KINDS, GAP if max_words == 1 else NEVER):
                for k, (row, crc) in enumerate(features(group, shared.value, max_words)):
                    if not len(row):
                        continue
                    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    n = np.diff(np.r_[begins, len(row)])
                    if k == 0:
                        out[0, row[begins]] += n
                    out[1, row[begins]] += n
                    out[2, row[begins]] += np.add.reduceat(gain.value[crc % buckets], begins)
            columns = [*batch.columns[:-1], *[pa.array(x) for x in out]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text_"))
    numbers = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *numbers]))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of the SHA-256 of seed and id; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(found: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``weighted`` rows with score and rank.

    Of the N rows with ``least_words`` words or more the floor(percent N / 100)
    highest scores are ranked from 1, ties by the smaller doc_id (null first); the rank of
    all others is null. Ranks are counted in ranges of scores cut by quantiles
    and shifted, so no task sorts the table; the noise spreads even documents
    of equal weight over thousands of scores. Columns score and rank are replaced.
    """
    rows = found.drop("rank").withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    rows = saved(rows, "scores")
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count()
    wanted = percent * n // 100
    parts = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    cuts = []
    if parts > 1:
        fractions = [i / parts for i in range(1, parts)]
        cuts = able.agg(F.percentile_approx("score", fractions, 20_000).alias("q")).first()["q"]
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    able = able.withColumn("_score", F.col("score").cast("double"))
    if len(splits) > 2:
        able = Bucketizer(splits=splits, inputCol="_score", outputCol="_range").transform(able)
    else:
        able = able.withColumn("_range", F.lit(0.0))
    sizes = {r["_range"]: r["count"] for r in able.groupBy("_range").count().collect()}  # at most MAX_RANGES rows
    start, starts = 0, []
    for number in sorted(sizes, reverse=True):
        starts.append((number, start))
        start += sizes[number]
    begin = F.coalesce(*[F.when(F.col("_range") == r, F.lit(s)) for r, s in starts], F.lit(0)) if starts else F.lit(0)
    able = able.withColumn("_start", begin.cast("long")).drop("_score")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), F.asc("doc_id"))) + F.col("_start")
    none = F.lit(None).cast("long")
    ranked = able.filter(F.col("_start") < wanted).withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("_range", "_start")
    beyond = able.filter(F.col("_start") >= wanted).drop("_range", "_start").withColumn("rank", none)
    short = rows.filter((F.col("n_words") < least_words) | F.col("n_words").isNull()).withColumn("rank", none)
    return ranked.unionByName(beyond).unionByName(short)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The drawn documents, all their columns, with weight, score and rank."""
    found = drawn(weighted(docs, target, [c for c in docs.columns if c not in ("score", "rank")], **options), percent=percent)
    return found.filter("rank is not null")
