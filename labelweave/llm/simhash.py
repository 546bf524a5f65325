"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Three differing bits leave
one segment equal, or one in each segment; by pigeonhole every pair shares one
of the keys below, where a Golay index stands for "two bits or fewer differ":

* one segment as it is, and a Golay index of the segment after it;
* Golay indices of the first two segments, and one half of the third.

Fingerprints meet under their keys and are compared bit by bit. Under a key of
at most ``RUN`` fingerprints, the pairs are compared and only a spanning forest
goes on. Members of larger groups meet by balls instead: two fingerprints
within three bits have a word within one bit of the first and two of the
second, so linking all that have a word in reach to one fingerprint beside that
word joins exactly what has to be joined, in rows linear in their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import golay
from labelweave.llm.components import connected_components
from labelweave.llm.steps import saved, text_of, tidy

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
HALVES = ((43, 11), (54, 10))  # of the third segment
WITHIN = 3  # bits; the keys are made for this distance
RUN = 1024  # fingerprints under one key that are compared pair by pair
SHORT = 16
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lowered, repeats counted."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    n = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, SHINGLE_BLOCK):
        block = parts[begin : min(n, begin + SHINGLE_BLOCK) + words - 1]
        shingles = map(b" ".join, zip(*[block[k:] for k in range(words)]))
        hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, hash of the text and fingerprint (a signed long) of every whole text; null counts as empty.

    A text without words has fingerprint zero, one with fewer than ``words``
    words is one shingle. Words are parted by ASCII white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
                names=["doc_id", "text_hash", "fingerprint"],
            )

    text = text_of("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return source.mapInArrow(tidy(run), "doc_id long, text_hash long, fingerprint long")


def _segment(values: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return (values >> np.uint64(at[0])).astype(np.int64) & ((1 << at[1]) - 1)


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in ``values``) of unsigned 64-bit fingerprints."""
    parts = [_segment(values, s) for s in SEGMENTS]
    near = [golay.neighbours(p) for p in parts]
    keys, rows = [], []
    for i in range(3):
        j = (i + 1) % 3
        row, col = np.nonzero(near[j] != golay.NONE)
        keys.append((i << 60) | (parts[i][row] << 12) | near[j][row, col])
        rows.append(row)
    both = near[0][:, :, None] * 4096 + near[1][:, None, :]
    known = (near[0] != golay.NONE)[:, :, None] & (near[1] != golay.NONE)[:, None, :]
    row, a, b = np.nonzero(known)
    for half, at in enumerate(HALVES, 3):
        keys.append((half << 60) | (_segment(values, at)[row] << 24) | both[row, a, b])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = batch["fingerprint"].to_numpy()
        for begin in range(0, len(values), 4096):
            some = values[begin : begin + 4096]
            keys, rows = keys_of(some.view(np.uint64))
            yield pd.DataFrame({"key": keys, "fingerprint": some[rows]})


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= WITHIN


def _forest(values: np.ndarray) -> np.ndarray:
    """For each value the place of one value it is joined to by near pairs, the same for all that are joined."""
    near = _near(values[:, None], values[None, :])
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _link(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Joined pairs among values with equal keys; keys are sorted and their runs are complete."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    of = np.repeat(sizes, sizes)
    short = of <= SHORT
    for lag in range(1, SHORT):
        at = np.flatnonzero(short[:-lag] & (keys[:-lag] == keys[lag:])) if lag < len(keys) else []
        if not len(at):
            break
        at = at[_near(values[at], values[at + lag])]
        a.append(values[at])
        b.append(values[at + lag])
    for start, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        some = values[start : start + size]
        label = _forest(some)
        moved = np.flatnonzero(label != np.arange(size))
        a.append(some[moved])
        b.append(some[label[moved]])
    return a, b


def linker(run: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Reads rows sorted by key; gives joined pairs (a, b), and (a, null) for members of groups larger than ``run``."""

    def pairs(a: list, b: list) -> pd.DataFrame:
        a = np.concatenate(a) if a else np.zeros(0, np.int64)
        b = np.concatenate(b) if b else np.zeros(0, np.int64)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})

    def members(found: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": pd.array(found, "Int64")}).assign(b=pd.array([None] * len(found), "Int64"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.r_[keys, batch["key"].to_numpy()]
            values = np.r_[values, batch["fingerprint"].to_numpy()]
            if large is not None:  # the last group goes on
                same = np.searchsorted(keys, large, "right")
                yield members(values[:same])
                keys, values = keys[same:], values[same:]
            if not len(keys):
                continue
            large = None
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            over = np.repeat(sizes > run, sizes)
            if over.any():
                yield members(values[over])
                large = keys[-1] if over[-1] else None
            last = len(keys) if over[-1] else starts[-1]
            done = ~over & (np.arange(len(keys)) < last)
            yield pairs(*_link(keys[done], values[done]))
            keys, values = keys[last:], values[last:]
        yield pairs(*_link(keys, values))

    return linked


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word within two bits of each fingerprint; ``beside`` tells those within one."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.r_[np.uint64(0), one, one[i] | one[j]]
    beside = np.r_[np.ones(65, bool), np.zeros(len(i), bool)]
    for batch in batches:
        for value in batch["a"].to_numpy(np.int64):
            words = (value.view(np.uint64) ^ masks).view(np.int64)
            yield pd.DataFrame({"word": words, "a": value, "beside": beside})


def links(distinct: DataFrame, run: int = RUN) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all pairs within three bits."""
    keyed = distinct.select("fingerprint").mapInPandas(_keyed, "key long, fingerprint long")
    grouped = keyed.repartition("key").sortWithinPartitions("key", "fingerprint")
    found = saved(grouped.mapInPandas(linker(run), "a long, b long"), "simhash-links")
    large = found.filter("b is null").select("a").distinct()
    pairs = found.filter("b is not null")
    if large.head(1):
        words = saved(large.mapInPandas(_balls, "word long, a long, beside boolean"), "simhash-balls")
        anchors = words.filter("beside").groupBy("word").agg(F.min("a").alias("b"))
        pairs = pairs.unionByName(words.join(anchors, "word").filter("a <> b").select("a", "b"))
    return pairs.distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fingerprint, component, component_id) for each distinct fingerprint of (doc_id, fingerprint) rows.

    component is the smallest fingerprint that can be reached.

    component_id is the smallest doc_id whose fingerprint can be reached over
    fingerprints that differ in three bits or fewer; null if all those are null.
    """
    heads = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("head"))
    heads = saved(heads, "simhash-heads")
    joined = connected_components(links(heads))
    roots = heads.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    roots = roots.withColumn("component", F.coalesce("component", "fingerprint"))
    least = roots.groupBy("component").agg(F.min("head").alias("component_id"))
    return roots.select("fingerprint", "component").join(least, "component")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    Rows with a null doc_id are fingerprinted and grouped but never name a
    group. Repeated rows repeat. Other columns are ignored.
    """
    prints = saved(fingerprints(docs, words), "simhash-prints")
    found = prints.join(components(prints), "fingerprint")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component, unchanged.

    It is the row with the smallest doc_id, null ids last, then with the
    smallest text hash; of rows equal in both, one. Other columns pass, whatever
    their names.
    """
    key = ["_unnamed", "_id", "_hash"]
    prints = saved(fingerprints(docs, words), "simhash-prints")
    named = [F.col("doc_id").isNull().alias("_unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")]
    rows = prints.select(*named, F.col("text_hash").alias("_hash"), "fingerprint")
    grouped = rows.join(components(prints), "fingerprint")
    best = grouped.groupBy("component").agg(F.min(F.struct(*key)).alias("best")).select("best.*")
    copies = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    best = saved(best.join(copies, key), "simhash-best")
    # All columns travel as one, so none can clash with the keys.
    marked = docs.select(F.struct("*").alias("_row"), *named, F.xxhash64(text_of("text")).alias("_hash"))
    kept = marked.join(best.filter("_copies = 1"), key, "left_semi")
    repeated = best.filter("_copies > 1")
    if repeated.head(1):
        kept = kept.unionByName(marked.join(repeated, key, "left_semi").dropDuplicates(key))
    return kept.select("_row.*")
