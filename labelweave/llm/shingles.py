"""Word shingles as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5  # of a shingle


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column, separators: str) -> Column:
    """Lower-case words between runs of separators (a regular expression)."""
    return F.array_remove(F.split(F.lower(text), separators), "")


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """64-bit hashes of all runs of ``size`` words; none where there are fewer words."""

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - size
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        found = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def shingle_texts(words: Column, size: int = WORDS) -> Column:
    """The runs of ``size`` words, joined by spaces."""
    last = F.size(words) - size
    at = F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1)))
    found = F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, size)))
    return F.when(last >= 0, found).otherwise(F.array().cast("array<string>"))
