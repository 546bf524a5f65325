"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.session import materialise

# Setting of a session: the shuffle files of an execution go when it ends, not when the driver next collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 1_000_000  # a side of id and small number columns below this may be broadcast


def join_sized(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only when it has at most ``limit`` rows.

    Beyond the limit both sides are shuffled on ``on``; the rows are the same.
    ``right`` should hold a few slim columns, as the limit counts rows.
    """
    small = len(right.head(1)) == 0 or right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def text_of(column: str) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_of_id(column: str) -> Column:
    """Unsigned CRC-32 of the id written in decimal; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that nothing before it is run again."""
    return materialise(df, name)


def saved_alone(df: DataFrame, name: str) -> DataFrame:
    """Like ``saved``, and the shuffle files that led to the table go as soon as it is written; nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return saved(df, name)
    finally:
        if before is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, before)


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition, after which the worker process, kept for other tasks, gives its buffers back."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped
