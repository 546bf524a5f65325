"""Vectors as ``array<double>`` columns, and their numpy views inside tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.cleaning import quoted

CACHED_CELLS = 1 << 14  # of a block of distances that grows in a core's cache
CACHED_COLUMNS = 1 << 10
PRODUCT_FEATURES = 8  # with more of them a product of rows is faster than sums feature by feature
SMALL_SQUARE = 1e-5  # smaller squared distances, against the rows' squares, are not left to a product


def feature_array(columns: Sequence[str]) -> Column:
    """One array column from numeric columns."""
    return F.array(*[quoted(c).cast("double") for c in columns])


def points(df: DataFrame, id_col: str, features: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, features, kept columns): the input form of all vector operators."""
    if isinstance(features, str):
        array = F.col(features).cast("array<double>")
    else:
        array = feature_array(features)
    return df.select(F.col(id_col).cast("long").alias("row_id"), array.alias("features"), *keep)


def with_vector(df: DataFrame, features: str = "features", out: str = "vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features)))


def norm(features: Column, p: int) -> Column:
    """L1 or L2 length, computed in the JVM."""
    if p == 1:
        return F.aggregate(features, F.lit(0.0), lambda total, x: total + F.abs(x))
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda total, x: total + x * x))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column as a 2-D float array without a Python loop."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def stack(series) -> np.ndarray:
    """pandas column of arrays as a 2-D float array."""
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, 0))


def distances(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """All L1 or L2 distances of two row blocks, summed one feature at a time.

    Blocks of the result stay in a core's cache while their sums grow.
    """
    total = _summed(left, right, p, float)
    return total if p == 1 else np.sqrt(total, out=total)


def _summed(left: np.ndarray, right: np.ndarray, p: int, kind: type) -> np.ndarray:
    """Sums over the features of the gaps of two blocks, or of their squares."""
    total = np.zeros((len(left), len(right)), kind)
    if not total.size:
        return total
    turned = np.ascontiguousarray(right.T, kind)
    left = np.ascontiguousarray(left, kind)
    wide = min(len(right), CACHED_COLUMNS)
    high = max(1, CACHED_CELLS // wide)
    gaps, sums = np.empty((2, high * wide), kind)
    for top in range(0, len(left), high):
        rows = left[top : top + high]
        for at in range(0, len(right), wide):
            block = total[top : top + high, at : at + wide]
            gap, part = (x[: block.size].reshape(block.shape) for x in (gaps, sums))
            part[:] = 0
            for j in range(left.shape[1]):
                np.subtract(rows[:, j, None], turned[j, at : at + wide], out=gap)
                part += np.abs(gap, out=gap) if p == 1 else np.multiply(gap, gap, out=gap)
            block[:] = part
    return total


def pair_distances(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """Distance of each row of ``left`` to the row of ``right`` in the same place; the very values of ``distances``."""
    total = np.zeros(len(left))
    for j in range(left.shape[1] if len(left) else 0):
        gap = left[:, j] - right[:, j]
        total += np.abs(gap) if p == 1 else gap * gap
    return total if p == 1 else np.sqrt(total)


def many_features(rows: np.ndarray) -> bool:
    """Are products of rows worth their rounding errors?"""
    return rows.ndim == 2 and rows.shape[1] > PRODUCT_FEATURES


def rough_squares(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared L2 distances of two blocks of finite rows by one product, and a bound of their errors."""
    one, two = (left * left).sum(axis=1), (right * right).sum(axis=1)
    found = left @ right.T
    found *= -2
    found += one[:, None]
    found += two
    scale = (one.max(initial=0.0) ** 0.5 + two.max(initial=0.0) ** 0.5) ** 2
    return found, float(scale * (left.shape[1] + 8) * 4 * np.finfo(float).eps)


def rough_sums(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """All L1 distances of two blocks of finite rows in single precision, and a bound of their errors."""
    scale = np.abs(left).sum(axis=1).max(initial=0.0) + np.abs(right).sum(axis=1).max(initial=0.0)
    return _summed(left, right, 1, np.float32), float(scale * (left.shape[1] + 8) * 2 * np.finfo(np.float32).eps)


def within(left: np.ndarray, right: np.ndarray, radius: float, p: int) -> np.ndarray:
    """Which distances are at most ``radius``; as ``distances`` has them."""
    if p != 2 or not many_features(left) or not len(right) or not (np.isfinite(left).all() and np.isfinite(right).all()):
        return distances(left, right, p) <= radius
    middle = right.mean(axis=0)
    squares, error = rough_squares(left - middle, right - middle)
    squares -= radius * radius
    near = squares <= 0
    row, col = np.nonzero(np.abs(squares, out=squares) <= error + radius * radius * 1e-12)
    near[row, col] = pair_distances(left[row], right[col], p) <= radius
    return near


def distance_sums(left: np.ndarray, right: np.ndarray, share: np.ndarray, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """L2 distances of ``left`` to ``right`` times ``share``, and, given ``back``, those of ``right`` to ``left`` times it.

    Distances of many features come from products; those too small to bear the
    rounding errors are measured feature by feature.
    """
    sums = np.zeros((len(left), share.shape[1]))
    other = np.zeros((len(right), back.shape[1] if back is not None else 0))
    by_product = many_features(left) and np.isfinite(left).all() and np.isfinite(right).all()
    if by_product and len(right):
        middle = right.mean(axis=0)
        left, right = left - middle, right - middle
        one, two = (left * left).sum(axis=1), (right * right).sum(axis=1)
    wide, high = CACHED_COLUMNS, 8 * CACHED_CELLS // CACHED_COLUMNS
    for top in range(0, len(left), high):
        rows = left[top : top + high]
        for at in range(0, len(right), wide):
            pool = right[at : at + wide]
            if by_product:
                d = rows @ pool.T
                d *= -2
                d += one[top : top + high, None]
                d += two[at : at + wide]
                least = SMALL_SQUARE * (one[top : top + high].max() + two[at : at + wide].max())
                near = np.nonzero(d < least) if d.min() < least else None
                if near is not None:
                    d[near] = 0.0
                np.sqrt(d, out=d)
                if near is not None:
                    d[near] = pair_distances(rows[near[0]], pool[near[1]], 2)
            else:
                d = distances(rows, pool, 2)
            sums[top : top + high] += d @ share[at : at + wide]
            if back is not None:
                other[at : at + wide] += d.T @ back[top : top + high]
    return sums, other
