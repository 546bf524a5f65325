"""Bounded blocks of vectors, so that pair work is cut into equal tasks.

A metric index over pivots: every row belongs to the cell of its nearest
pivot, cells are cut into rings by the distance to their pivot, and rings with
too many rows (a crowd at one distance) are split by a hash of the row id.
Every block therefore holds a bounded number of rows. A block cannot hold
anything within a radius of a vector if the triangle inequality says so, for
its ring (distance to the pivot against the ring's least and greatest) or for
its cell (nothing in a cell is nearer to another pivot). The number of pivots
grows with the rows up to a bound, so in clustered data a row meets a number
of blocks that does not grow with the table. The driver keeps the pivots and
one line per ring, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.vectors import distances, matrix

BLOCK_ROWS = 1024
WIDE_BLOCK_ROWS = 4096  # where a task holds one matrix for each pair of blocks
MIN_BLOCK_ROWS = 64
BLOCKS_WANTED = 16
MAX_PIVOTS = 4096
MAX_RINGS = 16  # of a cell
SAMPLE_ROWS = 8  # for each wanted block, of which pivots and rings are taken
MAX_SAMPLE = 8 * MAX_PIVOTS
CHUNK_CELLS = 2_000_000
SEARCH_FEATURES = 8


def block_rows(n: int, most: int = BLOCK_ROWS) -> int:
    """Rows per block: small tables are still spread over several tasks."""
    return max(MIN_BLOCK_ROWS, min(most, math.ceil(n / BLOCKS_WANTED)))


def scan_rows(n: int) -> int:
    """Rows per block where every block meets every other and is measured part by part: few blocks, few copies of a row."""
    return max(MIN_BLOCK_ROWS, min(math.ceil(n / BLOCKS_WANTED), max(WIDE_BLOCK_ROWS, math.ceil(n / (4 * BLOCKS_WANTED)))))


def search_rows(n: int, d: int = 1) -> int:
    """Rows per block for searches, which hold one block side at a time; among many features blocks hardly keep rows apart."""
    if d > SEARCH_FEATURES:
        return max(MIN_BLOCK_ROWS, min(32 * BLOCK_ROWS, math.ceil(n / BLOCKS_WANTED)))
    return max(MIN_BLOCK_ROWS, min(64 * BLOCK_ROWS, math.ceil(n / BLOCKS_WANTED), max(BLOCK_ROWS, n // 4096)))


def _hashes(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(33)


@dataclass(frozen=True)
class Index:
    """Pivots, and for every ring its cell, the range of its distances to the pivot, its first block and its parts."""

    p: int
    pivots: np.ndarray
    cuts: list[np.ndarray]  # of each cell: distances at which a new ring begins
    ring_of: np.ndarray  # of each cell: its first ring
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @property
    def n_blocks(self) -> int:
        return int(self.first[-1] + self.parts[-1]) if len(self.first) else 0

    def diameter(self) -> float:
        """No two rows are farther apart than this."""
        if not len(self.high) or not np.isfinite(self.high).any():
            return 0.0
        wide = np.full(len(self.pivots), -np.inf)
        np.maximum.at(wide, self.cell, self.high)
        far = max(float((distances(self.pivots[i : i + 1], self.pivots, self.p)[0] + wide).max()) + w for i, w in enumerate(wide))
        return far * (1 + 1e-9)

    def _rings(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ring of each row, and its distances to all pivots and to its own one."""
        d = distances(rows, self.pivots, self.p)
        own = d.argmin(axis=1)
        gap = d[np.arange(len(d)), own]
        ring = self.ring_of[own].copy()
        for c in np.unique(own):
            at = own == c
            ring[at] += np.searchsorted(self.cuts[c], gap[at], "right")
        return ring, d, gap

    def ring(self, df: DataFrame) -> DataFrame:
        """(ring, gap) of every row: where it lies and how far from its pivot."""

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    for at in range(0, batch.num_rows, self._step()):
                        ring, _, gap = self._rings(matrix(batch.column("features").slice(at, self._step())))
                        yield pa.RecordBatch.from_arrays([pa.array(ring.astype(np.int32)), pa.array(gap)], names=["ring", "gap"])

        return df.select("features").mapInArrow(place, "ring int, gap double")

    def _step(self) -> int:
        return max(1, CHUNK_CELLS // max(len(self.pivots), len(self.cell), 1))

    def own_block(self, df: DataFrame, id_col: str = "row_id", out: str = "block") -> DataFrame:
        """Block of every row: its ring's first block plus a hash part."""

        def place(batches):
            for batch in batches:
                blocks = []
                ids = batch.column(batch.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False)
                features = batch.column(batch.schema.get_field_index("features"))
                for at in range(0, batch.num_rows, self._step()):
                    ring, _, _ = self._rings(matrix(features.slice(at, self._step())))
                    # Rows that are not of the table may lie in a ring without blocks.
                    part = _hashes(ids[at : at + len(ring)]) % np.maximum(self.parts[ring], 1).astype(np.uint64)
                    blocks.append(np.minimum(self.first[ring] + part.astype(np.int64), self.n_blocks - 1))
                found = np.concatenate(blocks) if blocks else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], names=[*batch.schema.names, out])

        df = df.drop(out)
        return df.mapInArrow(place, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))

    def near_rings(self, rows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, ring) pairs in which something can lie within the row's radius."""
        _, d, gap = self._rings(rows)
        reach = (radius + (d.max(axis=1, initial=0.0) + np.abs(radius)) * 1e-9 + 1e-9)[:, None]
        to_pivot = d[:, self.cell]
        least = np.maximum(to_pivot - self.high, self.low - to_pivot)
        least = np.maximum(least, (to_pivot - gap[:, None]) / 2)
        return np.nonzero(least <= reach)

    def near_blocks(self, df: DataFrame, radius: Column, out: str = "other") -> DataFrame:
        """One row per block that can hold a vector within ``radius``."""

        def spread(batches):
            for batch in batches:
                names = batch.schema.names[:-1]
                features = batch.column(batch.schema.get_field_index("features"))
                radii = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                for at in range(0, batch.num_rows, self._step()):
                    row, ring = self.near_rings(matrix(features.slice(at, self._step())), radii[at : at + self._step()])
                    times = self.parts[ring]
                    begin = np.cumsum(times) - times
                    block = np.repeat(self.first[ring] - begin, times) + np.arange(times.sum())
                    row = np.repeat(row, times) + at
                    for part in range(0, len(row), CHUNK_CELLS // 128):
                        chosen = slice(part, part + CHUNK_CELLS // 128)
                        columns = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).take(pa.array(row[chosen]))
                        yield pa.RecordBatch.from_arrays([*columns.columns, pa.array(block[chosen].astype(np.int32))], names=[*names, out])

        df = df.drop(out)
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
        return df.withColumn("_radius", radius.cast("double")).mapInArrow(spread, schema)


def _spread_out(sample: np.ndarray, n: int, p: int) -> np.ndarray:
    """``n`` rows of a bounded sample, each the farthest from those before."""
    chosen, gap = [], np.full(len(sample), np.inf)
    at = 0
    for _ in range(min(n, len(sample))):
        chosen.append(at)
        gap = np.minimum(gap, distances(sample[at : at + 1], sample, p)[0])
        at = int(gap.argmax())
        if gap[at] <= 0:
            break
    return sample[chosen]


def build_index(points: DataFrame, p: int, rows: int | None = None, most: int = BLOCK_ROWS) -> Index:
    """Pivots and rings from a sample of at most ``MAX_SAMPLE`` rows, sizes of the rings from all rows.

    The sample is drawn by a hash of the row id. Cells with more than about
    ``rows`` rows get rings of about equal size, at most ``MAX_RINGS``, and rings still too
    large get parts, so every block holds about ``rows`` rows.
    """
    n = points.count()
    rows = rows or block_rows(n, most)
    wanted = max(1, min(MAX_PIVOTS, math.ceil(n / rows)))
    share = min(1.0, max(SAMPLE_ROWS * wanted, 256) / max(n, 1))
    drawn = F.pmod(F.xxhash64("row_id", F.lit(11)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))
    held = points.filter(drawn).select("features").limit(MAX_SAMPLE).toArrow().column("features").combine_chunks()
    sample = matrix(held)
    if not len(sample):
        held = points.select("features").limit(1).toArrow().column("features").combine_chunks()
        sample = matrix(held)
    if not len(sample):
        return Index(p, np.zeros((0, 0)), [], *[np.zeros(0, np.int64)] * 6)
    pivots = _spread_out(sample, wanted, p)
    step = max(1, CHUNK_CELLS // len(pivots))
    near = [distances(sample[at : at + step], pivots, p) for at in range(0, len(sample), step)]
    own = np.concatenate([d.argmin(axis=1) for d in near])
    gap = np.concatenate([d.min(axis=1) for d in near])
    cuts = []
    for c in range(len(pivots)):
        inside = np.sort(gap[own == c])
        rings = max(1, min(MAX_RINGS, round(len(inside) / len(sample) * n / rows)))
        cuts.append(np.unique(inside[[len(inside) * k // rings for k in range(1, rings)]]) if rings > 1 else np.zeros(0))
    ring_of = np.cumsum([0, *[len(c) + 1 for c in cuts[:-1]]])
    cell = np.repeat(np.arange(len(pivots)), [len(c) + 1 for c in cuts])
    plain = Index(p, pivots, cuts, ring_of, cell, *[np.zeros(len(cell))] * 4)
    sizes = plain.ring(points).groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    low, high, counts = np.full(len(cell), np.inf), np.full(len(cell), -np.inf), np.zeros(len(cell), np.int64)
    for r in sizes.collect():  # at most MAX_PIVOTS * MAX_RINGS rows
        low[r["ring"]], high[r["ring"]], counts[r["ring"]] = r["low"], r["high"], r["n"]
    parts = -(-counts // rows)  # empty rings have no block
    return Index(p, pivots, cuts, ring_of, cell, low, high, np.cumsum(parts) - parts, parts)


def tiles(points: DataFrame, index: Index, radius: float | None = None) -> DataFrame:
    """Rows spread over block pairs ``(low, high)``; every pair of near rows meets.

    Columns added: ``block`` (own), ``low``, ``high``. Without a radius a row
    meets every block; tiles of one block with itself exist only if there is
    no other block, because two-block tiles already hold each block whole.
    """
    own = index.own_block(points)
    if radius is None:
        spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, index.n_blocks - 1)))))
        if index.n_blocks > 1:
            spread = spread.filter(F.col("other") != F.col("block"))
    else:
        spread = index.near_blocks(own, F.lit(float(radius)))
    return spread.withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    ).drop("other")


def sides(tile: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """The rows of both blocks of a tile; None for the second where a block meets itself."""
    if tile["low"].iloc[0] == tile["high"].iloc[0]:
        return tile, None
    first = tile["block"] == tile["low"]
    return tile[first], tile[~first]


def distinct_points(points: DataFrame) -> DataFrame:
    """(row_id, features, weight): one row per vector, so copies cost nothing later.

    ``row_id`` is the smallest id among the copies.
    """
    return points.groupBy("features").agg(
        F.min("row_id").alias("row_id"), F.count(F.lit(1)).cast("long").alias("weight")
    )
