"""Radius work in few dimensions, on a grid.

Cells are as wide as two rows in one cell may be apart at most, so a row
meets only the fixed number of cells around its own, whatever the table holds.
What a pair of cells decides by the boxes of their rows (all pairs near, or
none) never becomes pairs; what is left is decided row by row against the
other cell's box, and only then pair by pair, crowded cells in parts. Boxes
are of the rows themselves, so rounding of cell numbers cannot change a result.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.forest import connected_components
from labelweave.session import materialise

MAX_DIMENSIONS = 3
PART_ROWS = 1024  # of a cell that are compared in one group
SHRINK = 1 - 1e-6  # keeps two rows of a cell within the radius under rounding


def fits(vectors: DataFrame, radius: float) -> int:
    """Number of dimensions if a grid serves them, else 0."""
    if not radius > 0:
        return 0
    sizes = vectors.agg(F.max(F.size("features")).alias("d"), F.min(F.size("features")).alias("least")).first()
    return sizes["d"] if sizes["d"] == sizes["least"] and sizes["d"] and sizes["d"] <= MAX_DIMENSIONS else 0


def _length(gaps: list[Column], p: int) -> Column:
    """L1 or L2 length, summed in the order of the dimensions."""
    parts = [F.abs(g) if p == 1 else g * g for g in gaps]
    total = F.lit(0.0)
    for x in parts:
        total = total + x
    return total if p == 1 else F.sqrt(total)


class Grid:
    """Rows (row_id, x0 .., weight, cell) of one radius, and the pairs of cells that are not apart."""

    def __init__(self, vectors: DataFrame, radius: float, p: int, d: int):
        self.radius, self.p, self.d = float(radius), p, d
        self.side = self.radius / d ** (1 / p) * SHRINK
        x = [F.col("features")[j] for j in range(d)]
        cell = F.array(*[F.floor(v / self.side) for v in x])
        keep = [c for c in vectors.columns if c not in ("features", "row_id")]
        self.rows = materialise(vectors.select("row_id", *[v.alias(f"x{j}") for j, v in enumerate(x)], cell.alias("cell"), *keep), "grid-rows")

    def cells(self, rows: DataFrame) -> DataFrame:
        """(cell, first, n, w, low, high): the box, the smallest id and the size of every cell that has rows."""
        boxes = [F.array(*[f(f"x{j}") for j in range(self.d)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
        sums = [F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")]
        return materialise(rows.groupBy("cell").agg(*sums, *boxes), "grid-cells")

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Cells of ``left`` with the cells of ``right`` around them that are not apart; sure where all pairs are near.

        Columns of the right cell are called other_*.
        """
        reach = math.ceil(self.radius / self.side)
        around = [
            o
            for o in itertools.product(range(-reach, reach + 1), repeat=self.d)
            if sum(max(abs(k) - 1, 0) ** self.p for k in o) ** (1 / self.p) * self.side <= self.radius * (1 + 1e-6)
        ]
        offsets = F.array(*[F.array(*[F.lit(k).cast("long") for k in o]) for o in around])
        spread = left.withColumn("_o", F.explode(offsets)).withColumn("other", F.zip_with("cell", "_o", lambda a, b: a + b)).drop("_o")
        met = spread.join(right.select(*[F.col(c).alias("other" if c == "cell" else f"other_{c}") for c in right.columns]), "other")
        least, most = self._between([F.col("low")[j] for j in range(self.d)], [F.col("high")[j] for j in range(self.d)])
        return materialise(met.withColumn("sure", most <= self.radius).filter(least <= self.radius), "grid-pairs")

    def _between(self, low: list[Column], high: list[Column]) -> tuple[Column, Column]:
        """Least and greatest distance between a box and the other cell's box."""
        gaps, spans = [], []
        for j in range(self.d):
            other_low, other_high = F.col("other_low")[j], F.col("other_high")[j]
            gaps.append(F.greatest(other_low - high[j], low[j] - other_high, F.lit(0.0)))
            spans.append(F.greatest(other_high - low[j], high[j] - other_low))
        return _length(gaps, self.p), _length(spans, self.p)

    def against_boxes(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Rows with each undecided cell around that is not apart from the row; sure where the whole cell is near."""
        kept = [c for c in pairs.columns if c == "cell" or c.startswith("other")]
        x = [F.col(f"x{j}") for j in range(self.d)]
        least, most = self._between(x, x)
        met = rows.join(pairs.filter("not sure").select(*kept), "cell")
        return met.withColumn("sure", most <= self.radius).filter(least <= self.radius)

    def against_rows(self, asked: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``asked`` (other, other_n, x0 ..) with every row of the other cell within the radius, as other_row and other_<keep>."""
        parts = F.ceil(F.col("other_n") / PART_ROWS).cast("int")
        spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        sizes = asked.select("other", parts.alias("parts")).distinct()
        there = rows.select(
            F.col("cell").alias("other"), F.col("row_id").alias("other_row"), *[F.col(f"x{j}").alias(f"y{j}") for j in range(self.d)],
            *[F.col(c).alias(f"other_{c}") for c in keep],
        ).join(sizes, "other")
        there = there.withColumn("part", F.pmod(F.xxhash64("other_row"), F.col("parts").cast("long")).cast("int")).drop("parts")
        gap = _length([F.col(f"x{j}") - F.col(f"y{j}") for j in range(self.d)], self.p)
        asked_columns = [c for c in spread.columns if c not in {f"other_{k}" for k in keep}]
        met = spread.select(*asked_columns).join(there, ["other", "part"])
        return met.withColumn("dist", gap).filter(F.col("dist") <= self.radius)

    def counts(self, rows: DataFrame, cells: DataFrame, asked: DataFrame) -> DataFrame:
        """(row_id, n_near) of the rows in the cells ``asked``: weight of all rows within the radius."""
        pairs = self.pairs(asked, cells)
        whole = pairs.filter("sure").groupBy("cell").agg(F.sum("other_w").alias("whole"))
        own = rows.join(asked.select("cell"), "cell", "left_semi")
        met = materialise(self.against_boxes(own, pairs).drop("weight"), "grid-met")
        near = met.filter("sure").select("row_id", F.col("other_w").alias("w"))
        close = self.against_rows(met.filter("not sure").select("row_id", "other", "other_n", *[f"x{j}" for j in range(self.d)]), rows, ["weight"])
        summed = near.unionByName(close.select("row_id", F.col("other_weight").alias("w"))).groupBy("row_id").agg(F.sum("w").alias("w"))
        found = own.select("row_id", "cell").join(whole, "cell", "left").join(summed, "row_id", "left")
        return found.select("row_id", (F.coalesce("whole", F.lit(0)) + F.coalesce("w", F.lit(0))).cast("long").alias("n_near"))


def radius_counts(vectors: DataFrame, radius: float, p: int, d: int) -> DataFrame:
    """(row_id, n_near) of distinct weighted vectors."""
    grid = Grid(vectors, radius, p, d)
    cells = grid.cells(grid.rows)
    return grid.counts(grid.rows, cells, cells)


def radius_pairs(vectors: DataFrame, radius: float, p: int, d: int) -> DataFrame:
    """(src, dst, dist) of all vectors within the radius, src < dst."""
    grid = Grid(vectors, radius, p, d)
    cells = grid.cells(grid.rows)
    pairs = grid.pairs(cells.select("cell", "low", "high"), cells).select("cell", "other", "other_n")
    asked = grid.rows.join(pairs, "cell").select("row_id", "other", "other_n", *[f"x{j}" for j in range(d)])
    met = grid.against_rows(asked, grid.rows, []).filter("row_id < other_row")
    return met.select(F.col("row_id").alias("src"), F.col("other_row").alias("dst"), "dist")


def dbscan(vectors: DataFrame, eps: float, min_pts: int, p: int, d: int) -> DataFrame:
    """(row_id, component, core): component is the smallest core id of the cluster, null for noise.

    All rows of a cell of ``min_pts`` or more are core without a comparison.
    Cells of core rows are linked by their boxes first; cells that are then still in
    different components are compared row by row.
    """
    grid = Grid(vectors, eps, p, d)
    cells = grid.cells(grid.rows)
    sparse = cells.filter(F.col("w") < min_pts)
    counted = grid.counts(grid.rows, cells, sparse).filter(F.col("n_near") >= min_pts).select("row_id", F.lit(True).alias("few"))
    crowded = cells.filter(F.col("w") >= min_pts).select("cell", F.lit(True).alias("many"))
    flagged = grid.rows.join(crowded, "cell", "left").join(counted, "row_id", "left")
    flagged = materialise(flagged.withColumn("core", F.coalesce("many", "few", F.lit(False))).drop("many", "few"), "grid-flagged")
    cores, x = flagged.filter("core").drop("core"), [f"x{j}" for j in range(d)]
    homes = grid.cells(cores)
    pairs = grid.pairs(homes, homes).filter("first <> other_first")
    links = pairs.filter("sure").select("first", "other_first")
    met = materialise(grid.against_boxes(cores, pairs.drop("w", "n", "low", "high")).join(homes.select("cell", "first"), "cell"), "grid-core-met")
    links = links.union(met.filter("sure").select("first", "other_first")).distinct()
    links = materialise(links.select(F.least("first", "other_first").alias("a"), F.greatest("first", "other_first").alias("b")).distinct(), "grid-links")

    def components(edges: DataFrame) -> DataFrame:
        found = connected_components(edges.select(F.lit(0).alias("g"), "a", "b"))
        return materialise(found.select(F.col("vertex").alias("first"), "component"), "grid-components")

    def named(df: DataFrame, parts: DataFrame, first: str, out: str) -> DataFrame:
        other = parts.select(F.col("first").alias(first), F.col("component").alias(out))
        return df.join(other, first, "left").withColumn(out, F.coalesce(out, first))

    parts = components(links)
    open_pairs = met.filter("not sure").select("row_id", "first", "other_first", "other", "other_n", *x).filter("first < other_first")
    open_pairs = named(named(open_pairs, parts, "first", "c1"), parts, "other_first", "c2").filter("c1 <> c2")
    close = grid.against_rows(open_pairs, cores, []).select(F.col("first").alias("a"), F.col("other_first").alias("b")).distinct()
    close = materialise(close, "grid-close")
    if not close.isEmpty():
        parts = components(links.unionByName(close))
    homes = named(homes, parts, "first", "component")
    inner = cores.join(homes.select("cell", "component"), "cell").select("row_id", "component")
    rest = flagged.filter("not core").drop("core")
    around = grid.pairs(grid.cells(rest).select("cell", "low", "high"), materialise(homes, "grid-homes"))
    # A row of a cell that is sure as a whole is as near as one that is sure on its own.
    by_cell = rest.join(around.filter("sure").groupBy("cell").agg(F.min("other_component").alias("component")), "cell")
    edge = materialise(grid.against_boxes(rest, around), "grid-edge")
    by_row = grid.against_rows(edge.filter("not sure").select("row_id", "other", "other_n", "other_component", *x), cores, [])
    reached = by_cell.select("row_id", "component")
    reached = reached.unionByName(edge.filter("sure").select("row_id", F.col("other_component").alias("component")))
    reached = reached.unionByName(by_row.select("row_id", F.col("other_component").alias("component")))
    borders = reached.groupBy("row_id").agg(F.min("component").alias("component"))
    found = inner.unionByName(borders)
    return flagged.select("row_id", "core").join(found, "row_id", "left")
