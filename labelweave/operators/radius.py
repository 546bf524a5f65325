"""Rows within a radius of each other, and clusters grown from them.

Copies of a vector are one weighted point. In up to three dimensions a grid
decides most pairs by boxes (see ``grid``). In more, tasks see one bounded
block pair each and pass on counts or a spanning forest of what is connected
inside the pair, so no step ever lists all pairs of a crowded neighbourhood.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.order import prefix_sums
from labelweave.functions.vectors import distances, stack, within
from labelweave.operators import grid
from labelweave.operators.blocks import WIDE_BLOCK_ROWS, build_index, distinct_points, sides, tiles
from labelweave.operators.forest import connected_components
from labelweave.session import materialise

PART_ROWS = 512  # of a block that meet the other one at once
LOT_ROWS = 256  # of one vector that meet other rows together


def _near(tile: pd.DataFrame, radius: float, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, near flag) for the pairs this tile is responsible for."""
    d = distances(stack(tile["features"]), stack(tile["features"]), p)
    near = d <= radius
    if tile["low"].iloc[0] != tile["high"].iloc[0]:
        block = tile["block"].to_numpy()
        near &= block[:, None] != block[None, :]
    return d, near


def radius_graph(points: DataFrame, radius: float, p: int = 2) -> tuple[DataFrame, DataFrame]:
    """Sparse distance graph as (edges, members).

    ``edges`` (src, dst, dist) join distinct vectors, src < dst; ``members``
    (row_id, point, weight) maps rows to their vector. Rows of one vector are
    at distance 0 of each other. Together they are the whole graph.
    """
    vectors = materialise(distinct_points(points), "vectors")

    def pairs(tile: pd.DataFrame) -> pd.DataFrame:
        d, near = _near(tile, radius, p)
        ids = tile["row_id"].to_numpy()
        row, col = np.nonzero(near & (ids[:, None] < ids[None, :]))
        return pd.DataFrame({"src": ids[row], "dst": ids[col], "dist": d[row, col]})

    d = grid.fits(vectors, radius)
    spread = None if d else tiles(vectors, build_index(vectors, p), radius)
    edges = grid.radius_pairs(vectors, radius, p, d) if d else spread.groupBy("low", "high").applyInPandas(pairs, "src bigint, dst bigint, dist double")
    named = vectors.select("features", F.col("row_id").alias("point"), "weight")
    members = points.join(named, "features").select("row_id", "point", "weight")
    return edges, members


def row_pairs(edges: DataFrame, members: DataFrame, lot_rows: int = LOT_ROWS) -> DataFrame:
    """(src, dst, dist), src < dst: the pairs of rows that a graph of ``radius_graph`` stands for.

    The rows of a vector are cut into lots of about ``lot_rows``. Lots are joined, by vector or as two of the same
    vector, and pairs are spelt out where lots meet: no pair is shuffled, and no task holds all copies of a vector.
    Rows with a null id are in no pair.
    """
    lots = F.ceil(F.col("weight") / lot_rows)
    lot = F.pmod(F.xxhash64("row_id"), lots)
    held = members.withColumns({"lots": lots, "lot": lot}).groupBy("point", "lots", "lot").agg(F.collect_list("row_id").alias("rows"))
    held = materialise(held, "lots")

    def spelt(met: DataFrame) -> DataFrame:
        rows = met.select("dist", "one", F.explode("left").alias("a"), "right").select("dist", "one", "a", F.explode("right").alias("b"))
        # Both orders of two rows meet within one lot.
        rows = rows.filter(F.when(F.col("one"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
        return rows.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "dist")

    left = held.select(F.col("point").alias("src"), F.col("rows").alias("left"))
    right = held.select(F.col("point").alias("dst"), F.col("rows").alias("right"))
    far = edges.join(left, "src").join(right, "dst").withColumn("one", F.lit(False))
    first = held.select("point", F.col("lot").alias("_lot"), F.col("rows").alias("left"), F.explode(F.sequence("lot", F.col("lots") - 1)).alias("lot"))
    same = first.join(held.select("point", "lot", F.col("rows").alias("right")), ["point", "lot"])
    same = same.withColumns({"dist": F.lit(0.0), "one": F.col("_lot") == F.col("lot")})
    return spelt(far).unionByName(spelt(same))


def radius_counts(points: DataFrame, radius: float, p: int = 2) -> DataFrame:
    """(row_id, n_near): rows within the radius, the row itself included."""
    vectors = materialise(distinct_points(points), "vectors")
    d = grid.fits(vectors, radius)
    counted = grid.radius_counts(vectors, radius, p, d) if d else _count_near(vectors, build_index(vectors, p, most=WIDE_BLOCK_ROWS), radius, p)
    near = vectors.join(counted, "row_id").select("features", "n_near")
    return points.join(near, "features").select("row_id", "n_near")


def _count_near(vectors: DataFrame, index, radius: float, p: int) -> DataFrame:
    def count(tile: pd.DataFrame) -> pd.DataFrame:
        one, two = sides(tile)
        rows = stack(one["features"])
        if two is None:
            n = np.concatenate([within(rows[at : at + PART_ROWS], rows, radius, p) @ one["weight"].to_numpy(float) for at in range(0, len(rows), PART_ROWS)])
            return pd.DataFrame({"row_id": one["row_id"], "n": n.astype(np.int64)})
        if not len(one) or not len(two):
            return pd.DataFrame({"row_id": [], "n": []}).astype("int64")
        others, n, back = stack(two["features"]), [], np.zeros(len(two))
        for at in range(0, len(rows), PART_ROWS):
            near = within(rows[at : at + PART_ROWS], others, radius, p).astype(float)
            n.append(near @ two["weight"].to_numpy(float))
            back += one["weight"].to_numpy(float)[at : at + PART_ROWS] @ near
        return pd.DataFrame({"row_id": np.concatenate([one["row_id"], two["row_id"]]), "n": np.concatenate([*n, back]).astype(np.int64)})

    spread = tiles(vectors, index, radius)
    partial = spread.groupBy("low", "high").applyInPandas(count, "row_id bigint, n bigint")
    return partial.groupBy("row_id").agg(F.sum("n").alias("n_near"))


def _link(tile: pd.DataFrame, radius: float, p: int) -> pd.DataFrame:
    """Core-to-core links as one star per connected part, and border candidates."""
    _, near = _near(tile, radius, p)
    ids, core = tile["row_id"].to_numpy(), tile["core"].to_numpy()
    label = np.where(core, ids, np.iinfo(np.int64).max)
    links = near & core[:, None] & core[None, :]
    at = np.argsort(ids)
    while True:
        reach = np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        lower = np.where(core, np.minimum(label, reach), label)
        # A row's label is the id of a core row of its part: jump on to that row's own label.
        lower[core] = np.minimum(lower[core], lower[at[np.searchsorted(ids[at], lower[core])]])
        if (lower == label).all():
            break
        label = lower
    stars = core & (label != ids)
    row, col = np.nonzero(near & ~core[:, None] & core[None, :])
    border = pd.DataFrame({"a": ids[row], "b": label[col]}).drop_duplicates()
    joined = pd.DataFrame({"a": label[stars], "b": ids[stars]})
    return pd.concat([joined.assign(kind="core"), border.assign(kind="border")])


def _dbscan_blocks(vectors: DataFrame, eps: float, min_pts: int, p: int) -> DataFrame:
    """(row_id, component, core) of distinct vectors in any number of dimensions; see ``grid.dbscan``."""
    index = build_index(vectors, p)
    counted = _count_near(vectors, index, eps, p).withColumn("core", F.col("n_near") >= min_pts)
    flagged = materialise(vectors.join(counted.select("row_id", "core"), "row_id"), "flagged")
    links = materialise(
        tiles(flagged, index, eps).groupBy("low", "high").applyInPandas(
            lambda tile: _link(tile, eps, p), "a bigint, b bigint, kind string"
        ),
        "links",
    )
    stars = links.filter("kind = 'core'").select(F.lit(0).alias("g"), "a", "b")
    parts = connected_components(stars).select(F.col("vertex").alias("row_id"), "component")
    cores = flagged.filter("core").join(parts, "row_id", "left").select(
        "row_id", F.coalesce("component", "row_id").alias("component")
    )
    cores = materialise(cores, "cores")
    reached = links.filter("kind = 'border'").join(cores.withColumnRenamed("row_id", "b"), "b")
    borders = reached.groupBy(F.col("a").alias("row_id")).agg(F.min("component").alias("component"))
    return flagged.select("row_id", "core").join(cores.unionByName(borders), "row_id", "left")


def dbscan(points: DataFrame, eps: float = 0.5, min_pts: int = 10, p: int = 2) -> DataFrame:
    """(row_id, cluster, core): density clusters, noise is -1.

    A row is core when at least ``min_pts`` rows (itself included) lie within
    ``eps``. Clusters are numbered by their first core row; a border row joins
    the first of the clusters that reach it.
    """
    vectors = materialise(distinct_points(points), "vectors")
    d = grid.fits(vectors, eps)
    found = grid.dbscan(vectors, eps, min_pts, p, d) if d else _dbscan_blocks(vectors, eps, min_pts, p)
    found = materialise(found, "components")
    cores = found.filter("core")
    firsts = cores.groupBy("component").agg(F.lit(1).alias("_one"))
    numbers = prefix_sums(firsts, "component", {"_number": "_one"}).select(
        "component", (F.col("_number") - 1).cast("int").alias("cluster")
    )
    labelled = found.join(numbers, "component", "left").join(vectors.select("row_id", "features"), "row_id")
    named = labelled.select("features", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "core")
    return points.join(named, "features").select("row_id", "cluster", "core")
