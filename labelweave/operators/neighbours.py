"""Exact nearest neighbours.

A pool below a checked size is broadcast and the other side is only scanned.
A larger pool, or one of many rows in few dimensions, is cut into bounded blocks: a first search in the block a row
falls into bounds its k-th distance, a second visits every block that could
hold something nearer. Both ways return the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.vectors import distances, many_features, matrix, pair_distances, rough_squares, rough_sums, stack
from labelweave.operators.blocks import SEARCH_FEATURES, build_index, search_rows
from labelweave.session import dealt_for_pairs, materialise

BROADCAST_BYTES = 64 * 1024 * 1024
# Distances equal to this many decimals are ties; the smaller row id goes first.
TIE_DIGITS = 9
CHUNK_CELLS = 2_000_000
QUERY_ROWS = 4096
GRID_FEATURES = 3  # with no more of them blocks keep most rows apart,
SCANNED_ROWS = 50_000  # so a larger pool is not scanned for every query
BOUND_COLUMNS = 2048  # of the pool, from which the k-th distance of a row is bounded

# ``tie`` is the rounded distance that orders the neighbours.
NEIGHBOUR = "struct<tie:double,row_id:bigint,dist:double,weight:bigint,label:int>"


def _kth(measure: np.ndarray, k: int, some: bool) -> np.ndarray:
    """A bound of the k-th least value of each row, taken from some columns or exactly from all."""
    step = max(1, measure.shape[1] // max(BOUND_COLUMNS, 64 * k)) if some else 1
    return np.partition(measure[:, ::step], k - 1, axis=1)[:, k - 1]


def top_k(queries: np.ndarray, pool: np.ndarray, k: int, p: int):
    """(query index, pool index, distance, rounded distance) of the k nearest; pool sorted by id.

    Rows of many features are first measured roughly, with a known error; whatever can be among the nearest is measured exactly. Some
    columns bound the k-th distance, so that few others are looked at again.
    """
    parts = []
    finite = bool(np.isfinite(queries).all() and np.isfinite(pool).all())
    rough = many_features(pool) and finite and k < len(pool)
    if rough:
        roughly = rough_sums if p == 1 else rough_squares
        middle = pool.mean(axis=0)
        turned_queries, turned_pool = queries - middle, pool - middle
    step = max(1, CHUNK_CELLS // max(1, len(pool)))
    for start in range(0, len(queries), step):
        asked = queries[start : start + step]
        if k >= len(pool):
            exact = distances(asked, pool, p)
            row, col = np.nonzero(np.ones_like(exact, dtype=bool))
            exact = exact[row, col]
        else:
            measure, error = roughly(turned_queries[start : start + step], turned_pool) if rough else (distances(asked, pool, p), 0.0)

            def widened(bound: np.ndarray) -> np.ndarray:
                """The bound, with room for what is rounded to the same distance."""
                bound = bound.astype(float) + error
                reach = np.sqrt(np.maximum(bound, 0.0)) if rough and p != 1 else bound
                reach = reach + 2 * 10.0**-TIE_DIGITS + np.abs(reach) * 1e-12
                return (reach * reach if rough and p != 1 else reach) + error

            row, col = np.nonzero(measure <= widened(_kth(measure, k, finite))[:, None])
            found = measure[row, col]
            if len(row) > 4 * k * len(asked):
                order = np.lexsort((found, row))
                place = np.arange(len(row)) - np.searchsorted(row, row)
                bound = np.full(len(asked), np.inf)
                last = order[place == k - 1]
                bound[row[last]] = found[last]
                kept = found <= widened(bound)[row]
                row, col, found = row[kept], col[kept], found[kept]
            exact = pair_distances(asked[row], pool[col], p) if rough else found
        tie = np.round(exact, TIE_DIGITS)
        order = np.lexsort((col, tie, row))
        row, col, exact, tie = row[order], col[order], exact[order], tie[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append((row[kept] + start, col[kept], exact[kept], tie[kept]))
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pool_columns(pool: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in pool.columns else F.lit(1)
    label = F.col("label") if "label" in pool.columns else F.lit(None)
    return pool.select("row_id", "features", weight.cast("long").alias("weight"), label.cast("int").alias("label"))


def _nearest_broadcast(queries: DataFrame, pool: DataFrame, k: int, p: int) -> DataFrame:
    rows = pool.toArrow().sort_by("row_id").combine_chunks()
    held = queries.sparkSession.sparkContext.broadcast(
        (
            matrix(rows["features"].combine_chunks()),
            rows["row_id"].to_numpy(),
            rows["weight"].to_numpy(),
            rows["label"].to_pandas().astype("float64").to_numpy(),
        )
    )

    def search(batches):
        vectors, ids, weights, labels = held.value
        for batch in batches:
            own = matrix(batch.column(batch.schema.get_field_index("features")))
            row, col, dist, tie = top_k(own, vectors, k, p) if len(vectors) else top_k(own[:0], own, k, p)
            found = pa.StructArray.from_arrays(
                [
                    pa.array(tie, pa.float64()),
                    pa.array(ids[col], pa.int64()),
                    pa.array(dist, pa.float64()),
                    pa.array(weights[col], pa.int64()),
                    pa.array(labels[col], pa.int32(), from_pandas=True, safe=False),
                ],
                names=["tie", "row_id", "dist", "weight", "label"],
            )
            offsets = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row_id")), lists], names=["row_id", "neighbours"]
            )

    asked = dealt_for_pairs(queries.select("row_id", "features"), len(rows) * max(len(rows), QUERY_ROWS))
    return asked.mapInArrow(search, f"row_id bigint, neighbours array<{NEIGHBOUR}>")


def _search_blocks(visits: DataFrame, blocks: DataFrame, k: int, p: int, part_rows: int = QUERY_ROWS) -> DataFrame:
    """Best k per (query, visited block); crowded blocks are visited in parts."""
    loads = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    asked = visits.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
    held = blocks.join(loads, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("row_id")
        if not len(left) or not len(right):
            row, col, dist, tie = top_k(np.zeros((0, 1)), np.zeros((0, 1)), k, p)
        else:
            row, col, dist, tie = top_k(stack(left["features"]), stack(right["features"]), k, p)
        near = right.iloc[col]
        return pd.DataFrame(
            {
                "query_id": left["row_id"].to_numpy()[row],
                "tie": tie,
                "row_id": near["row_id"].to_numpy(),
                "dist": dist,
                "weight": near["weight"].to_numpy(),
                "label": near["label"].to_numpy(),
            }
        )

    schema = "query_id bigint, tie double, row_id bigint, dist double, weight bigint, label int"
    left = asked.select("block", "part", "row_id", "features").groupBy("block", "part")
    right = held.select("block", "part", "row_id", "features", "weight", "label").groupBy("block", "part")
    found = left.cogroup(right).applyInPandas(search, schema)
    best = Window.partitionBy("query_id").orderBy("tie", "row_id")
    return (
        found.withColumn("_place", F.row_number().over(best))
        .filter(F.col("_place") <= k)
        .groupBy(F.col("query_id").alias("row_id"))
        .agg(F.array_sort(F.collect_list(F.struct("tie", F.col("row_id").alias("row_id"), "dist", "weight", "label"))).alias("neighbours"))
    )


def _nearest_blocks(queries: DataFrame, pool: DataFrame, k: int, p: int, rows: int | None, d: int) -> DataFrame:
    # Copies: only the first k of equal pool rows can be among the nearest,
    # and equal query rows share one search.
    copies = Window.partitionBy("features").orderBy("row_id")
    pool = pool.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy")
    pool = materialise(pool, "pool")
    asked = materialise(queries.groupBy("features").agg(F.min("row_id").alias("row_id")), "queries")
    index = build_index(pool, p, rows or search_rows(pool.count(), d))
    # Where rows visit most blocks, each block is sent to few parts of the queries.
    part_rows = QUERY_ROWS if d <= SEARCH_FEATURES else 8 * QUERY_ROWS
    blocks = materialise(index.own_block(pool), "blocks")
    near = _search_blocks(index.own_block(asked), blocks, k, p, part_rows)
    reach = F.when(F.size("neighbours") >= k, F.element_at("neighbours", -1)["tie"] + 10.0**-TIE_DIGITS)
    bounds = near.select("row_id", reach.alias("reach"))
    bounded = asked.join(bounds, "row_id", "left").withColumn("reach", F.coalesce("reach", F.lit(math.inf)))
    visits = index.near_blocks(bounded, F.col("reach"), "block").select("row_id", "features", "block")
    found = _search_blocks(materialise(visits, "visits"), blocks, k, p, part_rows)
    answers = asked.join(found, "row_id").select("features", "neighbours")
    return queries.select("row_id", "features").join(answers, "features").select("row_id", "neighbours")


def nearest(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    p: int = 2,
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows: int | None = None,
) -> DataFrame:
    """(row_id, neighbours): the k nearest pool rows of every query row.

    ``neighbours`` is sorted by (rounded distance, row id). ``exclude_self`` leaves the
    row with the query's own id out.
    """
    wanted = k + 1 if exclude_self else k
    pool = _pool_columns(pool)
    size = pool.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    d = size["d"] or 0
    if size["n"] * (d + 3) * 8 <= broadcast_bytes and (d > GRID_FEATURES or size["n"] <= SCANNED_ROWS):
        found = _nearest_broadcast(queries, pool, wanted, p)
    else:
        found = _nearest_blocks(queries, pool, wanted, p, rows, d)
    if exclude_self:
        others = F.filter("neighbours", lambda x: x["row_id"] != F.col("row_id"))
        found = found.withColumn("neighbours", F.slice(others, 1, k))
    return found


def knn_classify(
    queries: DataFrame, pool: DataFrame, k: int = 10, p: int = 1, weights: str = "distance", **options
) -> DataFrame:
    """Class probabilities from the labelled pool (row_id, features, label).

    With 'distance' weights an exact match outweighs everything else.
    """
    found = nearest(queries, pool, k, p, **options)

    def share(label_is_one):
        exact = F.exists("neighbours", lambda x: x["dist"] == 0)

        def weight(x):
            if weights == "uniform":
                return F.lit(1.0)
            return F.when(exact, (x["dist"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), x["dist"]))

        def add(total, x):
            return total + F.when(label_is_one(x["label"]), weight(x)).otherwise(F.lit(0.0))

        return F.aggregate("neighbours", F.lit(0.0), add)

    one, all_ = share(lambda v: v == 1), share(lambda v: v.isNotNull())
    scored = found.select("row_id", one.alias("_one"), all_.alias("_all"))
    p1 = F.try_divide(F.col("_one"), F.col("_all"))
    return scored.select("row_id", (1 - p1).alias("p0"), p1.alias("p1"))
