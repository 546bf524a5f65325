"""Approximate nearest neighbours by random projections.

Rows are hashed by a few random directions, cut into steps of one width; near
rows share a bucket in one of several such tables with a probability that
does not depend on the size of the table. Only rows that share a bucket are
compared, and those exactly. ``neighbours.nearest`` is the exact way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.vectors import distances, matrix, stack
from labelweave.operators.neighbours import top_k
from labelweave.session import materialise

PART_ROWS = 4096  # rows of a bucket that are compared in one group, of either side
SAMPLE_ROWS = 1024
SEED = 42


def usual_gap(pool: DataFrame, k: int, p: int = 2) -> float:
    """Median distance to the k-th neighbour inside a sample of at most ``SAMPLE_ROWS`` rows; too large rather than too small."""
    n = pool.count()
    cut = min(1.0, SAMPLE_ROWS / max(n, 1)) * 16**8
    prefix = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = matrix(pool.filter(prefix < F.lit(int(cut))).select("features").limit(SAMPLE_ROWS).toArrow().column("features").combine_chunks())
    if len(rows) < 2:
        return 1.0
    gaps = np.sort(distances(rows, rows, p), axis=1)[:, min(k, len(rows) - 1)]
    # Of m rows of n, neighbours are farther apart by the d-th root of n / m at most.
    return float(np.median(gaps) * (len(rows) / max(n, 1)) ** (1 / rows.shape[1])) or 1.0


def _bucketed(points: DataFrame, tables: int, projections: int, width: float, p: int, seed: int) -> DataFrame:
    """(row_id, features, bucket), one row for each table."""

    def run(batches):
        for batch in batches:
            ids, features = batch.column("row_id"), batch.column("features")
            rows = matrix(features)
            for table in range(tables if len(rows) else 0):
                rng = np.random.Generator(np.random.Philox(key=[seed, table]))
                size = (rows.shape[1], projections)
                turn = rng.standard_cauchy(size) if p == 1 else rng.normal(size=size)
                step = np.floor((rows @ turn) / width + rng.uniform(0, 1, projections)).astype(np.int64)
                code = np.full(len(rows), table + 1, np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(projections):
                        code = (code ^ step[:, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                        code ^= code >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([ids, features, pa.array(code.view(np.int64))], names=["row_id", "features", "bucket"])

    return points.select("row_id", "features").mapInArrow(run, "row_id bigint, features array<double>, bucket bigint")


def nearest_by_hashing(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    p: int = 2,
    tables: int = 8,
    projections: int = 2,
    width: float | None = None,
    exclude_self: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, row_id, dist): up to k near pool rows of every query row, by (rounded distance, row id).

    ``width`` is that of a step, four times the usual distance to the k-th
    neighbour by default. More tables find more, more projections compare
    fewer. A query that shares no bucket with anything has no row. Crowded
    buckets are compared in parts; nothing is capped.
    """
    width = width or 4 * usual_gap(pool, k, p)
    asked = materialise(_bucketed(queries, tables, projections, width, p, seed), "asked")
    held = materialise(_bucketed(pool, tables, projections, width, p, seed), "held")
    part = lambda n: F.ceil(F.col(n) / PART_ROWS).cast("int")
    sizes = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_asked")).join(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_held")), "bucket")
    sizes = materialise(sizes.select("bucket", part("n_asked").alias("q"), part("n_held").alias("h")), "bucket-sizes")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        spread = rows.join(sizes, "bucket").withColumn(f"{own}_part", F.pmod(F.xxhash64("row_id"), F.col(own).cast("long")).cast("int"))
        spread = spread.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return spread.select("bucket", "q_part", "h_part", "row_id", "features").groupBy("bucket", "q_part", "h_part")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("row_id")
        wanted = k + 1 if exclude_self else k
        if not len(left) or not len(right):
            row, col, dist, tie = top_k(np.zeros((0, 1)), np.zeros((0, 1)), wanted, p)
        else:
            row, col, dist, tie = top_k(stack(left["features"]), stack(right["features"]), wanted, p)
        return pd.DataFrame({"query_id": left["row_id"].to_numpy()[row], "row_id": right["row_id"].to_numpy()[col], "dist": dist, "tie": tie})

    found = dealt(asked, "q", "h").cogroup(dealt(held, "h", "q")).applyInPandas(search, "query_id bigint, row_id bigint, dist double, tie double")
    if exclude_self:
        found = found.filter("query_id <> row_id")
    best = Window.partitionBy("query_id").orderBy("tie", "row_id")
    found = found.dropDuplicates(["query_id", "row_id"])
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "row_id", "dist")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, recall): share of the exact neighbours (row_id, neighbours) that ``found`` holds, or others as near."""
    true = exact.select(F.col("row_id").alias("query_id"), F.explode("neighbours").alias("n")).select("query_id", F.col("n.dist").alias("dist"))
    wanted = true.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("reach"))
    hits = found.join(wanted, "query_id").filter(F.col("dist") <= F.col("reach") + 1e-9).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = wanted.join(hits, "query_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n")).alias("recall"))
