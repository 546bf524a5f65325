"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has a codebook of its own; a vector lies in the cell
of its pair of centroids. A query visits pairs by rising sum of its distances
to the two centroids, taking them from a heap, until the visited cells hold
the wanted number of entries; those are ranked anew by exact distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.steps import saved

CENTROIDS = 32  # of each half
SAMPLE = 20_000  # vectors the codebooks are fitted to, those with the least hash of their id
VISIT = 0.55  # share of the entries that visited cells have to hold
LEAST = 1000  # entries they have to hold at least
SHARD = 4096  # entries that are ranked together
QUERIES = 512  # queries that are ranked together


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of each vector to their centroids."""
        cut = self.first.shape[1]
        return _squared(vectors[:, :cut], self.first), _squared(vectors[:, cut:], self.second)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0)


def _centroids(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's k-means from evenly spread rows; empty centroids stay where they are."""
    k = min(k, len(points))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        label = _squared(points, centres).argmin(axis=1)
        sizes = np.bincount(label, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): vectors of doubles that can be compared.

    Left out are null ids, null or zero vectors, those with null or non-finite
    components, and those that are not as long as most (the longer of equally
    frequent lengths).
    """
    vec = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return rows.filter(F.size("vec") == (most["length"] if most else 0))


def fit(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Codebooks:
    """Codebooks of both halves, fitted on the driver to at most ``sample`` vectors."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()
    points = np.array([r["vec"] for r in some], float)
    cut = points.shape[1] // 2
    return Codebooks(_centroids(points[:, :cut], centroids), _centroids(points[:, cut:], centroids))


def index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Every row with the number of its cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=books.cells(np.stack(batch["vec"].to_numpy())))

    return rows.mapInPandas(run, "vec_id long, vec array<double>, cell int")


def traverse(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells by rising a[i] + b[j] until they hold ``wanted`` entries; ``sizes`` has the entries of each cell.

    Starts at the nearest pair; a pair puts its right neighbour on the heap,
    and its lower one where that has no other way there.
    """
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[order_a], b[order_b]
    heap, found, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def search(
    embeddings: DataFrame,
    query_every: int = 100,
    k: int = 10,
    visit: float = VISIT,
    least: int = LEAST,
    books: Codebooks | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest entries found for rows whose vec_id is divisible by ``query_every``.

    Nearness is Euclidean distance in double precision on the given vectors,
    ties go to the smaller vec_id; a query never finds rows with its own id.
    Cells are dealt out as shards of about ``SHARD`` entries, a large cell as
    several, by hash; queries meet the shards they visit in blocks, and only k
    rows of each shard go on. Repeated ids are entries of their own, a repeated
    query counts once (its least vector). See ``usable`` for what is left out.
    """
    spark = embeddings.sparkSession
    rows = saved(usable(embeddings), "vectors")
    if not rows.head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = books or fit(rows)
    entries = saved(index(rows, books), "multi-index")
    n_cells = len(books.first) * len(books.second)
    sizes = np.zeros(n_cells, np.int64)
    for row in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most CENTROIDS ** 2
        sizes[row["cell"]] = row["n"]
    total = int(sizes.sum())
    wanted = max(least, math.ceil(visit * total))
    # Small cells share a shard; a large one is spread over several.
    spread = np.maximum(1, -(-sizes // SHARD))
    first, held, shard = np.zeros(n_cells, np.int64), 0, 0
    for cell in range(n_cells):
        if spread[cell] > 1 or held + sizes[cell] > SHARD:
            shard, held = shard + (held > 0), 0
        first[cell] = shard
        if spread[cell] > 1:
            shard += int(spread[cell])
        else:
            held += int(sizes[cell])
    plan = spark.createDataFrame(
        [(c, int(first[c]), int(spread[c])) for c in range(n_cells)], "cell int, first long, spread long"
    )
    salt = F.pmod(F.xxhash64("vec_id"), F.col("spread"))
    placed = entries.join(F.broadcast(plan), "cell").select("vec_id", "vec", "cell", (F.col("first") + salt).alias("shard"))
    asked = rows.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                some = batch.iloc[begin : begin + 64]
                near = books.distances(np.stack(some["vec"].to_numpy()))
                out = []
                for query, vec, block, a, b in zip(some["vec_id"], some["vec"], some["block"], *near):
                    of: dict[int, list[int]] = {}
                    for cell in traverse(a, b, sizes, wanted):
                        for part in range(int(spread[cell])):
                            of.setdefault(int(first[cell]) + part, []).append(cell)
                    out += [(query, vec, cells, part, block) for part, cells in of.items()]
                yield pd.DataFrame(out, columns=["query_id", "query", "cells", "shard", "block"])

    probes = asked.mapInPandas(visits, "query_id long, query array<double>, cells array<int>, shard long, block int")
    # Every block of queries meets every shard it visits once.
    met = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def nearest(shard: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(some):
            order = np.argsort(shard["cell"].to_numpy(), kind="stable")
            cell, ids = shard["cell"].to_numpy()[order], shard["vec_id"].to_numpy()[order]
            vectors = np.stack(shard["vec"].to_numpy())[order]
            for query, vec, cells in zip(some["query_id"], some["query"], some["cells"]):
                at = np.flatnonzero(np.isin(cell, cells) & (ids != query))
                score = np.sqrt(((vectors[at] - vec) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    grouped = met.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block"))
    found = grouped.applyInPandas(nearest, "query_id long, vec_id long, score double")
    # Each shard gave k rows at most; the window keeps k of them before and after the shuffle.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
