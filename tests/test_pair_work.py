"""Pair work: bounds that must not lose a pair, and tasks enough for the pairs."""

import numpy as np
import pytest

from labelweave.functions import vectors
from labelweave.operators import classifiers, density, neighbours, validity
from labelweave.operators.classifiers import Member
from labelweave.plans import registry


def rows_of(seed, n, d):
    """Unit vectors, some of them copies and some a hair's breadth from others."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[: n // 10] = x[n // 10 : 2 * (n // 10)]
    x[n // 2 : n // 2 + 5] = x[n // 2 + 5 : n // 2 + 10] + 1e-8
    return x


def plain(x, y, p):
    gap = np.abs(x[:, None, :] - y[None, :, :])
    return gap.sum(2) if p == 1 else np.sqrt((gap**2).sum(2))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")


@pytest.mark.parametrize("d", [2, 64])
@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("n", [20, 300])
def test_rough_distances_lose_no_neighbour(monkeypatch, d, p, n):
    monkeypatch.setattr(neighbours, "BOUND_COLUMNS", 40)
    x = rows_of(d, n, d)
    row, col, dist, tie = neighbours.top_k(x, x, 5, p)
    exact = vectors.distances(x, x, p)
    np.testing.assert_allclose(exact, plain(x, x, p), atol=1e-12)
    wanted = np.round(exact, neighbours.TIE_DIGITS)
    for i in range(n):
        best = sorted((wanted[i, j], j) for j in range(n))[:5]
        assert col[row == i].tolist() == [j for _, j in best]
        assert dist[row == i].tolist() == [exact[i, j] for _, j in best]


@pytest.mark.parametrize("d", [3, 64])
def test_rows_at_the_very_radius_are_near(d):
    x = rows_of(d, 200, d)
    exact = vectors.distances(x, x, 2)
    for radius in (0.0, exact[0, 150], exact[20, 33]):
        assert (vectors.within(x, x, radius, 2) == (exact <= radius)).all()


@pytest.mark.parametrize("d", [2, 64])
def test_sums_of_distances_to_clusters(d):
    x, y = rows_of(1, 300, d), rows_of(2, 170, d)
    y[:20] = x[:20]
    rng = np.random.default_rng(3)
    share, back = rng.integers(0, 3, (170, 4)).astype(float), rng.integers(0, 3, (300, 2)).astype(float)
    sums, other = vectors.distance_sums(x, y, share, back)
    np.testing.assert_allclose(sums, plain(x, y, 2) @ share, rtol=1e-10)
    np.testing.assert_allclose(other, plain(y, x, 2) @ back, rtol=1e-10)


def test_edges_across_two_blocks_span_what_they_join():
    rng = np.random.default_rng(4)
    for reach in (0.3, 0.6, 2.0):
        w = np.round(rng.uniform(0, 1, (30, 20)), 2)
        w[w > reach] = np.inf
        x, y, cost = density._prim_across(w)
        assert (w[x, y] == cost).all()
        # Kruskal's choice has the same weights.
        parent, wanted = list(range(50)), []

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for c, i, j in sorted((w[i, j], i, 30 + j) for i in range(30) for j in range(20) if w[i, j] < np.inf):
            if root(i) != root(j):
                parent[root(i)] = root(j)
                wanted.append(c)
        assert sorted(cost.tolist()) == wanted


@pytest.mark.parametrize("rank", [1, 3])
@pytest.mark.parametrize("radius", [1.2, 10.0])
def test_trees_by_products_are_those_of_exact_distances(rank, radius):
    x = rows_of(7, 500, 64)
    exact = vectors.distances(x, x, 2)
    core = np.sort(exact, axis=1)[:, rank]
    left, right, near, far = x[:280], x[280:], core[:280], core[280:]
    reach = np.maximum(np.maximum(exact[:280, 280:], near[:, None]), far)
    reach[reach > radius] = np.inf
    found = density._prim_near(left, right, near, far, *vectors.rough_squares(left, right), radius)
    for got, wanted in zip(found, density._prim_across(reach)):
        assert got.tolist() == wanted.tolist()


def test_blocks_of_tied_rows_are_left_to_exact_distances():
    x = np.random.default_rng(8).integers(0, 3, (200, 9)) / 7
    none = np.zeros(100)
    assert density._prim_near(x[:100], x[100:], none, none, *vectors.rough_squares(x[:100], x[100:]), 10.0) is None


def test_a_table_of_one_file_is_searched_by_all_cores(spark):
    df = frame(spark, rows_of(5, 3500, 4)).coalesce(1)
    found = neighbours.nearest(df, df, 3)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_silhouettes_are_dealt_by_pairs(spark, monkeypatch):
    dealt = []
    plain_way = validity.dealt_for_pairs
    monkeypatch.setattr(validity, "dealt_for_pairs", lambda df, pairs: dealt.append(pairs) or plain_way(df, pairs))
    rows = frame(spark, rows_of(6, 40, 3)).selectExpr("*", "CAST(row_id % 3 AS INT) AS cluster")
    assert -1 <= validity.silhouette(rows).first()["silhouette"] <= 1
    assert dealt == [40**2]


def test_many_rows_in_few_dimensions_are_not_scanned(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("scanned")

    monkeypatch.setattr(neighbours, "SCANNED_ROWS", 50)
    monkeypatch.setattr(neighbours, "_nearest_broadcast", refuse)
    x = rows_of(7, 200, 2)
    d = np.round(vectors.distances(x, x, 2), 9)
    for r in neighbours.nearest(frame(spark, x), frame(spark, x), 4).collect():
        assert [n["row_id"] for n in r["neighbours"]] == [j for _, j in sorted((d[r["row_id"], j], j) for j in range(200))[:4]]


def test_a_large_pool_of_one_file_is_learnt_from_by_all_cores(spark, monkeypatch):
    parts = []
    plain_way = classifiers.labelled
    monkeypatch.setattr(classifiers, "DEALT_ROWS", 50)
    monkeypatch.setattr(classifiers, "labelled", lambda pool: parts.append(pool.rdd.getNumPartitions()) or plain_way(pool))
    pool = frame(spark, rows_of(8, 60, 2)).selectExpr("*", "CAST(row_id % 2 AS INT) AS label").coalesce(1)
    classifiers.fit(Member("logistic", "logistic"), pool)
    assert parts == [spark.sparkContext.defaultParallelism]


def test_the_single_train_loop_runs_over_all_events():
    assert "FROM events" in registry.ORACLES["h11_active_loop_single_train"]
