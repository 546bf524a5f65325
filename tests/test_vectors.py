import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from labelweave.functions.vectors import with_vector
from labelweave.operators import blocks, centres, forest, grid, hashing, kernels, merge_tree, neighbours, radius, selection, validity

SCHEMA = "row_id bigint, features array<double>"


@pytest.fixture(scope="module")
def cloud():
    """Three blobs, a scatter, and one vector held by a third of the rows."""
    rng = np.random.default_rng(5)
    blobs = [rng.normal(c, 0.15, (25, 3)) for c in ([0, 0, 0], [2, 0, 1], [0, 3, 1])]
    x = np.concatenate([*blobs, rng.uniform(-2, 4, (25, 3)), np.tile([1.0, 1.0, 1.0], (50, 1))])
    return x[rng.permutation(len(x))]


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def pairwise(x, p=2):
    gap = np.abs(x[:, None, :] - x[None, :, :])
    return gap.sum(2) if p == 1 else np.sqrt((gap**2).sum(2))


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "rows": 16}])
def test_nearest_against_brute_force(spark, cloud, p, options):
    df = frame(spark, cloud)
    found = neighbours.nearest(df, df, 4, p, exclude_self=True, **options).collect()
    d = np.round(pairwise(cloud, p), 9)
    assert len(found) == len(cloud)
    for r in found:
        others = sorted((d[r["row_id"], j], j) for j in range(len(cloud)) if j != r["row_id"])[:4]
        assert [n["row_id"] for n in r["neighbours"]] == [j for _, j in others]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "rows": 8}])
def test_knn_exact_match_outweighs_the_rest(spark, options):
    pool = spark.createDataFrame([(1, [0.0], 1), (2, [0.1], 0), (3, [0.2], 0), (4, [9.0], 1)], SCHEMA + ", label int")
    asked = spark.createDataFrame([(10, [0.0]), (11, [0.05])], SCHEMA)
    got = {r["row_id"]: r["p1"] for r in neighbours.knn_classify(asked, pool, 3, 1, "distance", **options).collect()}
    assert got[10] == 1.0
    assert got[11] == pytest.approx(20 / (20 + 20 + 1 / 0.15))
    small = neighbours.knn_classify(asked, pool, 99, 1, "uniform", **options)
    assert {r["p1"] for r in small.collect()} == {0.5}


def test_radius_counts_and_graph(spark, cloud):
    df = frame(spark, cloud)
    d = pairwise(cloud)
    counts = {r["row_id"]: r["n_near"] for r in radius.radius_counts(df, 0.4).collect()}
    assert counts == {i: int((d[i] <= 0.4).sum()) for i in range(len(cloud))}
    edges, members = radius.radius_graph(df, 0.4)
    assert members.count() == len(cloud)
    assert edges.count() < 3 * len(cloud) * 25


@pytest.mark.parametrize("p", [1, 2])
def test_index_loses_no_near_pair(spark, cloud, p):
    df = frame(spark, cloud)
    index = blocks.build_index(df, p, 16)
    placed = index.own_block(df)
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 40
    near = index.near_blocks(placed, F.lit(0.5)).select("row_id", "other")
    met = near.join(placed.select(F.col("row_id").alias("y"), F.col("block").alias("other")), "other")
    met = {(r["row_id"], r["y"]) for r in met.collect()}
    d = pairwise(cloud, p)
    assert {(int(a), int(b)) for a, b in np.argwhere(d <= 0.5)} <= met
    assert len(met) < 0.7 * len(cloud) ** 2
    assert index.diameter() >= d.max()


def clustered_unit_vectors(n, seed=3, per_cluster=250, dimensions=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(n // per_cluster, dimensions))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    x = np.repeat(middles, per_cluster, axis=0) + rng.normal(scale=0.02, size=(n, dimensions))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_copies_per_row_do_not_grow_with_the_table(spark):
    copies = []
    for n in (2000, 8000):
        df = frame(spark, clustered_unit_vectors(n))
        index = blocks.build_index(df, 2, 256)
        copies.append(index.near_blocks(df, F.lit(0.1)).count() / n)
        assert index.n_blocks >= n / 512
    assert copies[1] < 1.5 * copies[0] < 1.5 * 8


def test_no_rows_have_an_index(spark):
    df = frame(spark, np.zeros((0, 2)))
    assert radius.radius_counts(df, 1.0).count() == 0
    assert radius.dbscan(df, 1.0, 3).count() == 0
    assert blocks.tiles(df, blocks.build_index(df, 2), 1.0).count() == 0


def planar(seed, d=2, crowd=300):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.02, (crowd, d)), rng.uniform(-2, 2, (200, d)), rng.normal(1, 0.3, (80, d)), np.round(rng.uniform(-1, 1, (80, d)), 1)])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("d, p", [(1, 2), (2, 2), (2, 1), (3, 2)])
def test_grid_counts_and_pairs(spark, monkeypatch, d, p):
    monkeypatch.setattr(grid, "PART_ROWS", 32)
    x = planar(d, d)
    df, dist = frame(spark, x), pairwise(x, p)
    for eps in (0.1, 0.37):
        assert grid.fits(df, eps) == d
        got = {r["row_id"]: r["n_near"] for r in radius.radius_counts(df, eps, p).collect()}
        assert got == {i: int((dist[i] <= eps).sum()) for i in range(len(x))}
    edges, members = radius.radius_graph(df, 0.1, p)
    point = {r["row_id"]: r["point"] for r in members.collect()}
    found = {(r["src"], r["dst"]): r["dist"] for r in edges.collect()}
    for a, b in np.argwhere(dist <= 0.1):
        if point[a] < point[b]:
            assert found.pop((point[a], point[b]), dist[a, b]) == pytest.approx(dist[a, b])
    assert not [k for k in found if k[0] not in set(point.values())]


@pytest.mark.parametrize("eps, min_pts", [(0.1, 5), (0.3, 8), (0.05, 2), (1.0, 40)])
def test_grid_clusters_equal_brute_force_and_blocks(spark, eps, min_pts):
    x = planar(5)
    labels, core = brute_dbscan(x, eps, min_pts)
    df = frame(spark, x)
    got = radius.dbscan(df, eps, min_pts).orderBy("row_id").collect()
    assert [r["core"] for r in got] == list(core)
    assert [r["cluster"] for r in got] == list(labels)
    vectors = blocks.distinct_points(df)
    ways = [grid.dbscan(vectors, eps, min_pts, 2, 2), radius._dbscan_blocks(vectors, eps, min_pts, 2)]
    ways = [sorted(map(str, w.select("row_id", "component", "core").collect())) for w in ways]
    assert ways[0] == ways[1]


def test_crowded_cells_make_no_pairs(spark):
    """Rows that the grid joins to a crowd stay linear in the crowd."""
    made = []
    for crowd in (1000, 4000):
        vectors = blocks.distinct_points(frame(spark, planar(1, 2, crowd)))
        held = grid.Grid(vectors, 0.5, 2, 2)
        cells = held.cells(held.rows)
        sparse = cells.filter("w < 20")
        pairs = held.pairs(sparse, cells)
        met = held.against_boxes(held.rows.join(sparse.select("cell"), "cell", "left_semi").drop("weight"), pairs).filter("not sure")
        made.append(held.against_rows(met.select("row_id", "other", "other_n", "x0", "x1"), held.rows, ["weight"]).count())
    assert made[1] < 5 * made[0] + 4000


def brute_dbscan(x, eps, min_pts):
    near = pairwise(x) <= eps
    core = near.sum(1) >= min_pts
    labels, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or labels[i] != -1:
            continue
        stack, labels[i] = [i], number
        while stack:
            v = stack.pop()
            if not core[v]:
                continue
            for u in np.nonzero(near[v])[0]:
                if labels[u] == -1:
                    labels[u] = number
                    stack.append(u)
        number += 1
    return labels, core


@pytest.mark.parametrize("eps, min_pts", [(0.35, 4), (0.9, 3), (0.05, 2)])
def test_dbscan_against_brute_force(spark, cloud, eps, min_pts):
    got = radius.dbscan(frame(spark, cloud), eps, min_pts).orderBy("row_id").collect()
    labels, core = brute_dbscan(cloud, eps, min_pts)
    assert [r["cluster"] for r in got] == list(labels)
    assert [r["core"] for r in got] == list(core)


def random_edges(spark, n, m, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in (0, 1):
        for a, b in rng.integers(0, n, (m, 2)):
            if a != b:
                rows.append((g, int(min(a, b)), int(max(a, b)), float(rng.integers(0, 6))))
    return spark.createDataFrame(rows, "g int, a bigint, b bigint, w double")


def test_contraction_rounds_equal_one_task(spark):
    edges = random_edges(spark, 60, 90, 3)
    one = forest.spanning_forest(edges).groupBy("g").agg(F.sum("w"), F.count("w")).orderBy("g").collect()
    many = forest.spanning_forest(edges, task_edges=5).groupBy("g").agg(F.sum("w"), F.count("w")).orderBy("g").collect()
    assert one == many
    small = sorted(map(tuple, forest.connected_components(edges).collect()))
    large = sorted(map(tuple, forest.connected_components(edges, task_edges=5).collect()))
    assert small == large


def test_many_edges_of_few_vertices_are_thinned_without_contraction(spark, monkeypatch):
    edges = random_edges(spark, 30, 900, 5)
    edges = edges.withColumn("w", F.col("w") + F.col("a") / 100 + F.col("b") / 10000).distinct()
    one = sorted(map(tuple, forest.spanning_forest(edges).collect()))
    monkeypatch.setattr(forest, "_round", None)
    assert sorted(map(tuple, forest.spanning_forest(edges, task_edges=40).collect())) == one
    assert len(one) == 2 * 29


def shape(tree):
    """Merge tree as the set of (weight, leaf names) of its nodes."""
    rows = tree.collect()
    result = set()
    for g in {r["g"] for r in rows}:
        up = {r["name"]: r["parent"] for r in rows if r["g"] == g}
        weight = {r["name"]: (r["w"], r["size"]) for r in rows if r["g"] == g and r["is_node"]}
        leaves = {}
        for r in rows:
            if r["g"] == g and not r["is_node"]:
                at = up[r["name"]]
                while at is not None:
                    leaves.setdefault(at, set()).add(r["name"])
                    at = up[at]
        for node, names in leaves.items():
            assert weight[node][1] == len(names)
            result.add((g, weight[node][0], frozenset(names)))
    return result


def test_halved_merge_tree_equals_one_task(spark):
    edges = forest.spanning_forest(random_edges(spark, 50, 400, 8))
    rows = edges.select("g", F.explode(F.array("a", "b")).alias("row_id")).distinct()
    assert shape(merge_tree.merge_tree(edges, rows)) == shape(merge_tree.merge_tree(edges, rows, task_edges=6))


def test_small_parts_of_a_halved_tree_share_tasks(spark, monkeypatch):
    # 40 light pairs in a row: the light half is 40 components of one edge.
    rows = [(0, i, i + 1, 1.0 + i / 1000 if i % 2 == 0 else 5.0 + i / 1000) for i in range(79)]
    edges = spark.createDataFrame(rows, "g int, a bigint, b bigint, w double")
    vertices = spark.range(80).selectExpr("0 AS g", "id AS row_id")
    tasks, plain_way = [], merge_tree._solve

    def counted(left, right):
        tasks.append(right.select("g", "lot").distinct().count())
        return left.groupBy("g", "lot").cogroup(right.groupBy("g", "lot")).applyInPandas(plain_way, merge_tree.TREE_SCHEMA)

    monkeypatch.setattr(merge_tree, "_solved", counted)
    assert shape(merge_tree.merge_tree(edges, vertices, task_edges=50)) == shape(merge_tree.merge_tree(edges, vertices))
    assert sum(tasks) <= 8


def test_silhouette_and_dispersion(spark, cloud):
    labels = (cloud[:, 0] > 1.0).astype(int) + 2 * (cloud[:, 1] > 1.5)
    df = spark.createDataFrame([(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(cloud, labels))], SCHEMA + ", cluster int")
    d, values = pairwise(cloud), []
    for i in range(len(cloud)):
        own = labels == labels[i]
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) if c != labels[i])
        values.append((b - a) / max(a, b))
    for options in ({}, {"broadcast_bytes": 0, "rows": 16}):
        got = validity.silhouette(df, sample=None, **options).first()[0]
        assert got == pytest.approx(np.mean(values))
    inverse = np.linalg.inv(np.cov(cloud.T))
    gap = cloud[:, None, :] - cloud[None, :, :]
    m = np.sqrt(np.einsum("ijk,kl,ijl->ij", gap, inverse, gap))
    whitened = validity.whiten(df).orderBy("row_id").collect()
    assert np.allclose(pairwise(np.array([r["features"] for r in whitened])), m)
    means = np.array([cloud[labels == c].mean(0) for c in sorted(set(labels))])
    sizes = np.array([(labels == c).sum() for c in sorted(set(labels))])
    between = (sizes[:, None] * (means - cloud.mean(0)) ** 2).sum() / (len(sizes) - 1)
    within = sum(((cloud[labels == c] - cloud[labels == c].mean(0)) ** 2).sum() for c in set(labels)) / (len(cloud) - len(sizes))
    assert validity.calinski_harabasz(df).first()[0] == pytest.approx(between / within)


def test_silhouettes_of_many_clusterings_at_once(spark, cloud):
    ways = [(cloud[:, 0] > 1.0).astype(int), np.arange(len(cloud)) % 7, np.zeros(len(cloud), int), np.arange(len(cloud)), np.arange(len(cloud)) // 30 * 5 - 3]
    rows = [(i, [float(v) for v in x], [int(w[i]) for w in ways]) for i, x in enumerate(cloud)]
    df = spark.createDataFrame(rows, SCHEMA + ", clusters array<int>")
    for options in ({}, {"broadcast_bytes": 0, "rows": 16}, {"metric": "mahalanobis"}):
        got = {r["place"]: r["silhouette"] for r in validity.silhouettes(df, **options).collect()}
        for place in range(len(ways)):
            one = df.select("row_id", "features", F.col("clusters")[place].alias("cluster"))
            assert got[place] == pytest.approx(validity.silhouette(one, metric=options.get("metric", "euclidean")).first()[0])
    assert validity.silhouettes(df.limit(0)).count() == 0


def test_kmeans_elbow_and_exemplars(spark, cloud):
    df = frame(spark, cloud)
    assert centres.kmeans(df, 4).select("cluster").distinct().count() == 4
    costs = [r["wcss"] for r in centres.elbow(df, 2, 9).orderBy("k").collect()]
    assert len(costs) == 8 and all(a >= b > 0 for a, b in zip(costs, costs[1:]))
    for k, (held, cost) in centres.nested_kmeans(df, 3, 4).items():
        gaps = ((cloud[:, None] - held[None]) ** 2).sum(2).min(axis=1)
        assert len(held) == k and gaps.sum() == pytest.approx(cost)
    assert centres.nested_kmeans(frame(spark, cloud[:0]), 2, 3) == {}
    assert centres.elbow(frame(spark, np.ones((5, 2))), 2, 3).agg(F.max("wcss")).first()[0] == 0
    held = [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    d = pairwise(np.concatenate([np.array(held), cloud]))[:2, 2:]
    got = {r["cluster"]: r["row_id"] for r in centres.nearest_row_to_centre(df, held).collect()}
    assert got == {c: int(np.argmin(np.round(d[c], 9))) for c in (0, 1)}
    scores = spark.createDataFrame([(2, 0.5), (3, 0.9), (4, 0.9)], "k int, score double")
    assert centres.best_k(scores).first()[0] == 3


def test_p_values_equal_spark_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = 0.5 * x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([(float(t), *map(float, r), 1.0) for t, r in zip(y, x)], "y double, a double, b double, c double, same double")
    got = {r["feature"]: r["p_value"] for r in selection.ols_pvalues(df, "y", ["a", "b", "c", "same"]).collect()}
    data = with_vector(df.select("y", F.array("a", "b", "c").alias("features")))
    expected = LinearRegression(featuresCol="vector", labelCol="y", solver="normal").fit(data).summary.pValues
    assert [got[c] for c in "abc"] == pytest.approx(expected[:3], abs=1e-9)
    assert got["same"] is None
    kept = selection.backward_eliminate(df, "y", ["a", "b", "c", "same"])
    assert "a" in kept and "same" not in kept
    r = {(q["left"], q["right"]): q["r"] for q in selection.corr_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])


def test_pca_is_centred(spark, cloud):
    rows, held = selection.pca(frame(spark, cloud), 2, centres=[list(map(float, cloud.mean(0)))])
    assert held.first()["components"] == pytest.approx([0.0, 0.0], abs=1e-9)
    got = np.array([r["components"] for r in rows.orderBy("row_id").collect()])
    _, s, _ = np.linalg.svd(cloud - cloud.mean(0), full_matrices=False)
    assert np.sqrt((got**2).sum(0)) == pytest.approx(s[:2])


@pytest.mark.parametrize("gamma, d", [(0.5, 2), (2.0, 5)])
def test_fourier_features_approach_the_kernel(spark, gamma, d):
    x = np.random.default_rng(4).normal(size=(60, d))
    held = kernels.Fourier(4000, gamma)
    mapped = held.map_rows(x)
    kernel = np.exp(-gamma * pairwise(x) ** 2)
    assert np.abs(mapped @ mapped.T - kernel).max() < 0.1
    few = kernels.Fourier(50, gamma)
    got = few.transform(frame(spark, x)).orderBy("row_id").collect()
    assert np.allclose([r["features"] for r in got], few.map_rows(x))


@pytest.mark.parametrize("p", [1, 2])
def test_hashed_neighbours(spark, monkeypatch, p):
    monkeypatch.setattr(hashing, "PART_ROWS", 64)
    x = np.concatenate([clustered_unit_vectors(1500, per_cluster=150, dimensions=8), np.tile([[3.0] * 8], (200, 1))])
    df = frame(spark, x)
    d = np.round(pairwise(x, p), 9)
    found = hashing.nearest_by_hashing(df, df, 5, p, exclude_self=True)
    exact = neighbours.nearest(df, df, 5, p, exclude_self=True)
    assert hashing.recall(found, exact).first()["recall"] >= 0.9
    places = {}
    for r in found.collect():
        assert r["dist"] == pytest.approx(pairwise(x[[r["query_id"], r["row_id"]]], p)[0, 1]) and r["query_id"] != r["row_id"]
        places.setdefault(r["query_id"], []).append((r["rank"], d[r["query_id"], r["row_id"]], r["row_id"]))
    for own in places.values():
        assert [k for k, _, _ in sorted(own)] == list(range(1, len(own) + 1))
        assert [a[1:] for a in sorted(own)] == sorted(a[1:] for a in own)
    # What falls into one bucket is compared in full, however crowded it is.
    everything = hashing.nearest_by_hashing(df, df, 5, p, tables=1, width=1e9, exclude_self=True)
    assert hashing.recall(everything, exact).first()["recall"] == 1.0
    assert hashing.nearest_by_hashing(df.limit(0), df, 5, p).count() == 0
