"""Registered queries: feature selection, neighbours, centres, validity, radius clusters."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from labelweave.functions.vectors import points, with_vector
from labelweave.operators import centres as cen
from labelweave.operators import hashing, neighbours, propagation, radius, scoring, selection, splitting, triage, validity
from labelweave.plans.catalog import query, table
from labelweave.session import materialise

EMBEDDED = """
    e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS features, label AS cluster,
                 CAST(label < 5 AS INTEGER) AS Label FROM embeddings)
"""
L1 = "list_sum(list_transform(list_zip(a.features, b.features), lambda z: abs(z[1] - z[2])))"
L2 = "list_distance(a.features, b.features)"


def embedded(spark, d):
    rows = table(spark, d, "embeddings").withColumns(
        {"cluster": F.col("label"), "Label": (F.col("label") < 5).cast("int")}
    )
    return points(rows, "vec_id", "embedding", ["cluster", "Label"])


# ---------------------------------------------------------------- feature selection

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _returns(spark, d):
    return table(spark, d, "lineitem").select(
        *FEATURES, F.lit(1.0).alias("same"), (F.col("l_returnflag") == "R").cast("double").alias("Label")
    )


@query(
    "d1_corr_with_target",
    """
    WITH f AS (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem)
    SELECT 'l_quantity' AS feature, round(corr(l_quantity, y), 6) AS r FROM f
    UNION ALL SELECT 'l_extendedprice', round(corr(l_extendedprice, y), 6) FROM f
    UNION ALL SELECT 'l_discount', round(corr(l_discount, y), 6) FROM f
    UNION ALL SELECT 'l_tax', round(corr(l_tax, y), 6) FROM f
    UNION ALL SELECT 'same', NULL
    """,
)
def d1(spark, d):
    found = selection.corr_with_target(_returns(spark, d), "Label", [*FEATURES, "same"])
    return found.withColumn("r", F.round("r", 6))


@query(
    "d1_correl_selection",
    """
    WITH r AS (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS r FROM lineitem
               UNION ALL SELECT 'net', corr(l_extendedprice * (1 - l_discount), l_extendedprice) FROM lineitem
               UNION ALL SELECT 'per_unit', corr(l_extendedprice / l_quantity, l_extendedprice) FROM lineitem
               UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
               UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)
    SELECT feature, round(r, 6) AS r FROM r WHERE abs(r) > 0.05
    """,
)
def d1_selected(spark, d):
    rows = _returns(spark, d).withColumns(
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "per_unit": F.col("l_extendedprice") / F.col("l_quantity"),
        }
    )
    features = ["l_quantity", "net", "per_unit", "l_discount", "l_tax", "same"]
    kept = selection.correl_selection(rows, "l_extendedprice", features)
    return kept.withColumn("r", F.round("r", 6))


def _corr_sql():
    rows = [
        f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in FEATURES for b in FEATURES
    ]
    return " UNION ALL ".join(rows).replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"')


@query("d2_corr_matrix", _corr_sql())
def d2(spark, d):
    return selection.corr_matrix(table(spark, d, "lineitem"), FEATURES).withColumn("r", F.round("r", 6))


# Twelve columns with gaps: every third and every fifth kind of value is missing.
GAPPED = {
    f"{c}_{k}": f"CASE WHEN CAST(l_orderkey + l_linenumber AS BIGINT) % {k} = 0 THEN NULL ELSE {c} * {c} + {k} * l_tax END"
    for c in FEATURES
    for k in (3, 5, 7)
}


def _gapped(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_partkey", *[f"{e} AS {c}" for c, e in GAPPED.items()])


def _gapped_sql(pairs):
    columns = ", ".join(f"{e} AS {c}" for c, e in GAPPED.items())
    rows = " UNION ALL ".join(pairs)
    return f"WITH g AS (SELECT l_partkey, {columns} FROM lineitem) {rows}"


@query(
    "d1_corr_with_target_gaps",
    _gapped_sql([f"SELECT '{c}' AS feature, round(corr({c}, l_partkey), 6) AS r FROM g" for c in GAPPED]),
)
def d1_gaps(spark, d):
    return selection.corr_with_target(_gapped(spark, d), "l_partkey", list(GAPPED)).withColumn("r", F.round("r", 6))


@query(
    "d2_corr_matrix_gaps",
    _gapped_sql(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr({a}, {b}), 6) AS r FROM g""" for a in GAPPED for b in GAPPED
    ),
)
def d2_gaps(spark, d):
    return selection.corr_matrix(_gapped(spark, d), list(GAPPED)).withColumn("r", F.round("r", 6))


@query("d3_ols_pvalues")
def d3(spark, d):
    return selection.ols_pvalues(_returns(spark, d), "Label", [*FEATURES, "same"])


@query("d4_backward_eliminate")
def d4(spark, d):
    parts = table(spark, d, "part").withColumn("same", F.lit(1.0))
    kept = selection.backward_eliminate(parts, "p_retailprice", ["p_partkey", "p_size", "same"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query(
    "d5_pca",
    """
    SELECT count(*) AS n_rows, 0.0::DOUBLE AS mean_1, 0.0::DOUBLE AS mean_2, 0.0::DOUBLE AS correlated, true AS falling
    FROM embeddings
    """,
)
def d5(spark, d):
    """Scores of the axes: centred, uncorrelated, of falling variance."""
    axes = selection.pca(embedded(spark, d), 2).select(*[F.col("components")[i].alias(f"a{i}") for i in (0, 1)])
    return axes.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.abs(F.round(F.avg(f"a{i}"), 9)).alias(f"mean_{i + 1}") for i in (0, 1)],
        F.abs(F.round(F.corr("a0", "a1"), 6)).alias("correlated"),
        (F.var_pop("a0") >= F.var_pop("a1")).alias("falling"),
    )


# ---------------------------------------------------------------- centres

CENTRES = """
    c AS (SELECT cluster, list(m ORDER BY i) AS features FROM (
            SELECT cluster, i, avg(features[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i)
          GROUP BY cluster)
"""


def _label_centres(rows):
    means = with_vector(rows).groupBy("cluster").agg(Summarizer.mean(F.col("vector")).alias("m"))
    return [[float(x) for x in r["m"]] for r in means.orderBy("cluster").collect()]  # one row per class


@query(
    "e2_distance_to_centres",
    f"""
    WITH {EMBEDDED}, {CENTRES}
    SELECT a.row_id, b.cluster, round({L2}, 6) AS dist FROM e a, c b
    """,
)
def e2(spark, d):
    rows = embedded(spark, d)
    found = cen.distance_to_centres(rows, _label_centres(rows))
    return found.select("row_id", F.posexplode("distances").alias("cluster", "dist")).withColumn("dist", F.round("dist", 6))


E3 = f"""
    WITH {EMBEDDED}, {CENTRES},
    near AS (SELECT b.cluster, a.row_id, a.Label, round({L2}, 9) AS dist FROM e a, c b
             QUALIFY row_number() OVER (PARTITION BY b.cluster ORDER BY round({L2}, 9), a.row_id) = 1)
"""


@query("e3_nearest_row_to_centre", E3 + "SELECT cluster, row_id, round(dist, 6) AS dist FROM near")
def e3(spark, d):
    rows = embedded(spark, d)
    found = cen.nearest_row_to_centre(rows, _label_centres(rows))
    return found.withColumn("dist", F.round("dist", 6))


@query(
    "e4_propagate_from_centre",
    E3 + "SELECT e.row_id, e.cluster, e.Label, near.Label AS new_label FROM e JOIN near USING (cluster)",
)
def e4(spark, d):
    rows = embedded(spark, d)
    nearest = cen.nearest_row_to_centre(rows, _label_centres(rows))
    exemplars = nearest.select("cluster", "row_id").join(rows.select("row_id", "Label"), "row_id")
    return propagation.propagate_from_centre(rows.select("row_id", "cluster", "Label"), exemplars)


@query(
    "e1_kmeans",
    "SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_not_nearest FROM embeddings",
)
def e1(spark, d):
    """Every row is in the cluster of its nearest centre."""
    rows = embedded(spark, d).select("row_id", "features")
    centres = cen.centres_of(cen.fit_kmeans(rows, 10))
    found = cen.kmeans(rows, 10).join(cen.distance_to_centres(rows, centres), "row_id")
    own = F.element_at("distances", F.col("cluster") + 1)
    return found.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("cluster").alias("n_clusters"),
        F.count_if(own > F.array_min("distances") + 1e-9).alias("n_not_nearest"),
    )


@query("e5_elbow", "SELECT CAST(8 AS BIGINT) AS n_k, CAST(0 AS BIGINT) AS n_worse_than_two, true AS last_is_least")
def e5(spark, d):
    """No number of clusters is worse than two, and the largest is the best."""
    curve = cen.elbow(embedded(spark, d), 2, 9)
    two = F.max(F.when(F.col("k") == 2, F.col("wcss")))
    return curve.agg(
        F.count(F.lit(1)).alias("n_k"),
        (F.max("wcss") > two).cast("bigint").alias("n_worse_than_two"),
        (F.max_by("wcss", "k") == F.min("wcss")).alias("last_is_least"),
    )


SEEDED_K = range(2, 7)
# Clusters that SQL can repeat: the nearest of the first k vectors.
SILHOUETTES = f"""
    WITH {EMBEDDED},
    seeds AS (SELECT row_number() OVER (ORDER BY row_id) AS c, features FROM e QUALIFY c <= {max(SEEDED_K)}),
    gaps AS (SELECT a.row_id, b.c, {L2} AS dist FROM e a, seeds b),
    own AS (SELECT k, row_id, arg_min(c, row(dist, c)) AS cluster FROM gaps, (SELECT unnest(range({min(SEEDED_K)}, {max(SEEDED_K) + 1})) AS k)
            WHERE c <= k GROUP BY k, row_id),
    d AS (SELECT a.row_id AS x, b.row_id AS y, {L2} AS dist FROM e a, e b),
    m AS (SELECT s.k, x, s.cluster AS own, t.cluster AS other, sum(dist) AS total, count(*) AS n
          FROM d JOIN own s ON s.row_id = x JOIN own t ON t.row_id = y AND t.k = s.k GROUP BY ALL),
    ab AS (SELECT k, x, max(CASE WHEN own = other THEN n END) AS own_n, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
                  min(CASE WHEN own <> other THEN total / n END) AS b FROM m GROUP BY k, x),
    s AS (SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN own_n = 1 THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END) AS silhouette
          FROM ab GROUP BY k)
"""


def _seeded(spark, d):
    rows = embedded(spark, d).select("row_id", "features")
    seeds = [r["features"] for r in rows.orderBy("row_id").limit(max(SEEDED_K)).collect()]
    return cen.assign_each(rows, [seeds[:k] for k in SEEDED_K])


def _scores(found, ks):
    k = F.element_at(F.array(*[F.lit(x) for x in ks]), F.col("place") + 1)
    return found.select(k.alias("k"), "silhouette")


@query("e7_silhouette_over_k", SILHOUETTES + "SELECT k, round(silhouette, 6) AS silhouette FROM s")
def e7_scores(spark, d):
    """The silhouettes of five clusterings from one pass over the distances."""
    scores = _scores(validity.silhouettes(_seeded(spark, d)), SEEDED_K)
    return scores.select("k", F.round("silhouette", 6).alias("silhouette"))


@query("e7_silhouette_over_k_tiles", SILHOUETTES + "SELECT k, round(silhouette, 6) AS silhouette FROM s")
def e7_tiles(spark, d):
    """The way of tables too large to send to every task."""
    scores = _scores(validity.silhouettes(_seeded(spark, d), broadcast_bytes=0), SEEDED_K)
    return scores.select("k", F.round("silhouette", 6).alias("silhouette"))


@query("e7_best_k", SILHOUETTES + "SELECT max_by(k, row(silhouette, -k)) AS best_k FROM s")
def e7(spark, d):
    scores = _scores(validity.silhouettes(_seeded(spark, d)), SEEDED_K)
    return cen.best_k(scores.withColumnRenamed("silhouette", "score"))


@query(
    "e7_kmeans_best_k",
    "SELECT CAST(8 AS BIGINT) AS n_k, CAST(0 AS BIGINT) AS n_outside, true AS first_best, true AS falling FROM embeddings LIMIT 1",
)
def e7_kmeans(spark, d):
    """Mahalanobis silhouettes of nested k-means over eight k, and the first best of them."""
    rows = embedded(spark, d).select("row_id", "features")
    found = cen.nested_kmeans(rows, 2, 9)
    ks = sorted(found)
    clustered = cen.assign_each(rows, [found[k][0] for k in ks])
    scores = materialise(_scores(validity.silhouettes(clustered, "mahalanobis"), ks), "silhouettes")
    best = cen.best_k(scores.withColumnRenamed("silhouette", "score")).select("best_k")
    costs = [found[k][1] for k in ks]
    top = scores.agg(F.max("silhouette").alias("top"))
    firsts = scores.join(top, F.col("silhouette") == F.col("top")).agg(F.min("k").alias("first"))
    return scores.agg(F.count(F.lit(1)).alias("n_k"), F.count_if(~F.col("silhouette").between(-1, 1)).alias("n_outside")).select(
        "n_k", "n_outside", (firsts.scalar() == best.scalar()).alias("first_best"), F.lit(all(a >= b for a, b in zip(costs, costs[1:]))).alias("falling")
    )


# ---------------------------------------------------------------- validity


def _silhouette_sql(cluster: str) -> str:
    return f"""
    WITH {EMBEDDED},
    m AS (SELECT a.row_id, a.{cluster} AS own, b.{cluster} AS other, sum({L2}) AS total, count(*) AS n
          FROM e a, e b GROUP BY ALL),
    ab AS (SELECT row_id, max(CASE WHEN own = other THEN total / (n - 1) END) AS a,
                  min(CASE WHEN own <> other THEN total / n END) AS b FROM m GROUP BY row_id)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab
    """


def _silhouette(rows, **options):
    return validity.silhouette(rows, **options).select(F.round("silhouette", 6).alias("silhouette"))


@query("e6_silhouette", _silhouette_sql("cluster"))
def e6(spark, d):
    return _silhouette(embedded(spark, d))


@query("e6_silhouette_tiles", _silhouette_sql("cluster"))
def e6_tiles(spark, d):
    """The way of tables too large to send to every task."""
    return _silhouette(embedded(spark, d), broadcast_bytes=0)


@query("e6_silhouette_many_clusters", _silhouette_sql("row_id % 50"))
def e6_many(spark, d):
    return _silhouette(embedded(spark, d).withColumn("cluster", (F.col("row_id") % 50).cast("int")))


@query(
    "e6_silhouette_mahalanobis",
    """
    WITH e AS (SELECT c_custkey AS row_id, c_acctbal / 100 AS x, c_nationkey * 20.0::DOUBLE + c_acctbal / 500 AS y,
                      CAST(c_nationkey % 4 AS INTEGER) AS cluster FROM customer),
    v AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM e),
    m AS (SELECT a.row_id, a.cluster AS own, b.cluster AS other, count(*) AS n, sum(sqrt(greatest(0,
                 ((a.x - b.x) ** 2 * yy - 2 * (a.x - b.x) * (a.y - b.y) * xy + (a.y - b.y) ** 2 * xx) / (xx * yy - xy * xy)))) AS total
          FROM e a, e b, v GROUP BY ALL),
    ab AS (SELECT row_id, max(CASE WHEN own = other THEN total / (n - 1) END) AS a,
                  min(CASE WHEN own <> other THEN total / n END) AS b FROM m GROUP BY row_id)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab
    """,
)
def e6_mahalanobis(spark, d):
    """Distances by the inverse covariance of two correlated columns."""
    rows = table(spark, d, "customer").withColumns(
        {
            "x": F.col("c_acctbal") / 100, "y": F.col("c_nationkey") * 20.0 + F.col("c_acctbal") / 500,
            "cluster": F.pmod("c_nationkey", F.lit(4)).cast("int"),
        }
    )
    return _silhouette(points(rows, "c_custkey", ["x", "y"], ["cluster"]), metric="mahalanobis")


@query(
    "e8_calinski_harabasz",
    """
    WITH f AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
    t AS (SELECT avg(x) AS mx, avg(y) AS my FROM f),
    s AS (SELECT g, count(*) AS n, avg(x) AS ax, avg(y) AS ay, var_pop(x) + var_pop(y) AS v FROM f GROUP BY g)
    SELECT round((sum(n * ((ax - mx) * (ax - mx) + (ay - my) * (ay - my))) / (count(*) - 1))
                 / (sum(n * v) / (sum(n) - count(*))), 6) AS calinski_harabasz
    FROM s, t
    """,
)
def e8(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("cluster"), F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("features")
    )
    score = validity.calinski_harabasz(rows)
    return score.select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


# ---------------------------------------------------------------- radius


@query(
    "e12_radius_neighbours",
    f"""
    WITH {EMBEDDED}
    SELECT a.row_id, count(*) AS n_near FROM e a, e b WHERE {L2} <= 1.25 GROUP BY a.row_id
    """,
)
def e12(spark, d):
    return radius.radius_counts(embedded(spark, d), 1.25)


ACCOUNTS = """
    e AS (SELECT c_custkey AS row_id, [c_acctbal / 100, c_nationkey * 20.0::DOUBLE] AS features FROM customer)
"""


def _accounts(spark, d):
    rows = table(spark, d, "customer").withColumns({"x": F.col("c_acctbal") / 100, "y": F.col("c_nationkey") * 20.0})
    return points(rows, "c_custkey", ["x", "y"])


@query(
    "e12_radius_graph",
    f"WITH {ACCOUNTS} SELECT a.row_id AS src, b.row_id AS dst, round({L2}, 6) AS dist FROM e a JOIN e b ON a.row_id < b.row_id WHERE {L2} <= 2.5",
)
def e12_graph(spark, d):
    """All pairs of rows, those of one vector included."""
    pairs = radius.row_pairs(*radius.radius_graph(_accounts(spark, d), 2.5))
    return pairs.select("src", "dst", F.round("dist", 6).alias("dist"))


@query(
    "e13_dbscan",
    f"""
    WITH RECURSIVE {ACCOUNTS},
    near AS (SELECT a.row_id AS a, b.row_id AS b FROM e a, e b WHERE {L2} <= 2.5),
    cores AS (SELECT a AS row_id FROM near GROUP BY a HAVING count(*) >= 4),
    links AS (SELECT a, b FROM near JOIN cores x ON x.row_id = a JOIN cores y ON y.row_id = b),
    reach(row_id, root) AS (
        SELECT row_id, row_id FROM cores UNION SELECT b, root FROM reach JOIN links ON a = row_id),
    parts AS (SELECT row_id, min(root) AS root FROM reach GROUP BY row_id),
    numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM parts)),
    borders AS (SELECT a AS row_id, min(root) AS root FROM near JOIN parts ON row_id = b
                WHERE a NOT IN (SELECT row_id FROM cores) GROUP BY a)
    SELECT e.row_id, CAST(coalesce(n.cluster, -1) AS INTEGER) AS cluster, p.row_id IS NOT NULL AS core
    FROM e LEFT JOIN parts p USING (row_id) LEFT JOIN borders b ON b.row_id = e.row_id
    LEFT JOIN numbers n ON n.root = coalesce(p.root, b.root)
    """,
)
def e13(spark, d):
    return radius.dbscan(_accounts(spark, d), 2.5, 4)


# ---------------------------------------------------------------- nearest-neighbour model

POOL_SEED = 17
SPLIT_SQL = f"""
    o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {POOL_SEED}, row_id)), row_id) - 1 AS ord FROM e),
    p AS (SELECT * FROM o WHERE ord < (SELECT count(*) // 5 FROM e)),
    q AS (SELECT * FROM o WHERE ord >= (SELECT count(*) // 5 FROM e))
"""


def pool_and_rest(spark, d):
    """A fifth of the rows as labelled pool, the others to be labelled."""
    rows = splitting.shuffle(embedded(spark, d), POOL_SEED, total="_total")
    cut = F.floor(F.col("_total") / 5)
    return rows.filter(F.col("ord") < cut).drop("_total"), rows.filter(F.col("ord") >= cut).drop("_total")


KNN = f"""
    WITH {EMBEDDED}, {SPLIT_SQL},
    near AS (SELECT a.row_id, b.Label AS lab, round({{dist}}, 9) AS dist,
                    row_number() OVER (PARTITION BY a.row_id ORDER BY round({{dist}}, 9), b.row_id) AS place
             FROM q a, p b),
    votes AS (SELECT row_id, {{vote}} AS p1 FROM near WHERE place <= {{k}} GROUP BY row_id)
"""
UNIFORM = "sum(CASE WHEN lab = 1 THEN 1.0::DOUBLE ELSE 0 END) / count(*)"
BY_DISTANCE = "sum(CASE WHEN lab = 1 THEN 1 / dist ELSE 0 END) / sum(1 / dist)"


@query(
    "g2_knn_distance_weights",
    KNN.format(dist=L1, vote=BY_DISTANCE, k=10) + "SELECT row_id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1 FROM votes",
)
def g2(spark, d):
    pool, rest = pool_and_rest(spark, d)
    scored = neighbours.knn_classify(rest, pool.withColumnRenamed("Label", "label"), 10, 1, "distance")
    return scored.select("row_id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@query(
    "g2_knn_blocks",
    KNN.format(dist=L1, vote=BY_DISTANCE, k=10) + "SELECT row_id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1 FROM votes",
)
def g2_blocks(spark, d):
    """The way of pools too large to send to every task."""
    pool, rest = pool_and_rest(spark, d)
    scored = neighbours.knn_classify(rest, pool.withColumnRenamed("Label", "label"), 10, 1, "distance", broadcast_bytes=0)
    return scored.select("row_id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@query(
    "g2_knn_uniform_weights",
    KNN.format(dist=L2, vote=UNIFORM, k=5) + "SELECT row_id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1 FROM votes",
)
def g2_uniform(spark, d):
    pool, rest = pool_and_rest(spark, d)
    scored = neighbours.knn_classify(rest, pool.withColumnRenamed("Label", "label"), 5, 2, "uniform")
    return scored.select("row_id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@query(
    "g2_hashed_neighbours",
    "SELECT count(*) AS n_queries, true AS found_nine_of_ten, true AS compared_few FROM customer",
)
def g2_hashed(spark, d):
    """Ten near customers of every customer by hashing, held against the exact ones."""
    rows = _accounts(spark, d)
    found = materialise(hashing.nearest_by_hashing(rows, rows, 10, exclude_self=True), "hashed")
    exact = neighbours.nearest(rows, rows, 10, exclude_self=True)
    buckets = materialise(hashing._bucketed(rows, 1, 2, 4 * hashing.usual_gap(rows, 10), 2, hashing.SEED), "buckets").groupBy("bucket").count()
    most = F.lit(buckets.agg(F.max("count")).first()[0] * 4)
    return hashing.recall(found, exact).select("n_queries", (F.col("recall") >= 0.9).alias("found_nine_of_ten"), (most < F.col("n_queries")).alias("compared_few"))


@query(
    "flagship_label_report",
    KNN.format(dist=L1, vote=UNIFORM, k=7)
    + """,
    t AS (SELECT row_id, q.Label, CASE WHEN 1 - p1 > 0.7 THEN 0 WHEN p1 > 0.7 THEN 1 END AS model
          FROM votes JOIN q USING (row_id)),
    c AS (SELECT count(*) AS n_rows, count(*) FILTER (model IS NULL) AS n_query,
                 count(*) FILTER (model = 0 AND Label = 0) AS tn, count(*) FILTER (model = 1 AND Label = 0) AS fp,
                 count(*) FILTER (model = 0 AND Label = 1) AS fn, count(*) FILTER (model = 1 AND Label = 1) AS tp FROM t)
    SELECT n_rows, n_query, round(n_query / n_rows * 100, 6) AS query_share, tn, fp, fn, tp,
           round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
           round(1 - tp / (tp + fn), 6) AS fnr, round(1 - tn / (tn + fp), 6) AS fpr FROM c
    """,
)
def flagship(spark, d):
    pool, rest = pool_and_rest(spark, d)
    scored = neighbours.knn_classify(rest, pool.withColumnRenamed("Label", "label"), 7, 1, "uniform")
    batch = triage.triage_two_class(scored.join(rest.select("row_id", "Label"), "row_id"), 0.7)
    model_label = F.when(F.col("source") == "model", F.col("new_label")).alias("model")
    counted = scoring.confusion(batch.select("Label", model_label), "Label", "model")
    scores = scoring.add_error_rates(scoring.add_scores(counted))
    n_model = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    ratios = ["precision", "recall", "f1", "fnr", "fpr"]
    return scores.select(
        (n_model + F.col("n_undecided")).alias("n_rows"),
        F.col("n_undecided").alias("n_query"),
        F.round(F.col("n_undecided") / (n_model + F.col("n_undecided")) * 100, 6).alias("query_share"),
        "tn", "fp", "fn", "tp",
        *[F.round(c, 6).alias(c) for c in ratios],
    )
