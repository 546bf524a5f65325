"""Registered queries: density clusters, fitted models, tuning, loops."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelweave.functions.order import rank_by_key, shuffle_key
from labelweave.functions.vectors import points, with_vector
from labelweave.operators import classifiers, cleaning, density, reporting, splitting, triage, tuning
from labelweave.operators.blocks import distinct_points
from labelweave.operators.classifiers import Member
from labelweave.plans import loops
from labelweave.plans.catalog import query, table
from labelweave.plans.catalog_vectors import EMBEDDED, L2, embedded
from labelweave.session import materialise, scratch_path
from labelweave.sources import models

# ---------------------------------------------------------------- density clusters

SETTING = density.Setting(5, 3)
# The parameter grid searched for density clusters.
GRID_SIZES = [3, 5, 7, 9, 11, 15, 17, 20, 23, 25, 30]
GRID_SAMPLES = [None, 1, 3, 5, 7, 9, 12, 15, 17]


def _vectors(spark, d):
    return embedded(spark, d).select("row_id", "features")


@query(
    "e9_core_distances",
    f"""
    WITH {EMBEDDED},
    r AS (SELECT a.row_id, {L2} AS dist, row_number() OVER (PARTITION BY a.row_id ORDER BY {L2}, b.row_id) AS place
          FROM e a JOIN e b ON a.row_id <> b.row_id)
    SELECT row_id, round(max(dist) FILTER (place = 1), 6) AS core_1, round(max(dist) FILTER (place = 3), 6) AS core_3,
           round(max(dist) FILTER (place = 9), 6) AS core_9 FROM r GROUP BY row_id
    """,
)
def e9_core(spark, d):
    cores = density.core_distances(distinct_points(_vectors(spark, d)), [1, 3, 9])
    return cores.select(
        "row_id", *[F.round(F.col("cores")[i], 6).alias(f"core_{k}") for i, k in enumerate((1, 3, 9))]
    )


@query(
    "e9_density_clusters",
    """
    SELECT count(*) AS n_rows, 0::BIGINT AS n_small_clusters, 0::BIGINT AS n_without_core, 0::BIGINT AS n_noise_with_prob,
           0::BIGINT AS n_prob_outside FROM embeddings
    """,
)
def e9(spark, d):
    """Clusters have their least size and a row of probability 1; noise has probability 0."""
    found = density.density_clusters(_vectors(spark, d), SETTING.min_cluster_size, SETTING.min_samples)
    sizes = found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("prob").alias("most"), F.min("prob").alias("least")
    )
    real = F.col("cluster") >= 0
    return sizes.agg(
        F.sum("n").alias("n_rows"),
        F.count_if(real & (F.col("n") < SETTING.min_cluster_size)).alias("n_small_clusters"),
        F.count_if(real & (F.col("most") < 1)).alias("n_without_core"),
        F.count_if(~real & (F.col("most") > 0)).alias("n_noise_with_prob"),
        F.count_if((F.col("least") < 0) | (F.col("most") > 1)).alias("n_prob_outside"),
    )


@query("e10_relative_validity")
def e10(spark, d):
    settings = [density.Setting(3, 1), density.Setting(5, 3), density.Setting(7, 3)]
    hierarchy = density.build_hierarchy(_vectors(spark, d), [1, 3])
    return density.relative_validity(hierarchy, settings, density.label_homes(hierarchy, settings))


@query("e11_tune_density", f"SELECT {len(GRID_SIZES) * len(GRID_SAMPLES)}::BIGINT AS n_sets, 0::BIGINT AS n_outside, true AS first_best, count(*) AS n_rows FROM embeddings")
def e11(spark, d):
    """The whole grid: every setting once, scores within their bounds, and the first of the best ones chosen."""
    scores, clusters, best = density.tune_density(_vectors(spark, d), GRID_SIZES, GRID_SAMPLES)
    sample = F.array_position(F.array(*[F.lit(x or 0) for x in GRID_SAMPLES]), F.coalesce("min_samples", F.lit(0)))
    first = F.max_by(F.struct("min_cluster_size", "min_samples"), F.struct("score", -F.col("min_cluster_size"), -sample))
    found = scores.distinct().agg(F.count(F.lit(1)).alias("n_sets"), F.count_if(~F.col("score").between(-1, 1)).alias("n_outside"), first.alias("first"))
    chosen = (F.col("first.min_cluster_size") == best.min_cluster_size) & F.col("first.min_samples").eqNullSafe(F.lit(best.min_samples).cast("int"))
    return found.select("n_sets", "n_outside", chosen.alias("first_best"), clusters.agg(F.count(F.lit(1))).scalar().alias("n_rows"))


@query("e14_linkage_rows")
def e14(spark, d):
    return density.linkage_rows(density.build_hierarchy(_vectors(spark, d), [SETTING.rank]))


@query("e14_exemplars")
def e14_exemplars(spark, d):
    return density.exemplars(density.density_clusters(_vectors(spark, d), SETTING.min_cluster_size, SETTING.min_samples))


@query("e15_kmeans_auto_k")
def e15(spark, d):
    return loops.kmeans_auto_k(_vectors(spark, d), SETTING)


# ---------------------------------------------------------------- classifiers

ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _items(spark, d):
    """Scaled line items with a dense row id; label = was it returned."""
    raw = table(spark, d, "lineitem").select(
        *ITEM_FEATURES, *ITEM_KEY[:-1], (F.col("l_returnflag") == "R").cast("int").alias("Label")
    )
    keyed = raw.withColumn("_key", shuffle_key(*[F.col(c) for c in ITEM_KEY]))
    rows = rank_by_key(keyed, "_key", ITEM_KEY, out="row_id")
    scaled = cleaning.minmax_scale(rows, ITEM_FEATURES, cleaning.fit_stats(raw, ITEM_FEATURES, medians=False))
    return points(scaled, "row_id", ITEM_FEATURES, ["Label"])


def _parts(spark, d):
    """Parts as points: is a part expensive."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.array(F.col("p_size") / 50, F.length("p_name") / 20).alias("features"),
        (F.col("p_retailprice") > 950).cast("int").alias("label"),
    )


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("row_id"),
        F.array(F.col("s_nationkey") / 25, F.col("s_acctbal") / 10000).alias("features"),
        (F.col("s_acctbal") > 4000).cast("int").alias("Label"),
    )


def _scored(spark, d, member, rows=None):
    """How many rows got two probabilities that add up, and how far their mean is from the share of label 1."""
    rows = materialise(_items(spark, d), "items") if rows is None else rows
    label = F.col("Label").cast("double").alias("y")
    scored = classifiers.fit(member, rows).score(rows).join(rows.select("row_id", label), "row_id")
    gap = F.abs(F.avg("p1") - F.avg("y"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~(F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9) | (F.least("p0", "p1") < 0)).alias("n_no_chances"),
        (gap < 0.05).alias("calibrated"),
    )


def _scored_sql(table: str) -> str:
    return f"SELECT count(*) AS n_rows, 0::BIGINT AS n_no_chances, true AS calibrated FROM {table}"


@query("g1_random_forest", _scored_sql("supplier"))
def g1(spark, d):
    """All 600 trees at full depth, over a small table."""
    return _scored(spark, d, Member("forest", "forest"), _suppliers(spark, d))


@query("g3_logistic_regression", _scored_sql("lineitem"))
def g3(spark, d):
    return _scored(spark, d, Member("logistic", "logistic", {"C": 10.0}))


@query("g4_linear_margin", "SELECT count(*) AS n_rows, 0::BIGINT AS n_wrong_source, true AS mostly_right FROM part")
def g4(spark, d):
    """Rows inside the margin are asked, the others take the side of the plane."""
    rows = materialise(_parts(spark, d).withColumnRenamed("label", "Label"), "parts")
    fitted = classifiers.fit(Member("margin", "margin", {"C": 1.0}), rows)
    scored = fitted.margin(rows).join(fitted.score(rows), "row_id").join(rows.select("row_id", "Label"), "row_id")
    batch = triage.triage_margin(scored, 1.0)
    side = F.when(F.abs("dist") <= 1, F.col("Label")).otherwise((F.col("dist") > 0).cast("int"))
    wrong = (F.col("new_label") != side) | ((F.col("source") == "oracle") != (F.abs("dist") <= 1))
    half = F.avg(((F.col("p1") > 0.5) == (F.col("Label") == 1)).cast("double"))
    return batch.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_wrong_source"), (half >= 0.5).alias("mostly_right"))


RING_RADIUS = 0.3


@query(
    "g4_fourier_margin",
    f"""
    WITH p AS (SELECT least(value / 200, 1) AS v, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 AS k FROM events)
    SELECT count(*) AS n_rows, count(*) FILTER ((v - 0.5) * (v - 0.5) + (k - 0.5) * (k - 0.5) < {RING_RADIUS ** 2}) AS n_inside,
           true AS curved_is_right, true AS plain_is_not FROM p
    """,
)
def g4_fourier(spark, d):
    """Rows inside a circle: a plane over Fourier features tells them apart, a plane over the rows cannot."""
    inside = (F.col("x") - 0.5) * (F.col("x") - 0.5) + (F.col("y") - 0.5) * (F.col("y") - 0.5) < RING_RADIUS**2
    rows = _event_points(spark, d).select("row_id", "features", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    rows = materialise(rows.select("row_id", "features", inside.cast("int").alias("label")), "ring")
    out = rows.select("row_id", "label")
    for name, params in (("curved", {"fourier": {"n": 200, "gamma": 20.0}}), ("plain", {})):
        fitted = classifiers.fit(Member(name, "margin", {"C": 10.0} | params), rows)
        out = out.join(fitted.margin(rows).select("row_id", (F.col("dist") > 0).cast("int").alias(name)), "row_id")
    # The rarer side decides: a plane that puts all rows on one side finds none of it.
    right = lambda c: F.avg(F.when(F.col("label") == 1, (F.col(c) == 1).cast("double"))) + F.avg(F.when(F.col("label") == 0, (F.col(c) == 0).cast("double")))
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_inside"), (right("curved") > 1.9).alias("curved_is_right"), (right("plain") < 1.5).alias("plain_is_not")
    )


@query("g5_external_member", "SELECT CAST(event_id AS BIGINT) AS row_id, 1 - value / 1000 AS p0, value / 1000 AS p1 FROM events")
def g5(spark, d):
    events = table(spark, d, "events")
    scores = events.select(
        F.col("event_id").alias("row_id"), (1 - F.col("value") / 1000).alias("p0"), (F.col("value") / 1000).alias("p1")
    )
    fitted = classifiers.fit(Member("network", "table", {"scores": scores}), scores)
    return fitted.score(events.select(F.col("event_id").alias("row_id")))


@query("g5_neural_member", _scored_sql("lineitem"))
def g5_network(spark, d):
    return _scored(spark, d, Member("network", "network", {"layers": [4, 8, 2]}))


@query("a8_save_load_model", "SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM lineitem")
def a8(spark, d):
    rows = materialise(_items(spark, d), "items")
    pipeline = Pipeline(stages=classifiers.ml_stages("logistic", {}, rows.count()))
    fitted = pipeline.fit(classifiers.labelled(rows))
    folder = scratch_path(spark, "models")
    models.save_model(fitted, folder, "logistic", 1, "train_1")
    again = models.load_model(folder, "logistic", 1, "train_1")

    def p1(model):
        scored = model.transform(with_vector(rows))
        return scored.select("row_id", vector_to_array("probability")[1].alias("p1"))

    both = p1(fitted).join(p1(again).withColumnRenamed("p1", "again"), "row_id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p1") != F.col("again")).alias("n_different"))


# ---------------------------------------------------------------- tuning


FOREST_SETS = [{"n_trees": n, "max_depth": depth} for n in (100, 300, 600) for depth in (10, 30)]


@query("g12_tune", f"SELECT {len(FOREST_SETS)}::BIGINT AS n_sets, 0::BIGINT AS n_outside, true AS first_best")
def g12(spark, d):
    """Six forests up to the full size, over a small table."""
    rows = materialise(_suppliers(spark, d).withColumn("ord", F.col("row_id")), "rows")
    validation = materialise(splitting.validation_slice(rows, 0.5, 6000).withColumnRenamed("Label", "label"), "validation")
    rest = rows.withColumnRenamed("Label", "label").join(validation.select("row_id"), "row_id", "left_anti")
    best, scores = tuning.tune("forest", "forest", FOREST_SETS, validation, rest, parallelism=6)
    chosen = F.to_json(F.create_map(*[F.lit(str(x)) for pair in best.params.items() for x in pair]))
    first_best = F.max_by(F.to_json("params"), F.struct("score", -F.col("place")))
    return scores.agg(
        F.count(F.lit(1)).alias("n_sets"),
        F.count_if(~F.col("score").between(0, 1)).alias("n_outside"),
        (first_best == chosen).alias("first_best"),
    )


def _folded(spark, d, repeats=10):
    return materialise(splitting.stratified_kfold(_parts(spark, d), 3, repeats, label="label"), "folds")


def _searched(scores):
    outside = ~F.col("mean").between(0, 1) | (F.col("std") < 0)
    return scores.agg(F.count(F.lit(1)).alias("n_sets"), F.count_if(outside).alias("n_outside"))


@query("g13_cv_grid_search", "SELECT 5::BIGINT AS n_sets, 0::BIGINT AS n_outside")
def g13(spark, d):
    """Five penalties, three folds, ten repeats."""
    return _searched(tuning.cv_search("logistic", [{"C": c} for c in (100, 10, 1.0, 0.1, 0.01)], _folded(spark, d), 3))


@query("g14_cv_random_search", "SELECT 4::BIGINT AS n_sets, 0::BIGINT AS n_outside")
def g14(spark, d):
    grid = {"C": [0.01, 0.1, 1, 10, 100], "max_iter": [50, 100]}
    return _searched(tuning.cv_random_search("logistic", grid, 4, _folded(spark, d, 2), 3, seed=1))


# ---------------------------------------------------------------- loops

def _report(outcomes):
    """What the split, the sizes and the upkeep fix of the result rows of all folds; times and scores as checks."""
    report = reporting.combine_results([o.report for o in outcomes])
    rate = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return report.select(
        "ML_method",
        "Training_set",
        "N_Retrains",
        F.col("Number_of_Samples_trained").cast("bigint").alias("samples"),
        (F.col("Tuning_Time") > 0).alias("tuned"),
        (rate("F1") & rate("Precision") & rate("Recall")).alias("scored"),
    )


def _report_sql(methods, table, init, batch, tuned=True):
    """Rows of every fold: three chunks, two of them to train on, batches of fixed shares."""
    names = ", ".join(f"('{m}')" for m in methods)
    return f"""
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM {table}),
    folds(fold, test_chunk) AS (VALUES ('train_1', 3), ('train_2', 2), ('train_3', 1)),
    t AS (SELECT fold, n - (n // 3 + CASE WHEN test_chunk <= n % 3 THEN 1 ELSE 0 END) AS rows FROM n, folds),
    s AS (SELECT fold, rows, greatest(1, CAST(floor(rows * {init}) AS BIGINT)) AS init,
                 greatest(1, CAST(floor(rows * {batch}) AS BIGINT)) AS size FROM t),
    steps AS (SELECT fold, 1::BIGINT AS step, rows, size, least(init, rows) AS samples FROM s
              UNION ALL SELECT fold, step + 1, rows, size, least(samples + size, rows) FROM steps WHERE samples < rows)
    SELECT m AS ML_method, fold AS Training_set, step AS N_Retrains, samples, {str(tuned).lower()} AS tuned, true AS scored
    FROM steps, (VALUES {names}) v(m)
    """


def _folds(rows, n_init: float, n_batch: float, wanted: int = 3):
    """(name, train, test, size of the first batch, of the others) of the first folds of a seeded 3/2/1 split."""
    folds = materialise(splitting.split(rows, 3, 2, 1, seed=4), "folds")
    out = []
    for fold in range(1, wanted + 1):
        own = folds.filter(F.col("fold") == fold)
        train = splitting.shuffle(own.filter("role = 'train'").drop("ord", "chunk", "fold", "role"), 5)
        test = own.filter("role = 'test'").select("row_id", "features", "Label")
        train, test = materialise(train, "train"), materialise(test, "test")
        n = train.count()
        out.append((f"train_{fold}", train, test, max(1, int(n * n_init)), max(1, int(n * n_batch))))
    return out


def _event_points(spark, d):
    """Events as points: value and property; label from their sum, with some noise."""
    events = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100)
    events = events.withColumn("v", F.least(F.col("value") / 200, F.lit(1.0)))
    clean_label = F.col("v") + F.col("k") > 0.75
    label = F.when(F.col("event_type") == "error", ~clean_label).otherwise(clean_label).cast("int")
    return points(events.withColumn("Label", label), "event_id", ["v", "k"], ["Label"])


@query(
    "h6_triage_cluster_kmeans",
    """
    WITH n AS (SELECT count(*) AS n FROM events), t AS (SELECT n - (n // 3) AS rows FROM n)
    SELECT rows - greatest(1, CAST(floor(rows * 0.3) AS BIGINT)) AS n_rows, 10 AS n_query, 0::BIGINT AS n_without_label FROM t
    """,
)
def h6(spark, d):
    """Rows the model is sure of, and the others by ten exemplars."""
    _, train, _, init, _ = _folds(_event_points(spark, d), 0.3, 0.5, 1)[0]
    batches = splitting.assign_batches(train, init, 10**9)
    pool = materialise(batches.filter("iteration = 1").withColumn("label", F.col("Label")), "init")
    fitted = classifiers.fit_committee([Member("logistic", "logistic")], pool)
    batch, totals = loops.by_committee_and_centres(k=10)(batches.filter("iteration > 1"), fitted)
    return batch.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(totals["n_query"]).alias("n_query"),
        F.count_if(F.col("new_label").isNull() | ~F.col("source").isin("model", "cluster")).alias("n_without_label"),
    )


C_SETS = [{"C": c} for c in (0.1, 10.0)]


@query("h10_self_active_loop", _report_sql(["knn", "logistic", "committee"], "embeddings", 0.5, 0.25))
def h10(spark, d):
    """All folds; every batch picks its own density setting."""
    members = [Member("knn", "knn", {"k": 7}), Member("logistic", "logistic")]
    labeller = loops.by_committee_and_density(loops.DensityGrid([3, 5], [None, 1]), 0.6)

    def run(fold, train, test, init, size):
        # Folds run side by side, so each keeps its outputs in a folder of its own.
        upkeep = loops.Upkeep({"logistic": C_SETS}, store=scratch_path(spark, f"outputs-{fold}"))
        return loops.self_active_loop(train, test, members, labeller, init, size, fold=fold, upkeep=upkeep)

    return _report(loops.over_folds(_folds(embedded(spark, d).drop("cluster"), 0.5, 0.25), run))


@query("h10_self_active_loop_margin", _report_sql(["AL_SVM_C2H"], "events", 0.2, 0.4, tuned=False))
def h10_margin(spark, d):
    members = [Member("AL_SVM_C2H", "margin")]

    def run(fold, train, test, init, size):
        return loops.self_active_loop(train, test, members, loops.by_margin(), init, size, "AL_SVM_C2H", fold)

    return _report(loops.over_folds(_folds(_event_points(spark, d), 0.2, 0.4), run))


@query("h11_active_loop_single_train", _report_sql(["AL_RF_US"], "events", 0.2, 0.1, tuned=False))
def h11(spark, d):
    """Forests of full size."""
    members = [Member("AL_RF_US", "forest")]

    def run(fold, train, test, init, size):
        return loops.single_train_loop(train, test, members, loops.by_probability(), init, size, "AL_RF_US", fold)

    return _report(loops.over_folds(_folds(_event_points(spark, d), 0.2, 0.1), run))


@query(
    "h12_two_stage_loop",
    """
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings),
    folds(fold, test_chunk) AS (VALUES ('train_1', 3), ('train_2', 2), ('train_3', 1)),
    t AS (SELECT fold, n - (n // 3 + CASE WHEN test_chunk <= n % 3 THEN 1 ELSE 0 END) AS rows FROM n, folds),
    s AS (SELECT fold, rows, greatest(1, CAST(floor(rows * 0.3) AS BIGINT)) AS init,
                 greatest(1, CAST(floor(rows * 0.4) AS BIGINT)) AS size FROM t),
    b AS (SELECT *, greatest(1, init // 2) AS small FROM s),
    steps AS (SELECT fold, 1::BIGINT AS step, rows, init, small, size, least(small, rows) AS samples FROM b
              UNION ALL SELECT fold, step + 1, rows, init, small, size,
                               least(samples + CASE WHEN samples < init THEN small ELSE size END, rows) FROM steps WHERE samples < rows)
    SELECT 'AL_LR_US' AS ML_method, fold AS Training_set, step AS N_Retrains, samples, true AS tuned, true AS scored FROM steps
    """,
)
def h12(spark, d):
    """All folds: small batches labelled through density clusters at 0.9, scaled batches and pool, then larger batches."""
    members = [Member("AL_LR_US", "logistic")]
    upkeep = loops.Upkeep({"AL_LR_US": C_SETS})

    def run(fold, train, test, init, size):
        return loops.two_stage_loop(
            train, test, members, loops.by_probability(), density.Setting(3, 1), init, max(1, init // 2), size, majority=0.9,
            method="AL_LR_US", fold=fold, upkeep=upkeep, scale=True,
        )

    return _report(loops.over_folds(_folds(embedded(spark, d).drop("cluster"), 0.3, 0.4), run))
