import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import classifiers, density, tuning
from labelweave.operators.classifiers import Member
from labelweave.operators.reporting import RESULT_SCHEMA
from labelweave.plans import loops
from labelweave.session import materialise, scratch_path, shared_folder
from labelweave.streaming.labelling import label_stream

SCHEMA = "row_id bigint, ord bigint, features array<double>, Label int"


def rows(spark, n=120, seed=0, one_class=None):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 2))
    y = (x.sum(1) > 1).astype(int) if one_class is None else np.full(n, one_class)
    return spark.createDataFrame([(i, i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], SCHEMA)


def pool_of(df):
    return df.select("row_id", "features", F.col("Label").alias("label"))


KINDS = [("forest", {"n_trees": 5}), ("logistic", {}), ("margin", {"max_iter": 10}), ("knn", {"k": 3}), ("network", {"layers": [2, 4, 2], "max_iter": 30})]


@pytest.mark.parametrize("kind, params", KINDS)
def test_members_give_two_probabilities(spark, kind, params):
    df = rows(spark)
    scored = classifiers.fit(Member("m", kind, params), pool_of(df)).score(df)
    got = scored.agg(F.count("*"), F.max(F.abs(F.col("p0") + F.col("p1") - 1))).first()
    assert got[0] == 120 and got[1] < 1e-9
    right = scored.join(df, "row_id").filter((F.col("p1") > 0.5) == (F.col("Label") == 1)).count()
    assert right > 90


@pytest.mark.parametrize("kind, params", KINDS)
@pytest.mark.parametrize("only", [0, 1])
def test_one_class_pool(spark, kind, params, only):
    df = rows(spark, 30, one_class=only)
    scored = classifiers.fit(Member("m", kind, params), pool_of(df)).score(df)
    assert scored.filter(F.col(f"p{only}") > 0.5).count() == 30


def test_tuning_and_search(spark):
    df = materialise(pool_of(rows(spark)))
    best, table = tuning.tune("knn", "knn", [{"k": 1}, {"k": 3}], df)
    assert table.count() == 2 and best.kind == "knn"
    folded = df.withColumn("repeat", F.lit(1)).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    found = tuning.cv_search("logistic", [{"C": 100.0}], folded, 3).first()
    assert 0.8 < found["mean"] <= 1.0 and found["std"] >= 0
    assert tuning.random_sets({"a": [1, 2]}, 3, 1) == tuning.random_sets({"a": [1, 2]}, 3, 1)


def check(outcome, n, last):
    assert outcome.report.schema == RESULT_SCHEMA
    report = outcome.report.filter("ML_method = 'committee'").orderBy("N_Retrains").collect()
    assert [r["N_Retrains"] for r in report] == list(range(1, last + 1))
    assert report[-1]["Number_of_Samples_trained"] == n
    assert [r["Queries_to_Oracle"] for r in report] == sorted(r["Queries_to_Oracle"] for r in report)
    assert outcome.pool.count() == n and outcome.pool.select("row_id").distinct().count() == n
    return report


def test_self_active_loop(spark):
    train, test = rows(spark, 100), rows(spark, 60, seed=1)
    members = [Member("knn", "knn", {"k": 5}), Member("logistic", "logistic", {"max_iter": 10})]
    outcome = loops.self_active_loop(train, test, members, loops.by_probability(0.7), 40, 30)
    report = check(outcome, 100, 3)
    asked = outcome.pool.filter("source = 'oracle'").count()
    assert report[-1]["Queries_to_Oracle"] == asked
    assert report[0]["Botnet_label_err_rate_FNR"] == 1.0
    assert outcome.pool.filter("source = 'oracle' and new_label <> Label").count() == 0
    assert outcome.report.select("ML_method").distinct().count() == 3


def test_committee_and_density_loop(spark):
    train, test = rows(spark, 90), rows(spark, 40, seed=1)
    labeller = loops.by_committee_and_density(density.Setting(3, 1), 0.95)
    outcome = loops.self_active_loop(train, test, [Member("knn", "knn", {"k": 5})], labeller, 40, 50)
    report = check(outcome, 90, 2)
    assert report[-1]["Queries_to_Oracle"] <= 50


def test_single_train_loop_reports_every_batch(spark):
    train, test = rows(spark, 100), rows(spark, 60, seed=1)
    members = [Member("logistic", "logistic", {"max_iter": 10})]
    outcome = loops.single_train_loop(train, test, members, loops.by_probability(0.7), 20, 30)
    report = check(outcome, 100, 4)
    assert report[0]["F1"] == report[1]["F1"] == report[2]["F1"]


def test_two_stage_loop(spark):
    train, test = rows(spark, 100), rows(spark, 60, seed=1)
    members = [Member("logistic", "logistic", {"max_iter": 10})]
    outcome = loops.two_stage_loop(train, test, members, loops.passive(), density.Setting(3, 1), 40, 25, 60)
    check(outcome, 100, 3)


def test_centre_labels_cost_k_queries(spark):
    labelled, totals = loops.centre_labels(rows(spark, 50), 4)
    assert totals["n_query"] == 4 and labelled.count() == 50
    assert labelled.filter("new_label is null").count() == 0


def test_stream_equals_batch(spark):
    df = rows(spark, 60)
    fitted = classifiers.fit_committee([Member("logistic", "logistic", {"max_iter": 10})], pool_of(df))
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    df.select("row_id", "features").write.parquet(source)
    stream = spark.readStream.schema("row_id bigint, features array<double>").parquet(source)
    label_stream(stream, fitted, target, checkpoint).awaitTermination(120)
    got = spark.read.parquet(target)
    assert got.count() == 60
    assert got.filter("(source = 'oracle') <> (p0 <= 0.7 and p1 <= 0.7)").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    assert scratch_path(spark, "x").startswith(folder)


def test_a_pool_without_labels_is_refused(spark):
    pool = spark.createDataFrame([(1, [0.0], None), (2, [1.0], None)], "row_id long, features array<double>, label int")
    with pytest.raises(ValueError, match="no labelled rows"):
        classifiers.fit(Member("forest", "forest"), pool)


def test_the_margin_member_takes_the_side_of_the_plane(spark):
    rows = [(k, [k / 50 + (k % 7) / 20], int(k > 40)) for k in range(60)]
    pool = spark.createDataFrame(rows, "row_id long, features array<double>, label int")
    fitted = classifiers.fit(Member("plane", "margin", {"C": 1.0}), pool)
    both = fitted.margin(pool).join(fitted.score(pool), "row_id").collect()
    assert all((r.dist > 0) == (r.p1 > 0.5) for r in both)
