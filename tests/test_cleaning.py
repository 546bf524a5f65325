import math

import pytest
from pyspark.sql import functions as F

from labelweave.operators import cleaning


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id bigint, x {kind}")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("row_id").collect()]


def test_label_rules_later_wins_and_unmatched_is_null(spark):
    df = frame(spark, ["From-Normal", "From-Botnet", "Normal Botnet", "background", None])
    assert column(cleaning.binarize_label(df, "x")) == [0, 1, 1, None, None]


def test_coercion_of_text(spark):
    df = frame(spark, ["1", " 2.5 ", "-3e2", ".5", "7.", "abc", "", "inf", "NaN", "1.5d", "1_0", None, "0x1A"])
    expected = [1.0, 2.5, -300.0, 0.5, 7.0] + [None] * 8
    assert column(cleaning.coerce_numeric(df, ["x"])) == expected


def test_overflowing_text_is_not_finite(spark):
    df = cleaning.coerce_numeric(frame(spark, ["1e999", "1"]), ["x"])
    assert column(cleaning.null_non_finite(df, ["x"])) == [None, 1.0]


def test_median_of_even_count_interpolates(spark):
    stats = cleaning.fit_stats(frame(spark, [1.0, 2.0, 4.0, 10.0, None, float("nan"), math.inf], "double"), ["x"])["x"]
    assert (stats.count, stats.low, stats.high, stats.median) == (4, 1.0, 10.0, 3.0)


def test_all_null_stays_null_and_constant_scales_to_zero(spark):
    df = spark.createDataFrame([(0, None, 5.0), (1, None, 5.0)], "row_id bigint, a double, b double")
    out = cleaning.clean(df, ["a", "b"])
    assert column(out, "a") == [None, None]
    assert column(out, "b") == [0.0, 0.0]


def test_clean_is_bounded_and_fit_on_train(spark):
    train = frame(spark, ["0", "10", "x", "4"])
    test = frame(spark, ["20", "5"])
    assert column(cleaning.clean(train, ["x"])) == [0.0, 1.0, 0.4, 0.4]
    assert column(cleaning.clean(test, ["x"], fit_on=train)) == [2.0, 0.5]
    assert column(cleaning.clean(test, ["x"])) == [1.0, 0.0]


def test_label_scaled_only_on_request(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 1.0)], "row_id bigint, x double, Label double")
    assert column(cleaning.clean(df, ["x", "Label"]), "Label") == [1.0, 1.0]
    assert column(cleaning.clean(df, ["x", "Label"], scale_label=True), "Label") == [0.0, 0.0]


@pytest.mark.parametrize("task_rows", [10, 3])
@pytest.mark.parametrize("n", [1999, 2000])
def test_narrowing_median_equals_single_pass(spark, n, task_rows):
    df = spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000003)) / 7).alias("a"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("hot"),
        F.when(F.col("id") % 10 < 6, 1.0).otherwise(2.0).alias("two"),
        F.when(F.col("id") < n // 2, 1.0).otherwise(9.0).alias("edge"),
        F.lit(None).cast("double").alias("none"),
    )
    names = ["a", "hot", "two", "edge", "none"]
    slow = cleaning.fit_stats(df, names, task_rows=task_rows)
    assert slow == cleaning.fit_stats(df, names)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "1", "2"), (2, "3", "x")], ["row_id", " Flow Bytes/s", "Header.1"])
    out = cleaning.clean(df, [" Flow Bytes/s", "Header.1"])
    assert out.columns == ["row_id", " Flow Bytes/s", "Header.1"]
    assert [tuple(r) for r in out.orderBy("row_id").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.0)]


def test_clean_plan_is_a_projection(spark):
    df = frame(spark, ["1", "2"])
    plan = cleaning.clean(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
