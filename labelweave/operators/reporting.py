"""Result tables: quality set against the number of labels asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.numbers import ratio
from labelweave.operators.cleaning import quoted
from labelweave.operators.scoring import add_error_rates, add_scores, confusion

# Column names and types of the result table.
RESULT_COLUMNS = (
    ("ML_method", "string"),
    ("Training_set", "string"),
    ("N_Retrains", "bigint"),
    ("Queries_to_Oracle", "bigint"),
    ("F1", "double"),
    ("Normal_traffic_label_err_rate_FPR", "double"),
    ("Botnet_label_err_rate_FNR", "double"),
    ("Number_of_Samples_trained", "double"),
    ("Precision", "double"),
    ("Recall", "double"),
    ("Training_Time", "double"),
    ("Testing_Time", "double"),
    ("Tuning_Time", "double"),
    ("Number_of_Clusters", "bigint"),
    ("Cluster Noises", "bigint"),
    ("Prob_1s", "double"),
    ("init_train_sample_sz", "bigint"),
    ("init_batch_sz", "bigint"),
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField(name, {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType()}[kind])
        for name, kind in RESULT_COLUMNS
    ]
)
PASSIVE_PATTERN = "PL_"


def iteration_report(
    tested: DataFrame,
    pseudo: DataFrame,
    by: Sequence[str] = (),
    y: str = "Label",
    prediction: str = "prediction",
    new_label: str = "new_label",
) -> DataFrame:
    """Test scores and pseudo-label error rates per iteration.

    ``tested`` holds predicted test rows, ``pseudo`` the rows the model
    labelled; an iteration without pseudo-labels gets both rates 1.
    """
    by = list(by)
    scores = add_scores(confusion(tested, y, prediction, by)).select(
        *by,
        F.col("f1").alias("F1"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        "n_undecided",
    )
    rates = add_error_rates(confusion(pseudo, y, new_label, by)).select(
        *by,
        F.col("fpr").alias("Normal_traffic_label_err_rate_FPR"),
        F.col("fnr").alias("Botnet_label_err_rate_FNR"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_pseudo"),
    )
    joined = scores.join(rates, by, "left") if by else scores.withColumn("_one", F.lit(1)).join(
        rates.withColumn("_one", F.lit(1)), "_one", "left"
    ).drop("_one")
    return joined.na.fill(
        {"Normal_traffic_label_err_rate_FPR": 1.0, "Botnet_label_err_rate_FNR": 1.0, "n_pseudo": 0}
    )


def result_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Typed result table from one dict per iteration; missing numbers are 0."""
    defaults = {"string": "", "bigint": 0, "double": 0.0}
    data = [
        tuple(
            float(r.get(name, 0.0)) if kind == "double" else r.get(name, defaults[kind])
            for name, kind in RESULT_COLUMNS
        )
        for r in rows
    ]
    return spark.createDataFrame(data, RESULT_SCHEMA)


def typed_results(df: DataFrame, columns: Sequence[tuple[str, str]] = RESULT_COLUMNS) -> DataFrame:
    """Text result columns to their declared types; unreadable text is null."""
    kinds = dict(columns)
    fields = []
    for c in df.columns:
        kind = kinds.get(c, "string")
        value = quoted(c).cast("string")
        if kind == "bigint":
            typed = F.coalesce(value.try_cast("bigint"), F.nanvl(value.try_cast("double"), F.lit(None).cast("double")).cast("bigint"))
        elif kind == "double":
            typed = value.try_cast("double")
        else:
            typed = value
        fields.append(typed.alias(c))
    return df.select(*fields)


def combine_results(frames: Sequence[DataFrame], key: Sequence[str] = ("ML_method", "Training_set", "N_Retrains")) -> DataFrame:
    """Stack result tables; a (method, fold, iteration) found again is dropped.

    Of repeated rows the one from the earliest table is kept.
    """
    tagged = [df.withColumn("_from", F.lit(i)) for i, df in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in stacked.columns if c not in key and c != "_from"]
    firsts = stacked.groupBy(*key).agg(
        F.min_by(F.struct(*[quoted(c) for c in rest]), F.struct(F.col("_from"), *[quoted(c) for c in rest])).alias("_row")
    )
    return firsts.select(*key, "_row.*").select(*[quoted(c) for c in stacked.columns if c != "_from"])


def final_iteration(df: DataFrame, by: Sequence[str] = (), step: str = "N_Retrains") -> DataFrame:
    """Rows of the last iteration, overall or per group."""
    if not by:
        return df.filter(F.col(step) == df.agg(F.max(step)).scalar())
    last = df.groupBy(*by).agg(F.max(step).alias(step))
    return df.join(last, [*by, step], "left_semi")


def run_totals(batches: DataFrame, by: Sequence[str], init: int, label: str = "Label") -> DataFrame:
    """Wrong pseudo-labels and confident / uncertain row counts per run.

    ``batches`` are labelled rows with ``source`` 'init', 'model' or 'oracle'.
    """
    model = F.col("source") == "model"
    high = F.count_if(model)
    return batches.groupBy(*by).agg(
        F.count_if(model & (F.col(label) == 0) & (F.col("new_label") == 1)).alias("n_fp"),
        F.count_if(model & (F.col(label) == 1) & (F.col("new_label") == 0)).alias("n_fn"),
        high.alias("n_high_confidence"),
        (F.count(F.lit(1)) - high - F.lit(init)).alias("n_low_confidence"),
    )


def curve(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Mean, spread and count of ``y`` per ``x`` and group: the data of a line plot."""
    return df.groupBy(x, *by).agg(
        F.avg(y).alias("mean"), F.stddev(y).alias("spread"), F.count(y).alias("n")
    )


def bars(df: DataFrame, category: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of ``y`` per bar."""
    return df.groupBy(category, *([hue] if hue else [])).agg(F.avg(y).alias("mean"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "score_name", value: str = "score") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def composite_key(df: DataFrame, columns: Sequence[str], separator: str = "_") -> DataFrame:
    """Joined text of several columns, named after them."""
    texts = [quoted(c).cast("string") for c in columns]
    return df.withColumn(separator.join(columns), F.concat_ws(separator, *texts))


def query_share(queries: str = "Queries_to_Oracle", samples: str = "Number_of_Samples_trained") -> Column:
    """Asked labels per hundred samples."""
    return ratio(F.col(queries), F.col(samples)) * 100


def label_error_counts(totals: DataFrame, method: str = "ML_method") -> DataFrame:
    """Wrong pseudo-labels per method in long form, passive methods left out."""
    active = totals.filter(~F.col(method).contains(PASSIVE_PATTERN))
    return active.unpivot([method], ["n_fp", "n_fn"], "error", "n")


def compare_methods(predicted: DataFrame, y: str, prediction: str, by: Sequence[str] = ("Training_set", "ML_method")) -> DataFrame:
    """Precision, recall and F1 per fold and method."""
    scores = add_scores(confusion(predicted, y, prediction, by))
    return scores.select(
        *by, F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col("f1").alias("F1")
    )


def query_saving(final: DataFrame, baseline: str, fold: str = "Training_set", method: str = "ML_method") -> DataFrame:
    """Share of oracle queries each method saves against a baseline, per fold."""
    base = final.filter(F.col(method) == baseline).select(fold, F.col("Queries_to_Oracle").alias("_base"))
    joined = final.join(base, fold)
    saving = 1 - F.try_divide(F.col("Queries_to_Oracle").cast("double"), F.col("_base").cast("double"))
    return joined.select(fold, method, saving.alias("saving"))


def stopwatch_totals(stages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seconds per kind of stage; a stage reported twice counts once."""
    once = stages.groupBy(*by, "stage", "iteration").agg(F.max("seconds").alias("seconds"))

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stage") == kind, F.col("seconds"))), F.lit(0.0)).alias(f"{kind}_seconds")

    return once.groupBy(*by).agg(total("train"), total("test"), total("tune"))
