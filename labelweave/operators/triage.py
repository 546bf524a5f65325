"""Committees and the split into rows the model labels and rows the oracle labels.

Every rule is a column expression on scored rows. ``source`` says who labelled
a row: 'model' or 'oracle'. Thresholds are strict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.numbers import entropy
from labelweave.functions.order import top_by_value


def committee_average(members: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Mean class probabilities over the members of (row_id, member, p0, p1)."""
    return members.groupBy(id_col).agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1"))


def committee_label(p0: Column, p1: Column) -> Column:
    """Class with more than half of the probability; null when undecided."""
    return F.when(p0 > 0.5, F.lit(0)).when(p1 > 0.5, F.lit(1))


def committee_predict(scored: DataFrame, out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, committee_label(F.col("p0"), F.col("p1")))


def soft_vote(members: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Class with the larger mean probability; a tie, up to rounding of the means, goes to class 0."""
    mean = committee_average(members, id_col)
    return mean.withColumn("prediction", F.when(F.col("p1") - F.col("p0") > 1e-9, F.lit(1)).otherwise(F.lit(0)))


def soft_vote_entropy(members: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Entropy of the mean vote: how unsure the committee is."""
    mean = committee_average(members, id_col)
    return mean.withColumn("entropy", entropy(F.col("p0"), F.col("p1")))


def triage_entropy(df: DataFrame, n: int, by: Sequence[str] = (), label: str = "Label", id_col: str = "row_id") -> DataFrame:
    """The ``n`` most uncertain rows of every batch go to the oracle, the model labels the rest.

    Uncertainty is the entropy of (p0, p1); equal ones go by row id. The model's
    label is that of the larger probability, a tie class 0. A batch of ``n`` rows or fewer is asked whole.
    """
    scored = df.withColumn("entropy", entropy(F.col("p0"), F.col("p1")))
    # Rounded, so that ties do not hang on the order in which means were summed.
    ranked = top_by_value(scored.select(id_col, *by, F.round("entropy", 9).alias("_e")), "_e", n, by, [id_col], "_rank")
    asked = ranked.select(F.col(id_col).alias("_asked"))
    marked = scored.join(asked, F.col(id_col) == F.col("_asked"), "left")
    decided = F.when(F.col("_asked").isNull(), F.when(F.col("p1") - F.col("p0") > 1e-9, F.lit(1)).otherwise(F.lit(0)))
    return _settle(marked, decided, label).drop("_asked")


def binary_from_probability(scored: DataFrame, p1: str = "p1", out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, F.when(F.col(p1) > 0.5, F.lit(1)).otherwise(F.lit(0)))


def _settle(df: DataFrame, model_label: Column, label: str) -> DataFrame:
    """Model label where there is one, else the true label from the oracle."""
    return (
        df.withColumn("_model", model_label)
        .withColumn("new_label", F.coalesce(F.col("_model"), F.col(label).cast("int")))
        .withColumn("source", F.when(F.col("_model").isNotNull(), "model").otherwise("oracle"))
        .drop("_model")
    )


def two_class_label(threshold: float = 0.7) -> Column:
    return F.when(F.col("p0") > threshold, F.lit(0)).when(F.col("p1") > threshold, F.lit(1))


def triage_two_class(df: DataFrame, threshold: float = 0.7, label: str = "Label") -> DataFrame:
    """Confident in either class probability: the model labels the row."""
    return _settle(df, two_class_label(threshold), label)


def triage_binary(df: DataFrame, high: float = 0.7, low: float = 0.3, label: str = "Label") -> DataFrame:
    """Same decision from one probability column."""
    decided = F.when(F.col("p1") > high, F.lit(1)).when(F.col("p1") < low, F.lit(0))
    return _settle(df, decided, label)


def triage_margin(df: DataFrame, margin: float = 1.0, score: str = "dist", label: str = "Label") -> DataFrame:
    """Rows inside the margin of a separating plane go to the oracle."""
    decided = F.when(F.col(score) > margin, F.lit(1)).when(F.col(score) < -margin, F.lit(0))
    return _settle(df, decided, label)


def triage_passive(df: DataFrame, label: str = "Label") -> DataFrame:
    """No active learning: every row goes to the oracle."""
    return _settle(df, F.lit(None).cast("int"), label)


def split_confident(df: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(rows the committee labels, rows left for clustering)."""
    decided = two_class_label(threshold)
    confident = df.withColumn("new_label", decided).filter(F.col("new_label").isNotNull())
    uncertain = df.filter(decided.isNull())
    return confident.withColumn("source", F.lit("model")), uncertain


def append_to_pool(pool: DataFrame, batch: DataFrame) -> DataFrame:
    return pool.unionByName(batch)


def replace_pool(pool: DataFrame, batch: DataFrame) -> DataFrame:
    """Train-on-batch variants keep the current batch only."""
    return batch.select(*pool.columns)


def pseudo_label_log(pool: DataFrame, upto: int | None = None) -> DataFrame:
    """Rows the model labelled, up to and including an iteration."""
    rows = pool.filter(F.col("source") == "model")
    return rows if upto is None else rows.filter(F.col("iteration") <= upto)


def query_cost(batch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return batch.groupBy(*by).agg(
        F.count_if(F.col("source") == "oracle").alias("n_query"),
        F.count_if(F.col("source") == "model").alias("n_model"),
    )
