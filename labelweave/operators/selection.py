"""Feature selection and reduction.

Everything is derived from one pass of moments: the correlation matrix and the
column spreads (features x features numbers) hold all that least squares needs,
so eliminating a feature costs no further pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.vectors import with_vector
from labelweave.operators.cleaning import quoted


def corr_with_target(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, r): Pearson correlation with the target; null for a constant.

    Each feature counts the rows where it and the target are present.
    """

    def entry(c: str):
        x, y = (quoted(n).cast("double") for n in (c, target))
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        return F.struct(F.lit(c).alias("feature"), r.alias("r"))

    return df.agg(F.array(*[entry(c) for c in columns]).alias("rows")).select(F.inline("rows"))


def correl_selection(df: DataFrame, target: str, columns: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Features whose absolute correlation exceeds the threshold."""
    return corr_with_target(df, target, columns).filter(F.abs("r") > threshold)


def feature_key(names: Sequence[str]) -> str:
    """Result key of a feature set."""
    return " & ".join(names)


def correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson matrix, each pair over the rows where both are present; NaN where a column is constant there.

    Rows are turned into one row per present value, which meets all other
    columns in one aggregate; sums are combined before the shuffle.
    """
    d = len(columns)
    values = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    turned = values.select("*", F.posexplode(F.array(*[f"c{i}" for i in range(d)])).alias("i", "x")).filter("x is not null")
    fields = []
    for j in range(d):
        x, y = F.when(F.col(f"c{j}").isNotNull(), F.col("x")), F.col(f"c{j}")
        fields.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{j}"))
    r = np.full((d, d), math.nan)
    for row in turned.groupBy("i").agg(*fields).collect():  # one row per column
        r[row["i"]] = [math.nan if row[f"r{j}"] is None else row[f"r{j}"] for j in range(d)]
    r = (r + r.T) / 2
    np.fill_diagonal(r, 1.0)
    return r


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, r) for every pair of columns; null where undefined."""
    r = correlation(df, columns)
    rows = [
        (a, b, None if math.isnan(r[i, j]) else float(r[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "left string, right string, r double")


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return value


def two_sided_p(t: float, freedom: float) -> float:
    """P(|T| > |t|) of Student's t distribution."""
    x = freedom / (freedom + t * t)
    a, b = freedom / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1 - x, b, a) / b


def _p_values(r: np.ndarray, n: int, target: int, features: Sequence[int]) -> dict[int, float]:
    """Least-squares p-values with intercept, from correlations alone."""
    xs = list(features)
    inverse = np.linalg.pinv(r[np.ix_(xs, xs)])
    beta = inverse @ r[xs, target]
    freedom = n - len(xs) - 1
    unexplained = max(1.0 - float(r[xs, target] @ beta), 0.0)
    result = {}
    for i, x in enumerate(xs):
        error = math.sqrt(unexplained / freedom * inverse[i, i])
        result[x] = 0.0 if error == 0 else two_sided_p(float(beta[i]) / error, freedom)
    return result


def _moments(df: DataFrame, target: str, columns: Sequence[str]) -> tuple[np.ndarray, int, list[int]]:
    complete = df.select(*[quoted(c).cast("double").alias(c) for c in [target, *columns]]).dropna()
    r, n = correlation(complete, [target, *columns]), complete.count()
    usable = [i for i in range(1, len(columns) + 1) if not math.isnan(r[i, i]) and not math.isnan(r[i, 0])]
    return r, n, usable


def ols_pvalues(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, p_value) of a least-squares fit with intercept; null for a constant."""
    r, n, usable = _moments(df, target, columns)
    found = _p_values(r, n, 0, usable) if usable else {}
    rows = [(c, found.get(i)) for i, c in enumerate(columns, 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, p_value double")


def backward_eliminate(df: DataFrame, target: str, columns: Sequence[str], alpha: float = 0.05) -> list[str]:
    """Drop the feature with the largest p-value above ``alpha`` until none is left."""
    r, n, kept = _moments(df, target, columns)
    while kept:
        found = _p_values(r, n, 0, kept)
        worst = max(kept, key=lambda i: found[i])
        if found[worst] <= alpha:
            break
        kept.remove(worst)
    return [columns[i - 1] for i in kept]


def pca(points: DataFrame, k: int, centres: Sequence[Sequence[float]] | None = None):
    """Project centred features on the first ``k`` axes.

    Returns (row_id, components) and, if centres are given, their projections.
    """
    d = len(points.select("features").first()["features"])
    means = points.agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(d)]).first()
    middle = F.array(*[F.lit(means[f"m{i}"]) for i in range(d)])

    def centred(df: DataFrame) -> DataFrame:
        gap = F.zip_with("features", middle, lambda x, m: x - m)
        return with_vector(df.withColumn("features", gap))

    model = PCA(k=k, inputCol="vector", outputCol="axes").fit(centred(points))

    def project(df: DataFrame) -> DataFrame:
        return model.transform(centred(df)).select("row_id", vector_to_array("axes").alias("components"))

    if centres is None:
        return project(points)
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
    held = points.sparkSession.createDataFrame(rows, "row_id bigint, features array<double>")
    return project(points), project(held)
