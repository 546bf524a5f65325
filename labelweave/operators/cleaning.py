"""Label binarising, coercion, imputation, scaling and profiling.

Statistics are fitted once (one row of scalars per column reaches the driver)
and applied as literals, so a cleaned table is a plain projection of its scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.numbers import finite, to_number

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Up to this many values a column's exact median is one plain aggregate, and
# one task may rank this many distinct values.
MEDIAN_ROWS = 50_000
# Rank width (share of rows) kept on either side of the middle.
MEDIAN_MARGIN = 0.001


@dataclass(frozen=True)
class ColumnStats:
    count: int
    low: float | None
    high: float | None
    median: float | None


def quoted(name: str) -> Column:
    """Column by exact name, also with dots, slashes or leading spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def binarize_label(
    df: DataFrame,
    column: str = "Label",
    rules: Sequence[tuple[str, int]] = (("Normal", 0), ("Botnet", 1)),
    out: str | None = None,
) -> DataFrame:
    """Map label text to a class; a later rule wins, unmatched text is null."""
    label = F.lit(None).cast("int")
    for text, value in rules:
        label = F.when(quoted(column).contains(text), F.lit(value)).otherwise(label)
    return df.withColumn(out or column, label)


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind in NUMERIC or kind.startswith("decimal"):
        return quoted(name).cast("double")
    return to_number(quoted(name))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to double; text that is no number becomes null."""
    return df.withColumns({c: _number(df, c) for c in columns})


def null_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(quoted(c)) for c in columns})


def _middle_share(below: int, inside: int, total: int) -> list[float]:
    middle = ((total - 1) / 2 - below) / max(inside, 1)
    return [max(middle - MEDIAN_MARGIN, 0.0), min(middle + MEDIAN_MARGIN, 1.0)]


def _narrow(df: DataFrame, live: Sequence[str], bounds: dict, totals: dict, task_rows: int) -> dict:
    """Tighten value ranges round after round until each holds few rows.

    Needed only where the first range still holds too many rows for one task.
    A range is replaced only if counting shows that it keeps the middle ranks.
    """
    counts = {c: (0, totals[c]) for c in live}
    kept = dict.fromkeys(live)
    tried = bounds
    while True:
        fields = []
        for i, c in enumerate(live):
            fields.append(F.count_if(quoted(c) < tried[c][0]).alias(f"b{i}"))
            fields.append(F.count_if(quoted(c).between(*tried[c])).alias(f"i{i}"))
        row = df.agg(*fields).first()
        shrunk = False
        for i, c in enumerate(live):
            below, inside = row[f"b{i}"], row[f"i{i}"]
            holds = below <= (totals[c] - 1) // 2 and below + inside > totals[c] // 2
            if holds and (kept[c] is None or inside < counts[c][1]):
                kept[c], counts[c], shrunk = tried[c], (below, inside), True
        wide = [c for c in live if kept[c] is None or (counts[c][1] > task_rows and kept[c][0] < kept[c][1])]
        if not shrunk or not wide:
            return kept
        fields = []
        for i, c in enumerate(live):
            low, high = kept[c] or (None, None)
            value = quoted(c) if kept[c] is None else F.when(quoted(c).between(low, high), quoted(c))
            fields.append(F.percentile_approx(value, _middle_share(*counts[c], totals[c]), 10000).alias(f"q{i}"))
        row = df.agg(*fields).first()
        tried = {c: tuple(row[f"q{i}"]) for i, c in enumerate(live)}


def _rank_inside(df: DataFrame, live: Sequence[str], bounds: dict, totals: dict) -> dict[str, tuple]:
    """(value at the lower, at the upper middle rank) from one pass over the rows.

    Values below a range are one counted entry and values above are dropped;
    equal values are combined before they are ranked, so hot values cost one row.
    """
    entries = []
    for i, c in enumerate(live):
        low, high = bounds[c] or (None, None)
        value = quoted(c)
        if bounds[c] is not None:
            value = F.when(value < low, F.lit(float("-inf"))).when(value <= high, value)
        entries.append(F.struct(F.lit(i).alias("i"), value.alias("value")))
    values = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .filter("value is not null")
        .groupBy("i", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("last", F.sum("n").over(upto))
    total = F.element_at(F.array(*[F.lit(totals[c]) for c in live]), F.col("i") + 1)
    at = {"a": F.floor((total - 1) / 2), "b": F.floor(total / 2)}
    middle = ranked.groupBy("i").agg(
        *[F.min(F.when(F.col("last") > rank, F.col("value"))).alias(name) for name, rank in at.items()]
    )
    return {live[r["i"]]: (r["a"], r["b"]) for r in middle.collect()}  # one row per column


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    stats: dict[str, tuple[int, float, float]],
    ranges: dict[str, tuple[float, float]],
    task_rows: int = MEDIAN_ROWS,
) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values) of finite columns.

    ``stats`` holds (count, min, max), ``ranges`` approximate quantiles around
    the middle. Small tables use one aggregate. Otherwise one pass ranks the
    distinct values inside the ranges; a range that missed the middle is
    taken anew, eight times as wide each time.
    """
    live = [c for c in columns if stats[c][0] > 0]
    medians: dict[str, float | None] = {c: None for c in columns}
    if not live:
        return medians
    totals = {c: stats[c][0] for c in live}
    if max(totals.values()) <= task_rows:
        row = df.agg(*[F.median(quoted(c)).alias(f"m{i}") for i, c in enumerate(live)]).first()
        return medians | {c: row[f"m{i}"] for i, c in enumerate(live)}
    bounds = {c: ranges[c] for c in live}
    if max(totals.values()) * 4 * MEDIAN_MARGIN > task_rows:
        bounds = _narrow(df, live, bounds, totals, task_rows)
    margin = MEDIAN_MARGIN
    while live:
        missed = []
        for c, (a, b) in _rank_inside(df, live, bounds, totals).items():
            if a is None or b is None or float("-inf") in (a, b):
                missed.append(c)
            else:
                medians[c] = (a + b) / 2
        live, margin = missed, margin * 8
        if live:
            share = [max(0.5 - margin, 0.0), min(0.5 + margin, 1.0)]
            row = df.agg(*[F.percentile_approx(quoted(c), share, 10000).alias(f"q{i}") for i, c in enumerate(live)]).first()
            bounds = {c: tuple(row[f"q{i}"]) if margin < 0.5 else None for i, c in enumerate(live)}
    return medians


def fit_stats(
    df: DataFrame,
    columns: Sequence[str],
    approximate: bool = False,
    medians: bool = True,
    task_rows: int = MEDIAN_ROWS,
) -> dict[str, ColumnStats]:
    """Count, min, max and median of the finite values of every column."""
    values = df.select(*[finite(_number(df, c)).alias(c) for c in columns])
    share = [0.5 - MEDIAN_MARGIN, 0.5, 0.5 + MEDIAN_MARGIN]
    fields = []
    for i, c in enumerate(columns):
        fields += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.min(quoted(c)).alias(f"l{i}"),
            F.max(quoted(c)).alias(f"h{i}"),
        ]
        if medians:
            fields.append(F.percentile_approx(quoted(c), share, 10000).alias(f"q{i}"))
    row = values.agg(*fields).first()
    basic = {c: (row[f"n{i}"], row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(columns)}
    found: dict[str, float | None] = dict.fromkeys(columns)
    if medians:
        quantiles = {c: row[f"q{i}"] for i, c in enumerate(columns)}
        if approximate:
            found = {c: q[1] if q else None for c, q in quantiles.items()}
        else:
            ranges = {c: (q[0], q[2]) for c, q in quantiles.items() if q}
            found = exact_medians(values, columns, basic, ranges, task_rows)
    return {c: ColumnStats(*basic[c], found[c]) for c in columns}


def impute_median(df: DataFrame, columns: Sequence[str], stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Fill missing and non-finite values; an all-null column stays null."""
    stats = stats or fit_stats(df, columns)
    return df.withColumns(
        {c: F.coalesce(finite(_number(df, c)), F.lit(stats[c].median).cast("double")) for c in columns}
    )


def _scaled(value: Column, stats: ColumnStats) -> Column:
    if stats.low is None:
        return F.lit(None).cast("double")
    if stats.low == stats.high:
        return F.when(value.isNotNull(), F.lit(0.0))
    return (value - F.lit(stats.low)) / F.lit(stats.high - stats.low)


def minmax_scale(df: DataFrame, columns: Sequence[str], stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Scale to [0, 1] by the fitted range; a constant column becomes 0."""
    stats = stats or fit_stats(df, columns, medians=False)
    return df.withColumns({c: _scaled(finite(_number(df, c)), stats[c]) for c in columns})


def clean(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: DataFrame | None = None,
    label: str = "Label",
    scale_label: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """Coerce, null non-finite, impute the median and scale in one projection.

    ``fit_on`` is the table that gives the statistics: the table itself by
    default, or the train table for a test table. Filling in a median never
    moves a minimum or maximum, so one statistics pass serves both steps.
    """
    columns = [c for c in columns if c != label] + ([label] if scale_label else [])
    stats = fit_stats(df if fit_on is None else fit_on, columns, approximate)
    filled = {
        c: F.coalesce(finite(_number(df, c)), F.lit(stats[c].median).cast("double")) for c in columns
    }
    return df.withColumns({c: _scaled(filled[c], stats[c]) for c in columns})


def _per_column(df: DataFrame, columns: Sequence[str], entry) -> DataFrame:
    """One aggregate over all columns, returned as one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *entry(c)) for c in columns])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing values, finiteness and range of numeric columns."""

    def entry(c: str) -> list[Column]:
        value = quoted(c).cast("double")
        good = finite(value)
        return [
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(value.isNull()).alias("n_null"),
            F.count_if(F.isnan(value)).alias("n_nan"),
            F.count_if(F.abs(value) == F.lit(float("inf"))).alias("n_inf"),
            (F.count(good) == F.count(F.lit(1))).alias("all_finite"),
            F.min(good).alias("min_value"),
            F.max(good).alias("max_value"),
        ]

    return _per_column(df, columns, entry)


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and share per column, most missing first."""

    def entry(c: str) -> list[Column]:
        missing = F.count_if(quoted(c).isNull())
        return [
            missing.alias("n_missing"),
            F.coalesce(F.try_divide(missing.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("share"),
        ]

    return _per_column(df, columns, entry).orderBy(F.desc("n_missing"), "column")


def drop_columns(df: DataFrame, names: Sequence[str] = (), last: int = 0) -> DataFrame:
    """Drop by name, then the ``last`` trailing columns."""
    kept = [c for c in df.columns if c not in set(names)]
    kept = kept[: len(kept) - last] if last else kept
    return df.select(*[quoted(c) for c in kept])


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The named feature columns behind the ``keep`` columns, in the given order; names may hold any character."""
    return df.select(*[quoted(c) for c in [*keep, *features]])


def exclude_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text does not match the regular expression."""
    return df.filter(~quoted(column).rlike(pattern))


def concat_columns(left: DataFrame, right: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Put two tables side by side on their row identity."""
    return left.join(right, id_col)
