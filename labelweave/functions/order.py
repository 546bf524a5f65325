"""Reproducible row order.

A shuffle is the order of ``md5(seed:row_id)``. The hash is uniform, so its
leading hex digits split any table evenly; ranks are counted per digit bucket
and shifted by the bucket's start. No task ever sorts more than one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialise

MAX_BUCKET_DIGITS = 5  # at most 16 ** 5 buckets: the bound of the broadcast start table
BUCKETS_PER_PARTITION = 32
ROOM = 1.0  # times the room a bound of values needs
MAX_RANGES = 2048  # value ranges of a running sum, whatever the number of shuffle partitions


def bucket_digits(df: DataFrame) -> int:
    """Hex digits that give every shuffle partition a few buckets to sort."""
    wanted = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKET_DIGITS, math.ceil(math.log(wanted, 16))))


def shuffle_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ':'."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts))


def rank_by_key(
    df: DataFrame,
    key: str,
    ties: Sequence[str],
    by: Sequence[str] = (),
    limit: Column | int | None = None,
    out: str = "ord",
    groups: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """0-based rank by (``key``, ``ties``) inside each ``by`` group.

    ``key`` is a hex digest column. With ``limit`` only ranks below it are
    returned, and buckets that start at or after it are dropped before sorting.
    ``groups`` is the number of ``by`` groups where it is known: the start
    table is broadcast if groups x buckets stays below a fixed bound. ``total``
    names a column for the rows of the whole group, known from the same counts.
    """
    by = list(by)
    digits = bucket_digits(df)
    starts_bound = 16**digits * (groups if by and groups else 1)
    small = (not by or groups is not None) and starts_bound <= 16**MAX_BUCKET_DIGITS
    keyed = df.withColumn("_bucket", F.conv(F.substring(key, 1, digits), 16, 10).cast("int"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    extra = []
    if total is not None:
        starts = starts.withColumn(total, F.sum("_n").over(Window.partitionBy(*by)))
        extra = [total]
    if limit is not None:
        starts = starts.filter(F.col("_start") < limit)
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"), "_start", *extra)
    match = F.col("_bucket") == F.col("_b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    # Read back as a table, large starts no longer tempt the planner to keep a whole group in one task.
    joined = keyed.join(F.broadcast(starts) if small else materialise(starts, "bucket-starts"), match)
    inside = Window.partitionBy(*by, "_bucket").orderBy(key, *ties)
    ranked = joined.withColumn(out, (F.row_number().over(inside) - 1 + F.col("_start")).cast("long"))
    if limit is not None:
        ranked = ranked.filter(F.col(out) < limit)
    return ranked.drop("_bucket", "_b", "_start", *[f"_by_{c}" for c in by])


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Running sums over the whole table in the order of a unique numeric column.

    ``sums`` maps new column to summed column. Rows are cut into value ranges
    by approximate quantiles; each range is summed on its own and shifted by
    the total of the ranges before it. The ranges, at most ``MAX_RANGES``, are
    found by binary search.
    """
    parts = min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fractions = [i / parts for i in range(1, parts)] or [0.5]
    cuts = df.agg(F.percentile_approx(order, fractions, 10000).alias("q")).first()["q"] or [0.0]
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    valued = df.withColumn("_order", F.col(order).cast("double"))
    cutter = Bucketizer(splits=splits, inputCol="_order", outputCol="_cut")
    keyed = cutter.transform(valued).withColumn("_part", F.col("_cut").cast("int")).drop("_order", "_cut")
    direction = F.col(order).desc() if descending else F.col(order).asc()
    part_order = F.col("_part").desc() if descending else F.col("_part").asc()
    before = Window.orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    shifts = keyed.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
    shifts = shifts.select(
        F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_shift_{o}") for o in sums],
    )
    running = Window.partitionBy("_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(F.broadcast(shifts), F.col("_part") == F.col("_p"))
    for out, source in sums.items():
        joined = joined.withColumn(out, F.sum(source).over(running) + F.col(f"_shift_{out}"))
    return joined.drop("_part", "_p", *[f"_shift_{o}" for o in sums])


def top_by_value(df: DataFrame, value: str, n: int, by: Sequence[str], ties: Sequence[str], out: str = "rank") -> DataFrame:
    """The ``n`` rows of the highest values of every ``by`` group, ranked from 1; equal values in the order of ``ties``.

    Approximate quantiles of a group bound its n-th value from below, and rows
    under the bound leave before any shuffle of rows; a group whose bound was
    too high is looked at again with a lower one. What is left is cut into
    ranges of values by quantiles of its own, and rows are ranked inside a
    range and shifted by the ranges above, so no task sorts a group. Null
    values are the lowest.
    """
    if not by:
        return top_by_value(df.withColumn("_whole", F.lit(0)), value, n, ["_whole"], ties, out).drop("_whole")
    by = list(by)
    score = F.coalesce(F.col(value).cast("double"), F.lit(-math.inf))
    scored = materialise(df.withColumn("_value", score), "values")
    room, done, left = ROOM, None, scored
    while True:
        share = F.greatest(F.lit(0.0), 1 - room * (n + 6 * math.sqrt(n) + 30) / F.col("_rows"))
        # One sketch of a thousand quantiles serves every group; its bound is the step below the share.
        cuts = left.groupBy(*by).agg(F.percentile_approx("_value", [i / 1000 for i in range(1001)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_rows"))
        bounds = cuts.select(*by, "_rows", F.when(share <= 0.001, F.lit(-math.inf)).otherwise(F.get("_cuts", F.floor(share * 1000).cast("int") - 1)).alias("_bound"))
        bounds = materialise(bounds, "value-bounds")
        same = [left[c].eqNullSafe(bounds[c]) for c in by]
        above = left.join(bounds, same).filter(F.col("_value") >= F.col("_bound")).select(left["*"], "_rows")
        above = materialise(above, "highest")
        counts = above.groupBy(*by).agg(F.count(F.lit(1)).alias("_above"), F.max("_rows").alias("_rows"))
        short = materialise(counts.filter(F.col("_above") < F.least("_rows", F.lit(n))).select(*by), "short-groups")
        again = [above[c].eqNullSafe(short[c]) for c in by]
        settled = above.join(short, again, "left_anti").drop("_rows")
        done = settled if done is None else done.unionByName(settled)
        if short.isEmpty():
            break
        left = materialise(left.join(short, [left[c].eqNullSafe(short[c]) for c in by], "left_semi"), "values")
        room *= 4
    cuts = done.groupBy(*by).agg(F.percentile_approx("_value", [i / 64 for i in range(1, 64)], 10_000).alias("_cuts"))
    cuts = cuts.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_cuts")
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    ranged = done.join(cuts, match).drop(*[f"_by_{c}" for c in by])
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda x: x > F.col("_value")))).drop("_cuts")
    ranged = materialise(ranged, "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_start") < n)
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), "_start")
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("_value"), *ties)
    ranked = ranged.join(starts, match & (F.col("_range") == F.col("_r")))
    ranked = ranked.withColumn(out, (F.row_number().over(inside) + F.col("_start")).cast("long")).filter(F.col(out) <= n)
    return ranked.drop("_value", "_range", "_r", "_start", *[f"_by_{c}" for c in by])
