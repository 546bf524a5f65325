"""Flow tables in and out of files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.order import rank_by_key, shuffle_key


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a headered CSV, without inferring types."""
    return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=True).columns


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Headered CSV with every column as text; typing is the cleaner's job."""
    return spark.read.csv(path, header=True, schema=text_schema(columns or csv_header(spark, path)))


def scan_indexed_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV whose first column is the row index; it becomes ``row_id``."""
    names = list(columns or csv_header(spark, path))
    names[0] = "row_id"
    df = spark.read.csv(path, header=True, schema=text_schema(names))
    return df.withColumn("row_id", F.coalesce(F.col("row_id").try_cast("long"), F.col("row_id").cast("double").cast("long")))


def union_sources(frames: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Stack tables by column name, tag the source and number the rows anew.

    New ids follow the md5 order of (source, ``order`` columns), which must be
    unique inside a source.
    """
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    keyed = stacked.withColumn("_key", shuffle_key(F.col("source"), *[F.col(c) for c in order]))
    return rank_by_key(keyed, "_key", ["source", *order], out="row_id").drop("_key")


def write_table(df: DataFrame, name: str, path: str, dated: bool = True, format: str = "parquet") -> str:
    """Write below ``path``; with ``dated`` inside a run-stamped folder."""
    target = path.rstrip("/")
    if dated:
        stamp = df.sparkSession.range(1).select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd_HH-mm-ss").alias("s")
        ).first()["s"]
        target = f"{target}/{stamp}"
    target = f"{target}/{name}"
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(target)
    return target


def write_iteration(df: DataFrame, path: str, kind: str, run: str, fold: str, iteration: int) -> str:
    """Append one iteration's rows (train, predicted or test) to a partitioned table."""
    target = f"{path.rstrip('/')}/{kind}"
    (
        df.withColumn("run", F.lit(run))
        .withColumn("fold", F.lit(fold))
        .withColumn("iteration", F.lit(iteration))
        .write.mode("append")
        .partitionBy("run", "fold", "iteration")
        .parquet(target)
    )
    return target


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by seeded hash order."""
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(id_col)))
    return rank_by_key(keyed, "_key", [id_col], limit=n, out="_rank").drop("_key", "_rank")


def sample_frac(df: DataFrame, fraction: float, seed: int, id_col: str = "row_id") -> DataFrame:
    """About ``fraction`` of the rows: the 32-bit md5 prefix lies below the cut."""
    prefix = F.conv(F.substring(shuffle_key(seed, F.col(id_col)), 1, 8), 16, 10).cast("long")
    return df.filter(prefix < F.lit(int(fraction * 16**8)))
