"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the checkpoint folder, as the session names it.

    Where none is set, as in tests, a folder below the warehouse is used, which
    executors share as well.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/{application}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps start from the files, so lost executors never force a replay
    of the steps before, and the optimiser sees real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PAIRS_OF_TASK = 100_000_000
MOST_TASKS = 1024


def dealt_for_pairs(df: DataFrame, pairs: float, key: str = "row_id") -> DataFrame:
    """``df`` over as many tasks as its rows' comparisons are worth; few comparisons leave it as it is.

    A table of a few files would otherwise be measured against another one in as few tasks.
    """
    if pairs < PAIRS_OF_TASK / 10:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(max(cores, min(MOST_TASKS, pairs / PAIRS_OF_TASK))), key)
