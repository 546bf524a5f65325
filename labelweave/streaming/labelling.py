"""The single-train loop over arriving rows.

The model is fixed, so a micro-batch needs no state: it is scored, split into
confident and uncertain rows, and appended to a table partitioned by who
labels the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelweave.operators.classifiers import Fitted, committee_scores
from labelweave.operators.triage import committee_average, two_class_label


def label_stream(
    stream: DataFrame, fitted: Sequence[Fitted], target: str, checkpoint: str, threshold: float = 0.7
) -> StreamingQuery:
    """Label (row_id, features) rows as they arrive; ``source`` 'oracle' rows have a null label."""

    def label(batch: DataFrame, batch_id: int) -> None:
        scored = committee_average(committee_scores(fitted, batch))
        labelled = scored.withColumn("new_label", two_class_label(threshold))
        source = F.when(F.col("new_label").isNull(), "oracle").otherwise("model")
        labelled.withColumns({"source": source, "batch": F.lit(batch_id)}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(target)

    return (
        stream.writeStream.foreachBatch(label)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
