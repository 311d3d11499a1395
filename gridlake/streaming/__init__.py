"""The page scan over a stream: tables are found as pages arrive.

Detection keeps no state between pages, so each micro-batch is the batch plan.  A batch
writes its own folder and overwrites it when it is retried, so a lost executor or a restarted
query never doubles a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.types import column_evidence, decide_profile, merge_evidence
from ..plans.detect import detect_tables
from ..plans.staging import stages_removed


def append_tables(
    pages: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write the grid rows of every arriving page under ``path/batch_id=N``, by kind."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with stages_removed(batch.sparkSession):
            (
                detect_tables(batch)
                .write.mode("overwrite")
                .partitionBy("kind")
                .parquet(f"{path}/batch_id={batch_id}")
            )

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def append_evidence(grid: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the type evidence of arriving grid rows under ``path/batch_id=N``; rows of a table may come in any batch.

    Each batch adds its own counts, so no earlier cell is read again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        column_evidence(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = grid.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_profile(spark: SparkSession, path: str) -> DataFrame:
    """Types and formats from all evidence stored so far."""
    return decide_profile(merge_evidence(spark.read.parquet(path).drop("batch_id")))
