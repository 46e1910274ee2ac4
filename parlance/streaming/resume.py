"""Jobs that go on where they were stopped: new input files in batches, whole batches written once, failed rows on the side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import fresh


def run_available(todo: DataFrame, work: Callable[[DataFrame], DataFrame], failed: Column, path: str, errors: str, progress: str, key: str = "utt_id") -> None:
    """Does all of a stream that is there and has not been done, then ends: results as Parquet at `path`, keys of failed rows at `errors`.

    todo: a streaming DataFrame; its reader's `maxFilesPerTrigger` is the size of a batch. work is applied to each batch and gives rows of any columns; those
    for which `failed` is true go to `errors` (the key alone, each once a batch), those for which it is false or null to `path`. `progress` is the folder of the
    stream's checkpoint: a run that was killed is started again with the same three folders, and takes up the batch that was under way. A batch replaces
    the folder of its number in both places, so what a killed run had written of it is not there twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = work(batch)
        (bad,) = fresh(rows, "failed")
        kept = rows.withColumn(bad, F.coalesce(failed, F.lit(False))).persist()  # the work is done once for the two outputs
        try:
            kept.where(~F.col(bad)).drop(bad).write.mode("overwrite").parquet(f"{path}/batch={number}")
            kept.where(F.col(bad)).select(F.col(key).cast("string").alias("value")).distinct().write.mode("overwrite").text(f"{errors}/batch={number}")
        finally:
            kept.unpersist()

    todo.writeStream.foreachBatch(one).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
