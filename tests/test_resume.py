"""A job that is killed half-way and started again."""

import pytest
from pyspark.sql import functions as F

from parlance.streaming.resume import run_available


def test_killed_job_goes_on(spark, tmp_path):
    schema = "utt_id string, x int, failed string"
    for k in range(5):
        spark.createDataFrame([(f"u{k}{j}", k if j else -1, "mine") for j in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    where = [str(tmp_path / n) for n in ("out", "bad", "progress")]
    todo = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def work(stop):
        def own(batch):
            seen.append(batch.count())
            if len(seen) == stop:
                raise RuntimeError("killed")
            return batch.withColumn("y", F.col("x") * 2)

        return own

    with pytest.raises(Exception, match="killed"):
        run_available(todo(), work(3), F.col("x") < 0, *where)
    assert spark.read.parquet(where[0]).count() == 4
    run_available(todo(), work(None), F.col("x") < 0, *where)
    assert len(seen) == 6  # five batches, one of them twice
    got = sorted((r.utt_id, r.y, r.failed) for r in spark.read.parquet(where[0]).collect())
    assert got == sorted((f"u{k}{j}", 2 * k, "mine") for k in range(5) for j in (1, 2))
    assert sorted(r.value for r in spark.read.text(where[1]).collect()) == [f"u{k}0" for k in range(5)]
    run_available(todo(), work(None), F.col("x") < 0, *where)  # nothing is left
    assert len(seen) == 6
    spark.createDataFrame([("late", 1, None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run_available(todo(), work(None), F.col("x") < 0, *where)
    assert spark.read.parquet(where[0]).count() == 11
