"""Micro-batches that continue from the state the batch before left.

Event-time windows use Spark's own state store (``tickloom.streaming.windows``).
The operators here depend on the exact order of events, so each micro-batch runs
the batch operator, sliced over tasks like any table, from a small state table.
State and output are written per batch id and overwritten when a batch is
retried, hence each event counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tickloom.plans.materialize import remove_table, temporary_tables

Step = Callable[[DataFrame, dict[str, DataFrame] | None], tuple[DataFrame, dict[str, DataFrame]]]


def carried(stream: DataFrame, step: Step, path: str) -> DataStreamWriter:
    """Writer that runs ``step(batch, state) -> (output, next state)`` per micro-batch.

    Output goes to ``path/out/batch_id=n``, state to ``path/state/<name>/batch_id=n``,
    progress to ``path/checkpoint``.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            names = spark.read.text(f"{path}/state/names/batch_id={batch_id - 1}").collect()
            before = {
                r.value: spark.read.parquet(f"{path}/state/{r.value}/batch_id={batch_id - 1}") for r in names
            }
        batch = batch.persist()
        try:
            # what the step stores on the way has no reader once output and state are written
            with temporary_tables():
                out, after = step(batch, before)
                out.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")
                for name, table in after.items():
                    table.write.mode("overwrite").parquet(f"{path}/state/{name}/batch_id={batch_id}")
            spark.createDataFrame([(n,) for n in after], "value string").coalesce(1).write.mode("overwrite").text(
                f"{path}/state/names/batch_id={batch_id}"
            )
        finally:
            batch.unpersist()
        # a retry of this batch reads the state before it; what is older has no reader left
        for name in [*after, "names"]:
            remove_table(spark, f"{path}/state/{name}/batch_id={batch_id - 2}")

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")


def output(spark, path: str) -> DataFrame:
    """What a carried stream has written so far."""
    return spark.read.parquet(f"{path}/out").drop("batch_id")


def updates(stream: DataFrame, path: str) -> DataStreamWriter:
    """Writer of an update-mode aggregate; ``latest`` gives the current value per key."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(on_batch).option(
        "checkpointLocation", f"{path}/checkpoint"
    )


def latest(spark, path: str, key: list[str]) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{path}/out")
    values = [c for c in rows.columns if c not in (*key, "batch_id")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*key, "_v.*")
