"""Run state as a stream (S10 + S11 with Structured Streaming).

The run-event log is append-only Parquet; new files are picked up by a
file stream and folded into the latest state per run id with the same
aggregates as the batch ``run_latest_state`` (all of them combine
incrementally, so the state store holds one row per id). Each micro-batch
writes the ids it changed into a folder of its own, so a reader never sees a
half-replaced state; ``read_run_state`` takes the newest row of every id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import run_latest_state
from ..sources.sinks import RUN_EVENT_SCHEMA


def run_state_stream(spark: SparkSession, events_dir: str, state_dir: str,
                     checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    events = (spark.readStream.schema(RUN_EVENT_SCHEMA)
              .option("maxFilesPerTrigger", 64).parquet(events_dir))

    def publish(batch: DataFrame, epoch: int) -> None:
        # the same batch again after a failure replaces its own folder only
        batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{state_dir}/part-{epoch:012d}")

    writer = (run_latest_state(events).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint_dir).foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_run_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The latest state of every run id that has been published."""
    rows = spark.read.parquet(f"{state_dir}/part-*")
    names = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max(F.struct("batch", *names)).alias("s")).select("id", *[f"s.{c}" for c in names])
