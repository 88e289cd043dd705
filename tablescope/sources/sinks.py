"""Sinks: the append-only run-event log (S10) and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parallel_map

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("report_json", T.StringType()),
    T.StructField("error_msg", T.StringType()),
])


def append_run_events(events: DataFrame, path: str) -> None:
    """Start / complete / error rows are appended, never updated; the
    latest state is an aggregate over the log (``history.run_latest_state``)."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_EVENT_SCHEMA.fields]
    events.select(*cols).write.mode("append").parquet(path)


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_EVENT_SCHEMA).parquet(path)


def write_report_sections(sections: dict[str, DataFrame], path: str) -> DataFrame:
    """One JSON folder per report section; returns an index of what
    was written (section, rows). Rows are counted while they are written."""
    spark = next(iter(sections.values())).sparkSession

    def one(item):
        name, df = item
        seen = Observation(f"section-{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
        return name, seen.get["n"]

    return spark.createDataFrame(parallel_map(one, list(sections.items())), "section string, rows bigint")
