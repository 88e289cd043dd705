"""Run history (S11, T3) and conversation windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol

RECENT_RUNS = 20
CONTEXT_TURNS = 6
KEPT_TURNS = 20
SALT_BUCKETS = 32


def run_latest_state(events: DataFrame) -> DataFrame:
    """Latest state per run id from the append-only log: first
    filename and creation time, status of the newest event, newest
    non-null report and error, last update time. Of events with one time,
    the greater value counts as newer (the smaller filename as older). All
    aggregates combine map-side, so a run with very many events is no hot spot."""
    def newest(name):
        return F.max(F.when(F.col(name).isNotNull(), F.struct("ts", name)))[name].alias(name)
    return events.groupBy("id").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("filename").isNotNull(), F.struct("ts", "filename")))["filename"].alias("filename"),
        F.max(F.struct("ts", "status"))["status"].alias("status"),
        newest("report_json"), newest("error_msg"), F.max("ts").alias("updated_at"))


def recent_runs(state: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """Newest ``n`` runs by update time, without the report blob."""
    return (state.orderBy(F.col("updated_at").desc(), F.col("id").asc()).limit(n)
                 .select("id", "created_at", "filename", "status", "error_msg", "updated_at"))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    n: int, salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """The first ``n`` rows of every group in ``order``. A first window
    ranks inside (group, salt) slices, so a group holding a large share of
    all rows is spread over ``salt_buckets`` tasks; the second ranks at most
    ``n * salt_buckets`` survivors per group."""
    # a per-row id spreads even a block of identical rows over the salt
    # buckets; the result does not depend on which bucket a row lands in
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salt_buckets))
    g = [qcol(c) for c in group]
    w1 = Window.partitionBy(*g, F.col("_salt")).orderBy(*order)
    w2 = Window.partitionBy(*g).orderBy(*order)
    first = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
               .where(F.col("_r1") <= n).drop("_r1", "_salt"))
    return first.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= n)


def last_turns(conversations: DataFrame, n: int = CONTEXT_TURNS) -> DataFrame:
    """The last ``n`` messages of every conversation (6 as model
    context, 20 kept as history), oldest first. Messages of one turn are
    ordered by role, then text."""
    top = top_n_per_group(conversations, ["conv_id"], [F.col("turn").desc(), F.col("role"), F.col("text")], n)
    return top.select("conv_id", "turn", "role", "text",
                      (F.lit(n) + F.lit(1) - F.col("_rank")).alias("position"))
