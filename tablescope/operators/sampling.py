"""Scaling strategy and exact-size reproducible samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..session import materialize

# Fixed values of the scaling rule (rows).
FULL_SCAN_MAX_ROWS = 500_000
SAMPLE_BAND_MAX_ROWS = 5_000_000
SAMPLE_ROWS = 100_000

TWO53 = float(2 ** 53)


def strategy_expr(row_count: Column, full_max: int = FULL_SCAN_MAX_ROWS,
                  sample_max: int = SAMPLE_BAND_MAX_ROWS) -> Column:
    return (F.when(row_count <= F.lit(full_max), F.lit("full"))
             .when(row_count <= F.lit(sample_max), F.lit("sample"))
             .otherwise(F.lit("aggregate")))


def scaling_strategy(counts: DataFrame, full_max: int = FULL_SCAN_MAX_ROWS,
                     sample_max: int = SAMPLE_BAND_MAX_ROWS,
                     sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """R1 over a table of (dataset, row_count): one strategy per dataset.

    A label table only: what a size would be labelled, and the sample that
    label names. No operator switches by it; see ``analysis_frames``."""
    strat = strategy_expr(F.col("row_count"), full_max, sample_max)
    return counts.select(
        "dataset", "row_count", strat.alias("strategy"),
        F.when(strat == "full", F.lit(None).cast("bigint"))
         .otherwise(F.lit(sample_rows).cast("bigint")).alias("sample_size"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, row_count) for many tables in one Spark job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("dataset"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _row_hash(df: DataFrame, key: Sequence[str] | None, seed: int) -> Column:
    if key:
        return F.xxhash64(*[qcol(k) for k in key], F.lit(seed))
    # No key: the row content plus a seeded per-row draw, so that copies of
    # one row are drawn independently (a block of copies is never all-or-none).
    return F.xxhash64(*[qcol(c) for c in df.columns], F.lit(seed), F.rand(seed))


def sample_exact(df: DataFrame, n: int, seed: int = 42,
                 key: Sequence[str] | None = None,
                 total: int | None = None) -> DataFrame:
    """R2/H3: uniform sample of exactly ``min(n, rows)`` rows, no replacement.

    Every row gets a seeded 64-bit hash; a Bernoulli pre-filter on that hash
    keeps about ``n`` plus a safety margin of rows, which are checkpointed
    and counted (raising the rate if short), and the ``n`` smallest hashes
    win: the n-th smallest is found by counting, 16 bits of it at a time, and
    the rows up to it are filtered, so nothing is sorted. With ``key`` the result
    does not depend on partitioning (of rows with one key any may stay)."""
    total = df.count() if total is None else total
    if total <= n:
        return df
    h = _row_hash(df, key, seed)
    rate = min(1.0, (n + 8.0 * math.sqrt(n) + 64.0) / total)
    with_h = df.select("*", h.alias("_h"))
    u = F.pmod(F.col("_h"), F.lit(2 ** 53)).cast("double") / F.lit(TWO53)
    while True:
        cand = materialize(with_h.where(u < F.lit(rate)))
        if rate >= 1.0 or cand.count() >= n:
            break
        rate = min(1.0, rate * 2.0)
    cut, left = _nth_smallest(cand, "_h", n)
    last = cand.where(F.col("_h") == F.lit(cut)).limit(left)              # of rows with that hash as many as there is room for
    return cand.where(F.col("_h") < F.lit(cut)).unionByName(last).drop("_h")


def _nth_smallest(df: DataFrame, name: str, n: int) -> tuple[int, int]:
    """The n-th smallest of a column of 64-bit numbers (df has as many rows), and
    how many rows with that very number are among the n smallest."""
    rows, left, prefix = df.select(name), n, None
    for shift in (48, 32, 16, 0):                                        # at most 65,536 counts a round
        at = F.shiftright(name, shift)
        here = rows if prefix is None else rows.where(F.shiftright(name, shift + 16) == F.lit(prefix))
        for value, count in sorted((r[0], r[1]) for r in here.groupBy(at).count().collect()):
            if left <= count:
                break
            left -= count
        prefix = value
    return prefix, left


def analysis_frames(df: DataFrame, sample_rows: int | None = None, key: Sequence[str] | None = None,
                    seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The frames for aggregates and for raw rows. Aggregates read every
    row at every size; raw-row outputs do too, unless the caller asks for a
    sample of ``sample_rows`` (drawn once, reproducible)."""
    if sample_rows is None:
        return df, df
    return df, sample_exact(df, sample_rows, seed=seed, key=key, total=total)
