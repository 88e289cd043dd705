"""A16 correlation matrix and C7 heatmap shaping.

All pairs come from one pass: each task adds up, over Arrow batches, the
products of its columns' values (a Gram matrix) and, for rows where the other
column is null, what a pair leaves out, as matrix products of values, squares
and null masks. The tasks' sums, a row a pair, are added by Spark. Values are
taken relative to a value of their column near its mean (a pass before, unless
the means are known), so that large offsets cost no digits. A coefficient is
undefined, and left out, where a side is constant over the pair's rows, where
there are none, or where one of them is NaN or infinite."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need not have the package

#: Columns of a block of the matrix; rows of a product; the share of a variance that is rounding.
BLOCK, ROWS, ROUNDING = 128, 1 << 14, 1e-13

PAIR_SCHEMA = T.StructType([T.StructField("col_a", T.StringType()),
                            T.StructField("col_b", T.StringType()),
                            T.StructField("correlation", T.DoubleType())])


_SUMS = ("n", "a", "b", "aa", "bb", "ab", "odd")


def pair_sums(df: DataFrame, columns: Sequence[str], shifts: Sequence[float]) -> DataFrame:
    """Of every pair i <= j of columns, over the rows where both have a value:
    their number, sums, squares and products of the values less their column's
    shift; ``odd``: how many of the rows hold a NaN or infinity."""
    k, less = len(columns), np.array(shifts, float)
    blocks = [(i, j) for i in range(0, k, BLOCK) for j in range(i, k, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                raw = np.column_stack([c.to_numpy(zero_copy_only=False) for c in some.columns])
                have = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in some.columns])
                odd = have & ~np.isfinite(raw)
                x = np.where(have & ~odd, raw - less, 0.0)
                full, strange, have, odd = have.all(), odd.any(), have.astype(float), odd.astype(float)
                for i, j in blocks:
                    a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                    xa, xb, ma, mb = x[:, a], x[:, b], have[:, a], have[:, b]
                    if full:                                     # nothing is left out: the columns' own sums serve
                        one = np.ones((len(x), 1))
                        wide = np.ones((1, xb.shape[1]))
                        tall = np.ones((xa.shape[1], 1))
                        parts = [len(x) * tall @ wide, (xa.T @ one) @ wide, tall @ (one.T @ xb),
                                 ((xa ** 2).T @ one) @ wide, tall @ (one.T @ xb ** 2), xa.T @ xb]
                    else:
                        parts = [ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa ** 2).T @ mb, ma.T @ xb ** 2, xa.T @ xb]
                    parts.append(odd[:, a].T @ mb + ma.T @ odd[:, b] if strange else np.zeros_like(parts[0]))
                    sums[i, j] = sums[i, j] + np.array(parts) if (i, j) in sums else np.array(parts)
        for (i, j), parts in sums.items():
            p, q = np.meshgrid(np.arange(i, i + parts.shape[1]), np.arange(j, j + parts.shape[2]), indexing="ij")
            upper = p <= q
            yield pa.record_batch({"i": pa.array(p[upper], pa.int32()), "j": pa.array(q[upper], pa.int32()),
                                   **{name: pa.array(part[upper]) for name, part in zip(_SUMS, parts)}})

    rows = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    return rows.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def correlation_matrix(df: DataFrame, columns: Sequence[str], max_columns: int | None = None,
                       means: dict[str, float] | None = None) -> DataFrame:
    """Long matrix (col_a, col_b, correlation): every pair with a defined
    coefficient, mirrored; the diagonal once. All columns, or the first
    ``max_columns``. ``means``: the columns' means, where they are known."""
    cols = [c for c in columns if c][:max_columns]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    means = dict(means or {})
    if unknown := [c for c in dict.fromkeys(cols) if not np.isfinite(means.get(c) if means.get(c) is not None else np.nan)]:
        v = [qcol(c).cast("double") for c in unknown]
        means |= zip(unknown, df.agg(*[F.avg(F.when(F.abs(x) < F.lit(float("inf")), x)) for x in v]).first())
    sums = pair_sums(df, cols, [means[c] or 0.0 for c in cols]).where((F.col("n") > 0) & (F.col("odd") == 0))
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    varied = (va > F.col("aa") * ROUNDING) & (vb > F.col("bb") * ROUNDING)
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.sqrt(va) * F.sqrt(vb))
    found = sums.where(varied).select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    rows = found.orderBy("i", "j").collect()                   # a number for each pair of columns
    out = [row for x in rows for row in ([(cols[x["i"]], cols[x["j"]], x["r"])] + [(cols[x["j"]], cols[x["i"]], x["r"])] * (x["i"] != x["j"]))]
    return df.sparkSession.createDataFrame(out, PAIR_SCHEMA)


def heatmap_matrix(pairs: DataFrame) -> DataFrame:
    """Long -> wide with sorted labels; missing cells stay NULL. The
    labels are the names of a table's columns."""
    labels = sorted({r["col_b"] for r in pairs.select("col_b").distinct().collect()})
    if not labels:
        return pairs.select("col_a").where(F.lit(False))
    wide = pairs.groupBy("col_a").pivot("col_b", labels).agg(F.first("correlation"))
    return wide.orderBy("col_a")
