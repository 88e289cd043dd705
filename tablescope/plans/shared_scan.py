"""The tasks of a plan in a number of passes that does not depend on their number.

Every grouping task (histogram, value counts, totals, cross counts, time
series, hours) is a selection of rows, a key and a number. One pass turns each
row into a (task, key, number) for each task that selects it and aggregates them
all together; the sums are written to the shared folder, a folder a task, and
each task's result is read from its own. Bounds that no profile knows come from
one call for all columns, outliers of all columns from two passes, correlations
of all columns from one Gram matrix, scatter samples of all pairs from one."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import epoch_seconds, group_key, groupable, qcol, safe_aliases, safe_div, strict_double
from ..functions.quantiles import multi_column_quantiles
from ..operators import analyses as A
from ..operators import correlation as C
from ..operators.sampling import TWO53
from ..sources.files import scratch_path


@dataclass
class Grouping:
    """Rows, keys (as text, with the types they return to) and the number that is summed up."""

    rows: Column
    keys: list[Column]
    kinds: list[str]
    number: Column | None = None


@dataclass
class Wanted:
    """What the tasks of one plan ask for, by task number: a column, or several."""

    histograms: dict[int, str] = field(default_factory=dict)
    counts: dict[int, str] = field(default_factory=dict)
    totals: dict[int, tuple[str, str]] = field(default_factory=dict)
    crossed: dict[int, tuple[str, str]] = field(default_factory=dict)
    series: dict[int, tuple[str, str, str]] = field(default_factory=dict)      # date, number, grain
    hours: dict[int, tuple[str, str]] = field(default_factory=dict)
    matrices: dict[int, list[str]] = field(default_factory=dict)
    scatters: dict[int, tuple[str, str]] = field(default_factory=dict)
    outliers: dict[int, str] = field(default_factory=dict)


def _text_key(df: DataFrame, name: str) -> tuple[Column, str]:
    """A column as text that casts back to the same value, and its type."""
    c, kind = group_key(df, name), df.schema[name].dataType
    if not groupable(kind):
        return c, "string"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)                 # one zero, as grouping has it
    if isinstance(kind, T.BinaryType):
        return F.hex(c), "binary"
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(c.alias("v"))), f"json {kind.simpleString()}"
    return c.cast("string"), kind.simpleString()


def _back(c: Column, kind: str) -> Column:
    if kind == "binary":
        return F.unhex(c)
    if kind.startswith("json "):
        return F.from_json(c, f"v {kind[5:]}")["v"]
    return c.cast(kind)


def _bounds(df: DataFrame, wanted: Wanted, known: dict[str, tuple]) -> dict[str, tuple]:
    """The 1 % and 99 % bounds of all columns that tasks clip by; one call for those not known."""
    need = {c: strict_double(c) for c in wanted.histograms.values()}
    need |= {d: F.when(qcol(d).isNotNull(), epoch_seconds(A.as_timestamp(df, d))) for d, _, _ in wanted.series.values()}
    missing = {c: v for c, v in need.items() if c not in known}
    found = multi_column_quantiles(df, missing, [A.CLIP_LOW, A.CLIP_HIGH]) if missing else {}
    return {c: known.get(c) or tuple(found[c]) for c in need}


def _groupings(df: DataFrame, wanted: Wanted, bounds: dict[str, tuple]) -> dict[int, Grouping]:
    out: dict[int, Grouping] = {}
    some = lambda c: qcol(c).isNotNull()
    for i, c in wanted.histograms.items():
        lo, hi = bounds[c]
        if lo is not None:
            v = strict_double(c)
            bucket = F.floor(safe_div(v - F.lit(lo), F.lit(hi) - F.lit(lo)) * F.lit(A.HISTOGRAM_BINS))
            out[i] = Grouping(A.clipped(df, c, lo, hi) & bucket.isNotNull(), [bucket.cast("string")], ["bigint"], v)
    for i, c in wanted.counts.items():
        key, kind = _text_key(df, c)
        out[i] = Grouping(some(c), [key], [kind])
    for i, (c, number) in wanted.totals.items():
        key, kind = _text_key(df, c)
        out[i] = Grouping(some(c) & some(number), [key], [kind], strict_double(number))
    for i, (a, b) in wanted.crossed.items():
        (ka, ta), (kb, tb) = _text_key(df, a), _text_key(df, b)
        out[i] = Grouping(some(a) & some(b), [ka, kb], [ta, tb])
    for i, (d, number, grain) in wanted.series.items():
        lo, hi = bounds[d]
        if lo is not None:
            period = F.date_trunc(grain, A.as_timestamp(df, d)).cast("timestamp_ntz").cast("string")
            out[i] = Grouping(some(d) & some(number) & A.within(df, d, lo, hi), [period], ["timestamp_ntz"], strict_double(number))
    for i, (d, number) in wanted.hours.items():
        out[i] = Grouping(some(d), [F.hour(A.as_timestamp(df, d)).cast("string")], ["int"], strict_double(number))
    return out


def _summed(df: DataFrame, groupings: dict[int, Grouping]) -> DataFrame:
    """task, k1, k2, n, total, mean, least, most of all groupings, in one pass."""
    empty = F.lit(None).cast("string")
    each = [F.when(g.rows, F.struct(F.lit(i).alias("task"), g.keys[0].alias("k1"), (g.keys[1] if len(g.keys) > 1 else empty).alias("k2"),
                                    (F.lit(None).cast("double") if g.number is None else g.number).alias("v"))) for i, g in groupings.items()]
    rows = df.select(F.inline(F.array(*each))).where(F.col("task").isNotNull())
    v = F.col("v")
    return rows.groupBy("task", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"),
                                                F.min(v).alias("least"), F.max(v).alias("most"))


def _shaped(wanted: Wanted, i: int, sums: DataFrame, g: Grouping) -> DataFrame:
    """A task's sums as its template's result."""
    k = [_back(F.col(f"k{j}"), kind) for j, kind in enumerate(g.kinds, 1)]
    n = F.col("n").alias("count")
    if i in wanted.histograms:
        return sums.orderBy(k[0]).select(F.round("least", 4).alias("bin_start"), F.round("most", 4).alias("bin_end"), n)
    if i in wanted.counts:
        return sums.select(k[0].alias("category"), n).orderBy(F.col("count").desc(), "category")
    if i in wanted.totals:
        return (sums.select(k[0].alias("category"), n, F.round("mean", 4).alias("avg_value"), F.round("total", 4).alias("total_value"))
                .orderBy(F.col("total_value").desc(), "category"))
    if i in wanted.crossed:
        label = F.concat_ws(" / ", *[x.cast("string") for x in k])
        return sums.select(label.alias("category"), n).orderBy(F.col("count").desc(), "category")
    name = "period" if i in wanted.series else "hour_of_day"
    total, mean = F.col("total").alias("total_value"), F.col("mean").alias("avg_value")
    return sums.select(k[0].alias(name), *([total, mean, n] if i in wanted.series else [n, total, mean])).orderBy(name)


def _scatters(df: DataFrame, pairs: dict[int, tuple[str, str]], rows: int, seed: int = 42) -> dict[int, DataFrame]:
    """A random sample of ``rows`` clipped points of each pair (all, if there are
    no more): the bounds of all pairs in one call, their numbers in one pass,
    and one pass that takes the rows of small hashes, of which the smallest stay."""
    both = {i: qcol(x).isNotNull() & qcol(y).isNotNull() for i, (x, y) in pairs.items()}
    axes = {(i, j): F.when(both[i], strict_double(c)) for i, p in pairs.items() for j, c in enumerate(p)}
    bounds = multi_column_quantiles(df, axes, [A.CLIP_LOW, A.CLIP_HIGH])
    inside = {i: axes[i, 0].between(*map(F.lit, bounds[i, 0])) & axes[i, 1].between(*map(F.lit, bounds[i, 1]))
              for i in pairs if bounds[i, 0][0] is not None}
    totals = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in inside.items()]).first() if inside else {}
    rate = {i: min(1.0, (rows + 8 * math.sqrt(rows) + 64) / max(1, totals[f"n{i}"])) for i in inside}
    out = {}
    point = lambda i: F.struct(F.lit(i).alias("task"), axes[i, 0].alias("x"), axes[i, 1].alias("y"), F.col("_h").alias("h"))
    hashed = df.withColumn("_h", F.xxhash64(F.rand(seed), F.lit(seed)))
    u = F.pmod(F.col("_h"), F.lit(2 ** 53)).cast("double") / F.lit(TWO53)
    points = None
    while inside:
        some = F.array(*[F.when(c & (u < F.lit(rate[i])), point(i)) for i, c in inside.items()])
        path = scratch_path(df.sparkSession, "points")
        hashed.select(F.inline(some)).where(F.col("task").isNotNull()).write.partitionBy("task").parquet(path)
        points = df.sparkSession.read.schema("x double, y double, h long, task int").parquet(path)
        drawn = {r["task"]: r["count"] for r in points.groupBy("task").count().collect()}
        short = [i for i in inside if rate[i] < 1 and drawn.get(i, 0) < rows]
        if not short:                        # else too few by chance, about once in 1e15
            break
        rate |= {i: min(1.0, 2 * rate[i]) for i in short}
    for i, p in pairs.items():
        x, y = safe_aliases(list(p))
        if i in inside:
            mine = points.where(F.col("task") == i)
            mine = mine.orderBy("h").limit(rows) if totals[f"n{i}"] > rows else mine
        else:
            mine = df.sparkSession.createDataFrame([], "x double, y double")
        out[i] = mine.select(F.col("x").alias(x), F.col("y").alias(y))
    return out


def _matrices(df: DataFrame, wanted: dict[int, list[str]], means: dict[str, float]) -> dict[int, DataFrame]:
    every = list(dict.fromkeys(c for cols in wanted.values() for c in cols))
    pairs = C.correlation_matrix(df, every, means=means)
    return {i: pairs.where(F.col("col_a").isin(cols) & F.col("col_b").isin(cols)) for i, cols in wanted.items()}


def run_together(df: DataFrame, raw: DataFrame, wanted: Wanted, key: str | None, bounds: dict[str, tuple],
                 moments: dict[str, tuple], scatter_rows: int) -> dict[int, DataFrame]:
    """The results by task number. ``bounds``, ``moments``: what is known of columns already."""
    spark, out = df.sparkSession, {}
    groupings = _groupings(df, wanted, _bounds(df, wanted, bounds))
    if groupings:
        path = scratch_path(spark, "sums")
        sums = _summed(df, groupings)
        sums.write.partitionBy("task").parquet(path)
        kept = spark.read.schema(sums.schema).parquet(path)
        out |= {i: _shaped(wanted, i, kept.where(F.col("task") == i), g) for i, g in groupings.items()}
    if wanted.matrices:
        out |= _matrices(df, wanted.matrices, {c: m for c, (m, _) in moments.items()})
    if wanted.scatters:
        out |= _scatters(raw, wanted.scatters, scatter_rows)
    if wanted.outliers:
        cols = list(dict.fromkeys(wanted.outliers.values()))
        known = {c: m for c, m in moments.items() if c in cols and None not in m and all(map(math.isfinite, m))}
        found = A.many_outliers(df, known | A.many_moments(df, [c for c in cols if c not in known]), key)
        out |= {i: found[c] for i, c in wanted.outliers.items()}
    # a clip without any value, a column of one value: no rows
    for i, c in {**wanted.histograms, **wanted.series}.items():
        if i not in out:
            out[i] = A.histogram(df, c, bounds=(None, None)) if i in wanted.histograms else A.time_series(df, *c, bounds=(None, None))
    return out
