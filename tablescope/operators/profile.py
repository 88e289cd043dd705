"""Column profiling (A1-A7) and semantic typing.

A profile is a DataFrame with one row per column (schema ``PROFILE_SCHEMA``),
built in a number of passes that does not depend on the number of columns
(per batch of ``BATCH`` columns):

* one aggregate for row count, per-column non-null counts, numeric moments
  and a quantile sketch per numeric column; ``approx=True`` adds HyperLogLog
  distinct counts here instead of the next pass;
* one pass for the exact distinct counts: every value becomes its column's
  number and a 128-bit hash, so no value, however long, is shuffled;
* one pass for the samples: each task's smallest values of every column,
  merged over the tasks;
* two passes for the exact medians of all numeric columns together.

Only per-column scalars reach the driver (bounded by the column count).
Everything downstream (categories, tags, plans, insights) is a DataFrame
transformation of profile tables, so a whole catalog profiles at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, epoch_seconds, groupable, qcol, try_timestamp
from ..functions.quantiles import multi_column_quantiles, sketch_aggs, sketch_edges
from ..session import materialize, parallel_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need not have the package

BATCH = 64

# Fixed values of the typing rules.
TEXT_UNIQUE_RATIO = 0.8
TEXT_UNIQUE_MIN = 100
NO_GROUP_UNIQUE = 500
BINARY_MAX = 2
LOW_CARD_MAX = 20
GROUPABLE_MAX = 50
GROUPABLE_FALLBACK = 3
HIGH_MISSING_PCT = 30
SAMPLE_VALUES = 5
SAMPLE_CHARS = 200           # of a sample value that are shown
FACT_PROBS = [0.01, 0.5, 0.99]

PROFILE_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("base_category", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("missing_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
    T.StructField("min_val", T.DoubleType()),
    T.StructField("max_val", T.DoubleType()),
    T.StructField("mean_val", T.DoubleType()),
    T.StructField("median_val", T.DoubleType()),
    T.StructField("std_val", T.DoubleType()),
])


def base_category(dt: T.DataType) -> str:
    """Type map of Y1 (before the cardinality rule)."""
    if isinstance(dt, T.NumericType):
        return "numeric"
    if type(dt).__name__ in ("DateType", "TimestampType", "TimestampNTZType", "TimeType",
                             "DayTimeIntervalType", "YearMonthIntervalType",
                             "CalendarIntervalType"):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.BinaryType) or type(dt).__name__ == "VariantType":
        return "text"
    return "categorical"


def category_expr(base: Column, unique: Column, rows: Column) -> Column:
    """A categorical column whose unique/rows ratio exceeds 0.8 with more
    than 100 distinct values is free text."""
    ratio = unique.cast("double") / F.greatest(rows, F.lit(1)).cast("double")
    return F.when((base == "categorical") & (ratio > F.lit(TEXT_UNIQUE_RATIO)) &
                  (unique > F.lit(TEXT_UNIQUE_MIN)), F.lit("text")).otherwise(base)


def missing_pct_expr(missing: Column, rows: Column) -> Column:
    """A2: round(missing / max(rows, 1) * 100, 2)."""
    return F.round(missing.cast("double") / F.greatest(rows, F.lit(1)).cast("double")
                   * F.lit(100.0), 2)


def _batches(items: list, size: int = BATCH):
    for i in range(0, len(items), size):
        yield items[i:i + size]


def ranked_value(f: T.StructField) -> Column | None:
    """What quantiles of a column rank: its number, or its epoch seconds."""
    if base_category(f.dataType) == "numeric":
        return qcol(f.name).cast("double")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_seconds(try_timestamp(qcol(f.name), f.dataType))
    return None


def _moments(df: DataFrame, fields: list[T.StructField], approx: bool,
             probs: list[float], ranked: dict[int, Column]) -> dict:
    """A1 + A5 moments + optional approximate distincts, one aggregate per
    batch of columns. The same scan builds the quantile sketch of every
    column in ``ranked`` (pass 1 of the quantiles)."""
    def one(batch):
        aggs, sketches = [F.count(F.lit(1)).alias("_rows")], []
        for i, f in batch:
            c = qcol(f.name)
            aggs.append(F.count(c).alias(f"n{i}"))
            if approx:
                aggs.append(F.approx_count_distinct(as_text(c, f.dataType)).alias(f"u{i}"))
            if base_category(f.dataType) == "numeric":
                v = c.cast("double")
                # decimal sums can overflow at scale (an error under ANSI):
                # exact average where it fits, the double average otherwise
                mean = F.coalesce(F.try_avg(c).cast("double"), F.avg(v)) \
                    if isinstance(f.dataType, T.DecimalType) else F.avg(c).cast("double")
                aggs += [F.min(c).cast("double").alias(f"mn{i}"),
                         F.max(c).cast("double").alias(f"mx{i}"),
                         mean.alias(f"av{i}"),
                         F.stddev_samp(v).alias(f"sd{i}")]
            if i in ranked:
                aggs += sketch_aggs(ranked[i], f"num{i}", f"nan{i}", f"kll{i}")
                sketches.append(i)
        wide = df.agg(*aggs)
        return wide.select(*[c for c in wide.columns if not c.startswith("kll")],
                           *[sketch_edges(F.col(f"kll{i}"), F.col(f"num{i}"), probs, f"q{i}")
                             for i in sketches]).first().asDict()

    out: dict = {"_rows": None}
    for row in parallel_map(one, list(_batches(list(enumerate(fields))))):
        out.update(row)
    return out


def _distinct_key(f: T.StructField) -> tuple[Column, T.DataType]:
    """The value itself, or its JSON text where the type cannot be grouped."""
    c = qcol(f.name)
    if groupable(f.dataType):
        return c, f.dataType
    return F.to_json(c), T.StringType()


def _hashable(f: T.StructField) -> Column:
    """Equal values with equal bits: one zero, one NaN."""
    key, kind = _distinct_key(f)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = key.cast("double") + F.lit(0.0)
        return F.when(F.isnan(v), F.lit(float("nan"))).otherwise(v)
    return key


def distinct_counts_long(df: DataFrame, fields: list[T.StructField],
                         indices: list[int] | None = None) -> DataFrame:
    """A3: distinct non-null values per column index as (ci, unique_count).

    One pass for all columns: each value is its column's index and 128 bits
    of hash, de-duplicated map-side first, so that a hot value collapses and
    a long text costs no more than a number. ``indices``: the columns'
    numbers when a batch of them is given."""
    packed = F.array(*[F.when(qcol(f.name).isNotNull(), F.struct(
        F.lit(i).alias("ci"), F.xxhash64(F.lit(1), _hashable(f)).alias("h1"), F.xxhash64(F.lit(2), _hashable(f)).alias("h2")))
        for i, f in zip(indices or range(len(fields)), fields)])
    values = df.select(F.inline(packed)).where(F.col("ci").isNotNull())
    return values.distinct().groupBy("ci").agg(F.count(F.lit(1)).alias("unique_count"))


def _least(df: DataFrame, keys: dict[int, tuple[Column, T.DataType]], k: int) -> dict[int, list[str]]:
    """The k smallest distinct values of each key, as text: the j-th aggregate
    asks every column for its smallest value beyond the (j-1)-th. For small tables."""
    found, beyond, live = {i: [] for i in keys}, {}, list(keys)
    for _ in range(k):
        rows: dict = {}
        for batch in _batches(live):
            aggs = []
            for i in batch:
                key, kind = keys[i]
                least = F.min(F.when(key > F.lit(beyond[i]).cast(kind), key) if i in beyond else key)
                aggs += [least.alias(f"v{i}"), F.substring(as_text(least, kind), 1, SAMPLE_CHARS).alias(f"t{i}")]
            rows.update(df.agg(*aggs).first().asDict())
        live = [i for i in live if rows[f"t{i}"] is not None]
        for i in live:
            found[i].append(rows[f"t{i}"])
            beyond[i] = rows[f"v{i}"]
        if not live:
            break
    return found


def smallest_values(df: DataFrame, fields: list[T.StructField], k: int = SAMPLE_VALUES) -> dict[int, list[str]]:
    """A4: the k smallest distinct non-null values of every column, compared
    whole, of which ``SAMPLE_CHARS`` characters are shown. NaN is the largest.

    One pass: each task keeps a sorted set of k values a column and merges its
    batches into it; the tasks' sets, k rows each, are merged in the same way."""
    keys = {}
    for i, f in enumerate(fields):
        key, kind = _distinct_key(f)
        if isinstance(kind, (T.ArrayType, T.StructType)):
            key, kind = F.to_json(key), T.StringType()
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            key = F.when(key == 0, F.lit(0.0).cast(kind)).otherwise(key)          # one zero
        if isinstance(kind, T.StringType):
            kind = T.StringType()
        keys[i] = (key, kind)
    width = len(keys)
    if not width:
        return {}

    def least(column: pa.Array, kept: pa.Array | None) -> pa.Array:
        column = column.drop_null()
        if kept is not None and len(kept) == k:
            column = column.filter(pc.less(column, kept[-1]))                       # hardly any, after some batches
        if not len(column) and kept is not None:
            return kept
        column = pc.unique(column if kept is None else pa.concat_arrays([kept, column]))
        return column.take(pc.array_sort_indices(column))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array | None] = [None] * width
        names: list[str] = []
        for batch in batches:
            names = batch.schema.names
            kept = [least(column, old) for column, old in zip(batch.columns, kept)]
        if names:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.nulls(k - len(x), x.type)]) for x in kept], names)

    wide = df.select(*[key.cast(kind).alias(f"c{i}") for i, (key, kind) in keys.items()])
    sets = materialize(wide.mapInArrow(run, wide.schema))
    return _least(sets, {i: (F.col(f"c{i}"), kind) for i, (_, kind) in keys.items()}, k)


def profile(df: DataFrame, dataset: str = "dataset", approx: bool = False,
            samples: bool = True, medians: bool = True) -> DataFrame:
    """The full profile of ``df`` (profiled rows = rows of ``df``).
    ``samples``/``medians`` off skip those passes when only categories and
    counts are needed (planning)."""
    return profile_with_facts(df, dataset, approx, samples, [0.5] if medians else [])[0]


def profile_with_facts(df: DataFrame, dataset: str = "dataset", approx: bool = False, samples: bool = True,
                       probs: list[float] = FACT_PROBS, distincts: bool = True) -> tuple[DataFrame, dict[str, dict]]:
    """The profile (``distincts`` off leaves unique_count 0), and the unrounded statistics that later tasks reuse: per
    numeric column mean, stddev and its quantiles at ``probs``; per date or
    time column the quantiles of its epoch seconds."""
    spark = df.sparkSession
    fields = list(df.schema.fields)
    if not fields:
        return spark.createDataFrame([], PROFILE_SCHEMA).withColumn("category", F.col("base_category")), {}
    numeric = {i for i, f in enumerate(fields) if base_category(f.dataType) == "numeric"}
    ranked = {i: ranked_value(f) for i, f in enumerate(fields) if probs and ranked_value(f) is not None
              and (i in numeric or len(probs) > 1)}
    jobs = [lambda: _moments(df, fields, approx, probs, ranked)]
    if distincts and not approx:
        for batch in _batches(list(enumerate(fields))):
            jobs.append(lambda b=batch: distinct_counts_long(
                df, [f for _, f in b], [i for i, _ in b]).collect())
    if samples:
        jobs.append(lambda: smallest_values(df, fields))
    done = parallel_map(lambda job: job(), jobs)      # independent: submitted side by side
    m = done[0]
    rows = m["_rows"] or 0
    smp = done[-1] if samples else {}
    if approx:
        uniq = {i: m[f"u{i}"] for i in range(len(fields))}
    else:
        uniq = {r["ci"]: r["unique_count"] for part in done[1:len(done) - samples] for r in part}
    stats = [{"k": i, "n": m[f"num{i}"], "nan": m[f"nan{i}"], "q": m[f"q{i}"]} for i in ranked]
    quant = multi_column_quantiles(df, ranked, probs, stats=stats) if ranked else {}

    def _float(x):
        return None if x is None else float(x)

    data, facts = [], {}
    for i, f in enumerate(fields):
        at = dict(zip(probs, quant.get(i, [])))
        mean, std = (_float(m[f"av{i}"]), _float(m[f"sd{i}"])) if i in numeric else (None, None)
        if i in ranked:
            facts[f.name] = {"mean": mean, "std": std, "quantiles": at}
        data.append((
            dataset, i, f.name, f.dataType.simpleString(), base_category(f.dataType),
            int(rows), int(rows - m[f"n{i}"]), int(uniq.get(i, 0) or 0), smp.get(i, []),
            _float(m[f"mn{i}"]) if i in numeric else None, _float(m[f"mx{i}"]) if i in numeric else None,
            mean, at.get(0.5) if i in numeric else None, std))
    return finish_profile(spark.createDataFrame(data, PROFILE_SCHEMA)), facts


def finish_profile(prof: DataFrame) -> DataFrame:
    """Add the derived columns: category (Y1) and missing % (A2)."""
    return prof.select(
        "dataset", "pos", "name", "dtype",
        category_expr(F.col("base_category"), F.col("unique_count"),
                      F.col("row_count")).alias("category"),
        "row_count", "missing_count",
        missing_pct_expr(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
        "unique_count", "sample_values",
        *[F.round(c, 6).alias(c) for c in ("min_val", "max_val", "mean_val",
                                            "median_val", "std_val")])


def profile_catalog(tables: dict[str, DataFrame], approx: bool = False,
                    samples: bool = True, medians: bool = True) -> DataFrame:
    """Profiles of many tables, stacked with a ``dataset`` column; the
    tables are profiled side by side from a few driver threads."""
    profs = parallel_map(lambda item: profile(item[1], item[0], approx=approx, samples=samples,
                                              medians=medians), list(tables.items()))
    out = None
    for p in profs:
        out = p if out is None else out.unionByName(p)
    return out


# -- A1 / A3 / A5 as stand-alone long tables ---------------------------------

def missing_counts(df: DataFrame) -> DataFrame:
    """A1 + A2: (pos, column, missing_count, missing_pct) in one aggregate,
    unpivoted with ``stack``."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")] + \
           [(F.count(F.lit(1)) - F.count(qcol(f.name))).alias(f"m{i}")
            for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("column"),
                               F.col(f"m{i}").alias("missing_count"))
                      for i, f in enumerate(fields)])
    return (wide.select("_rows", F.inline(pairs))
                .select("pos", "column", "missing_count",
                        missing_pct_expr(F.col("missing_count"), F.col("_rows"))
                        .alias("missing_pct")))


def distinct_counts(df: DataFrame) -> DataFrame:
    """A3: (pos, column, unique_count); exact, NULL excluded."""
    fields = df.schema.fields
    names = df.sparkSession.createDataFrame(
        [(i, f.name) for i, f in enumerate(fields)], "ci int, column string")
    counts = distinct_counts_long(df, fields)
    return (names.join(counts, "ci", "left")
            .select(F.col("ci").alias("pos"), "column",
                    F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count")))


def numeric_profile(df: DataFrame) -> DataFrame:
    """A5: min, max, mean, median, sample stddev of every numeric column."""
    p, _ = profile_with_facts(df.select(*[qcol(f.name) for f in df.schema.fields
                                          if base_category(f.dataType) == "numeric"]),
                              samples=False, probs=[0.5], distincts=False)
    return p.select(F.col("name").alias("column"), "min_val", "max_val", "mean_val",
                    "median_val", "std_val")


# -- A7 / Y2 / Y3 / Y4 over profile tables -------------------------------------

def profile_summary(prof: DataFrame) -> DataFrame:
    """Totals per category and columns with more than 30 % missing."""
    hm = F.array_sort(F.collect_list(F.when(F.col("missing_pct") > HIGH_MISSING_PCT,
                                            F.struct("pos", "name"))))
    return prof.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("category") == "numeric").alias("numeric_count"),
        F.count_if(F.col("category") == "categorical").alias("categorical_count"),
        F.count_if(F.col("category") == "datetime").alias("datetime_count"),
        F.count_if(F.col("category") == "text").alias("text_count"),
        F.transform(hm, lambda s: s["name"]).alias("high_missing"))


def cardinality_tag(category: Column, unique: Column) -> Column:
    """Y2: grouping tag for categorical, text and boolean columns."""
    applies = category.isin("categorical", "text", "boolean")
    return (F.when(~applies, F.lit(None).cast("string"))
             .when((category == "text") | (unique > NO_GROUP_UNIQUE), F.lit("TEXT/ID"))
             .when(unique <= BINARY_MAX, F.lit("BINARY"))
             .when(unique <= LOW_CARD_MAX, F.lit("CAT-LOW"))
             .otherwise(F.lit("CAT-MEDIUM")))


def cardinality_tags(prof: DataFrame) -> DataFrame:
    return prof.select("dataset", "pos", "name", "category", "unique_count",
                       cardinality_tag(F.col("category"), F.col("unique_count")).alias("tag"))


def groupable_columns(prof: DataFrame) -> DataFrame:
    """Categoricals with at most 50 distinct values; when a dataset has
    none, its first three categoricals."""
    cats = prof.where(F.col("category") == "categorical")
    w_all = Window.partitionBy("dataset")
    w_ord = Window.partitionBy("dataset").orderBy("pos")
    flagged = cats.select(
        "dataset", "pos", "name", "unique_count",
        (F.col("unique_count") <= GROUPABLE_MAX).alias("_safe"),
        F.count_if(F.col("unique_count") <= GROUPABLE_MAX).over(w_all).alias("_n_safe"),
        F.row_number().over(w_ord).alias("_rank"))
    keep = F.when(F.col("_n_safe") > 0, F.col("_safe")).otherwise(
        F.col("_rank") <= GROUPABLE_FALLBACK)
    return flagged.where(keep).select("dataset", "pos", "name", "unique_count")


def ordered_names(prof: DataFrame, cond: Column, alias: str) -> Column:
    """Y4 helper: names matching ``cond`` in column order, as an array."""
    picked = F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "name"))))
    return F.transform(picked, lambda s: s["name"]).alias(alias)
