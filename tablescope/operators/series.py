"""Chart-ready tables (C1-C9): chart-kind correction, plottability and the
series data of bar, line, scatter, pie, heatmap and box charts. Styling is
not built. Inputs are task results (bounded by the task limits) carrying a
``seq`` column that fixes their row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol, try_number
from ..functions.quantiles import grouped_quantiles

# Fixed values of the chart rules.
CATEGORICAL_MAX_UNIQUE = 15
PIE_MAX_SLICES = 10
PIE_MIN_UNIQUE = 2
PIE_MAX_UNIQUE = 5
PIE_ROWS = 12             # of a report's pie
BOX_MAX_CATEGORIES = 10  # of a report's box plot


def with_seq(result: DataFrame) -> DataFrame:
    """Number the rows of an ordered (sorted or top-k) result in order."""
    return result.withColumn("seq", F.monotonically_increasing_id())


def _float_like(c: Column) -> Column:
    """True when the value's text parses as a number."""
    return try_number(c.cast("string")).isNotNull()


def num_or_zero(c: Column) -> Column:
    """Chart numbers: NULL or unparsable -> 0.0."""
    return F.coalesce(try_number(c.cast("string")), F.lit(0.0))


def _fact_aggs(x: str, y: str | None) -> list[Column]:
    xc = qcol(x)
    aggs = [F.count(F.lit(1)).alias("rows"), F.count(xc).alias("_nx"),
            F.min_by(xc.cast("string"), F.when(xc.isNotNull(), F.col("seq"))).alias("_first"),
            F.count_distinct(xc.cast("string")).alias("unique_x")]
    if y is not None:
        yc = qcol(y)
        ynum = try_number(yc.cast("string"))
        aggs += [F.count(yc).alias("_ny"),
                 F.count_if(yc.isNotNull() & ynum.isNull()).alias("_bad"),
                 F.count_if(ynum.isNotNull() & (ynum != 0)).alias("_nz")]
    return aggs


def _is_categorical() -> Column:
    # x is categorical if its first value is not a number or it has few values
    return (~_float_like(F.col("_first"))) | (F.col("unique_x") <= CATEGORICAL_MAX_UNIQUE)


def _kind(planned: str, has_y: bool) -> Column:
    """A scatter over categories becomes a bar, a pie of many slices a
    bar, and a bar over two to five categories a pie (if there is a y)."""
    few = F.col("unique_x").between(PIE_MIN_UNIQUE, PIE_MAX_UNIQUE)
    as_bar = _is_categorical() if planned == "scatter" else \
        F.col("unique_x") > PIE_MAX_SLICES if planned == "pie" else F.lit(planned == "bar")
    as_pie = as_bar & _is_categorical() & few & F.lit(has_y)
    return F.when(F.col("_nx") == 0, planned).when(as_pie, "pie").when(as_bar, "bar").otherwise(planned)


def _plottable(has_y: bool) -> Column:
    """C2 over the fact columns."""
    ok = (F.col("rows") >= 2) & (F.col("_nx") > 0)
    if has_y:
        ok = ok & (F.col("_ny") > 0) & ((F.col("_bad") > 0) | (F.col("_nz") > 0))
    return ok


def chart_kind(result: DataFrame, x: str, y: str | None, planned: str) -> DataFrame:
    """One row (planned, chart_kind, unique_x, x_is_categorical)."""
    return result.agg(*_fact_aggs(x, y)).select(
        F.lit(planned).alias("planned"), _kind(planned, y is not None).alias("chart_kind"),
        F.col("unique_x").cast("bigint").alias("unique_x"),
        F.when(F.col("_nx") > 0, _is_categorical()).alias("x_is_categorical"))


def plottable(result: DataFrame, x: str, y: str | None) -> DataFrame:
    """At least two rows, some non-null x, and when y is given some
    non-null y that is not all zero (unparsable y counts as plottable)."""
    return result.agg(*_fact_aggs(x, y)).select("rows", _plottable(y is not None).alias("plottable"))


def chart_facts(result: DataFrame, x: str, y: str | None, planned: str) -> DataFrame:
    """C1 + C2 + row count of one result in a single aggregate."""
    return result.agg(*_fact_aggs(x, y)).select(
        "rows", _kind(planned, y is not None).alias("chart_kind"),
        _plottable(y is not None).alias("plottable"))


def series_bar(result: DataFrame, x: str, y: str | None) -> DataFrame:
    """Numeric axis iff every non-null x parses as a number (and there
    is at least one row); else text labels with NULL -> ''."""
    xc = qcol(x)
    facts = result.agg(F.bool_and(F.when(xc.isNotNull(), _float_like(xc))).alias("num"),
                       F.count(F.lit(1)).alias("n")).first()          # one row
    all_num = bool(facts["n"]) and facts["num"] is not False
    yv = num_or_zero(qcol(y)) if y is not None else F.lit(None).cast("double")
    return result.select(
        "seq", F.lit("linear" if all_num else "category").alias("x_axis"),
        (num_or_zero(xc) if all_num else F.lit(None).cast("double")).alias("x_num"),
        (F.lit(None).cast("string") if all_num else F.coalesce(xc.cast("string"), F.lit(""))).alias("x_label"),
        yv.alias("y"))


def _text(c: Column) -> Column:
    # str() of a JSON-safe value; None prints as 'None'.
    return F.coalesce(c.cast("string"), F.lit("None"))


def series_line(result: DataFrame, x: str, y: str) -> DataFrame:
    """C4: x as text, y as number."""
    return result.select("seq", _text(qcol(x)).alias("x"), num_or_zero(qcol(y)).alias("y"))


def series_scatter(result: DataFrame, x: str, y: str) -> DataFrame:
    """Both axes numeric, NULL -> 0."""
    return result.select("seq", num_or_zero(qcol(x)).alias("x"), num_or_zero(qcol(y)).alias("y"))


def series_pie(result: DataFrame, x: str, y: str, rows: int | None = None) -> DataFrame:
    """Every row, or the first ``rows``, with its share of the total of
    all rows (one number)."""
    v = num_or_zero(qcol(y))
    total = result.agg(F.sum(v)).first()[0]
    shown = result if rows is None else result.orderBy("seq").limit(rows)
    return shown.select("seq", _text(qcol(x)).alias("label"), v.alias("value"),
                        F.try_divide(v, F.lit(total).cast("double")).alias("share"))


def series_box(df: DataFrame, cat: str, num: str, max_categories: int | None = None) -> DataFrame:
    """Five-number summary and mean of num per category, in order: all
    categories or the first ``max_categories``. Quantiles use the distributed
    exact method, so a category holding most rows is never gathered into
    one task, and nothing of a category reaches the driver."""
    c, v = qcol(cat).cast("string"), qcol(num).cast("double")
    sub = df.where(c.isNotNull())
    if max_categories is not None:
        cats = [r[0] for r in sub.select(c).distinct().orderBy(1).limit(max_categories).collect()]
        sub = sub.where(c.isin(cats)) if cats else sub.where(F.lit(False))
    q = grouped_quantiles(sub.select(c.alias("k"), v.alias("v")), [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ("min_val", "q1_val", "median_val", "q3_val", "max_val")
    five = q.select(F.col("k").alias("category"), *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    means = sub.groupBy(c.alias("category")).agg(F.avg(v).alias("mean_val"))
    return means.join(five, "category", "left").select("category", *names, "mean_val").orderBy("category")
