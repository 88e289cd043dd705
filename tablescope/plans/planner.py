"""Analysis plans as tables.

A plan has one row per task: dataset, seq, type, title, description,
columns (array), chart_type, priority. Plans for many datasets are built
in one job from a stacked profile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fill
from ..operators.profile import GROUPABLE_FALLBACK, GROUPABLE_MAX, ordered_names

DEFAULT_PRIORITY = 3

TASK_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("chart_type", T.StringType()),
    T.StructField("priority", T.IntegerType()),
])
#: As a plan text may have them: a priority can be a number or text.
PLAN_ITEM_SCHEMA = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == "priority" else f.dataType) for f in TASK_TYPE.fields])

# Task texts of the rule-based plan, {0}/{1} = column names.
OVERVIEW_TITLE = "Dataset Overview"
OVERVIEW_DESC = "First 100 rows preview and structure"
HIST_TITLE = "Distribution of {0}"
HIST_DESC = "Histogram showing spread of {0}"
TOP_TITLE = "Top Values — {0}"
TOP_DESC = "Frequency count for {0}"
MATRIX_TITLE = "Numeric Correlation Matrix"
MATRIX_DESC = "Pearson correlations between all numeric columns"
PAIR_TITLE = "{0} vs {1}"
PAIR_DESC = "Scatter plot of {0} against {1}"
AGG_TITLE = "{0} by {1}"
AGG_DESC = "Total {0} grouped by {1}"
TREND_TITLE = "{0} Over Time"
TREND_DESC = "Trend of {0} over {1}"
OUTLIER_TITLE = "Outliers in {0}"
OUTLIER_DESC = "Statistical anomalies (z-score > 3) in {0}"


def _task(cond: Column, type_: str, title: Column, desc: Column, cols: Column,
          chart: str, priority: int) -> Column:
    t = F.struct(F.lit(type_).alias("type"), title.alias("title"), desc.alias("description"),
                 cols.cast("array<string>").alias("columns"), F.lit(chart).alias("chart_type"),
                 F.lit(priority).alias("priority"))
    return F.when(cond, t)


def heuristic_plan(prof: DataFrame) -> DataFrame:
    """L1: the rule-based plan of every dataset in a profile table."""
    lists = prof.groupBy("dataset").agg(
        ordered_names(prof, F.col("category") == "numeric", "nums"),
        ordered_names(prof, F.col("category") == "categorical", "cats"),
        ordered_names(prof, (F.col("category") == "categorical") &
                      (F.col("unique_count") <= GROUPABLE_MAX), "safe"),
        ordered_names(prof, F.col("category") == "datetime", "dts"))
    safe = F.when(F.size("safe") > 0, F.col("safe")).otherwise(
        F.slice("cats", 1, GROUPABLE_FALLBACK))
    n0, n1 = F.try_element_at("nums", F.lit(1)), F.try_element_at("nums", F.lit(2))
    c0 = F.try_element_at(safe, F.lit(1))
    d0 = F.try_element_at("dts", F.lit(1))
    nn = F.size("nums")
    has_cat = F.size(safe) > 0
    tasks = F.array(
        _task(F.lit(True), "overview", F.lit(OVERVIEW_TITLE), F.lit(OVERVIEW_DESC),
              F.array(), "bar", 1),
        _task(nn >= 1, "distribution", fill(HIST_TITLE, n0), fill(HIST_DESC, n0),
              F.array(n0), "histogram", 2),
        _task(has_cat, "distribution", fill(TOP_TITLE, c0), fill(TOP_DESC, c0),
              F.array(c0), "bar", 2),
        _task(nn >= 3, "correlation", F.lit(MATRIX_TITLE), F.lit(MATRIX_DESC),
              F.col("nums"), "heatmap", 3),
        _task(nn == 2, "correlation", fill(PAIR_TITLE, n0, n1), fill(PAIR_DESC, n0, n1),
              F.array(n0, n1), "scatter", 3),
        _task(has_cat & (nn >= 1), "aggregation", fill(AGG_TITLE, n0, c0),
              fill(AGG_DESC, n0, c0), F.array(c0, n0), "bar", 3),
        _task((F.size("dts") > 0) & (nn >= 1), "time_series", fill(TREND_TITLE, n0),
              fill(TREND_DESC, n0, d0), F.array(d0, n0), "line", 2),
        _task(nn >= 1, "anomaly", fill(OUTLIER_TITLE, n0), fill(OUTLIER_DESC, n0),
              F.array(n0), "scatter", 4),
    )
    kept = F.filter(tasks, lambda t: t.isNotNull())
    return (lists.select("dataset", F.posexplode(kept).alias("seq", "task"))
                 .select("dataset", F.col("seq").cast("int").alias("seq"), "task.*"))


def plan_to_text(plan: DataFrame) -> DataFrame:
    """Render each dataset's plan as a JSON array inside prose, the shape a
    planning answer arrives in (input for ``ingest_plan``)."""
    arr = F.array_sort(F.collect_list(F.struct("seq", F.struct(
        *[F.col(f.name) for f in TASK_TYPE.fields]).alias("t"))))
    return plan.groupBy("dataset").agg(
        F.concat(F.lit("Here is the plan:\n```json\n"),
                 F.to_json(F.transform(arr, lambda s: s["t"])),
                 F.lit("\n```")).alias("text"))


def ingest_plan(texts: DataFrame, text_col: str = "text",
                id_cols: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """L2: take the outermost JSON array out of each text, keep objects that
    have a type and a title, default the rest (description '', columns [],
    chart 'bar', priority 3; a priority may be text, an unreadable one is 3).
    Unparsable text yields no tasks; ``plan_or_rules`` then falls back."""
    found = F.regexp_extract(F.col(text_col), r"(?s)\[.*\]", 0)
    body = F.when(F.length(found) > 0, found).otherwise(F.col(text_col))
    # item by item, so that one which is no task does not spoil the others
    items = F.from_json(body, T.ArrayType(T.StringType()))
    rows = texts.select(*id_cols, F.posexplode_outer(items).alias("seq", "item")) \
                .select(*id_cols, "seq", F.from_json("item", PLAN_ITEM_SCHEMA).alias("t")) \
                .where(F.col("t.type").isNotNull() & F.col("t.title").isNotNull())
    return rows.select(
        *id_cols, F.col("seq").cast("int").alias("seq"), F.col("t.type").alias("type"),
        F.col("t.title").alias("title"),
        F.coalesce("t.description", F.lit("")).alias("description"),
        F.coalesce("t.columns", F.array().cast("array<string>")).alias("columns"),
        F.coalesce("t.chart_type", F.lit("bar")).alias("chart_type"),
        F.coalesce(F.col("t.priority").try_cast("int"), F.col("t.priority").try_cast("double").try_cast("int"),
                   F.lit(DEFAULT_PRIORITY)).alias("priority"))


def plan_or_rules(ingested: DataFrame, prof: DataFrame) -> DataFrame:
    """Each dataset's ingested plan, or the rule-based plan where it has no task."""
    without = prof.join(ingested.select("dataset").distinct(), "dataset", "left_anti")
    return ingested.unionByName(heuristic_plan(without))


def plan_order(plan: DataFrame) -> DataFrame:
    """T4: stable execution order by priority (default 3), then plan order."""
    w = Window.partitionBy("dataset").orderBy(
        F.coalesce("priority", F.lit(DEFAULT_PRIORITY)), "seq")
    return plan.select("dataset", F.row_number().over(w).alias("run_order"), "seq", "type",
                       "title", "priority")


def plan_valid_columns(plan: DataFrame, prof: DataFrame) -> DataFrame:
    """Each task's columns that exist in its dataset's profile, in task
    order. The profile side has one row per column."""
    names = prof.select("dataset", F.col("name").alias("col"))
    exploded = plan.select("dataset", "seq", F.posexplode("columns").alias("cpos", "col"))
    valid = exploded.join(names, ["dataset", "col"], "left_semi")
    agg = valid.groupBy("dataset", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cpos", "col"))),
                    lambda s: s["col"]).alias("valid_columns"))
    return (plan.select("dataset", "seq", "type", "columns")
                .join(agg, ["dataset", "seq"], "left")
                .select("dataset", "seq", "type", "columns",
                        F.coalesce("valid_columns", F.array().cast("array<string>"))
                        .alias("valid_columns")))
