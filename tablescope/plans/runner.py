"""L3: run a plan. Tasks (collected: one row each) are dispatched in priority
order; what they ask of the table is computed together, in a number of passes
that does not depend on their number (``shared_scan``), or, where a task fails,
by each task's own template, side by side from a few driver threads. Every
result is kept whole in the shared checkpoint folder, described by one
results-index row, with its chart's series beside it. Bounds, means and
deviations come from the profile where it has them. Log rows (U2) say what
ran, what was skipped and what failed; a failing task becomes an error row
and the others continue."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_safe import json_safe
from ..operators import analyses as A
from ..operators import correlation as C
from ..operators import series as S
from ..session import materialize, parallel_map
from .shared_scan import Wanted, run_together

INDEX_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("run_order", T.IntegerType()),
    T.StructField("task_id", T.StringType()), T.StructField("task_type", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("x_col", T.StringType()), T.StructField("y_col", T.StringType()),
    T.StructField("row_count", T.LongType()), T.StructField("chart_kind", T.StringType()),
    T.StructField("plottable", T.BooleanType()), T.StructField("outlier_total", T.LongType()),
    T.StructField("error", T.StringType()),
])
LOG_SCHEMA = "dataset string, seq int, agent string, message string, timestamp string, level string"


@dataclass
class PlanRun:
    """The results index, the whole results and chart series by task id, and the log."""

    index: DataFrame
    results: dict[str, DataFrame] = field(default_factory=dict)
    series: dict[str, DataFrame] = field(default_factory=dict)
    log: DataFrame | None = None


def log_rows(spark, dataset: str, agent: str, entries: list[tuple[str, str]]) -> DataFrame:
    """(level, message) entries as log rows in their order."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
    return spark.createDataFrame([(dataset, i, agent, m, now, level) for i, (level, m) in enumerate(entries)], LOG_SCHEMA)


def _asked(task, cats: dict[str, str]) -> tuple | None:
    """What a task asks for, as a field of ``Wanted`` (or overview) and its
    columns; None when its type or columns do not fit."""
    ttype, cols = task["type"], task["cols"]
    nums = [c for c in cols if cats.get(c) == "numeric"]
    if ttype == "overview":
        return "overview", None
    if ttype == "distribution" and cols:
        return "histograms" if cats.get(cols[0]) == "numeric" else "counts", cols[0]
    if ttype == "correlation" and len(nums) >= 2:
        return ("matrices", nums) if task["chart_type"] == "heatmap" else ("scatters", (nums[0], nums[1]))
    if ttype == "time_series" and len(cols) >= 2:
        return ("hours", (cols[0], cols[1])) if task["grain"] == "hour" else ("series", (cols[0], cols[1], task["grain"]))
    if ttype == "aggregation" and len(cols) >= 2:
        return "totals" if cats.get(cols[1]) == "numeric" else "crossed", (cols[0], cols[1])
    if ttype == "anomaly" and nums:
        return "outliers", nums[0]
    return None


def _alone(df: DataFrame, raw: DataFrame, asked: tuple, key: str | None, facts: dict, scatter_rows: int) -> DataFrame:
    """A task's result by its own template."""
    kind, cols = asked
    bounds, moments = _known(facts)
    if kind == "histograms":
        return A.histogram(df, cols, bounds=bounds.get(cols))
    if kind == "counts":
        return A.value_counts(df, cols)
    if kind == "matrices":
        return C.correlation_matrix(df, cols)
    if kind == "scatters":
        return A.scatter(raw, *cols, rows=scatter_rows)
    if kind == "series":
        return A.time_series(df, *cols, bounds=bounds.get(cols[0]))
    if kind == "outliers":
        return A.zscore_outliers(df, cols, key, moments=moments.get(cols))
    if kind == "overview":
        return A.overview(raw, [key] if key else [])
    return {"hours": A.hour_of_day, "totals": A.group_aggregate, "crossed": A.cross_count}[kind](df, *cols)


def _known(facts: dict) -> tuple[dict, dict]:
    """What the profile knows: 1 % and 99 % quantiles, finite means and deviations, by column."""
    bounds, moments = {}, {}
    for c, f in facts.items():
        q = f.get("quantiles", {})
        if A.CLIP_LOW in q and A.CLIP_HIGH in q:
            bounds[c] = (q[A.CLIP_LOW], q[A.CLIP_HIGH])
        if all(x is not None and math.isfinite(x) for x in (f.get("mean"), f.get("std"))):
            moments[c] = (f["mean"], f["std"])
    return bounds, moments


def _axes(kind: str, res: DataFrame, chart: str) -> tuple:
    """(x, y, chart) of a result."""
    if kind == "overview":
        return None, None, chart
    if kind == "matrices":
        return None, None, "heatmap"
    if kind == "scatters":
        return res.columns[0], res.columns[1], chart
    return {"histograms": ("bin_start", "count", chart), "counts": ("category", "count", chart), "hours": ("hour_of_day", "count", chart),
            "series": ("period", "total_value", chart), "totals": ("category", "total_value", chart),
            "crossed": ("category", "count", chart), "outliers": ("row_id", "value", "scatter")}[kind]


def chart_series(df: DataFrame, res: DataFrame, x: str | None, y: str | None, kind: str | None,
                 cols: list[str]) -> DataFrame | None:
    """The data of a result's chart (C3-C8), by kind."""
    if kind == "heatmap":
        return S.with_seq(C.heatmap_matrix(res))
    if x is None:
        return None
    res = json_safe(res)                 # times as ISO text
    if kind == "box" and len(cols) >= 2:
        return S.with_seq(S.series_box(df, cols[0], cols[1]))
    if kind == "line":
        return S.series_line(res, x, y)
    if kind == "scatter":
        return S.series_scatter(res, x, y)
    if kind == "pie":
        return S.series_pie(res, x, y)
    return S.series_bar(res, x, y)


def run_plan(df: DataFrame, dataset: str, plan: DataFrame, prof: DataFrame,
             key: str | None = None, raw: DataFrame | None = None, facts: dict | None = None,
             scatter_rows: int = A.SCATTER_ROWS) -> PlanRun:
    """``facts``: unrounded statistics by column (``profile_with_facts``).
    ``scatter_rows``: points of a scatter chart's random sample."""
    spark, facts, raw = df.sparkSession, facts or {}, df if raw is None else raw
    cats = {r["name"]: r["category"] for r in
            prof.where(F.col("dataset") == dataset).select("name", "category").collect()}
    tasks = (plan.where(F.col("dataset") == dataset).withColumn("grain", A.granularity(F.col("title")))
                 .orderBy(F.coalesce("priority", F.lit(3)), "seq").collect())

    asked, wanted = {}, Wanted()
    for order, t in enumerate(tasks, start=1):
        asked[order] = _asked({"type": t["type"], "chart_type": t["chart_type"], "grain": t["grain"],
                               "cols": [c for c in (t["columns"] or []) if c in cats]}, cats)
        if asked[order] and asked[order][0] != "overview":
            getattr(wanted, asked[order][0])[order] = asked[order][1]
    try:
        together = run_together(df, raw, wanted, key, *_known(facts), scatter_rows)
    except Exception:                    # some task fails: each runs by itself, and its own error is its row
        together = {}
    if any(a and a[0] == "overview" for a in asked.values()):
        shown = A.overview(raw, [key] if key else [])
        together |= {order: shown for order, a in asked.items() if a and a[0] == "overview"}

    def run_one(item):
        order, t = item
        cols = [c for c in (t["columns"] or []) if c in cats]
        tid, head = uuid.uuid4().hex[:8], (dataset, order)
        about = (t["type"], t["title"], t["description"])
        log = [("info", f"Running: {t['title']}")]
        try:
            if asked[order] is None:
                log.append(("warning", f"Skipped: {t['title']} (type or columns do not fit)"))
                return None, None, None, log
            kind = asked[order][0]
            res = together[order] if order in together else _alone(df, raw, asked[order], key, facts, scatter_rows)
            x, y, chart = _axes(kind, res, t["chart_type"])
            res = materialize(S.with_seq(res))
            if x is not None:
                found = S.chart_facts(res, x, y, chart).first()
                n = found["rows"]
                chart, plot = (found["chart_kind"], bool(found["plottable"])) if n else (chart, False)
            else:
                n = res.count()
                plot = chart == "heatmap" and n > 0
            log.append(("success", f"✓ {t['title']} ({n} rows)"))
            row = (*head, tid, *about, x, y, n, chart, plot, n if kind == "outliers" else None, None)
            return row, res, chart_series(df, res, x, y, chart, cols) if plot else None, log
        except Exception as exc:  # one failing task does not stop the run
            message = f"Task '{t['title']}' failed: {str(exc)[:500]}"
            log.append(("error", message))
            return (*head, tid, *about, None, None, 0, None, False, None, message), None, None, log

    rows, run, entries = [], PlanRun(prof), []
    # tasks are independent Spark jobs: run them side by side, keep the order
    for row, res, series, log in parallel_map(run_one, list(enumerate(tasks, start=1))):
        entries += log
        if row is None:
            continue
        rows.append(row)
        if res is not None:
            run.results[row[2]] = res
        if series is not None:
            run.series[row[2]] = series
    entries.append(("success", f"Execution complete — {len(rows)} results"))
    run.index = spark.createDataFrame(rows, INDEX_SCHEMA)
    run.log = log_rows(spark, dataset, "execution", entries)
    return run
