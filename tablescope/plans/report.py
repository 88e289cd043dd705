"""Report assembly (L9) with bounded fetches (S12), JSON-safe projection
(S13) and section writing (S14)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..functions.json_safe import json_safe
from ..session import parallel_map
from ..sources.sinks import write_report_sections
from .runner import PlanRun

FETCH_ROWS = 50_000


def bounded(df: DataFrame, n: int = FETCH_ROWS) -> DataFrame:
    """Never more than ``n`` rows leave a result."""
    return df.limit(n)


def report_charts(index: DataFrame) -> DataFrame:
    """charts = results that are plottable and error-free; the
    correlation matrix comes first and appears once."""
    ok = index.where(F.col("error").isNull() & F.col("plottable"))
    first = F.when(F.col("chart_kind") == "heatmap", F.lit(0)).otherwise(F.lit(1))
    return ok.select("dataset", "task_id", "title", "description", "chart_kind",
                     first.alias("_f"), "run_order") \
             .orderBy("dataset", "_f", "run_order").drop("_f")


NO_DATA = "No data available for this chart"


def result_rows(run: PlanRun) -> DataFrame:
    """Every row of every result as JSON: (dataset, task_id, title, seq, row)."""
    out = None
    for r in run.index.where(F.col("error").isNull()).collect():
        res = run.results[r["task_id"]]
        cols = [c for c in res.columns if c != "seq"]
        safe = json_safe(res.select("seq", *[qcol(c) for c in cols]))
        part = safe.select(F.lit(r["dataset"]).alias("dataset"), F.lit(r["task_id"]).alias("task_id"),
                           F.lit(r["title"]).alias("title"), "seq",
                           F.to_json(F.struct(*[qcol(c) for c in cols]), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else run.index.sparkSession.createDataFrame(
        [], "dataset string, task_id string, title string, seq bigint, row string")


def chart_data(run: PlanRun) -> DataFrame:
    """L9 with its data: every point of every chart as JSON, in order; a
    result that cannot be plotted has one row with a note instead (C9).
    (dataset, task_id, title, chart_kind, seq, point, note)."""
    out = None
    for r in run.index.where(F.col("error").isNull() & (F.col("task_type") != "overview")).collect():
        series = run.series.get(r["task_id"])
        if series is None:
            part = run.index.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("point"),
                                                          F.lit(NO_DATA).alias("note"))
        else:
            cols = [c for c in series.columns if c != "seq"]
            part = series.select(F.col("seq").cast("bigint").alias("seq"),
                                 F.to_json(F.struct(*[qcol(c) for c in cols]), {"ignoreNullFields": "false"}).alias("point"),
                                 F.lit(None).cast("string").alias("note"))
        part = part.select(F.lit(r["dataset"]).alias("dataset"), F.lit(r["task_id"]).alias("task_id"),
                           F.lit(r["title"]).alias("title"), F.lit(r["chart_kind"]).alias("chart_kind"), "seq", "point", "note")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else run.index.sparkSession.createDataFrame(
        [], "dataset string, task_id string, title string, chart_kind string, seq bigint, point string, note string")


def error_rows(run: PlanRun) -> DataFrame:
    return run.index.where(F.col("error").isNotNull()).select("dataset", "run_order", "title", "error")


def report_json(dataset: DataFrame, profile: DataFrame, preview: DataFrame, findings: DataFrame,
                run: PlanRun, path: str | None) -> str:
    """The report's text for the run log: what is bounded by columns and tasks
    in full, and where the result rows and chart points are."""
    sections = {"dataset": dataset, "schema": profile, "preview": json_safe(preview), "findings": findings,
                "charts": report_charts(run.index), "results": run.index, "log": run.log, "errors": error_rows(run)}
    rows = parallel_map(lambda df: [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()], list(sections.values()))
    body = ",".join(f'"{name}":[{",".join(r)}]' for name, r in zip(sections, rows))
    return "{" + body + f',"rows_and_points":{json.dumps(path)}' + "}"


def write_report(path: str, dataset: DataFrame, profile: DataFrame, preview: DataFrame,
                 findings: DataFrame, run: PlanRun) -> DataFrame:
    """Every section as JSON under ``path``; returns (section, rows)."""
    return write_report_sections({
        "dataset": dataset, "schema": profile, "preview": json_safe(preview),
        "findings": findings, "charts": report_charts(run.index), "chart_data": chart_data(run),
        "results": run.index, "result_rows": result_rows(run), "log": run.log, "errors": error_rows(run)}, path)
