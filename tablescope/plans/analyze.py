"""One call from a source to a written report: load, scale, profile, plan,
run, explain, report, and record the run in the event log. Plain function
composition over the library's table jobs."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyses import preview
from ..operators.profile import profile_with_facts
from ..operators.sampling import analysis_frames, strategy_expr
from ..sources.files import parsed_once
from ..sources.sinks import RUN_EVENT_SCHEMA, append_run_events
from .insights import template_insights
from .planner import heuristic_plan, ingest_plan, plan_or_rules
from .report import report_json, write_report
from .runner import PlanRun, log_rows, run_plan


@dataclass(frozen=True)
class Analysis:
    dataset: str
    strategy: str
    profile: DataFrame
    plan: DataFrame
    run: PlanRun
    findings: DataFrame
    report: DataFrame | None


def _event(spark: SparkSession, run_id: str, status: str, filename: str | None = None,
           report: str | None = None, error: str | None = None) -> DataFrame:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(run_id, now, status, filename, report, error)],
                                 RUN_EVENT_SCHEMA)


def analyze(spark: SparkSession, source: str | DataFrame, name: str | None = None,
            key: str | None = None, out_dir: str | None = None,
            plan_text: DataFrame | None = None, run_log: str | None = None,
            run_id: str | None = None, sample_rows: int | None = None) -> Analysis:
    """Analyse one dataset, all of its rows. ``source`` is a path (CSV/TSV/TXT,
    Parquet, JSON; text is parsed once and kept as typed Parquet in the shared
    folder for the run) or a DataFrame; ``key`` orders overview rows and row
    ids; ``plan_text`` (rows with a ``text`` column holding a JSON task list)
    replaces the rule-based plan, which still serves where the text holds no
    task; ``out_dir`` receives the report sections; ``run_log`` the run events
    and the report's JSON; ``sample_rows``, if given, limits raw-row outputs
    (overview, scatter) to a random sample of so many rows."""
    if name is None:
        name = os.path.basename(source.rstrip("/")) if isinstance(source, str) else "dataset"
    run_id = run_id or name
    if run_log:
        append_run_events(_event(spark, run_id, "running", filename=name), run_log)
    try:
        df = parsed_once(spark, source) if isinstance(source, str) else source
        prof, facts = profile_with_facts(df, name)
        total = prof.agg(F.max("row_count")).first()[0] or 0
        strategy = spark.range(1).select(strategy_expr(F.lit(total))).first()[0]
        agg_df, raw_df = analysis_frames(df, sample_rows, key=[key] if key else None, total=total)
        notes = []
        if plan_text is not None:
            ingested = ingest_plan(plan_text.select(F.lit(name).alias("dataset"), "text"))
            plan = plan_or_rules(ingested, prof)
            if ingested.isEmpty():
                notes.append(("warning", "The plan text holds no task; using the rule-based plan"))
        else:
            plan = heuristic_plan(prof)
        notes += [("info", f"  → [{t['type']}] {t['title']}") for t in plan.orderBy("seq").collect()]
        run = run_plan(agg_df, name, plan, prof, key=key, raw=raw_df, facts=facts)
        run.log = log_rows(spark, name, "planner", notes).unionByName(run.log)
        findings = template_insights(prof, run.index, total_rows={name: total})
        summary = spark.range(1).select(
            F.lit(name).alias("dataset"), F.lit(total).cast("bigint").alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"), F.lit(strategy).alias("strategy"),
            F.lit(sample_rows).cast("bigint").alias("sample_size"))
        shown = preview(raw_df, [key] if key else [])
        report = write_report(out_dir, summary, prof, shown, findings, run) if out_dir else None
        if run_log:
            text = report_json(summary, prof, shown, findings, run, out_dir)
            append_run_events(_event(spark, run_id, "complete", report=text), run_log)
        return Analysis(name, strategy, prof, plan, run, findings, report)
    except Exception as exc:
        if run_log:
            append_run_events(_event(spark, run_id, "error", error=str(exc)[:2000]), run_log)
        raise
