"""Run history, conversation windows, plans and ad-hoc SQL."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablescope.operators import adhoc as Q
from tablescope.operators import history as H
from tablescope.plans import planner as PL


def test_run_latest_state_restart_and_error(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        ("r1", t, "running", "a.csv", None, None),
        ("r1", t + dt.timedelta(minutes=1), "complete", None, '{"ok":1}', None),
        ("r1", t + dt.timedelta(minutes=2), "running", "b.csv", None, None),
        ("r1", t + dt.timedelta(minutes=3), "error", None, None, "boom"),
    ], "id string, ts timestamp_ntz, status string, filename string, report_json string, error_msg string")
    s = H.run_latest_state(ev).first()
    assert (s["status"], s["filename"], s["report_json"], s["error_msg"]) == \
        ("error", "a.csv", '{"ok":1}', "boom")
    assert s["created_at"] == t and s["updated_at"] == t + dt.timedelta(minutes=3)


def test_last_turns_skewed_conversation(spark):
    rows = [(1, i, "user", f"m{i}") for i in range(3000)] + [(2, i, "bot", "x") for i in range(3)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = H.last_turns(c, 6).collect()
    one = sorted(r["turn"] for r in out if r["conv_id"] == 1)
    assert one == list(range(2994, 3000))
    assert sorted(r["turn"] for r in out if r["conv_id"] == 2) == [0, 1, 2]


def test_ingest_plan_edge_cases(spark):
    texts = spark.createDataFrame([
        ("fenced", 'Sure!\n```json\n[{"type": "overview", "title": "O"}, '
                   '{"type": "distribution", "columns": ["x"]}, '
                   '{"type": "aggregation", "title": "A", "columns": ["x", "nope"], "priority": 1}]\n```'),
        ("garbage", "no plan here"),
    ], "dataset string, text string")
    plan = PL.ingest_plan(texts).collect()
    assert [(r["dataset"], r["title"], r["priority"], r["chart_type"]) for r in plan] == \
        [("fenced", "O", 3, "bar"), ("fenced", "A", 1, "bar")]
    prof = spark.createDataFrame([("fenced", "x")], "dataset string, name string")
    valid = PL.plan_valid_columns(PL.ingest_plan(texts), prof).orderBy("seq").collect()
    assert [list(r["valid_columns"]) for r in valid] == [[], ["x"]]


def test_ask_sql_read_only_and_placeholder(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert Q.ask_sql(df, "SELECT sum(n) AS t FROM data_table").first()["t"] == 3
    assert Q.ask_sql(df, "SELECT '{x}' AS b FROM data_table").first()["b"] == "{x}"
    with pytest.raises(Exception):
        Q.ask_sql(df, "DROP TABLE data_table").collect()
    with pytest.raises(Exception):
        Q.ask_sql(df, "INSERT INTO data_table VALUES (3, 'c')").collect()
    big = spark.range(0, 100)
    assert Q.ask_sql(big, "SELECT * FROM data_table").count() == 100
    assert Q.ask_sql(big, "SELECT * FROM data_table", limit=Q.ADHOC_ROWS).count() == 20


def test_follow_up(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    old = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(25)] + [(2, 0, "user", "x")],
                                "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["text"]) for r in Q.follow_up(
        df, old, 1, "how many?", "<sql>SELECT s, n FROM data_table ORDER BY n</sql>").collect())
    assert len(got) == 21 and got[-1] == (2, 0, "x")
    assert got[-2] == (1, 27, '[{"s":"a","n":1},{"s":"b","n":2}]') and got[0][1] == 8
    bad = Q.follow_up(df, old, 3, "q", "<sql>SELECT nope FROM data_table</sql>").where("conv_id = 3").collect()
    assert [r["role"] for r in sorted(bad, key=lambda r: r["turn"])] == ["user", "assistant", "result"]
    assert "SQL execution failed" in max(bad, key=lambda r: r["turn"])["text"]


def test_ties_are_decided(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("r", t, s, f, None, None) for s, f in (("running", "b"), ("complete", "a"))],
                               "id string, ts timestamp_ntz, status string, filename string, report_json string, error_msg string")
    for df in (ev, ev.orderBy("status"), ev.repartition(2)):
        r = H.run_latest_state(df).first()
        assert (r["status"], r["filename"]) == ("running", "a")
    c = spark.createDataFrame([(1, 5, "b", "x"), (1, 5, "a", "y"), (1, 5, "a", "w")], "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in H.last_turns(c, 2).orderBy("position").collect()] == ["y", "w"]


def test_extract_sql(spark):
    df = spark.createDataFrame([("x <SQL>\nSELECT 1\n</sql> y <sql>SELECT 2</sql>",), ("none",)], "t string")
    assert [r[0] for r in df.select(Q.extract_sql(F.col("t"))).collect()] == ["SELECT 1", None]


def test_template_insight_lines(spark):
    from tablescope.plans import insights as L
    prof = spark.createDataFrame([
        ("d", 0, "a", "numeric", 1000, 300, 30.0, 0.5, 9.0, 2.0, 4.0),
        ("d", 1, "b", "categorical", 1000, 250, 25.0, None, None, None, None),
        ("d", 2, "c", "numeric", 1000, 0, 0.0, 1.0, 2.0, 1.5, 0.1),
    ], "dataset string, pos int, name string, category string, row_count long, "
       "missing_count long, missing_pct double, min_val double, max_val double, "
       "mean_val double, std_val double")
    index = spark.createDataFrame([("d", 7, "anomaly", 50, 182, None)],
                                  "dataset string, run_order int, task_type string, row_count long, "
                                  "outlier_total long, error string")
    got = [(r["kind"], r["seq"], r["text"]) for r in
           L.template_insights(prof, index).orderBy("kind", "seq").collect()]
    assert got == [
        ("anomaly", 0, "a shows high variability (CV=2.0), suggesting outliers."),
        ("anomaly", 1, "182 statistical outliers detected (z-score > 3)."),
        ("insight", 0, "Dataset contains 1,000 rows across 3 columns."),
        ("insight", 1, "Columns with >20% missing values: a, b."),
        ("insight", 2, "a ranges from 0.5 to 9.0 (mean: 2.00)."),
        ("recommendation", 0, "Investigate and impute missing values in a, b."),
        ("recommendation", 1, "Explore correlations between numeric columns: a, c."),
        ("recommendation", 2, "Consider removing or binning high-cardinality categorical columns."),
    ]


def test_analyze_end_to_end(spark, tmp_path):
    from tablescope.operators.history import run_latest_state
    from tablescope.plans.analyze import analyze
    from tablescope.sources.sinks import read_run_events
    path = tmp_path / "sales.csv"
    lines = ["region,amount,day"] + [f"r{i % 4},{(i * 37) % 101}.5,2024-01-{i % 28 + 1:02d}"
                                      for i in range(300)]
    path.write_text("\n".join(lines) + "\n")
    log = str(tmp_path / "log")
    a = analyze(spark, str(path), out_dir=str(tmp_path / "report"), run_log=log)
    assert a.dataset == "sales.csv" and a.strategy == "full"
    types = {r["type"] for r in a.plan.collect()}
    assert {"overview", "distribution", "aggregation", "time_series", "anomaly"} <= types
    sections = {r["section"]: r["rows"] for r in a.report.collect()}
    assert sections["schema"] == 3 and sections["preview"] == 5
    rows = {r["task_id"]: r["row_count"] for r in a.run.index.collect()}
    assert sections["result_rows"] == sum(rows.values()) and sections["errors"] == 0
    state = run_latest_state(read_run_events(spark, log)).first()
    assert state["status"] == "complete" and state["filename"] == "sales.csv"
    text = json.loads(state["report_json"])
    assert len(text["schema"]) == 3 and len(text["charts"]) == sections["charts"] and text["dataset"][0]["row_count"] == 300
    assert text["log"][0]["agent"] == "planner" and text["rows_and_points"] == str(tmp_path / "report")
    points = spark.read.json(str(tmp_path / "report" / "chart_data"))
    assert points.where("title = 'amount by region'").count() == 4


def test_failed_and_skipped_tasks_are_logged(spark):
    from tablescope.operators.profile import profile
    from tablescope.plans import report as RP
    from tablescope.plans.runner import run_plan
    df = spark.createDataFrame([(i, "x", dt.date(2024, 1, 1 + i)) for i in range(5)], "n int, s string, d date")
    plan = spark.createDataFrame([
        ("t", 0, "aggregation", "text as number", "", ["n", "s"], "bar", 1), ("t", 1, "time_series", "bad", "", ["d", "s"], "line", 2),
        ("t", 2, "nonsense", "unknown", "", ["n"], "bar", 3)],
        "dataset string, seq int, type string, title string, description string, columns array<string>, chart_type string, priority int")
    run = run_plan(df, "t", plan, profile(df, "t"))
    levels = [(r["level"], r["message"][:20]) for r in run.log.orderBy("seq").collect()]
    assert ("warning", "Skipped: unknown (ty") in levels and any(lv == "error" for lv, _ in levels)
    assert [r["title"] for r in RP.error_rows(run).collect()] == ["bad"]
    notes = RP.chart_data(run).where("note is not null").collect()
    assert all(r["note"] == RP.NO_DATA for r in notes)


def test_analyze_uses_all_rows(spark):
    """No size changes what is analysed."""
    from tablescope.plans.analyze import analyze
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_quantity", "l_returnflag")
    a = analyze(spark, li, name="lineitem")
    assert {r["row_count"] for r in a.profile.collect()} == {600_000}
    text = {r["title"]: r["row_count"] for r in a.run.index.collect()}
    assert text["Top Values — l_returnflag"] == 3
    many = analyze(spark, li.select(F.col("l_quantity"), (F.col("l_orderkey") % 6000).cast("string").alias("c")), name="many",
                   plan_text=spark.createDataFrame([('[{"type": "distribution", "title": "all", "columns": ["c"]}]',)], "text string"))
    assert many.run.index.first()["row_count"] == 6000


def test_unusable_plan_text_falls_back(spark):
    from tablescope.plans.analyze import analyze
    df = spark.range(0, 50).select("id", (F.col("id") * 1.5).alias("v"))
    a = analyze(spark, df, name="t", plan_text=spark.createDataFrame([("no list here",)], "text string"))
    assert {"overview", "distribution", "anomaly"} <= {r["task_type"] for r in a.run.index.collect()}
    assert a.run.log.where("level = 'warning' AND agent = 'planner'").count() == 1


def test_analyze_records_errors(spark, tmp_path):
    from tablescope.operators.history import run_latest_state
    from tablescope.plans.analyze import analyze
    from tablescope.sources.sinks import read_run_events
    log = str(tmp_path / "log")
    with pytest.raises(Exception):
        analyze(spark, str(tmp_path / "missing.parquet"), run_log=log)
    assert run_latest_state(read_run_events(spark, log)).first()["status"] == "error"


def test_insights_use_total_rows(spark):
    from tablescope.plans import insights as L
    prof = spark.createDataFrame([("d", 0, "a", "numeric", 100, 0, 0.0, 1.0, 2.0, 1.5, 0.5)],
                                 "dataset string, pos int, name string, category string, row_count long, "
                                 "missing_count long, missing_pct double, min_val double, max_val double, "
                                 "mean_val double, std_val double")
    first = L.template_insights(prof, total_rows={"d": 2500000}).where("kind = 'insight'") \
             .orderBy("seq").first()["text"]
    assert first == "Dataset contains 2,500,000 rows across 1 columns."


def test_analyze_with_ingested_plan(spark):
    from tablescope.plans.analyze import analyze
    df = spark.range(0, 400).select("id", (F.col("id") % 5).cast("string").alias("g"),
                                    (F.col("id") * 1.5).alias("v"))
    text = spark.createDataFrame([(
        'Plan: [{"type": "aggregation", "title": "v by g", "columns": ["g", "v"], "priority": 1},'
        ' {"type": "distribution", "title": "v spread", "columns": ["v"], "chart_type": "histogram"},'
        ' {"type": "anomaly", "title": "odd", "columns": ["nope"]}]',)], "text string")
    a = analyze(spark, df, name="t", key="id", plan_text=text)
    idx = {r["title"]: r for r in a.run.index.collect()}
    assert set(idx) == {"v by g", "v spread"}          # unknown column: task skipped
    assert idx["v by g"]["run_order"] == 1 and idx["v by g"]["row_count"] == 5
    assert idx["v spread"]["chart_kind"] == "histogram"
