"""Physical-plan properties: pushdown, no cross joins, no Python UDFs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablescope.operators import analyses as A


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_bounds_reach_the_scan(spark, sf001):
    ev = spark.read.parquet(f"{sf001}/events.parquet")
    txt = plan_text(A.histogram(ev, "value"))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value," in txt
    assert "ReadSchema: struct<value:double>" in txt


@pytest.mark.parametrize("key", ["histogram", "time_series_day", "scatter_clip", "group_aggregate",
                                 "value_counts", "cross_count", "hour_of_day", "attach_stats",
                                 "run_latest_state", "last_turns", "heuristic_plan"])
def test_no_cross_join_no_python(spark, sf001, key):
    txt = plan_text(E.queries()[key](spark, sf001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in txt, (key, bad)


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, "")
    import tablescope.session as session
    threads, session.DRIVER_THREADS = session.DRIVER_THREADS, 1
    try:
        before = session.parallel_map.__globals__["ThreadPoolExecutor"]
        session.ThreadPoolExecutor = _InOrder       # job groups belong to a thread
        work()
    finally:
        session.DRIVER_THREADS, session.ThreadPoolExecutor = threads, before
        spark.sparkContext.setJobGroup("other", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


class _InOrder:
    def __init__(self, **kw):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        return False

    def map(self, fn, items):
        return [fn(x) for x in items]


def test_profile_jobs_do_not_depend_on_columns(spark):
    """Five or fifty columns: the same passes."""
    from tablescope.operators import profile as P

    def table(n):
        return spark.range(0, 500).select(*[(F.col("id") * (j + 1) % 97).cast("double" if j % 2 else "string").alias(f"c{j}")
                                            for j in range(n)])
    assert _jobs(spark, "narrow", lambda: P.profile(table(5)).collect()) == _jobs(spark, "wide", lambda: P.profile(table(50)).collect())


def test_time_and_integer_bounds_reach_the_scan(spark, sf001):
    ev = spark.read.parquet(f"{sf001}/events.parquet")
    txt = plan_text(A.time_series(ev, "ts", "value"))
    assert "GreaterThanOrEqual(ts," in txt and "LessThanOrEq" in txt
    txt = plan_text(A.histogram(ev, "user_id"))
    assert "GreaterThanOrEqual(user_id," in txt and "LessThanOrEqual(user_id," in txt


def test_top_n_limits_before_shuffle(spark, sf001):
    txt = plan_text(E.queries()["last_turns"](spark, sf001))
    assert "WindowGroupLimit" in txt


def test_group_by_combines_map_side(spark, sf001):
    txt = plan_text(E.queries()["value_counts"](spark, sf001))
    partial = txt.find("HashAggregate")
    assert "partial_count" in txt and txt.count("HashAggregate") >= 2 and partial >= 0


def _scans(spark, df, work):
    """How often the rows of ``df`` are read while ``work`` runs on it."""
    read, n = spark.sparkContext.accumulator(0), df.count()

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    work(df.mapInArrow(counted, df.schema))
    return read.value / n


def test_correlation_takes_two_scans(spark):
    from tablescope.operators import correlation as C
    few, many = (spark.range(0, 400).select(*[(F.col("id") * (j + 1) % 97).cast("double").alias(f"c{j}") for j in range(n)]) for n in (3, 150))
    for df in (few, many):
        assert _scans(spark, df, lambda d: C.correlation_matrix(d, d.columns).collect()) == 2
    assert _scans(spark, few, lambda d: C.correlation_matrix(d, d.columns, means={c: 48.0 for c in d.columns}).collect()) == 1


def test_outliers_take_three_scans_and_no_exchange_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 40_000).select("id", F.when(F.col("id") % 200 == 7, 1e3).otherwise(F.col("id") % 10 * 1.0).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    found = {}
    scans = _scans(spark, df, lambda d: found.update(n=A.zscore_outliers(d, "v", "id").count()))
    assert found["n"] == 200 and scans == 3                       # moments, outliers, rows before them
    text = plan_text(A.zscore_outliers(df, "v", "id"))
    assert "FileScan" not in text and "rangepartitioning(id" not in text


def _plan_of(spark, n):
    """n tasks of every kind."""
    rows = []
    for i in range(n):
        rows += [("t", "distribution", f"h{i}", ["a"], "histogram"), ("t", "distribution", f"c{i}", ["g"], "bar"),
                 ("t", "aggregation", f"s{i}", ["g", "b"], "bar"), ("t", "aggregation", f"x{i}", ["g", "k"], "bar"),
                 ("t", "time_series", f"weekly {i}", ["d", "a"], "line"), ("t", "time_series", f"hourly {i}", ["d", "b"], "bar"),
                 ("t", "correlation", f"m{i}", ["a", "b"], "heatmap"), ("t", "correlation", f"p{i}", ["a", "b"], "scatter"),
                 ("t", "anomaly", f"z{i}", ["b"], "scatter")]
    return spark.createDataFrame([(d, i, t, title, "", cols, chart, 3) for i, (d, t, title, cols, chart) in enumerate(rows)],
                                 "dataset string, seq int, type string, title string, description string, columns array<string>, chart_type string, priority int")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(0, 3000).select(
        "id", (F.col("id") % 83).cast("double").alias("a"), F.when(F.col("id") % 211 == 5, 900).otherwise(F.col("id") % 17).alias("b"),
        F.concat(F.lit("g"), F.col("id") % 4).alias("g"), (F.col("id") % 3 == 0).alias("k"),
        F.timestamp_add("HOUR", F.col("id") % 999, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("d"))


def test_plan_scans_do_not_depend_on_its_tasks(spark, mixed):
    from tablescope.operators.profile import profile_with_facts
    from tablescope.plans.runner import run_plan
    prof, facts = profile_with_facts(mixed, "t", samples=False)
    prof = spark.createDataFrame(prof.toArrow())
    scans = [_scans(spark, mixed, lambda d, n=n: run_plan(d, "t", _plan_of(spark, n), prof, key="id", facts=facts)) for n in (1, 3)]
    assert scans[0] == scans[1] <= 9          # sums, products, outliers 2, a scatter chart 5


def test_shared_scan_equals_the_templates(spark, mixed):
    from tablescope.operators.profile import profile
    from tablescope.plans import runner
    df = mixed.withColumn("g", F.when(F.col("id") % 50 != 0, F.col("g")))
    prof, plan = profile(df, "t"), _plan_of(spark, 1)
    run = runner.run_plan(df, "t", plan, prof, key="id")
    index = {r["title"]: r for r in run.index.collect()}
    assert len(index) == 9 and not any(r["error"] for r in index.values())
    asked = {"h0": A.histogram(df, "a"), "c0": A.value_counts(df, "g"), "s0": A.group_aggregate(df, "g", "b"), "x0": A.cross_count(df, "g", "k"),
             "weekly 0": A.time_series(df, "d", "a", "week"), "hourly 0": A.hour_of_day(df, "d", "b"), "z0": A.zscore_outliers(df, "b", "id")}
    for title, want in asked.items():
        got = run.results[index[title]["task_id"]].orderBy("seq").drop("seq")
        assert got.schema.simpleString() == want.schema.simpleString(), title
        assert got.collect() == want.collect(), title
    assert run.results[index["p0"]["task_id"]].count() == min(3000, A.scatter_clip(df, "a", "b").count())
