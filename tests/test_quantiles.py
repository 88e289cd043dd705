"""H1 against brute force: wide and narrow bands, edge cases and partition
invariance."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablescope.functions import quantiles as Q


def brute(values, p):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    con = duckdb.connect()
    con.execute("CREATE TABLE t (v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in v])
    return con.execute(f"SELECT quantile_cont(v, {p}) FROM t").fetchone()[0]


def cases():
    rnd = random.Random(3)
    uniform = [round(rnd.uniform(-50, 50), 2) for _ in range(3000)]
    hot = [7.5] * 1500 + [round(rnd.uniform(0, 100), 3) for _ in range(3000)]
    return {"uniform": uniform, "hot_value": hot, "constant": [4.0] * 100,
            "single": [1.25], "two": [1.0, 3.0],
            "with_nulls": [None, 2.0, None, 8.0, 5.0] * 50,
            "inf": [float("-inf"), 1.0, 2.0, 3.0, float("inf")] * 20,
            "some_nan": [round(rnd.uniform(-5, 5), 2) for _ in range(700)] + [float("nan")] * 9,
            "mostly_nan": [1.5, 2.5, 3.5] + [float("nan")] * 400, "all_nan": [float("nan")] * 50}


@pytest.mark.parametrize("name,distinct,margin", [
    *((n, d, Q.BAND_MARGIN) for n in cases() for d in (200_000, 10)),
    ("uniform", 10, 1e-6), ("hot_value", 200_000, 1e-6), ("some_nan", 10, 1e-6)])
def test_exact(spark, monkeypatch, name, distinct, margin):
    # a band of at most ten distinct values forces narrowing passes; a margin
    # far below the sketch's error makes ranks miss their bands
    monkeypatch.setattr(Q, "BAND_DISTINCT", distinct)
    monkeypatch.setattr(Q, "BAND_MARGIN", margin)
    monkeypatch.setattr(Q, "KLL_K", 4000 if margin > 1e-3 else 64)
    vals = cases()[name]
    df = spark.createDataFrame([(x,) for x in vals], "v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = Q.column_quantiles(df, F.col("v"), probs)
    n = sum(1 for x in vals if x is not None)
    for p, g in zip(probs, got):
        want = brute(vals, p)
        if want is None or (isinstance(want, float) and math.isnan(want)):
            assert g is None or math.isnan(g)
        elif ((n - 1) * p) % 1 == 0 or math.isinf(want):
            assert g == want, (name, p, g, want)      # an order statistic: exact
        else:
            # interpolated: the rank selection is exact; the last bit of the
            # interpolation depends on the engine's evaluation order
            assert math.isclose(g, want, rel_tol=1e-12, abs_tol=1e-12), (name, p, g, want)


def test_empty(spark):
    df = spark.createDataFrame([], "v double")
    assert Q.column_quantiles(df, F.col("v"), [0.5]) == [None]


def test_nan_ranks_last(spark):
    vals = [1.0, 2.0, float("nan"), 3.0]
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    lo, hi = Q.column_quantiles(df, F.col("v"), [0.0, 1.0])
    assert lo == 1.0 and math.isnan(hi)


def test_partition_invariance(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), rnd.gauss(0, 1)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double")
    one = Q.grouped_quantiles(df.coalesce(1), [0.1, 0.5, 0.9])
    many = Q.grouped_quantiles(df.repartition(16), [0.1, 0.5, 0.9])
    assert sorted(one.collect()) == sorted(many.collect())


def test_multi_column_equals_single(spark):
    rnd = random.Random(1)
    rows = [(rnd.random(), rnd.randint(0, 9) * 1.0) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double")
    multi = Q.multi_column_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.3, 0.7])
    assert multi["a"] == Q.column_quantiles(df, F.col("a"), [0.3, 0.7])
    assert multi["b"] == Q.column_quantiles(df, F.col("b"), [0.3, 0.7])


@pytest.mark.parametrize("rows_of_an_array, margin", [(10_000, Q.BAND_MARGIN), (50, Q.BAND_MARGIN), (50, 1e-6), (0, 0.05)])
def test_grouped_like_columns(spark, monkeypatch, rows_of_an_array, margin):
    """Many groups of all sizes, NaN in some; arrays, bands, and bands that miss their ranks."""
    monkeypatch.setattr(Q, "GROUP_ROWS", rows_of_an_array)
    monkeypatch.setattr(Q, "BAND_MARGIN", margin)
    monkeypatch.setattr(Q, "KLL_K", 4000 if margin > 1e-3 else 64)
    rnd = random.Random(2)
    rows = [(f"g{i % 4}", rnd.choice([rnd.gauss(0, 9), float(rnd.randint(0, 3)), float("nan") if i % 4 == 3 else 1.0]))
            for i in range(8000)] + [("one", 2.0), ("nan", float("nan")), ("two", 1.0), ("two", float("inf"))] + [("nans", float("nan"))] * 60
    df = spark.createDataFrame([*rows, ("none", None), (None, 1.0)], "k string, v double").repartition(4)
    probs = [0.0, 0.25, 0.5, 1.0]
    got = {r["k"]: r["q"] for r in Q.grouped_quantiles(df, probs).collect()}
    assert got.keys() == {r[0] for r in rows}
    for k in got:
        values = sorted((math.isnan(v), v) for g, v in rows if g == k)
        for p, q in zip(probs, got[k]):
            pos = (len(values) - 1) * p
            a, b = values[math.floor(pos)][1], values[math.ceil(pos)][1]
            want = a if a == b or pos == math.floor(pos) else a + (pos - math.floor(pos)) * (b - a)
            assert repr(q) == repr(want), (k, p)


def test_grouped_quantiles_leave_the_driver_alone(spark, monkeypatch):
    """Twenty thousand groups, and neither a row of them collected nor a table made from the driver."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    monkeypatch.setattr(Q, "GROUP_ROWS", 30)
    df = spark.range(0, 300_000).select((F.col("id") % 20_000).alias("k"), F.col("id").cast("double").alias("v"))
    df = df.unionByName(spark.range(0, 20_000).select(F.lit(7).cast("long").alias("k"), (F.col("id") * 1.0).alias("v")))
    with monkeypatch.context() as m:
        def refuse(*args, **kw):
            raise AssertionError("rows on the driver")
        for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
            m.setattr(Classic, name, refuse)
        m.setattr(type(spark), "createDataFrame", refuse)
        found = Q.grouped_quantiles(df, [0.0, 0.5])
    assert found.count() == 20_000
    assert found.where("k = 3").first()["q"] == [3.0, 140_003.0]


def test_number_of_jobs_does_not_depend_on_columns(spark):
    """Narrow and wide tables take the same passes."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        df = spark.range(0, 2000).select(*[(F.col("id") * (j + 1) % 997).cast("double").alias(f"c{j}") for j in range(n)])
        spark.sparkContext.setJobGroup(f"quantiles-{n}", "")
        Q.multi_column_quantiles(df, {f"c{j}": F.col(f"c{j}") for j in range(n)}, [0.5])
        spark.sparkContext.setJobGroup("other", "")
        return len(tracker.getJobIdsForGroup(f"quantiles-{n}"))
    assert jobs(20) == jobs(2)
