"""Chart-kind correction (C1), plottability (C2) and series shapes."""

from pyspark.sql import functions as F

from tablescope.operators import series as S


def _res(spark, xs, ys=None):
    ys = ys or [1.0] * len(xs)
    return S.with_seq(spark.createDataFrame(list(zip(xs, ys)), "x string, y double"))


def kind(spark, xs, planned, ys=None, has_y=True):
    return S.chart_kind(_res(spark, xs, ys), "x", "y" if has_y else None, planned).first()["chart_kind"]


def test_chart_kind_rules(spark):
    assert kind(spark, ["a", "b", "c"], "scatter") == "pie"          # scatter -> bar -> pie (2-5)
    assert kind(spark, [str(i) for i in range(20)], "scatter") == "scatter"   # numeric, >15 distinct
    assert kind(spark, [f"c{i}" for i in range(12)], "pie") == "bar"  # pie with > 10 slices
    assert kind(spark, ["a", "b"], "bar") == "pie"
    assert kind(spark, ["a"], "bar") == "bar"                          # 1 distinct: stays bar
    assert kind(spark, ["a", "b"], "bar", has_y=False) == "bar"        # no y: no pie
    assert kind(spark, [str(i) for i in range(6)], "bar") == "bar"     # 6 distinct
    assert kind(spark, ["1.5", "2.5"], "histogram") == "histogram"     # histogram untouched


def test_plottable(spark):
    p = lambda xs, ys: S.plottable(_res(spark, xs, ys), "x", "y").first()["plottable"]
    assert p(["a", "b"], [1.0, 2.0]) is True
    assert p(["a"], [1.0]) is False                  # fewer than two rows
    assert p(["a", "b"], [0.0, 0.0]) is False        # all zero


def test_series_bar_axis(spark):
    num = S.series_bar(_res(spark, ["1.5", "2"]), "x", "y").orderBy("seq").collect()
    assert [r["x_axis"] for r in num] == ["linear", "linear"] and num[0]["x_num"] == 1.5
    cat = S.series_bar(_res(spark, ["a", None]), "x", "y").orderBy("seq").collect()
    assert [r["x_label"] for r in cat] == ["a", ""]


def test_series_pie_share(spark):
    res = _res(spark, [f"c{i}" for i in range(14)], [float(i + 1) for i in range(14)])
    rows = S.series_pie(res, "x", "y").collect()
    assert len(rows) == 14 and abs(sum(r["share"] for r in rows) - 1.0) < 1e-12
    first = S.series_pie(res, "x", "y", S.PIE_ROWS).orderBy("seq").collect()
    assert len(first) == 12 and first[3]["share"] == 4 / 105          # of the whole, not of the twelve
