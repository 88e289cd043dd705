"""Profile and typing edge cases."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators import profile as P


def _by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_all_null_and_types(spark):
    rows = [(None, Decimal("1.50"), True, bytearray(b"x"), dt.date(2024, 1, 1), "a", [1, 2])] * 4
    df = spark.createDataFrame(
        rows, "n double, d decimal(10,2), b boolean, bin binary, day date, s string, arr array<int>")
    p = _by_name(P.profile(df, "t"))
    assert p["n"]["missing_count"] == 4 and p["n"]["missing_pct"] == 100.0
    assert p["n"]["unique_count"] == 0 and p["n"]["mean_val"] is None
    assert p["d"]["category"] == "numeric" and p["d"]["mean_val"] == 1.5
    assert p["b"]["category"] == "boolean"
    assert p["bin"]["category"] == "text"
    assert p["day"]["category"] == "datetime"
    assert p["s"]["category"] == "categorical"
    assert p["arr"]["category"] == "categorical" and p["arr"]["sample_values"] == ["[1,2]"]


def test_zero_rows(spark):
    df = spark.createDataFrame([], "a double, b string")
    p = _by_name(P.profile(df, "t"))
    assert p["a"]["row_count"] == 0 and p["a"]["missing_pct"] == 0.0


def test_text_rule_boundaries(spark):
    # 101 distinct of 126 rows: ratio 0.8016 > 0.8 and unique > 100 -> text
    rows = [(f"v{i}",) for i in range(101)] + [("v0",)] * 25
    assert _by_name(P.profile(spark.createDataFrame(rows, "s string")))["s"]["category"] == "text"
    # 100 distinct: never text
    rows = [(f"v{i}",) for i in range(100)]
    assert _by_name(P.profile(spark.createDataFrame(rows, "s string")))["s"]["category"] == "categorical"
    # ratio exactly 0.8 is not above it
    rows = [(f"v{i}",) for i in range(200)] + [("v0",)] * 50
    assert _by_name(P.profile(spark.createDataFrame(rows, "s string")))["s"]["category"] == "categorical"


def test_groupable_50_51(spark):
    rows = [(f"a{i % 50}", f"b{i % 51}") for i in range(2000)]
    prof = P.profile(spark.createDataFrame(rows, "a string, b string"), "t", samples=False)
    assert [r["name"] for r in P.groupable_columns(prof).collect()] == ["a"]
    rows = [(f"a{i % 60}", f"b{i % 51}", f"c{i % 70}", f"d{i % 80}") for i in range(2000)]
    prof = P.profile(spark.createDataFrame(rows, "a string, b string, c string, d string"), "t",
                     samples=False)
    assert [r["name"] for r in P.groupable_columns(prof).orderBy("pos").collect()] == ["a", "b", "c"]


def test_nan_counts_as_one_distinct_value(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (1.0,)], "v double")
    assert _by_name(P.profile(df))["v"]["unique_count"] == 2


def test_missing_counts_long(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    got = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in P.missing_counts(df).collect()}
    assert got == {"a": (1, 33.33), "b": (2, 66.67)}


def test_summary_high_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    s = P.profile_summary(P.profile(df, "t")).first()
    assert s["high_missing"] == ["b"] and s["numeric_count"] == 1


def test_cardinality_tags(spark):
    prof = spark.createDataFrame(
        [("t", 0, "a", "categorical", 2), ("t", 1, "b", "categorical", 20),
         ("t", 2, "c", "categorical", 21), ("t", 3, "d", "categorical", 501),
         ("t", 4, "e", "text", 5), ("t", 5, "f", "numeric", 3)],
        "dataset string, pos int, name string, category string, unique_count long")
    got = {r["name"]: r["tag"] for r in P.cardinality_tags(prof).collect()}
    assert got == {"a": "BINARY", "b": "CAT-LOW", "c": "CAT-MEDIUM", "d": "TEXT/ID",
                   "e": "TEXT/ID", "f": None}


def test_wide_table_batches(spark):
    # 70 columns = two batches; column j has j + 1 distinct values
    cols = [(F.col("id") % (j + 1)).alias(f"c{j}") for j in range(70)]
    df = spark.range(0, 200).select(*cols)
    p = _by_name(P.profile(df, "wide", samples=True, medians=False))
    assert all(p[f"c{j}"]["unique_count"] == j + 1 for j in range(70))
    assert p["c69"]["sample_values"] == ["0", "1", "2", "3", "4"]


def test_approx_mode(spark):
    df = spark.range(0, 20000).select((F.col("id") % 1000).alias("a"), F.col("id").cast("string").alias("s"))
    p = _by_name(P.profile(df, "t", approx=True, samples=False))
    # HyperLogLog with Spark's default relative standard deviation 0.05: 3 sd
    assert abs(p["a"]["unique_count"] - 1000) <= 150
    assert abs(p["s"]["unique_count"] - 20000) <= 3000
    assert p["s"]["category"] == "text"


def test_ungroupable_types(spark):
    df = spark.createDataFrame([({"a": 1}, '{"k": 1}', [{"x": 1}]), ({"a": 2}, '{"k": 1}', [{"x": 1}])],
                               "m map<string,int>, j string, am array<map<string,int>>") \
              .select("m", F.parse_json("j").alias("v"), "am")
    p = _by_name(P.profile(df, "t"))
    assert p["m"]["unique_count"] == 2 and p["v"]["unique_count"] == 1 and p["am"]["unique_count"] == 1
    assert p["v"]["sample_values"] == ['{"k":1}']


def test_samples_compare_whole_values_in_one_scan(spark):
    import datetime as dt
    import decimal

    from tablescope.operators import profile as P
    head = "h" * 220
    nan = float("nan")
    rows = [(f"{head}{i % 9}", [None, nan, -0.0, 0.0, 2.5, 1e9, -1.0, float("inf")][i % 8], dt.date(2024, 1, 1 + i % 7), i % 2 == 0,
             bytes([i % 11]), decimal.Decimal(i % 13) / 4, [i % 6], {"k": i % 4}, dt.datetime(2024, 1, 1, i % 23)) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, d double, day date, b boolean, raw binary, n decimal(9,2), a array<int>, m map<string,int>, "
                                     "ts timestamp_ntz").repartition(7)
    fields = df.schema.fields
    got = P.smallest_values(df, fields)
    keys = {i: P._distinct_key(f) for i, f in enumerate(fields)}
    want = P._least(df.select(*[F.to_json("a").alias(f.name) if f.name == "a" else F.col(f.name) for f in fields]),
                    {i: (k, T.StringType() if f.name == "a" else t) for (i, (k, t)), f in zip(keys.items(), fields)}, 5)
    assert {i: len(v) for i, v in got.items()} == {0: 5, 1: 5, 2: 5, 3: 2, 4: 5, 5: 5, 6: 5, 7: 4, 8: 5}
    assert {i: v for i, v in got.items() if i != 1} == {i: v for i, v in want.items() if i != 1}
    assert got[1] == ["-1.0", "0.0", "2.5", "1.0E9", "Infinity"] and set(got[0]) == {"h" * 200}
    assert P.smallest_values(df.limit(0), fields) == {i: [] for i in range(len(fields))}
