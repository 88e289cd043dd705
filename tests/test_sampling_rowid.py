"""Exact-size samples and distributed row numbers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablescope.functions.rowid import positions_of, with_row_number
from tablescope.operators import sampling as R


def test_sample_exact_size_subset_and_partition_invariance(spark):
    df = spark.range(0, 50000).select("id", (F.col("id") % 13).alias("g"))
    a = R.sample_exact(df.repartition(1), 1000, seed=5, key=["id"])
    b = R.sample_exact(df.repartition(9), 1000, seed=5, key=["id"])
    ra = sorted(r["id"] for r in a.collect())
    assert len(ra) == 1000 and len(set(ra)) == 1000
    assert ra == sorted(r["id"] for r in b.collect())
    assert all(0 <= x < 50000 for x in ra)


def test_sample_smaller_table_returns_all(spark):
    df = spark.range(0, 10)
    assert R.sample_exact(df, 100).count() == 10


def test_sample_copies_drawn_independently(spark):
    # a third of the rows are copies of one row; without a key they must not
    # be all-or-nothing
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit(-1))
                                      .otherwise(F.col("id")).alias("v"))
    s = R.sample_exact(df, 3000, seed=11)
    hot = s.where("v = -1").count()
    assert s.count() == 3000 and 700 < hot < 1300


def test_scaling_strategy(spark):
    counts = spark.createDataFrame([("a", 500000), ("b", 500001), ("c", 5000000), ("d", 5000001)],
                                   "dataset string, row_count long")
    got = {r["dataset"]: (r["strategy"], r["sample_size"]) for r in R.scaling_strategy(counts).collect()}
    assert got == {"a": ("full", None), "b": ("sample", 100000), "c": ("sample", 100000),
                   "d": ("aggregate", 100000)}


def test_row_number_matches_global_window(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3001).alias("k"), "id")
    got = {r["id"]: r["row_id"] for r in with_row_number(df, ["k"]).collect()}
    want = {r["id"]: r["rn"] for r in
            df.select("id", F.row_number().over(Window.orderBy("k")).alias("rn")).collect()}
    assert got == want


def test_row_number_hot_key_is_spread(spark):
    df = spark.range(0, 6000).select(F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id")).alias("k"))
    out = with_row_number(df, ["k"])
    ids = sorted(r["row_id"] for r in out.collect())
    assert ids == list(range(1, 6001))


def test_positions_of(spark):
    df = spark.range(0, 100).select((F.col("id") * 2).alias("k"))
    assert positions_of(df, "k", [0, 10, 198]) == {0: 1, 10: 6, 198: 100}


def test_positions_of_pairs_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (None, 2.0), (3, 1.0), (None, 9.0), (1, 7.0)], "k int, v double")
    assert positions_of(df, "k", [(1, 5.0), (1, 7.0), (3, 1.0), (None, 2.0), (None, 9.0)], "v") == \
        {(1, 5.0): 1, (1, 7.0): 2, (3, 1.0): 4, (None, 2.0): 5, (None, 9.0): 6}


def test_analysis_frames(spark):
    """All rows, whatever their number, unless a sample is asked for; aggregates keep all even then."""
    df = spark.range(0, 3000).select("id", (F.col("id") % 7).alias("g"))
    agg, raw = R.analysis_frames(df, key=["id"])
    assert agg is df and raw is df
    agg, raw = R.analysis_frames(df, 500, key=["id"])
    assert agg is df and raw.count() == 500


def test_row_number_block_of_identical_rows(spark):
    # a third of the rows are identical copies (same key, same content)
    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1))
                                     .otherwise(F.col("id")).alias("k"))
    out = with_row_number(df, ["k"])
    assert sorted(r["row_id"] for r in out.collect()) == list(range(1, 6001))
    assert out.where("k = -1").agg(F.max("row_id")).first()[0] == 2000


def test_sample_is_the_rows_of_smallest_hashes(spark):
    from tablescope.operators import sampling as R
    df = spark.range(0, 20_000).select("id", (F.col("id") % 7).alias("g")).repartition(9)
    rate = (700 + 8 * 700 ** 0.5 + 64) / 20_000
    some = df.withColumn("h", F.xxhash64("id", F.lit(5))).where(F.pmod("h", F.lit(2 ** 53)) / F.lit(float(2 ** 53)) < rate)
    want = {r["id"] for r in some.orderBy("h").limit(700).collect()}
    got = R.sample_exact(df, 700, seed=5, key=["id"])
    assert {r["id"] for r in got.collect()} == want and got.count() == 700 and got.columns == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    hot = R.sample_exact(df, 5000, seed=5, key=["g"])                     # seven hashes, some 2,857 rows each
    assert hot.count() == 5000 and hot.select("g").distinct().count() == 2
    values = [-(1 << 63), -1, 0, 5, 5, 5, 9, (1 << 63) - 1]
    numbers = spark.createDataFrame([(v,) for v in values], "h long")
    assert [R._nth_smallest(numbers, "h", n) for n in range(1, 9)] == [
        (v, values[:i + 1].count(v)) for i, v in enumerate(values)]
