"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the given test tables. Computed
doubles are rounded to 6 digits (4 where the template itself rounds) so
results compare across engines."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import round_doubles, try_timestamp_guarded
from .functions.quantiles import multi_column_quantiles
from .functions.json_safe import json_safe
from .functions.rowid import with_row_number
from .operators import analyses as A
from .operators import correlation as C
from .operators import profile as P
from .operators import sampling as R
from .operators import series as S
from .session import TABLES, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# Columns used by several queries (fixed choices of the checks).
CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def orders_with_nulls(spark, sf) -> DataFrame:
    """Stand-in input for the missing-value checks: orders with NULLs put in
    by value (the test tables have none)."""
    o = _t(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.nullif(F.col("o_custkey"), F.lit(7)).alias("o_custkey"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("o_orderstatus"),
        "o_totalprice", "o_orderdate",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))


# -- sources / shape ---------------------------------------------------------

@query("scan_parquet")
def q_scan_parquet(spark, sf):
    return _t(spark, sf, "lineitem")


@query("dataset_shape")
def q_dataset_shape(spark, sf):
    df = _t(spark, sf, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("row_count")) \
             .select("row_count", F.lit(len(df.columns)).alias("column_count"))


@query("preview")
def q_preview(spark, sf):
    return A.preview(_t(spark, sf, "orders"), ["o_orderkey"])


@query("overview")
def q_overview(spark, sf):
    return A.overview(_t(spark, sf, "orders"), ["o_orderkey"])


# -- bounds, clip, J1 ----------------------------------------------------------

@query("percentile_bounds")
def q_percentile_bounds(spark, sf):
    lo, hi = A.percentile_bounds(_t(spark, sf, "events"), "value")
    return round_doubles(spark.createDataFrame([(lo, hi)], "lo double, hi double"), 6)


@query("percentile_clip")
def q_percentile_clip(spark, sf):
    return A.percentile_clip(_t(spark, sf, "lineitem"), "l_extendedprice")


@query("attach_stats")
def q_attach_stats(spark, sf):
    return round_doubles(A.attach_stats(_t(spark, sf, "events"), "value", keep=["event_id"]), 6)


@query("try_cast_timestamp")
def q_try_cast_timestamp(spark, sf):
    e = _t(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", F.col("props")) \
           .otherwise(F.col("ts").cast("string"))
    return e.select("event_id", raw.alias("raw")) \
            .select("event_id", "raw", try_timestamp_guarded(F.col("raw")).alias("parsed"))


# -- templates ----------------------------------------------------------------

@query("histogram")
def q_histogram(spark, sf):
    return A.histogram(_t(spark, sf, "events"), "value")


@query("histogram_extprice")
def q_histogram_extprice(spark, sf):
    return A.histogram(_t(spark, sf, "lineitem"), "l_extendedprice")


@query("value_counts")
def q_value_counts(spark, sf):
    return A.value_counts(_t(spark, sf, "orders"), "o_orderpriority", A.VALUE_COUNTS_TOP)


@query("value_counts_props")
def q_value_counts_props(spark, sf):
    """The top-30 report of a column with more values; ``value_counts_all`` has them all."""
    return A.value_counts(_t(spark, sf, "events"), "props", A.VALUE_COUNTS_TOP)


@query("value_counts_all")
def q_value_counts_all(spark, sf):
    return A.value_counts(_t(spark, sf, "events"), "props")


@query("group_aggregate")
def q_group_aggregate(spark, sf):
    return A.group_aggregate(_t(spark, sf, "orders"), "o_orderpriority", "o_totalprice", A.GROUPS_TOP)


@query("cross_count")
def q_cross_count(spark, sf):
    return A.cross_count(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", A.CROSS_COUNTS_TOP)


@query("time_series_day")
def q_ts_day(spark, sf):
    return round_doubles(A.time_series(_t(spark, sf, "events"), "ts", "value", "day"), 6)


@query("time_series_week")
def q_ts_week(spark, sf):
    return round_doubles(A.time_series(_t(spark, sf, "events"), "ts", "value", "week"), 6)


@query("time_series_month")
def q_ts_month(spark, sf):
    return round_doubles(A.time_series(_t(spark, sf, "orders"), "o_orderdate",
                                       "o_totalprice", "month"), 6)


@query("time_series_day_365")
def q_ts_day_365(spark, sf):
    """The first 365 days, a chart's limit; ``time_series_all`` has them all."""
    return round_doubles(A.time_series(_t(spark, sf, "lineitem"), "l_shipdate",
                                       "l_extendedprice", "day", A.PERIODS_MAX), 6)


@query("time_series_all")
def q_ts_all(spark, sf):
    return round_doubles(A.time_series(_t(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", "day"), 6)


@query("hour_of_day")
def q_hour_of_day(spark, sf):
    return round_doubles(A.hour_of_day(_t(spark, sf, "events"), "ts", "value"), 6)


@query("scatter_clip")
def q_scatter_clip(spark, sf):
    return A.scatter_clip(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("scatter_sample")
def q_scatter_sample(spark, sf):
    return A.scatter(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("zscore_outliers")
def q_zscore_outliers(spark, sf):
    return A.zscore_outliers(_t(spark, sf, "events"), "value", order_col="event_id", top=A.OUTLIERS_TOP)


def odd_values(spark, sf) -> DataFrame:
    """Events whose values are NaN or infinite now and then."""
    v = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 997 == 0, float("-inf")).otherwise(F.col("value"))
    return _t(spark, sf, "events").select("event_id", v.alias("value"))


@query("zscore_nan")
def q_zscore_nan(spark, sf):
    found = A.zscore_outliers(odd_values(spark, sf), "value", order_col="event_id")
    return found.select("row_id", F.col("value").cast("string").alias("value"), F.col("z_score").cast("string").alias("z_score")) \
        .where("value = '-Infinity'").unionByName(found.where("value > -1e300").select(
            "row_id", F.lit("finite").alias("value"), F.round(F.col("z_score") * 1000).cast("bigint").cast("string").alias("z_score")))


@query("outlier_count_nan")
def q_outlier_count_nan(spark, sf):
    return A.outlier_count(odd_values(spark, sf), "value")


@query("zscore_dup_key")
def q_zscore_dup_key(spark, sf):
    """All outliers, in the order of a key that repeats and has nulls."""
    k = F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 50)
    return A.zscore_outliers(_t(spark, sf, "events").select(k.alias("k"), "value"), "value", order_col="k")


@query("outlier_count")
def q_outlier_count(spark, sf):
    return A.outlier_count(_t(spark, sf, "events"), "value")


@query("row_ids")
def q_row_ids(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "value")
    return with_row_number(e, ["event_id"])


@query("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return round_doubles(C.correlation_matrix(_t(spark, sf, "lineitem"), CORR_COLUMNS), 6)


@query("correlation_all_numeric")
def q_correlation_all(spark, sf):
    li = _t(spark, sf, "lineitem")
    names = [f.name for f in li.schema.fields if P.base_category(f.dataType) == "numeric"]
    return round_doubles(C.correlation_matrix(li, names), 6)


@query("heatmap_matrix")
def q_heatmap_matrix(spark, sf):
    pairs = C.correlation_matrix(_t(spark, sf, "lineitem"), CORR_COLUMNS)
    return round_doubles(C.heatmap_matrix(pairs), 6)


# -- sampling / scaling -----------------------------------------------------------

@query("scaling_strategy")
def q_scaling_strategy(spark, sf):
    return R.scaling_strategy(R.table_counts({t: _t(spark, sf, t) for t in TABLES}))


@query("sample_exact")
def q_sample_exact(spark, sf):
    li = _t(spark, sf, "lineitem")
    return R.sample_exact(li, R.SAMPLE_ROWS, seed=42, key=["l_orderkey", "l_linenumber"])


@query("sample_exact_scatter_size")
def q_sample_exact_small(spark, sf):
    li = _t(spark, sf, "lineitem")
    return R.sample_exact(li, A.SCATTER_ROWS, seed=7, key=["l_orderkey", "l_linenumber"])


@query("sample_facts")
def q_sample_facts(spark, sf):
    """Of samples of two sizes: rows, distinct keys, and keys that are the table's."""
    li, key = _t(spark, sf, "orders"), ["o_orderkey"]
    out = None
    for n, seed in ((R.SAMPLE_ROWS, 42), (A.SCATTER_ROWS, 7)):
        got = R.sample_exact(li, n, seed=seed, key=key)
        part = (got.agg(F.count("*").alias("rows"), F.count_distinct(*key).alias("distinct_keys"))
                .crossJoin(got.join(li.select(*key), key, "left_semi").agg(F.count("*").alias("members")))
                .select(F.lit(n).cast("bigint").alias("asked"), "rows", "distinct_keys", "members"))
        out = part if out is None else out.unionByName(part)
    return out


# -- profile and typing -------------------------------------------------------------

@query("missing_counts")
def q_missing_counts(spark, sf):
    return P.missing_counts(orders_with_nulls(spark, sf))


@query("distinct_counts")
def q_distinct_counts(spark, sf):
    return P.distinct_counts(_t(spark, sf, "orders"))


@query("sample_values")
def q_sample_values(spark, sf):
    p = P.profile(_t(spark, sf, "customer"), "customer")
    return p.select("pos", "name", F.array_join("sample_values", ", ").alias("sample_values"))


@query("numeric_profile")
def q_numeric_profile(spark, sf):
    return P.numeric_profile(_t(spark, sf, "lineitem"))


def _profile_out(p: DataFrame) -> DataFrame:
    return p.select(*[c for c in p.columns if c not in ("sample_values", "dataset")],
                    F.array_join("sample_values", ", ").alias("sample_values"))


@query("profile")
def q_profile(spark, sf):
    return _profile_out(P.profile(orders_with_nulls(spark, sf), "orders"))


@query("profile_summary")
def q_profile_summary(spark, sf):
    s = P.profile_summary(P.profile(_t(spark, sf, "customer"), "customer"))
    return s.select(*[c for c in s.columns if c != "high_missing"],
                    F.array_join("high_missing", ", ").alias("high_missing"))


@query("column_categories")
def q_column_categories(spark, sf):
    p = P.profile(_t(spark, sf, "customer"), "customer", samples=False, medians=False)
    return p.select("pos", "name", "dtype", "unique_count", "row_count", "category")


@query("cardinality_tags")
def q_cardinality_tags(spark, sf):
    p = P.profile(_t(spark, sf, "orders"), "orders", samples=False, medians=False)
    return P.cardinality_tags(p).drop("dataset")


@query("groupable_columns")
def q_groupable_columns(spark, sf):
    prof = P.profile_catalog({t: _t(spark, sf, t) for t in ("events", "customer")},
                             samples=False, medians=False)
    return P.groupable_columns(prof)


# -- files: sources and sinks ---------------------------------------------------

from .operators import adhoc as Q  # noqa: E402
from .operators import history as H  # noqa: E402
from .plans import insights as L  # noqa: E402
from .plans import planner as PL  # noqa: E402
from .plans import report as RP  # noqa: E402
from .plans.runner import run_plan  # noqa: E402
from .sources import files as SRC  # noqa: E402
from .sources import sinks as SNK  # noqa: E402
from .streaming.run_state import read_run_state, run_state_stream  # noqa: E402


def orders_as_token_text(spark, sf) -> DataFrame:
    """Stand-in CSV content: orders as text, with null tokens in place of
    some values and a blank-header index column in front."""
    o = _t(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("_idx"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_custkey") == 7, F.lit("NA")).otherwise(F.col("o_custkey").cast("string"))
         .alias("o_custkey"),
        F.when(F.col("o_orderstatus") == "F", F.lit("N/A")).otherwise(F.col("o_orderstatus"))
         .alias("o_orderstatus"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("NULL"))
         .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def _write_token_csv(spark, sf, sep=",", encoding="UTF-8") -> str:
    path = SRC.scratch_path(spark, "csv")
    text = orders_as_token_text(spark, sf).withColumnRenamed("_idx", "Unnamed: 0")
    text.write.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').csv(path)
    return path


@query("csv_null_tokens")
def q_csv_null_tokens(spark, sf):
    return SRC.read_csv_tokens(spark, _write_token_csv(spark, sf), sep=",")


@query("infer_types")
def q_infer_types(spark, sf):
    raw = SRC.null_tokens_to_null(orders_as_token_text(spark, sf).drop("_idx"))
    types = SRC.infer_types(raw)
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(types.items())],
                                 "pos int, column string, inferred string")


@query("sniff_delimiter")
def q_sniff_delimiter(spark, sf):
    rows = []
    for name, sep in (("comma.csv", ","), ("tab.tsv", "\t"), ("semicolon.txt", ";"),
                      ("pipe.txt", "|")):
        path = SRC.scratch_path(spark, name)
        _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                         "l_extendedprice") \
            .write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
        rows.append((name, sep, SRC.sniff_delimiter(spark, path)))
    return spark.createDataFrame(rows, "file string, written string, detected string")


@query("sniff_quoted")
def q_sniff_quoted(spark, sf):
    """Whole documents, quoted, separators and line breaks in them."""
    rows = []
    for name, sep in (("comma.csv", ","), ("tab.tsv", "\t"), ("semicolon.txt", ";"), ("pipe.txt", "|")):
        path = SRC.scratch_path(spark, name)
        d = _t(spark, sf, "documents")
        (d.select("doc_id", "lang", F.concat(F.lit(f"x{sep}y "), "text").alias("text"), "source")
         .write.option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path))
        rows.append((name, sep, SRC.sniff_delimiter(spark, path)))
    return spark.createDataFrame(rows, "file string, written string, detected string")


@query("csv_no_header")
def q_csv_no_header(spark, sf):
    path = SRC.scratch_path(spark, "bare")
    orders_as_token_text(spark, sf).write.option("header", False).option("escape", '"').csv(path)
    return SRC.read_csv_tokens(spark, path, sep=",", header=False)


@query("keep_real_c1")
def q_keep_real_c1(spark, sf):
    """A blank header goes; columns that are called _c1 and _c2 stay."""
    path = SRC.scratch_path(spark, "named")
    _t(spark, sf, "orders").select(F.col("o_custkey").alias(" "), F.col("o_orderkey").alias("_c1"), F.col("o_orderstatus").alias("_c2")) \
        .write.option("header", True).option("escape", '"').csv(path)
    return SRC.read_csv_tokens(spark, path, sep=",")


def _written_as_text(df: DataFrame, path: str) -> str:
    """CSV as other programs write it: doubled quotes, cells as they are."""
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query("csv_doubled_quotes")
def q_csv_doubled_quotes(spark, sf):
    """Cells with quotes, separators and backslashes, some at a cell's end."""
    said = F.concat(F.lit('say "'), "source", F.lit('", '), "text", F.lit(' "so"'))
    df = _t(spark, sf, "documents").select("doc_id", said.alias("said"), F.concat("lang", F.lit(':\\')).alias("folder"), "n_chars")
    return SRC.read_csv_tokens(spark, _written_as_text(df, SRC.scratch_path(spark, "quotes")), sep=",")


@query("csv_line_breaks")
def q_csv_line_breaks(spark, sf):
    """Quoted line breaks and doubled quotes, found and cut by the reader itself."""
    broken = F.replace(F.replace("text", F.lit(". "), F.lit('.\n"')), F.lit(", "), F.lit('",\n\n'))
    df = _t(spark, sf, "documents").select("doc_id", broken.alias("text"), "source", "lang")
    return SRC.read_csv_tokens(spark, _written_as_text(df, SRC.scratch_path(spark, "breaks")))


@query("csv_letter_codes")
def q_csv_letter_codes(spark, sf):
    """Codes that end in d, f or D look like Java's number literals; they are text."""
    o = _t(spark, sf, "orders")
    code = lambda letter: F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(letter))
    df = o.select("o_orderkey", code("d").alias("desk"), code("F").alias("floor"), code("e1").alias("tens"))
    return SRC.read_csv_tokens(spark, _written_as_text(df, SRC.scratch_path(spark, "codes")))


@query("json_array_split")
def q_json_array_split(spark, sf):
    """One file that is one array, with brackets and quotes in its strings, read by many tasks."""
    e, path = _t(spark, sf, "events"), SRC.scratch_path(spark, "array")
    said = e.withColumn("note", F.concat(F.lit('}], {"'), "event_type", F.lit('\\"')))
    rows = said.select(F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))

    def framed(batches):
        """The array's elements as they come: one file has one writer, which holds a batch at a time."""
        yield pa.record_batch({"value": pa.array(["["])})
        lead = ""
        for batch in batches:
            for value in (batch["value"].slice(0, 1), batch["value"].slice(1)):
                if len(value):
                    yield pa.record_batch({"value": pc.binary_join_element_wise(lead, value, "")})
                    lead = ","
        yield pa.record_batch({"value": pa.array(["]"])})

    rows.coalesce(1).mapInArrow(framed, "value string").write.text(path)
    return SRC.read_json(spark, path).select("event_id", "ts", "user_id", "event_type", "value", "props", "note")


@query("json_bad_line")
def q_json_bad_line(spark, sf):
    """A truncated record among the good ones, asked to be left out."""
    path = SRC.scratch_path(spark, "ndjson-bad")
    e = _t(spark, sf, "events")
    e.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    spark.createDataFrame([('{"event_id": 1, "ts": "2024-01-01T00:0',)], "value string").write.mode("append").text(path)
    return SRC.read_json(spark, path, bad_lines="drop").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("encoding_fallback")
def q_encoding_fallback(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    path = SRC.scratch_path(spark, "latin1")
    (d.write.option("header", True).option("encoding", "ISO-8859-1")
      .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
      .option("escape", '"').csv(path))
    enc = SRC.detect_encoding(spark, path)
    back = SRC.read_csv_tokens(spark, path, sep=",", encoding=enc)
    return back.select(F.lit(enc).alias("encoding"), "*")


@query("scan_json")
def q_scan_json(spark, sf):
    path = SRC.scratch_path(spark, "ndjson")
    (_t(spark, sf, "events").write
       .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))
    return SRC.read_json(spark, path).select("event_id", "ts", "user_id", "event_type",
                                             "value", "props")


@query("file_inventory")
def q_file_inventory(spark, sf):
    return SRC.file_inventory(spark, f"{sf.rstrip('/')}/*.parquet")


@query("drop_index_columns")
def q_drop_index_columns(spark, sf):
    """The same table with a blank header and pandas' name for the index."""
    path = SRC.scratch_path(spark, "indexed")
    text = orders_as_token_text(spark, sf)
    (text.select(F.col("_idx").alias(" "), F.col("_idx").alias("Unnamed: 1"), *[c for c in text.columns if c != "_idx"])
     .write.option("header", True).option("escape", '"').csv(path))
    return SRC.read_csv_tokens(spark, path, sep=",")


def run_events_from(spark, sf) -> DataFrame:
    """Stand-in run-event rows: user_id as run id, event_type as status."""
    e = _t(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("id"), F.col("ts"),
        F.col("event_type").alias("status"),
        F.concat(F.lit("upload_"), F.col("event_type"), F.lit(".csv")).alias("filename"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("report_json"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), F.col("props")))
         .alias("error_msg"))


@query("run_events_append")
def q_run_events_append(spark, sf):
    path = SRC.scratch_path(spark, "runs")
    ev = run_events_from(spark, sf)
    SNK.append_run_events(ev.where(F.col("status").isin("view", "click")), path)
    SNK.append_run_events(ev.where(~F.col("status").isin("view", "click")), path)
    return SNK.read_run_events(spark, path)


@query("run_latest_state")
def q_run_latest_state(spark, sf):
    return H.run_latest_state(run_events_from(spark, sf))


@query("recent_runs")
def q_recent_runs(spark, sf):
    return H.recent_runs(H.run_latest_state(run_events_from(spark, sf)))


@query("run_state_stream")
def q_run_state_stream(spark, sf):
    events_dir = SRC.scratch_path(spark, "run-log")
    ev = run_events_from(spark, sf)
    SNK.append_run_events(ev.where(F.col("status").isin("view", "click")), events_dir)
    SNK.append_run_events(ev.where(~F.col("status").isin("view", "click")), events_dir)
    state_dir = SRC.scratch_path(spark, "run-state")
    q = run_state_stream(spark, events_dir, state_dir, SRC.scratch_path(spark, "run-ckpt"))
    q.awaitTermination()
    return read_run_state(spark, state_dir)


@query("last_turns")
def q_last_turns(spark, sf):
    return H.last_turns(_t(spark, sf, "conversations"), H.CONTEXT_TURNS)


@query("bounded_result")
def q_bounded_result(spark, sf):
    return RP.bounded(A.overview(_t(spark, sf, "events"), ["event_id"], 5000), 5000)


@query("json_safe")
def q_json_safe(spark, sf):
    return json_safe(_t(spark, sf, "orders"))


@query("adhoc_sql")
def q_adhoc_sql(spark, sf):
    return Q.ask_sql(_t(spark, sf, "orders"),
                     "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price "
                     "FROM data_table GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")


@query("ask_followup")
def q_ask_followup(spark, sf):
    """Question, answer with SQL, and its result, appended to a conversation."""
    return Q.follow_up(_t(spark, sf, "orders"), _t(spark, sf, "conversations"), 0, "How many orders by status?",
                       "See <sql>SELECT o_orderstatus, count(*) AS n FROM data_table GROUP BY 1 ORDER BY 1</sql>")


def answers_with_sql(spark, sf) -> DataFrame:
    """Stand-in answers: conversation texts, in two of three turns with SQL in
    tags of different case, over several lines, and a second block."""
    body = F.concat(F.lit("\n  SELECT "), F.col("role"), F.lit("\nFROM data_table "))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.concat(
        F.col("text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" <sql>"), body, F.lit("</sql> and <sql>SELECT 2</sql>")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit(" <SQL>"), body, F.lit("</Sql>"))).otherwise(F.lit(" <sql> </sql>"))).alias("text"))


@query("extract_sql")
def q_extract_sql(spark, sf):
    c = answers_with_sql(spark, sf)
    return c.select("conv_id", "turn", Q.extract_sql(F.col("text")).alias("sql"))


#: Ends of stand-in task titles.
TITLE_ENDS = ["Hourly totals", "by time of day", "per WEEK", "Monthly sales", "by month", "annual sum", "over the years", "by day",
              "weekly, by hour"]


@query("granularity")
def q_granularity(spark, sf):
    """Titles made of conversation texts and words for every grain."""
    c = _t(spark, sf, "conversations")
    end = F.element_at(F.array(*[F.lit(t) for t in TITLE_ENDS]), ((F.col("conv_id") + F.col("turn")) % len(TITLE_ENDS) + 1).cast("int"))
    title = F.concat_ws(" ", "text", end)
    return c.select("conv_id", "turn", A.granularity(title).alias("granularity"))


# -- plans, insights, charts ------------------------------------------------------

def _prof(spark, sf, names, samples=True, medians=True):
    return P.profile_catalog({t: _t(spark, sf, t) for t in names}, samples=samples,
                             medians=medians)


def _arr_out(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


@query("heuristic_plan")
def q_heuristic_plan(spark, sf):
    return _arr_out(PL.heuristic_plan(_prof(spark, sf, ("events", "orders"), False, False)), "columns")


@query("plan_order")
def q_plan_order(spark, sf):
    return PL.plan_order(PL.heuristic_plan(_prof(spark, sf, ("events", "orders"), False, False)))


@query("plan_valid_columns")
def q_plan_valid_columns(spark, sf):
    prof = _prof(spark, sf, ("events", "orders"), False, False)
    texts = PL.plan_to_text(PL.heuristic_plan(prof))
    plan = PL.ingest_plan(texts)
    return _arr_out(PL.plan_valid_columns(plan, prof), "columns", "valid_columns")


@query("ingest_plan")
def q_ingest_plan(spark, sf):
    prof = _prof(spark, sf, ("events", "orders"), False, False)
    return _arr_out(PL.ingest_plan(PL.plan_to_text(PL.heuristic_plan(prof))), "columns")


def _run(spark, sf, table, key):
    df = _t(spark, sf, table)
    prof, facts = P.profile_with_facts(df, table, samples=False)
    return df, prof, run_plan(df, table, PL.heuristic_plan(prof), prof, key=key, facts=facts)


@query("run_plan")
def q_run_plan(spark, sf):
    _, _, run = _run(spark, sf, "events", "event_id")
    return run.index.drop("task_id")


def messy_plan_texts(spark, sf) -> DataFrame:
    """Stand-in plan answers, one per customer: prose around a list with a
    task without title, text and number priorities, and items that are no tasks."""
    name, quoted = F.col("c_name"), lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    return _t(spark, sf, "customer").select(name.alias("dataset"), F.concat(
        F.lit('Plan:\n```json\n[{"type": "overview", "title": '), quoted(name), F.lit(', "priority": '), quoted(F.col("c_custkey")),
        F.lit('}, {"type": "distribution", "columns": ["x"]}, {"type": "distribution", "title": '), quoted(F.col("c_nationkey")),
        F.lit(', "description": "d", "columns": ['), quoted(name), F.lit(', "x"], "chart_type": "pie", "priority": "soon"}, '
              '{"type": "anomaly", "title": "last", "priority": 2}, 7]\n``` done')).alias("text"))


@query("ingest_plan_messy")
def q_ingest_plan_messy(spark, sf):
    return _arr_out(PL.ingest_plan(messy_plan_texts(spark, sf)), "columns")


@query("template_insights")
def q_template_insights(spark, sf):
    _, prof, run = _run(spark, sf, "events", "event_id")
    return L.template_insights(prof, run.index)


@query("variability_flags")
def q_variability_flags(spark, sf):
    return L.variability_flags(_prof(spark, sf, ("lineitem",), False))


@query("result_digest")
def q_result_digest(spark, sf):
    _, _, run = _run(spark, sf, "events", "event_id")
    return L.result_digest(run.index, run.results)


@query("stat_lines")
def q_stat_lines(spark, sf):
    return L.stat_lines(_prof(spark, sf, ("lineitem",), False))


@query("stat_lines_large")
def q_stat_lines_large(spark, sf):
    """Statistics from a million to a quadrillion: a customer's orders, counted in units of that size."""
    m = F.col("n") * F.lit(1_000_000.0) * F.pow(F.lit(10.0), (F.col("o_custkey") % 9).cast("double"))
    counted = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return L.stat_lines(counted.select(
        F.lit("big").alias("dataset"), F.col("o_custkey").cast("int").alias("pos"), F.concat(F.lit("customer "), "o_custkey").alias("name"),
        F.lit("numeric").alias("category"), (m * 1.25).alias("mean_val"), m.alias("min_val"), (m * 1.5).alias("max_val"),
        F.lit(0.0).alias("missing_pct")))


@query("schema_digest")
def q_schema_digest(spark, sf):
    return L.schema_digest(_prof(spark, sf, ("orders",)))


@query("report_sections")
def q_report_sections(spark, sf):
    from .plans.analyze import analyze
    out, log = SRC.scratch_path(spark, "report"), SRC.scratch_path(spark, "runs")
    return analyze(spark, _t(spark, sf, "events"), name="events", key="event_id",
                   out_dir=out, run_log=log).report


def _numbered(rows: DataFrame) -> DataFrame:
    """Places within a result; results are small sets of periods, categories or cells."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("title").orderBy("seq")))


@query("report_results")
def q_report_results(spark, sf):
    """The rows of the histogram, count, group and time results, out of the report's JSON."""
    rows = RP.result_rows(_run(spark, sf, "events", "event_id")[2])
    get = lambda name: F.get_json_object("row", f"$.{name}")
    kept = rows.where(get("count").isNotNull())
    return _numbered(kept).select("title", "pos", F.coalesce(get("category"), get("period")).alias("label"),
                                  get("bin_start").cast("double").alias("x"), get("count").cast("bigint").alias("n"))


@query("report_charts_data")
def q_report_charts_data(spark, sf):
    """Every chart's points, out of the report's JSON; y of the matrix is its event_id column."""
    rows = RP.chart_data(_run(spark, sf, "events", "event_id")[2])
    get = lambda name: F.get_json_object("point", f"$.{name}")
    return round_doubles(_numbered(rows).select(
        "title", "chart_kind", "pos", F.coalesce(get("label"), get("x_label"), get("x"), get("col_a")).alias("label"),
        get("x_num").cast("double").alias("x"), F.coalesce(get("y"), get("event_id"), get("value")).cast("double").alias("y"), "note"), 6)


@query("run_log_rows")
def q_run_log_rows(spark, sf):
    return _run(spark, sf, "events", "event_id")[2].log.select("seq", "agent", "level", "message")


def _vc_results(spark, sf):
    pairs = [("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("events", "props"),
             ("lineitem", "l_linenumber"), ("lineitem", "l_returnflag")]
    return [(t, c, S.with_seq(A.value_counts(_t(spark, sf, t), c))) for t, c in pairs]


@query("chart_kind")
def q_chart_kind(spark, sf):
    out = None
    for t, c, res in _vc_results(spark, sf):
        k = S.chart_kind(res, "category", "count", "bar").select(
            F.lit(t).alias("dataset"), F.lit(c).alias("column"), "*")
        out = k if out is None else out.unionByName(k)
    return out


@query("plottable")
def q_plottable(spark, sf):
    out = None
    for t, c, res in _vc_results(spark, sf):
        k = S.plottable(res, "category", "count").select(
            F.lit(t).alias("dataset"), F.lit(c).alias("column"), "*")
        out = k if out is None else out.unionByName(k)
    return out


@query("series_bar")
def q_series_bar(spark, sf):
    res = S.with_seq(A.value_counts(_t(spark, sf, "orders"), "o_orderpriority"))
    return S.series_bar(res, "category", "count").drop("seq")


@query("series_bar_numeric")
def q_series_bar_numeric(spark, sf):
    res = S.with_seq(A.histogram(_t(spark, sf, "events"), "value"))
    return S.series_bar(res, "bin_start", "count").drop("seq")


@query("series_line")
def q_series_line(spark, sf):
    res = json_safe(A.time_series(_t(spark, sf, "events"), "ts", "value", "day"))
    return round_doubles(S.series_line(S.with_seq(res), "period", "total_value").drop("seq"), 6)


@query("series_scatter")
def q_series_scatter(spark, sf):
    res = S.with_seq(A.scatter_clip(_t(spark, sf, "events"), "user_id", "value"))
    return S.series_scatter(res, "user_id", "value").drop("seq")


@query("series_pie")
def q_series_pie(spark, sf):
    res = S.with_seq(A.value_counts(_t(spark, sf, "customer"), "c_mktsegment"))
    return round_doubles(S.series_pie(res, "category", "count").drop("seq"), 6)


@query("series_box")
def q_series_box(spark, sf):
    return round_doubles(S.series_box(_t(spark, sf, "orders"), "o_orderpriority",
                                      "o_totalprice"), 6)


@query("pie_share_all")
def q_pie_share_all(spark, sf):
    res = S.with_seq(A.value_counts(_t(spark, sf, "events"), "props"))
    return round_doubles(S.series_pie(res, "category", "count").drop("seq"), 6)


@query("box_all")
def q_box_all(spark, sf):
    box = S.series_box(_t(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    # off the ties of rounding, where the order of a sum would decide
    return round_doubles(box.withColumn("mean_val", F.col("mean_val") + 1e-9), 6)


@query("box_by_part")
def q_box_by_part(spark, sf):
    """More categories than any driver should see."""
    box = S.series_box(_t(spark, sf, "lineitem"), "l_partkey", "l_extendedprice")
    return round_doubles(box.withColumn("mean_val", F.col("mean_val") + 1e-9), 6)


@query("quantiles_nan")
def q_quantiles_nan(spark, sf):
    """Quantiles of columns with some, mostly and only NaN, and with infinities."""
    nan, v = F.lit(float("nan")), F.col("value")
    error = F.col("event_type") == "error"
    cols = {"some": F.when(error, nan).otherwise(v), "every": nan,
            "most": F.when(F.col("event_id") % 100 < 90, nan).otherwise(v), "edge": F.when(error, F.lit(float("inf"))).otherwise(v)}
    got = multi_column_quantiles(_t(spark, sf, "events"), cols, [0.0, 0.5, 1.0])
    rows = [(c, p, math.isnan(q), None if math.isnan(q) or math.isinf(q) else q)
            for c, qs in got.items() for p, q in zip([0.0, 0.5, 1.0], qs)]
    return round_doubles(spark.createDataFrame(rows, "column string, p double, is_nan boolean, q double"), 6)


@query("history_kept")
def q_history_kept(spark, sf):
    """Dialogues of hundreds of turns: each user's events as messages."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"),
                                       F.col("event_type").alias("role"), F.col("props").alias("text"))
    return H.last_turns(e, H.KEPT_TURNS)


@query("catalog_profile")
def q_catalog_profile(spark, sf):
    prof = P.profile_catalog({t: _t(spark, sf, t) for t in TABLES}, samples=False)
    return prof.drop("sample_values")
