"""Findings as tables (L4-L8, L10): template insights, variability flags,
result digest, numeric stat lines and the schema digest, computed with
Spark expressions over profile and results-index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fill
from ..functions.json_safe import json_safe
from ..operators.profile import cardinality_tag, ordered_names
from ..session import parallel_map

# Fixed values of the template findings.
MISSING_NOTE_PCT = 20
HIGH_CV = 1.5
CV_EPS = 1e-9
DIGEST_ROWS = 5            # first rows of a result that a digest shows
NAMED_COLUMNS = 3          # columns that a finding's text names
SIZE_LINE = "Dataset contains {0} rows across {1} columns."
MISSING_LINE = "Columns with >20% missing values: {0}."
IMPUTE_LINE = "Investigate and impute missing values in {0}."
RANGE_LINE = "{0} ranges from {1} to {2} (mean: {3})."
CV_LINE = "{0} shows high variability (CV={1}), suggesting outliers."
OUTLIER_LINE = "{0} statistical outliers detected (z-score > 3)."
EXPLORE_LINE = "Explore correlations between numeric columns: {0}."
BINNING_LINE = "Consider removing or binning high-cardinality categorical columns."


def py_str(c: Column) -> Column:
    """Text of a double the way it prints in the findings: decimal digits
    from 1e-4 up to 1e16, exponent form outside. Spark prints the same
    shortest digits, but in exponent form from 1e7 up and below 1e-3."""
    text = c.cast("string")
    e = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(c < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"[-.]", ""), r"0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    whole = F.rpad(digits, F.greatest(e + 1, F.length(digits)), "0")
    large = F.concat(F.substring(whole, F.lit(1), e + 1), F.lit("."),
                     F.coalesce(F.nullif(F.substring(whole, e + 2, F.length(whole)), F.lit("")), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    return (F.when(~text.contains("E"), text)
             .when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), F.concat(sign, large))
             .when((F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4), F.concat(sign, small))
             .otherwise(F.concat(sign, F.substring(digits, F.lit(1), F.lit(1)),
                                 F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits))))
                                 .otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))))


def cv_expr(std: Column, mean: Column) -> Column:
    """std / |mean + 1e-9|; NULL instead of an ANSI error if that is 0."""
    return F.try_divide(std, F.abs(mean + F.lit(CV_EPS)))


def variability_flags(prof: DataFrame) -> DataFrame:
    """Coefficient of variation of every numeric column and whether it
    exceeds 1.5 (only defined for a positive stddev)."""
    num = prof.where((F.col("category") == "numeric") & F.col("mean_val").isNotNull())
    cv = F.when(F.col("std_val") > 0, cv_expr(F.col("std_val"), F.col("mean_val")))
    return num.select("dataset", "pos", "name", F.round(cv, 6).alias("cv"),
                      F.coalesce(cv > F.lit(HIGH_CV), F.lit(False)).alias("high_variability"))


def stat_lines(prof: DataFrame) -> DataFrame:
    """L7: 'name: mean=..., min=..., max=..., missing=...%' per numeric column."""
    num = prof.where((F.col("category") == "numeric") & F.col("mean_val").isNotNull())
    return num.select("dataset", "pos", F.concat(
        F.col("name"), F.lit(": mean="), py_str(F.col("mean_val")),
        F.lit(", min="), py_str(F.col("min_val")), F.lit(", max="), py_str(F.col("max_val")),
        F.lit(", missing="), py_str(F.col("missing_pct")), F.lit("%")).alias("line"))


def schema_digest(prof: DataFrame) -> DataFrame:
    """One JSON object per column: category, unique, missing %, numeric
    stats, or samples (5; 3 for datetime) and the grouping tag."""
    cat = F.col("category")
    is_num = cat == "numeric"
    is_lbl = cat.isin("categorical", "text", "boolean")
    samples = (F.when(is_lbl, F.slice("sample_values", 1, 5))
                .when(cat == "datetime", F.slice("sample_values", 1, 3)))
    body = F.struct(
        cat.alias("category"), F.col("unique_count").alias("unique"),
        F.col("missing_pct").alias("missing_pct"),
        F.when(is_num, F.col("min_val")).alias("min"), F.when(is_num, F.col("max_val")).alias("max"),
        F.when(is_num, F.col("mean_val")).alias("mean"), F.when(is_num, F.col("std_val")).alias("std"),
        samples.alias("samples"), cardinality_tag(cat, F.col("unique_count")).alias("tag"))
    return prof.select("dataset", "pos", "name", F.to_json(body).alias("digest"))


def template_insights(prof: DataFrame, index: DataFrame | None = None,
                      total_rows: dict[str, int] | None = None, cap: int | None = None) -> DataFrame:
    """L4 (+ L10): findings (dataset, kind, seq, text). The size line uses
    ``total_rows`` (the full table when the profile ran on a sample) or the
    profiled rows; the outlier line uses the uncapped outlier count when the
    results index carries it. All findings, or the first ``cap`` of a kind."""
    rows = F.max("row_count")
    if total_rows:
        given = F.create_map(*[F.lit(x) for kv in total_rows.items() for x in kv])
        rows = F.coalesce(given[F.first("dataset")], rows)
    per = prof.groupBy("dataset").agg(
        rows.alias("rows"), F.count(F.lit(1)).alias("ncols"),
        ordered_names(prof, F.col("missing_pct") > MISSING_NOTE_PCT, "missing"),
        ordered_names(prof, F.col("category") == "numeric", "nums"),
        F.min_by(F.struct("name", "min_val", "max_val", "mean_val", "std_val"),
                 F.when((F.col("category") == "numeric") & F.col("mean_val").isNotNull(),
                        F.col("pos"))).alias("first"))
    names = F.array_join(F.slice("missing", 1, NAMED_COLUMNS), ", ")
    has_missing = F.size("missing") > 0
    f = F.col("first")
    has_first = f["name"].isNotNull()
    cv = cv_expr(f["std_val"], f["mean_val"])
    insights = F.array(
        fill(SIZE_LINE, F.format_number(F.col("rows"), 0), F.col("ncols").cast("string")),
        F.when(has_missing, fill(MISSING_LINE, names)),
        F.when(has_first, fill(RANGE_LINE, f["name"], py_str(f["min_val"]), py_str(f["max_val"]),
                               F.format_string("%.2f", f["mean_val"]))))
    anomalies = F.array(
        F.when(has_first & (f["std_val"] > 0) & (cv > HIGH_CV),
               fill(CV_LINE, f["name"], F.format_string("%.1f", cv))))
    recs = F.array(
        F.when(has_missing, fill(IMPUTE_LINE, names)),
        F.when(F.size("nums") > 0, fill(EXPLORE_LINE,
                                        F.array_join(F.slice("nums", 1, NAMED_COLUMNS), ", "))),
        F.lit(BINNING_LINE))
    base = per
    if index is not None:
        outl = (index.where((F.col("task_type") == "anomaly") & F.col("error").isNull() &
                            (F.col("row_count") > 0))
                     .groupBy("dataset").agg(F.transform(
                         F.array_sort(F.collect_list(F.struct("run_order", F.coalesce(
                             "outlier_total", "row_count").alias("n")))),
                         lambda s: fill(OUTLIER_LINE, s["n"].cast("string"))).alias("outl")))
        base = per.join(outl, "dataset", "left")
        anomalies = F.concat(anomalies, F.coalesce(F.col("outl"), F.array().cast("array<string>")))

    def _kind(arr: Column, kind: str) -> Column:
        kept = F.filter(arr, lambda x: x.isNotNull())
        kept = kept if cap is None else F.slice(kept, 1, cap)
        return F.transform(kept, lambda x, i: F.struct(F.lit(kind).alias("kind"),
                                                       i.cast("int").alias("seq"),
                                                       x.alias("text")))
    allf = F.concat(_kind(insights, "insight"), _kind(anomalies, "anomaly"), _kind(recs, "recommendation"))
    return base.select("dataset", F.inline(allf))


def result_digest(index: DataFrame, results: dict[str, DataFrame], first: int | None = None,
                  rows: int = DIGEST_ROWS) -> DataFrame:
    """Of all results, or the ``first`` ones, those without error: title,
    type, row count and their first ``rows`` rows as JSON (not for the overview,
    and not for a correlation heatmap)."""
    spark = index.sparkSession
    w = Window.partitionBy("dataset").orderBy("run_order")   # a row per task
    numbered = index.withColumn("_n", F.row_number().over(w))
    if first is not None:
        numbered = numbered.where(F.col("_n") <= first)
    chosen = numbered.where(F.col("error").isNull()).orderBy("dataset", "run_order").collect()

    def one(r):
        res, top = results.get(r["task_id"]), None
        if res is not None and r["task_type"] != "overview" and r["chart_kind"] != "heatmap":
            cols = [c for c in res.columns if c != "seq"]
            safe = json_safe(res.orderBy("seq").limit(rows).select("seq", *cols))
            lines = safe.select("seq", F.to_json(F.struct(*cols)).alias("j")).collect()
            top = "[" + ",".join(x["j"] for x in sorted(lines, key=lambda x: x["seq"])) + "]"
        return (r["dataset"], r["run_order"], r["title"], r["task_type"], r["row_count"], top)

    return spark.createDataFrame(parallel_map(one, chosen), "dataset string, run_order int, title string, "
                                 "task_type string, row_count bigint, top_rows string")
