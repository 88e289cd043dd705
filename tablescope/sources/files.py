"""Readers (S1-S7, I1): delimited text with null tokens and whole-file type
inference, delimiter sniffing, encoding fallback, Parquet, JSON, a file
inventory and auto-index column removal. All of them are Spark jobs: the
inference and the sniffing are aggregates over every line; only the first
line of the data is looked at by itself."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ISO_TIMESTAMP_TEXT, qcol, try_number
from ..session import ensure_checkpoint_dir, parallel_map, scratch_path
from .records import csv_records, json_records, may_be_open

# The null tokens of the CSV reader, in this order.
NULL_TOKENS = ["NA", "N/A", "n/a", "nan", "NaN", "NAN", "null", "NULL", "None", "NONE",
               "#N/A", "#NA", ""]

# File suffix -> reader format; unknown suffixes read as csv.
FORMAT_BY_SUFFIX = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet",
                    "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json"}

DELIMITER_CANDIDATES = [",", "\t", ";", "|"]

ISO_DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"
BOOL_TEXT = r"^(?i)\s*(true|false)\s*$"
# What a cast to bigint may take. Elsewhere the cast raises and catches an
# exception that quotes the whole value, which costs more than all other tests.
INTEGER_TEXT = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"


def clean_scratch(spark: SparkSession) -> bool:
    """Remove all scratch folders; nothing that reads them may still be in use."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablescope-scratch")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# -- S1 / I1 -----------------------------------------------------------------

def null_tokens_to_null(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Every string cell equal to a null token becomes NULL."""
    return df.select(*[F.when(~qcol(c).isin(tokens), qcol(c)).alias(c) for c in df.columns])


BATCH = 64
_TYPE_ORDER = ["boolean", "bigint", "double", "date", "timestamp_ntz"]


def _parses(c: Column, t: str) -> Column:
    if t == "boolean":
        return c.rlike(BOOL_TEXT)
    if t == "bigint":
        return F.when(c.rlike(INTEGER_TEXT), c.try_cast("bigint")).isNotNull()
    if t == "double":
        return try_number(c).isNotNull()
    if t == "date":
        return c.rlike(ISO_DATE_TEXT) & c.try_cast("date").isNotNull()
    return c.rlike(ISO_TIMESTAMP_TEXT) & c.try_cast("timestamp_ntz").isNotNull()


def infer_types(df: DataFrame) -> dict[str, str]:
    """For every string column the narrowest type that all its
    non-null values parse as (boolean, bigint, double, date, timestamp),
    else string. Every value becomes the set of types it parses as (one bit
    each) and a column keeps the bits that all its values share: one
    aggregate per column, ``BATCH`` columns a pass. Late surprises count."""
    def one(cols):
        aggs = []
        for i, c in enumerate(cols):
            bits = sum((F.when(_parses(qcol(c), t), 1 << j).otherwise(0) for j, t in enumerate(_TYPE_ORDER)), F.lit(0))
            aggs.append(F.bit_and(F.when(qcol(c).isNotNull(), bits)).alias(f"b{i}"))
        return zip(cols, df.agg(*aggs).first())

    batches = [df.columns[i:i + BATCH] for i in range(0, len(df.columns), BATCH)]
    found = dict(x for part in parallel_map(one, batches) for x in part)
    return {c: next((t for j, t in enumerate(_TYPE_ORDER) if (found[c] or 0) >> j & 1), "string") for c in df.columns}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for c in df.columns:
        t = types.get(c, "string")
        col = qcol(c)
        if t == "boolean":
            col = F.lower(F.trim(col)) == F.lit("true")
            col = F.when(qcol(c).isNotNull(), col)
        elif t != "string":
            col = F.trim(col).try_cast(t)
        out.append(col.alias(c))
    return df.select(*out)


def _header_names(cells: list[str]) -> list[str]:
    """Column names of a header as Spark gives them: a blank one and one that
    another has too get their place's number."""
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _cut_csv(spark: SparkSession, path: str, sep: str, encoding: str, header: bool) -> tuple[DataFrame, list[str]]:
    """Text columns and header cells of delimited text whose cells hold line
    breaks: cut into records by many tasks, parsed, and kept as Parquet in the
    shared folder, so that the cutting is done once."""
    records = csv_records(spark, path, sep).select("header", F.decode("record", encoding).alias("record"))
    first = records.where("header").first()
    if first is None:
        return spark.createDataFrame([], "_c0 string"), []
    cells = next(csv.reader(io.StringIO(first["record"], newline=""), delimiter=sep))
    options = {"sep": sep, "mode": "FAILFAST", "escape": '"'}
    schema = ", ".join(f"c{i} string" for i in range(len(cells)))
    parsed = records.where(~F.col("header") if header else F.lit(True)).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    kept = scratch_path(spark, "records")
    parsed.write.parquet(kept)
    names = _header_names(cells) if header else [f"_c{i}" for i in range(len(cells))]
    return spark.read.schema(schema).parquet(kept).toDF(*names), cells


def read_csv_tokens(spark: SparkSession, path: str, sep: str | None = None,
                    encoding: str | None = None, header: bool = True,
                    multi_line: bool | None = None) -> DataFrame:
    """CSV as RFC 4180 has it (quotes in quoted cells doubled), 13 null
    tokens, whole-file type inference; malformed rows fail the read (FAILFAST).
    Delimiter and encoding are detected when not given (S2, S3), and so is
    whether a line may end within a quoted cell (``multi_line``: it does, it
    doesn't). Columns whose header is blank, or is one of pandas' index
    names, are dropped (S7); without a header nothing is. Every later pass
    parses the text again: ``parsed_once`` keeps it."""
    if sep is None or encoding is None:
        sep, found_enc, found_open = _text_facts(spark, path, sep=sep)
        encoding, multi_line = encoding or found_enc, found_open if multi_line is None else multi_line
    if multi_line is None:
        multi_line = not spark.read.text(path).where(may_be_open(F.col("value"), sep)).isEmpty()
    if multi_line:
        raw, names = _cut_csv(spark, path, sep, encoding, header)
    else:
        raw = (spark.read.option("header", header).option("inferSchema", False).option("escape", '"')
               .option("mode", "FAILFAST").option("sep", sep).option("encoding", encoding).csv(path))
        names = next(csv.reader([first_line(spark, path)], delimiter=sep), []) if header else []
    if header:
        blank = {i for i, n in enumerate(names) if not n.strip()}
        keep = [c for i, c in enumerate(raw.columns) if i not in blank and c not in index_columns([c])]
        raw = raw.select(*[qcol(c) for c in keep or raw.columns])
    clean = null_tokens_to_null(raw)
    return apply_types(clean, infer_types(clean))


# -- S2 / S3 -----------------------------------------------------------------

def first_line(spark: SparkSession, path: str) -> str:
    """The first line that is not blank (of the first file)."""
    row = spark.read.text(path).where(F.trim("value") != "").first()
    return row[0] if row else ""


def _separators(line: Column, d: str) -> Column:
    """How many separators a line has outside quotes."""
    # a doubled quote ends one section and begins the next
    bare = F.when(line.contains('"'), F.regexp_replace(line, r'"[^"]*"', "")).otherwise(line)
    gone = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(d), F.lit("")))
    return gone if len(d.encode()) == 1 else (gone / F.lit(len(d.encode()))).cast("int")


def _in_head(head: str, candidates: list[str]) -> list[int]:
    """How many separators the first line has outside quotes."""
    bare = re.sub(r'"[^"]*"', "", head)
    return [bare.count(d) for d in candidates]


def _delimiter_aggs(head: str, candidates: list[str]) -> list[Column]:
    """Lines that a candidate splits as it does the first one; if none splits
    that, the least and most separators of any line. Only what the choice needs:
    a candidate that alone splits the first line needs nothing."""
    line, heads = F.col("value"), _in_head(head, candidates)
    n = [F.when(F.trim(line) != "", _separators(line, d)) for d in candidates]
    if any(heads):
        several = sum(map(bool, heads)) > 1
        return [F.count_if(n[i] == F.lit(h)).alias(f"like{i}") for i, h in enumerate(heads) if h and several]
    return [f(n[i]).alias(f"{a}{i}") for i in range(len(candidates)) for f, a in ((F.min, "mn"), (F.max, "mx"))]


def _pick_delimiter(row, path: str, head: str, candidates: list[str]) -> str:
    """Of the candidates that split the first line: the one that splits most
    lines likewise (quoted line breaks make some differ), then the one the
    file's suffix names, then the one with most separators."""
    named = {"tsv": "\t", "csv": ","}.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    heads = _in_head(head, candidates)
    able = [i for i, h in enumerate(heads) if h]
    if len(able) == 1:
        return candidates[able[0]]
    if able:
        return candidates[-max((row[f"like{i}"], candidates[i] == named, heads[i], -i) for i in able)[3]]
    even = [d for i, d in enumerate(candidates) if row[f"mx{i}"] and row[f"mn{i}"] == row[f"mx{i}"]]
    if even:
        return even[0]
    if any(row[f"mx{i}"] for i in range(len(candidates))):
        raise ValueError(f"no delimiter splits the first line of {path}; name one")
    return named or ","                      # one column


def sniff_delimiter(spark: SparkSession, path: str,
                    candidates: list[str] = DELIMITER_CANDIDATES) -> str:
    """The delimiter of delimited text, separators in quotes not counted."""
    head = first_line(spark, path)
    aggs = _delimiter_aggs(head, candidates)
    row = spark.read.text(path).agg(*aggs).first() if aggs else None
    return _pick_delimiter(row, path, head, candidates)


def _text_facts(spark: SparkSession, path: str, candidates: list[str] = DELIMITER_CANDIDATES, sep: str | None = None) -> tuple[str, str, bool]:
    """S2 + S3 in one pass over the raw lines: delimiter (the given one, if one
    is), encoding, and whether a line may end within a quoted cell."""
    head = first_line(spark, path) if sep is None else ""
    able = [d for d, h in zip(candidates, _in_head(head, candidates)) if h] or candidates if sep is None else [sep]
    row = spark.read.text(path).agg(
        *(_delimiter_aggs(head, candidates) if sep is None else []),
        *[F.bool_or(may_be_open(F.col("value"), d)).alias(f"open{i}") for i, d in enumerate(able)],
        F.count_if(~F.is_valid_utf8("value")).alias("_bad")).first()
    sep = sep or _pick_delimiter(row, path, head, candidates)
    return sep, "ISO-8859-1" if row["_bad"] else "UTF-8", bool(row[f"open{able.index(sep)}"])


def text_facts(spark: SparkSession, path: str,
               candidates: list[str] = DELIMITER_CANDIDATES) -> tuple[str, str]:
    """S2 + S3 in one pass over the raw lines: (delimiter, encoding)."""
    return _text_facts(spark, path, candidates)[:2]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S3: UTF-8 unless some line holds bytes that are not valid UTF-8;
    then LATIN-1 (ISO-8859-1), which accepts every byte."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


# -- S4 / S5 -----------------------------------------------------------------

def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Self-describing; filters and projections push down."""
    return spark.read.parquet(path)


def is_json_document(spark: SparkSession, path: str) -> bool:
    """A JSON array or one pretty-printed object (as opposed to one record
    per line): the data begin with '[', or the first line is an unfinished
    object and no line holds a whole one. A bad line among records, be it
    the first, does not make them a document."""
    head = first_line(spark, path).lstrip()
    if not head.startswith("{"):
        return head.startswith("[")
    if head.rstrip().endswith("}"):
        return False
    line = F.col("value")
    return spark.read.text(path).where(line.startswith("{") & F.rtrim(line).endswith("}")).isEmpty()


def _compressed(spark: SparkSession, path: str) -> bool:
    return any(re.search(r"\.(gz|bz2|zst|lz4|snappy|deflate)$", f) for f in spark.read.text(path).inputFiles())


def read_json(spark: SparkSession, path: str, bad_lines: str = "raise") -> DataFrame:
    """JSON array or newline-delimited; nested types kept; string
    fields that hold dates or timestamps are typed as such (I1). An array's
    elements (or pretty-printed objects) are first written one a line, by as
    many tasks as the file has blocks. What is no JSON raises, or with
    ``bad_lines="drop"`` is left out."""
    mode = {"raise": "FAILFAST", "drop": "DROPMALFORMED"}[bad_lines]
    lines, document = path, is_json_document(spark, path)
    if document and not _compressed(spark, path):          # what is compressed can't be read in parts
        lines, document = scratch_path(spark, "elements"), False
        json_records(spark, path).select(F.col("record").cast("string").alias("value")).write.text(lines)
    df = spark.read.option("multiLine", document).option("mode", mode).json(lines)
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not strings:
        return df
    types = infer_types(df.select(*[qcol(c) for c in strings]))
    keep = {c: t for c, t in types.items() if t in ("date", "timestamp_ntz")}
    return df.select(*[F.trim(qcol(c)).try_cast(keep[c]).alias(c) if c in keep else qcol(c)
                       for c in df.columns])


def file_format(spark: SparkSession, path: str) -> str:
    """By the path's suffix, or for a folder without a known one, by its first file's."""
    def of(name):
        return FORMAT_BY_SUFFIX.get(name.rsplit(".", 1)[-1].lower()) if "." in name.rsplit("/", 1)[-1] else None
    found = of(path.rstrip("/"))
    if found is None:
        row = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
        found = of(row[0]) if row else None
    return found or "csv"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    path = path.rstrip("/") or path
    fmt = file_format(spark, path)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "json":
        return read_json(spark, path)
    return read_csv_tokens(spark, path)


def parsed_once(spark: SparkSession, path: str) -> DataFrame:
    """The data behind ``path`` for many passes: text is parsed once and kept
    as typed Parquet in the shared folder (``clean_scratch`` removes it)."""
    df = read_any(spark, path)
    if file_format(spark, path) == "parquet":
        return df
    kept = scratch_path(spark, "parsed")
    df.write.parquet(kept)
    return spark.read.schema(df.schema).parquet(kept)


# -- S6 / S7 -----------------------------------------------------------------

def file_inventory(spark: SparkSession, path_glob: str) -> DataFrame:
    """Name, suffix, format and size (MB, 3 decimals) of every file;
    only path and length are read, never the content."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    fmt_map = F.create_map(*[F.lit(x) for kv in FORMAT_BY_SUFFIX.items() for x in kv])
    return files.select(
        name.alias("name"), suffix.alias("suffix"),
        F.coalesce(fmt_map[suffix], F.lit("csv")).alias("format"),
        F.round(F.col("length") / F.lit(1024.0 * 1024.0), 3).alias("size_mb"),
        F.col("length").alias("size_bytes"))


#: Names that pandas and spreadsheets give to an index column.
INDEX_COLUMN_PATTERNS = [r"(?i)^unnamed:", r"^column\d{2}$"]


def index_columns(columns: list[str]) -> list[str]:
    """Index columns by their name. Columns with a blank header are
    known by their place in the header line (``read_csv_tokens``)."""
    return [c for c in columns if any(re.search(p, c) for p in INDEX_COLUMN_PATTERNS)]
