"""Readers on small hand-written files (FIXTURES section 4)."""

import os
import tempfile

import pytest

from tablescope.sources import files as S

TOKENS = ["NA", "N/A", "n/a", "nan", "NaN", "NAN", "null", "NULL", "None", "NONE", "#N/A", "#NA", ""]


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="tablescope-test-")


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return path


def test_all_null_tokens(spark, tmp):
    lines = ["num,txt,day,flag"]
    for i, t in enumerate(TOKENS):
        lines.append(f"{t},{t},{t},{t}")
        lines.append(f"{i}.5,w{i},2024-01-{i + 1:02d},true")
    df = S.read_csv_tokens(spark, write(os.path.join(tmp, "a.csv"), "\n".join(lines) + "\n"))
    types = dict(df.dtypes)
    assert types == {"num": "double", "txt": "string", "day": "date", "flag": "boolean"}
    assert df.where("num is null").count() == len(TOKENS)
    assert df.where("txt is null").count() == len(TOKENS)


def test_late_surprise_keeps_text(spark, tmp):
    lines = ["x"] + [str(i) for i in range(10000)] + ["oops"]
    df = S.read_csv_tokens(spark, write(os.path.join(tmp, "b.csv"), "\n".join(lines) + "\n"))
    assert dict(df.dtypes)["x"] == "string"


def test_integer_and_timestamp_inference(spark, tmp):
    text = "a,b\n1,2024-01-01 10:00:00\n2,2024-01-02T11:30:00\n"
    df = S.read_csv_tokens(spark, write(os.path.join(tmp, "c.csv"), text))
    assert dict(df.dtypes) == {"a": "bigint", "b": "timestamp_ntz"}


def test_partial_date_text_is_not_a_timestamp(spark, tmp):
    text = "y\n2024\n2025\n"
    df = S.read_csv_tokens(spark, write(os.path.join(tmp, "d.csv"), text))
    assert dict(df.dtypes)["y"] == "bigint"


@pytest.mark.parametrize("header,kept", [
    (",a,b", ["a", "b"]),
    ("Unnamed: 0,a,b", ["a", "b"]),
    ("column01,a,b", ["a", "b"]),
    ("column1,a,b", ["column1", "a", "b"]),
])
def test_index_columns_dropped(spark, tmp, header, kept):
    text = header + "\n0,1,x\n1,2,y\n"
    df = S.read_csv_tokens(spark, write(os.path.join(tmp, "e.csv"), text))
    assert df.columns == kept


def test_latin1_fallback(spark, tmp):
    path = write(os.path.join(tmp, "l.csv"), "name,n\nMüller,1\nJosé,2\n", encoding="latin-1")
    assert S.detect_encoding(spark, path) == "ISO-8859-1"
    df = S.read_csv_tokens(spark, path)
    assert sorted(r["name"] for r in df.collect()) == ["José", "Müller"]


@pytest.mark.parametrize("sep,name", [("\t", "t.tsv"), (";", "s.txt"), ("|", "p.txt"), (",", "c.csv")])
def test_sniff_delimiter(spark, tmp, sep, name):
    text = sep.join(["a", "b", "c"]) + "\n" + sep.join(["1", "2", "x y"]) + "\n"
    path = write(os.path.join(tmp, name), text)
    assert S.sniff_delimiter(spark, path) == sep
    assert S.read_csv_tokens(spark, path).columns == ["a", "b", "c"]


def test_json_variants(spark, tmp):
    arr = write(os.path.join(tmp, "a.json"), '[{"a": 1, "t": "2024-01-01 00:00:00"}, {"a": 2, "t": "2024-01-02 00:00:00"}]')
    pretty = write(os.path.join(tmp, "p.json"), '{\n  "a": 1,\n  "n": {"x": [1, 2]}\n}\n')
    nd = write(os.path.join(tmp, "n.ndjson"), '{"a": 1}\n{"a": 2}\n')
    a = S.read_json(spark, arr)
    assert a.count() == 2 and dict(a.dtypes)["t"] == "timestamp_ntz"
    p = S.read_json(spark, pretty)
    assert p.count() == 1 and dict(p.dtypes)["n"].startswith("struct")
    assert S.read_json(spark, nd).count() == 2


def test_file_inventory(spark, tmp):
    for n in ("a.csv", "b.PQ", "c.ndjson", "d.xyz"):
        write(os.path.join(tmp, n), "x\n")
    got = {r["name"]: r["format"] for r in S.file_inventory(spark, tmp + "/*").collect()}
    assert got == {"a.csv": "csv", "b.PQ": "parquet", "c.ndjson": "json", "d.xyz": "csv"}


def test_malformed_row_fails(spark, tmp):
    path = write(os.path.join(tmp, "m.csv"), 'a,b\n1,2\n"3,4\n')
    with pytest.raises(Exception):
        S.read_csv_tokens(spark, path, sep=",").collect()


def test_json_safe_projection(spark):
    import datetime as dt
    from decimal import Decimal

    from tablescope.functions.json_safe import json_safe
    df = spark.createDataFrame(
        [(dt.date(2024, 5, 1), dt.datetime(2024, 5, 1, 8, 30, 0, 120000), dt.datetime(2024, 5, 1),
          Decimal("12.50"), bytearray(b"ok\xff"), [dt.date(2024, 1, 2)], 3, "x")],
        "d date, t timestamp_ntz, t0 timestamp_ntz, m decimal(10,2), b binary, "
        "ds array<date>, n int, s string")
    r = json_safe(df).first()
    assert r["d"] == "2024-05-01"
    assert r["t"] == "2024-05-01T08:30:00.120000" and r["t0"] == "2024-05-01T00:00:00"
    assert r["m"] == 12.5 and isinstance(r["m"], float)
    assert r["b"] == "ok�"
    assert list(r["ds"]) == ["2024-01-02"]
    assert r["n"] == 3 and r["s"] == "x"


def test_text_is_parsed_once(spark, tmp):
    text = "a,b\n1,x\n2,NA\n3,z\n"
    df = S.parsed_once(spark, write(os.path.join(tmp, "m.csv"), text))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "csv" not in plan.lower().replace("m.csv", "")
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, None), (3, "z")]


def test_bad_json_line(spark, tmp):
    lines = [f'{{"a": {i}}}' for i in range(100)] + ['{"a": 1, "b']
    for name, text in (("last", lines), ("first", lines[::-1])):
        path = write(os.path.join(tmp, name + ".json"), "\n".join(text) + "\n")
        with pytest.raises(Exception):
            S.read_json(spark, path).collect()
        assert S.read_json(spark, path, bad_lines="drop").count() == 100


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_separators_in_quotes(spark, tmp, sep):
    text = f'name{sep}note{sep}n\n' + "".join(f'a{sep}"x{s}y ""q{s}"" \n{s}{s} z"{sep}{i}\n' for i, s in enumerate(",;|\t"))
    path = write(os.path.join(tmp, "q.txt"), text)
    assert S.sniff_delimiter(spark, path) == sep


def test_delimiter_that_is_none(spark, tmp):
    with pytest.raises(ValueError):
        S.sniff_delimiter(spark, write(os.path.join(tmp, "n.txt"), "title\na,b\nc;d,e,f\n"))
    assert S.sniff_delimiter(spark, write(os.path.join(tmp, "o.txt"), "one\n1\n2\n")) == ","


def test_real_c1_and_no_header(spark, tmp):
    path = write(os.path.join(tmp, "c.csv"), "_c1,x\n1,2\n3,4\n")
    assert S.read_csv_tokens(spark, path, sep=",").columns == ["_c1", "x"]
    df = S.read_csv_tokens(spark, write(os.path.join(tmp, "h.csv"), "1,a\n2,b\n"), header=False)
    assert df.columns == ["_c0", "_c1"] and df.count() == 2


def test_folder_with_trailing_slash(spark, tmp):
    pq = os.path.join(tmp, "events.parquet")
    spark.range(3).write.parquet(pq)
    bare = os.path.join(tmp, "events")
    spark.range(4).write.parquet(bare)
    assert S.read_any(spark, pq + "/").count() == 3 and S.read_any(spark, bare).count() == 4


def test_read_any_dispatch(spark, tmp):
    csv = write(os.path.join(tmp, "a.txt"), "x;y\n1;2\n")
    js = write(os.path.join(tmp, "b.jsonl"), '{"x": 1}\n')
    pq = os.path.join(tmp, "c.parquet")
    spark.range(3).write.parquet(pq)
    assert S.read_any(spark, csv).columns == ["x", "y"]
    assert S.read_any(spark, js).count() == 1
    assert S.read_any(spark, pq).count() == 3
