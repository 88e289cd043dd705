"""Records across lines and blocks, against the csv and json modules."""

import csv
import io
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tablescope.sources import files as S
from tablescope.sources import records as R


@pytest.fixture()
def small_blocks(spark):
    """Blocks of some hundred bytes, so that records lie across several."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def written(name, text, encoding="utf-8"):
    path = os.path.join(tempfile.mkdtemp(prefix="tablescope-records-"), name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def cells_of(seed, rows, sep):
    rnd = random.Random(seed)
    pieces = ["a", "b c", '"', '""', "\n", "\r\n", sep, "\\", "é", "", 'x"y', "\n\n", " "]
    table = [["id", "first", "second, third"]]
    for i in range(rows):
        size = 200 if rnd.random() < 0.03 else 6             # some longer than a block
        table.append([str(i)] + ["z" + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, size))) for _ in range(2)])
    return table


@pytest.mark.parametrize("sep, end, encoding", [(",", "\n", "utf-8"), (";", "\r\n", "utf-8"), (",", "\r\n", "latin-1"), (",", "\n", "utf-8-sig")])
def test_quoted_line_breaks_across_blocks(spark, small_blocks, sep, end, encoding):
    table = cells_of(4, 120, sep)
    text = io.StringIO(newline="")
    csv.writer(text, delimiter=sep, lineterminator=end).writerows(table)
    path = written("t.csv", text.getvalue(), encoding)
    assert R.csv_records(spark, path, sep).rdd.getNumPartitions() > 10
    df = S.read_csv_tokens(spark, path, sep=sep, encoding="ISO-8859-1" if encoding == "latin-1" else "UTF-8")
    assert df.columns == table[0]
    assert sorted(tuple(r) for r in df.collect()) == sorted((int(a), b, c) for a, b, c in table[1:])


def test_every_file_of_a_folder_has_its_header(spark, small_blocks):
    path = written("a.csv", 'k,t\n1,"x\ny"\n')
    with open(os.path.join(os.path.dirname(path), "b.csv"), "w") as f:
        f.write('k,t\n2,"p\n' + "q" * 500 + '"\n\n3,r')
    rows = S.read_csv_tokens(spark, os.path.dirname(path), sep=",").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "x\ny"), (2, "p\n" + "q" * 500), (3, "r")]


def test_rfc_quotes_and_letters(spark):
    path = written("q.csv", 'a,b,c,d\n1,"say ""hi"", ok",12d,"C:\\"\n2,5" pipe,3F,"D:\\"\n')
    got = S.read_csv_tokens(spark, path, sep=",").collect()
    assert [tuple(r) for r in got] == [(1, 'say "hi", ok', "12d", "C:\\"), (2, '5" pipe', "3F", "D:\\")]


@pytest.mark.parametrize("text, form", [("12d", "string"), ("7D", "string"), ("3F", "string"), ("1e5", "double"), (" -.5 ", "double"),
                                        ("+7.", "double"), ("Infinity", "double"), ("1e", "string"), ("٣", "string")])
def test_numbers_as_text(spark, text, form):
    assert S.infer_types(spark.createDataFrame([(text,)], "t string"))["t"] == form


def test_a_malformed_record_raises(spark, small_blocks):
    with pytest.raises(Exception):
        S.read_csv_tokens(spark, written("m.csv", 'a,b\n1,"x\ny"\n1,2,3\n'), sep=",").collect()


def elements(seed, n):
    rnd = random.Random(seed)
    strings = ["", "}", "]", '"', '\\"', "\\", "{[", "},{", "a,b", "é\t", "x" * 700]
    return [{"i": i, "s": "".join(rnd.choice(strings) for _ in range(rnd.randint(0, 4))), "o": {"deep": [{"k": rnd.choice(strings)}, {}]}, "l": [1, [2]]}
            for i in range(n)]


@pytest.mark.parametrize("form", ["minified", "pretty", "lines", "spaced", "bom", "objects"])
def test_json_arrays_across_blocks(spark, small_blocks, form):
    rows = elements(7, 60)
    text = {"minified": lambda: json.dumps(rows, separators=(",", ":"), ensure_ascii=False), "pretty": lambda: json.dumps(rows, indent=2) + "\n",
            "lines": lambda: "[" + ",\n".join(map(json.dumps, rows)) + "\n]\n", "spaced": lambda: " \n\t[ " + " , \r\n".join(map(json.dumps, rows)) + " ] \n",
            "bom": lambda: "\ufeff" + json.dumps(rows), "objects": lambda: "\n".join(json.dumps(r, indent=1) for r in rows)}[form]()
    path = written("a.json", text)
    records = R.json_records(spark, path)
    assert records.rdd.getNumPartitions() > 10
    key = lambda r: r["i"]
    assert sorted((json.loads(bytes(r["record"])) for r in records.collect()), key=key) == rows
    if form != "bom":
        got = S.read_json(spark, path).select("i", "s", F.to_json("o").alias("o")).collect()
        assert sorted((r["i"], r["s"], json.loads(r["o"])["deep"][0]["k"]) for r in got) == [(r["i"], r["s"], r["o"]["deep"][0]["k"]) for r in rows]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}, 7, {"a": 2}]', '[{"a": 1}, {"a": {"b": 3}', '[{"a": 1}, "x'])
def test_a_truncated_array_raises(spark, text):
    with pytest.raises(Exception):
        S.read_json(spark, written("a.json", text)).collect()


def test_empty_arrays(spark):
    assert R.json_records(spark, written("a.json", "[]\n")).count() == 0
    assert R.json_records(spark, written("b.json", " [ ] ")).count() == 0
    assert R.json_records(spark, written("c.json", '[{"a": 1}]')).count() == 1


def test_text_is_cut_once(spark, small_blocks):
    """What follows reads the pieces that were kept, not the text again."""
    for records in (R.csv_records(spark, written("a.csv", 'k,t\n' + '1,"x\ny"\n' * 200)), R.json_records(spark, written("a.json", json.dumps(elements(3, 40))))):
        assert "MapInArrow" not in records._jdf.queryExecution().executedPlan().toString()


def test_a_named_delimiter_needs_no_sniffing(spark):
    """None of the usual ones splits the first line, and some lines have commas."""
    got = S.read_csv_tokens(spark, written("a.txt", "k:t\n1:x,y\n2:z\n"), sep=":").collect()
    assert [tuple(r) for r in got] == [(1, "x,y"), (2, "z")]


@pytest.mark.parametrize("text", ["12", " 12 ", "+5", "-7\t", "\x01 12\x7f", "12\n", "12.", "12.0", "9223372036854775807", "9223372036854775808", "", "+", "1 2", "٣", "12\u00a0", "\x8512", "x" * 3000])
def test_integers_are_what_the_cast_takes(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S._parses(F.col("t"), "bigint"), F.col("t").try_cast("bigint").isNotNull()).first()[:] == (df.select(F.col("t").try_cast("bigint").isNotNull()).first()[0],) * 2


def test_integer_test_casts_nothing_else(spark):
    """The cast raises and catches inside for each value that is none."""
    plan = spark.range(1).select(S._parses(F.col("id").cast("string"), "bigint"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan or "if (" in plan


def test_an_array_of_events_is_json(spark, tmp_path, monkeypatch):
    """One file, valid also where the smallest identifier repeats or is null; no task sorts the table."""
    from tablescope.registry import QUERIES

    spark.sql("""SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-01 00:00:00', 5L, 'a', 1.5D, '{}'), (1L, TIMESTAMP_NTZ'2024-01-01 00:00:01', 6L, 'b', 2.5D, '[{'),
              (null, TIMESTAMP_NTZ'2024-01-01 00:00:02', 7L, 'c', 3.5D, null) t(event_id, ts, user_id, event_type, value, props)""") \
        .repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(S, "scratch_path", lambda spark, name="": f"{tmp_path}/{name}")
    rows = QUERIES["json_array_split"](spark, str(tmp_path)).collect()
    file, = [f for f in os.listdir(tmp_path / "array") if f.startswith("part-")]
    assert len(json.loads((tmp_path / "array" / file).read_text())) == 3
    assert sorted((r["user_id"], r["event_id"], r["props"], r["note"]) for r in rows) == [
        (5, 1, "{}", '}], {"a\\"'), (6, 1, "[{", '}], {"b\\"'), (7, None, None, '}], {"c\\"')]
