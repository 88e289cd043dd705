"""Ad-hoc SQL: what it may read and run."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators import adhoc as Q


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 30).select("id", F.concat(F.lit("g"), F.col("id") % 3).alias("g"))


@pytest.mark.parametrize("sql, rows", [
    ("SELECT count(*) AS n FROM data_table", [(30,)]),
    ("SELECT 'data_table' AS t, \"{x}\" AS b FROM data_table LIMIT 1;", [("data_table", "{x}")]),
    ("SELECT max(id) AS m FROM data_table -- the largest", [(29,)]),
    ("/* from data_table */ SELECT 'it''s' AS s, 'a\\'data_table' AS q FROM `data_table` WHERE id = 3", [("it's", "a'data_table")]),
    ("WITH a AS (SELECT id FROM data_table WHERE id < 5), b AS (SELECT max(id) AS id FROM a) SELECT b.id FROM b JOIN a USING (id)", [(4,)]),
    ("SELECT id FROM data_table AS d WHERE id = (SELECT max(x.id) FROM data_table x) OR EXISTS (SELECT 1 FROM (SELECT 1 AS k) y WHERE d.id = y.k) ORDER BY 1", [(1,), (29,)]),
    ("SELECT g, count(*) FILTER (WHERE id > 9) AS n FROM data_table GROUP BY g HAVING n > 1 ORDER BY g LIMIT 1", [("g0", 6)]),
    ("SELECT e FROM data_table LATERAL VIEW explode(array(1, 2)) t AS e WHERE id = 0", [(1,), (2,)])])
def test_queries_on_the_dataset(table, sql, rows):
    assert [tuple(r) for r in Q.ask_sql(table, sql).collect()] == rows


@pytest.mark.parametrize("sql", [
    "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM other",
    "SELECT id FROM data_table WHERE id IN (SELECT value FROM csv.`/etc/hosts`)", "WITH a AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM a",
    "SELECT (SELECT max(value) FROM text.`/etc/passwd`) FROM data_table", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.lang.System', 'exit', 1) FROM data_table", "SELECT try_reflect('java.util.UUID', 'randomUUID')",
    "SELECT * FROM range(5)", "SELECT own_code(id) FROM data_table", "SELECT id FROM data_table UNION ALL SELECT id FROM default.t",
    "SELECT id FROM IDENTIFIER('oth' || 'er')", "DROP TABLE data_table", "INSERT INTO data_table VALUES (1, 'a')", "SET spark.x = 1", "SHOW TABLES",
    "SELECT * FROM other AS other", "SELECT * FROM other JOIN (WITH other AS (SELECT 1) SELECT * FROM other) x ON true", "SELECT 1) AS a, (SELECT * FROM other"])
def test_nothing_else_is_read_or_run(spark, table, sql):
    spark.udf.register("own_code", lambda x: x)
    spark.range(3).createOrReplaceTempView("other")
    with pytest.raises(Exception) as e:
        Q.ask_sql(table, sql).collect()
    assert isinstance(e.value, Q.NotAllowed) or "PARSE" in str(e.value).upper()


def test_a_cut_answer_says_so(spark, table):
    history = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    said = lambda sql: Q.follow_up(table, history, 1, "q", f"<sql>{sql}</sql>", rows=4).where("role = 'result'").first()["text"]
    assert said("SELECT id FROM data_table ORDER BY id") == '[{"id":0},{"id":1},{"id":2},{"id":3}] (the first 4 rows; there are more)'
    assert said("SELECT id FROM data_table WHERE id < 4 ORDER BY id") == '[{"id":0},{"id":1},{"id":2},{"id":3}]'
    assert "NotAllowed" not in said("SELECT * FROM other") and "failed" in said("SELECT * FROM other")
