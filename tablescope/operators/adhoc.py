"""Ad-hoc SQL on a dataset (Q1) and SQL extraction from answer text (Q2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..functions.json_safe import json_safe
from .history import KEPT_TURNS, last_turns

ADHOC_ROWS = 20
SQL_TAG = r"(?is)<sql>(.*?)</sql>"
#: The dataset's name, where it is no part of a text, a comment or another name.
_NAME = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/|`(?:[^`]|``)*`|\bdata_table\b""", re.S)
#: Built-in functions that run code outside of SQL.
NOT_ALLOWED = {"reflect", "java_method", "try_reflect"}


class NotAllowed(ValueError):
    """SQL that reads, or runs, something else than the dataset and built-in functions."""


def _named(match: re.Match) -> str:
    text = match.group().replace("{", "{{").replace("}", "}}")
    return "{data_table}" if match.group() in ("data_table", "`data_table`") else text


def _parts(spark: SparkSession, node) -> Iterator:
    """All tree nodes of a parsed query: its own, those in lists, pairs and sub-queries."""
    is_a = lambda x, name: is_instance_of(spark.sparkContext._gateway, x, name)
    todo = [node]
    while todo:
        x = todo.pop()
        if not isinstance(x, JavaObject):
            continue
        if is_a(x, "org.apache.spark.sql.catalyst.trees.TreeNode"):
            yield x
        items = x.iterator() if is_a(x, "scala.collection.Iterable") else x.productIterator() if is_a(x, "scala.Product") else None
        while items is not None and items.hasNext():
            todo.append(items.next())


def check_query(spark: SparkSession, sql: str) -> None:
    """Raises ``NotAllowed`` unless a query, as Spark parses it, reads ``data_table``
    and its own WITH tables alone and calls built-in functions that stay in SQL."""
    jvm = spark.sparkContext._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kinds: dict[str, list] = {}
    for x in _parts(spark, plan):
        kinds.setdefault(x.getClass().getSimpleName(), []).append(x)
    own = {"data_table"}
    for x in kinds.get("UnresolvedWith", []):
        tables = x.cteRelations().iterator()
        while tables.hasNext():
            own.add(tables.next().productElement(0).lower())
    if hiding := [name for name in own - {"data_table"} if spark.catalog.tableExists(name)]:
        raise NotAllowed(f"{hiding[0]} is a table's name already")      # out of the WITH's reach it would mean that table
    for x in kinds.get("UnresolvedRelation", []):
        if (name := x.multipartIdentifier().mkString(".")).lower() not in own:
            raise NotAllowed(f"only data_table can be read, not {name}")
    builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    for x in kinds.get("UnresolvedFunction", []):
        name = x.nameParts().mkString(".").lower()
        if name in NOT_ALLOWED or not builtin.functionExists(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)):
            raise NotAllowed(f"function {name} is not allowed")
    command = "org.apache.spark.sql.catalyst.plans.logical.Command"
    for kind, found in kinds.items():
        if "TableValuedFunction" in kind or "UnresolvedIdentifier" in kind or is_instance_of(spark.sparkContext._gateway, found[0], command):
            raise NotAllowed(f"{kind} is not allowed")


def ask_sql(df: DataFrame, sql: str, limit: int | None = None) -> DataFrame:
    """Q1: run a caller's query in which ``data_table`` names the dataset; all
    rows, or at most ``limit`` (an answer shows ``ADHOC_ROWS``). Read-only: the
    text is a sub-query, so statements (INSERT, DROP, ...) fail to parse, and
    ``check_query`` lets it read nothing but the dataset."""
    body = sql.strip().rstrip(";")
    check_query(df.sparkSession, body)
    check_query(df.sparkSession, f"SELECT * FROM ({body}\n) AS q")
    cut = "" if limit is None else f" LIMIT {int(limit)}"
    braces = lambda t: t.replace("{", "{{").replace("}", "}}")
    text, at = [], 0
    for m in _NAME.finditer(body):
        text += [braces(body[at:m.start()]), _named(m)]
        at = m.end()
    text.append(braces(body[at:]))
    return df.sparkSession.sql(f"SELECT * FROM ({''.join(text)}\n) AS q{cut}", data_table=df)


def extract_sql(text: Column) -> Column:
    """Q2: the first ``<sql>...</sql>`` block (case-insensitive, across
    lines) without surrounding whitespace (line breaks included); NULL when
    there is none."""
    body = F.regexp_replace(F.regexp_extract(text, SQL_TAG, 1), r"^\s+|\s+$", "")
    return F.nullif(body, F.lit(""))


def follow_up(df: DataFrame, history: DataFrame, conv_id: int, question: str, answer: str,
              rows: int = ADHOC_ROWS, kept: int = KEPT_TURNS) -> DataFrame:
    """The follow-up chain: take the SQL out of an answer (Q2), run it on the
    dataset (Q1), make the first ``rows`` rows JSON-safe (S13), append question,
    answer and result to the conversation and keep the last ``kept`` turns of
    every conversation (W2). A result of more rows says so in the turn that
    shows its first. SQL that fails becomes the result's text.

    ``history``: conv_id, turn, role, text."""
    spark = df.sparkSession
    sql = spark.range(1).select(extract_sql(F.lit(answer))).first()[0]
    said = [("user", question), ("assistant", answer)]
    if sql is not None:
        try:
            found = json_safe(ask_sql(df, sql, rows + 1))
            lines = [r[0] for r in found.select(F.to_json(F.struct(*[qcol(c) for c in found.columns]))).collect()]
            more = f" (the first {rows} rows; there are more)" if len(lines) > rows else ""
            said.append(("result", f"[{','.join(lines[:rows])}]{more}" if lines else "No rows returned"))
        except Exception as exc:
            said.append(("result", f"SQL execution failed: {str(exc)[:500]}"))
    last = history.where(F.col("conv_id") == conv_id).agg(F.max("turn")).first()[0]
    first = 0 if last is None else last + 1
    new = spark.createDataFrame([(conv_id, first + i, role, text) for i, (role, text) in enumerate(said)],
                                "conv_id long, turn long, role string, text string")
    return last_turns(history.select("conv_id", "turn", "role", "text").unionByName(new), kept)
