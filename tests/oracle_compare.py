"""Compare registered Spark queries with their DuckDB oracle the way the
driver does: same row count, same column names (sorted), same multiset of
rows. Usage: python tests/oracle_compare.py [sf_dir] [key ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablescope.session import TABLES, build_session  # noqa: E402


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def canon_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows), sorted(cols)


# Spark type -> the DuckDB type the oracle should produce for that column
DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
             "date": "DATE"}


def type_diff(df, description) -> dict:
    """Columns whose Spark and DuckDB types disagree: {name: (spark, duck)}."""
    s = {f.name: DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
         for f in df.schema.fields}
    d = {x[0]: str(x[1]) for x in description}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, key, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    ts = time.time() - t0
    if sql is None:
        return {"key": key, "rows": len(srows), "oracle": None, "spark_s": round(ts, 2)}
    t1 = time.time()
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    td = time.time() - t1
    a, ac = canon_rows(scols, srows)
    b, bc = canon_rows(dcols, drows)
    types = type_diff(df, rel.description)
    ok = ac == bc and a == b and not types
    out = {"key": key, "match": ok, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(ts, 2), "duck_s": round(td, 3)}
    if not ok:
        out["cols"] = (ac, bc) if ac != bc else "same"
        out["types"] = types
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out["only_spark"], out["only_oracle"] = diff_a, diff_b
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    spark = build_session()
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or list(qs)):
        try:
            r = compare(spark, con, sf_dir, k, qs[k], ors.get(k))
        except Exception as exc:  # report and continue
            r = {"key": k, "error": repr(exc)[:400]}
        if r.get("match") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv)
