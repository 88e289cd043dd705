"""Every registered query against its DuckDB oracle (sf0.001), and every
rows-only query for non-emptiness / stable schema."""

import json

import pytest

import __spark_entry__ as E
from oracle_compare import canon_rows, duck, type_diff
from tablescope.session import TABLES

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf001):
    return duck(sf001)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, sf001, key):
    df = QUERIES[key](spark, sf001)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(ORACLE[key])
    dcols = [d[0] for d in rel.description]
    assert type_diff(df, rel.description) == {}
    a, ac = canon_rows(df.columns, srows)
    b, bc = canon_rows(dcols, rel.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b


#: Keys of the training-data operators without SQL are tested beside them.
ROWS_ONLY = {
    "scatter_sample": lambda r, t: len(r) == min(3000, t["lineitem"]) and {x["l_quantity"] for x in r} <= set(range(1, 51)),
    "sample_exact": lambda r, t: len(r) == min(100_000, t["lineitem"]),
    "sample_exact_scatter_size": lambda r, t: len(r) == min(3000, t["lineitem"]),
    "file_inventory": lambda r, t: {x["name"] for x in r} == {f"{n}.parquet" for n in t} and all(x["size_bytes"] > 0 for x in r),
    "result_digest": lambda r, t: [x["run_order"] for x in r] == list(range(1, 8)) and json.loads(
        next(x for x in r if x["title"].startswith("Top Values"))["top_rows"])[0].keys() == {"category", "count"},
}


@pytest.mark.parametrize("key", sorted(k for k in set(QUERIES) - set(ORACLE) if not k.startswith("op") and k != "pipeline"))
def test_rows_only(spark, con, sf001, key):
    sizes = {t: con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in TABLES}
    assert ROWS_ONLY[key](QUERIES[key](spark, sf001).collect(), sizes)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["bin_start", "bin_end", "count"]
