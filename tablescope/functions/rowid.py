"""H2 -- distributed global row numbers.

A global ``row_number() over (order by k)`` runs in one partition. Here the
rows are range-partitioned on the order key plus a tie-breaker (so that a
hot key value is spread over many partitions), sorted inside each
partition, tagged with (partition id, position) and written to the reliable
checkpoint so that every later pass sees the same tagging. Partition row
counts -- one row per partition, a proven bound -- become offsets that are
broadcast back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shuffle_partitions
from .columns import qcol

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need not have the package


def with_row_number(df: DataFrame, order_by: Sequence[str | Column],
                    name: str = "row_id") -> DataFrame:
    """Append a 1-based global row number in ``order_by`` order.

    Rows that tie on ``order_by`` are numbered in an arbitrary order (row
    hash, then scan position), fixed once the tagging is checkpointed."""
    keys = [qcol(c) if isinstance(c, str) else c for c in order_by]
    # tie-breakers: row hash, then a per-row id, so that even a block of
    # identical rows is spread over many range partitions (identical rows
    # are interchangeable; the tagging is checkpointed before use)
    with_tb = df.select("*", F.xxhash64(*[qcol(f) for f in df.columns]).alias("_tb"),
                        F.monotonically_increasing_id().alias("_ri"))
    parts = shuffle_partitions(df.sparkSession)
    ordered = (with_tb.repartitionByRange(parts, *keys, F.col("_tb"), F.col("_ri"))
                      .sortWithinPartitions(*keys, F.col("_tb"), F.col("_ri")))
    tagged = materialize(ordered.select(
        "*", F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid")))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                        F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_m0",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    rid = (F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(1)).alias(name)
    return out.select(*[qcol(c) for c in df.columns], rid)


def positions_of(df: DataFrame, order_col: str, keys: Sequence, then: str | None = None) -> dict:
    """1-based position of the first row with each given key in the order of
    ``order_col`` (nulls last) over ``df``: the number of rows before it, plus
    one. With ``then``, a second column that is never null, keys are pairs. One
    pass: each row looks up, by halving, how many of the sorted keys it does
    not come before; meant for a short list of keys (``FEW``) such as a top-k
    result."""
    keys = list(dict.fromkeys(keys))
    if not keys:
        return {}
    c, pairs = qcol(order_col), [k if then else (k, None) for k in keys]
    ordered = sorted(range(len(pairs)), key=lambda i: [part for x in pairs[i] for part in (x is None, x != x, 0 if x is None or x != x else x)])

    def before(k, t) -> Column:
        first = c.isNotNull() if k is None else F.coalesce(c < F.lit(k), F.lit(False))
        if then is None:
            return first
        same = c.isNull() if k is None else F.coalesce(c == F.lit(k), F.lit(False))
        return first | (same & (qcol(then) < F.lit(t)))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(*pairs[ordered[mid]]), place(lo, mid)).otherwise(place(mid + 1, hi))

    counts = {r["place"]: r["count"] for r in df.groupBy(place(0, len(pairs)).alias("place")).count().collect()}
    out, rows = {}, 0
    for i, at in enumerate(ordered):
        rows += counts.get(i, 0)
        out[keys[at]] = rows + 1
    return out


#: Keys that are looked up by expressions, by sorted arrays; beyond that rows are numbered.
FEW, MANY = 64, 1 << 20
_PLAIN_KEYS = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def can_look_up(kind: T.DataType) -> bool:
    """Whether keys of this type can be looked up in sorted arrays."""
    return isinstance(kind, _PLAIN_KEYS)


def rows_before(df: DataFrame, order_col: str, then: dict[int, str], keys: dict[int, pa.Table]) -> dict[int, np.ndarray]:
    """How many rows come before each of many keys, without sorting the rows.

    ``then`` names number columns of ``df``, each an order of its own: the rows
    where it is not null, by ``order_col`` (nulls last), then by it. ``keys`` has
    the pairs wanted of each order, distinct and sorted (columns k, v; at most
    ``MANY``). One pass of ``df``: each task counts its rows between the keys."""
    sorted_keys = {}
    for i, table in keys.items():
        known = table["k"].is_valid().to_numpy()
        sorted_keys[i] = (comparable(table["k"].filter(pa.array(known))), table["v"].to_numpy())
    shipped = df.sparkSession.sparkContext.broadcast(sorted_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {i: np.zeros(len(v) + 1, np.int64) for i, (_, v) in shipped.value.items()}
        for batch in batches:
            for i, name in then.items():
                column = batch.column(name)
                here = batch.filter(column.is_valid()) if column.null_count else batch
                key, value = here.column("_k"), here.column(name).to_numpy(zero_copy_only=False)
                counts[i] += np.bincount(_places(key, value, *shipped.value[i]), minlength=len(counts[i]))
        for i, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.record_batch({"i": pa.array(np.full(len(some), i), pa.int32()), "place": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    rows = df.select(qcol(order_col).alias("_k"), *[qcol(c) for c in then.values()])
    got = rows.mapInArrow(run, "i int, place long, n long").groupBy("i", "place").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    for i, (_, v) in sorted_keys.items():
        mine = got.filter(pa.compute.equal(got["i"], i))
        counts = np.zeros(len(v) + 1, np.int64)
        counts[mine["place"].to_numpy()] = mine["n"].to_numpy()
        out[i] = np.cumsum(counts)[:-1]
    return out


def comparable(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Keys without nulls as an array whose order is Spark's."""
    kind = keys.type
    if pa.types.is_timestamp(kind):
        keys = keys.cast(pa.int64())
    elif pa.types.is_date(kind):
        keys = keys.cast(pa.int32())
    return keys.to_numpy() if isinstance(keys, pa.ChunkedArray) else keys.to_numpy(zero_copy_only=False)


def _places(key: pa.Array, value: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of the sorted pairs each row does not come before."""
    known = key.is_valid().to_numpy(zero_copy_only=False)
    mine = comparable(key.filter(pa.array(known)))
    place = np.full(len(value), len(keys))
    place[~known] += np.searchsorted(values[len(keys):], value[~known], side="right")
    low, high = np.searchsorted(keys, mine, side="left"), np.searchsorted(keys, mine, side="right")
    tied, of = np.flatnonzero(low < high), value[known]
    if len(tied):                               # rows whose key is a wanted one: by their value
        order = tied[np.argsort(low[tied], kind="stable")]
        cuts = np.flatnonzero(np.diff(low[order], prepend=-1))
        for some in np.split(order, cuts[1:]):
            a, b = low[some[0]], high[some[0]]
            low[some] = a + np.searchsorted(values[a:b], of[some], side="right")
    place[known] = low
    return place
