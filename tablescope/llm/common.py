"""What the operators share: the folder all executors see, tables that cut
lineage, and the table readers of the registered queries."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that become Python objects at a time, and their bytes in Arrow's columns.
SLICE, SLICE_BYTES = 256, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session
    that names none gets a folder of its own; elsewhere this raises, for a
    folder of the driver's machine would be invisible to the executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablescope-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    and later stages survive the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns, nothing else."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
                       *[docs[c] for c in more])


def squeezed(text: Column) -> Column:
    """Every run of white space replaced by one space."""
    return F.regexp_replace(text, SPACE, " ")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``folds``; a null
    identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object of this package by value, so that executors need
    not have the package; the result gives the object, once per task."""
    raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(raw.value)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few rows at a time become Python objects,
    which take many times the room they have in Arrow's columns. A slice of
    several rows has no more than ``size`` bytes there."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def hash_sample(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Of each group (a label, a language: few) the ``n`` rows whose key hashes
    smallest, with that hash as ``u`` in [0, 1). Rows that can't be among them
    are left out where they are read: about n of each group are ever ranked,
    however large it is."""
    u = F.pmod(F.xxhash64(key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return rows.withColumn("u", u)
    rate = F
    for g, size in counts.items():
        rate = rate.when(F.col(group).eqNullSafe(F.lit(g)), min(1.0, (n + 10 * n ** 0.5 + 100) / size))
    order = Window.partitionBy(group).orderBy("u", key)
    return (rows.withColumn("u", u).where(F.col("u") <= rate).withColumn("rank_in_group", F.row_number().over(order))
            .where(F.col("rank_in_group") <= n).drop("rank_in_group"))


#: DuckDB: the unsigned crc32 of a list of bytes, by the polynomial's table; and a text's bytes.
CRC_SQL = """crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """Of a text expression; ``crc_table`` must be in reach."""
    digit = "(strpos('0123456789ABCDEF', substr(hex(encode({t})), 2 * k + {n}, 1)) - 1)".replace("{t}", text)
    at = f"16 * {digit.replace('{n}', '1')} + {digit.replace('{n}', '2')}"
    steps = f"list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda k: {at}))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
