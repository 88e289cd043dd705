"""Document fingerprints: bottom-k sketches of five-word shingles.

A sketch holds the k smallest distinct shingle hashes of a text. Sketches of
parts merge into the sketch of the whole (the k smallest of both), so very
long texts are sketched block by block, and the sketches of documents merge
into those of sources or corpora (``merged``). A sketch of fewer than k
hashes holds every shingle and its estimates are exact.

Defined results: a null text is an empty one; texts without words have an
empty fingerprint, which is like another empty one (1) and unlike any other
(0). Order of documents: descending identifier, nulls last, then text;
repeated rows follow each other; a single document is its own next one.
Extra columns are ignored. No rows in, no rows out."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, slices, texts
from .shingles import WORDS, of_words, word_hashes

#: Hashes a sketch holds.
K = 128
#: Words sketched at a time.
PART = 1 << 17

OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, shingles double, edited_shingles double, kept_share double")


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a text whose parts have these sketches."""
    return bottom(np.concatenate([a, b]), k)


def sketch(text: str, k: int = K) -> np.ndarray:
    """Of the whole text; long ones part by part, each with the words that
    shingles share with the next part."""
    words = word_hashes(text)
    out = bottom(of_words(words[:PART + WORDS - 1]), k)
    for at in range(PART, len(words) - WORDS + 1, PART):
        out = merge(out, bottom(of_words(words[at:at + PART + WORDS - 1]), k), k)
    return out


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0 ** 64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a) or not len(b):
        return float(not len(a))
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / ((1 + j) * distinct(a, k)))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the beginning of the following one."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (range, guest, doc_id, text): each document with the one
    after it. Only one document is held back."""
    names = [x.split()[0] for x in OUT.split(", ")]
    held = None                                     # (range, doc_id, text, sketch) of the row above
    for batch in slices(batches):
        out: list[tuple] = []
        for at, guest, doc_id, text in zip(*(batch[c].to_pylist() for c in ("range", "guest", "doc_id", "text"))):
            own = sketch(text)
            if held and held[0] == at:
                _, of, above, its = held
                new = edited(above, text)
                changed = sketch(new) if new != above else its
                out.append((of, len(above), hashlib.sha256(new.encode()).hexdigest(), to_text(its), to_text(changed),
                            resemblance(its, changed), resemblance(its, own), distinct(its), distinct(changed),
                            containment(its, changed)))
            held = None if guest else (at, doc_id, text, own)
        if out:
            columns = list(zip(*out))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)


_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]


def one_a_partition(spark: SparkSession, number: Column, n: int) -> Column:
    """A key for each number modulo ``n`` that hashing puts into a partition of its own."""
    of = F.pmod(F.hash("id"), F.lit(n))
    keys = {r["p"]: r["id"] for r in spark.range(0, 32 * n + 64).groupBy(of.alias("p")).agg(F.min("id").alias("id")).collect()}
    return F.element_at(F.lit([keys.get(i, i) for i in range(n)]).cast("array<bigint>"), (F.pmod(number, F.lit(n)) + 1).cast("int"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its sketch, the sketch of its edited text, and how alike
    they and the next document's are. Also the estimated numbers of distinct
    shingles and the share of the document's shingles left in the edited text.

    The order needs each document next to its follower: identifiers are cut
    into ranges at their quantiles (a bounded list), each range is sorted by
    itself, and the first document of the following range is sent along as a
    guest at the end of the range."""
    spark, rows = docs.sparkSession, texts(docs)
    n = partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # range 0 holds the largest identifiers; nulls come last
    at = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
        F.lit(len(cuts)) - F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: F.col("doc_id") > c))
        if cuts else F.lit(0))
    keyed = rows.select(at.cast("int").alias("range"), "doc_id", "text")
    tops = keyed.groupBy("range").agg(F.max("doc_id").alias("top"))         # a row per range, at most one a partition
    order = Window.orderBy("range")
    before = tops.select("range", "top", F.coalesce(
        F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("host"))
    first = Window.partitionBy("range").orderBy("text")
    guests = (keyed.join(F.broadcast(before.withColumnRenamed("range", "of")),
                         (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
              .withColumn("n", F.row_number().over(first)).where("n = 1")
              .select(F.col("host").alias("range"), F.lit(True).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "text"))
    both = keyed.withColumn("guest", F.lit(False)).unionByName(guests)
    return (both.repartition(n, one_a_partition(spark, F.col("range"), n))
            .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")
            .mapInArrow(_pairs, OUT))


def merged(prints: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of groups of documents, from theirs: the columns ``by`` and
    ``hashes`` (the k smallest). Each task passes on at most k hashes of a group."""
    raw = F.unbase64("fingerprint")
    unpacked = prints.where(F.col("fingerprint") != "").select(*by, F.explode(F.transform(
        F.sequence(F.lit(0), (F.length(raw) / 8 - 1).cast("int")),
        lambda i: F.hex(F.substring(raw, i * 8 + 1, F.lit(8))))).alias("hash"))
    rank = Window.partitionBy(*by).orderBy("hash")
    return (unpacked.distinct().withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
            .groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias("hashes")))
