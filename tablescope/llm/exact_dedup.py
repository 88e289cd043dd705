"""Exact duplicates by content sort.

The normalised texts are range-partitioned: Spark samples the keys, picks
splitters and deals the rows out by them. The key is the text's leading
characters, then a hash of all of it, then the identifier and the row's
place in the scan, so that only short keys are sampled and the copies of
one text, however many, spread over as many partitions as their share of
the rows calls for. Spark's external sort puts equal texts next to each
other; one pass compares each text with its neighbour in full. Runs of
equal texts that may go on in a neighbouring partition (those that share
the leading characters and hash of a partition's first or last row) are
joined by a grouping on their whole text, one row per such run.

Defined results: a null text is an empty one; empty and white-space-only
texts follow the same rule (one run of white space equals another, but not
the empty text); null identifiers sort after all others, so a group keeps
one only if it has no other; of repeated rows with one identifier, a single
row is kept. Extra columns are ignored. No rows in, no rows out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, squeezed, texts, written

#: Characters of the text that the splitters hold.
LEAD = 24

OUT = ("doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, "
       "run long, run_text string")


def _changes(now: pa.Array, before) -> np.ndarray:
    """For each row, whether it differs from the one above (``before``: above the first)."""
    first = np.array([before is None or now[0].as_py() != before])
    return np.concatenate([first, pc.not_equal(now[1:], now[:-1]).to_numpy(zero_copy_only=False)])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: each row with the first identifier and the
    size of its run. Holds the identifiers of one class (equal leading
    characters and hash) and one text per run of it, never the whole partition's texts."""
    part = TaskContext.get().partitionId() << 33
    held: list[tuple] = []                     # of the open class: ids, starts of runs, digests, texts of runs
    runs, opening = 0, True                    # opening: the partition's first class is still open
    text = lead = code = None

    def closed(edge: bool) -> pa.RecordBatch:
        nonlocal runs
        ids = pa.concat_arrays([x[0] for x in held])
        starts = np.concatenate([x[1] for x in held])
        firsts, run = np.flatnonzero(starts), np.cumsum(starts) - 1
        sizes = np.diff(np.append(firsts, len(starts)))
        whole = None
        if edge:                               # whole texts only at the edges, one per run
            which, words = np.full(len(starts), -1), [t for x in held for t in x[3]]
            which[firsts] = np.arange(len(firsts))
            whole = pa.array(words, pa.string()).take(pa.array(which, mask=which < 0))
        out = pa.record_batch({
            "doc_id": ids, "keep_id": ids.take(pa.array(firsts)).take(pa.array(run)),
            "group_size": pa.array(sizes[run], pa.int64()), "kept": pa.array(starts),
            "text_sha256": pa.concat_arrays([x[2] for x in held]),
            "run": pa.array(part + runs + run, pa.int64()) if edge else pa.nulls(len(starts), pa.int64()),
            "run_text": whole if edge else pa.nulls(len(starts), pa.string())})
        runs += len(firsts)
        held.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        new_text = _changes(batch["norm"], text)
        new_class = _changes(batch["code"], code) | _changes(batch["lead"], lead)
        cuts = np.flatnonzero(new_class)
        for begin, end in zip(np.concatenate([[0], cuts]), np.append(cuts, batch.num_rows)):
            if begin in cuts and held:
                yield closed(opening)
                opening = False
            if end > begin:
                piece, starts = batch.slice(begin, end - begin), new_text[begin:end]
                held.append((piece["doc_id"], starts, piece["sha"],
                             piece["norm"].take(pa.array(np.flatnonzero(starts))).to_pylist()))
        text, lead, code = (batch[c][-1].as_py() for c in ("norm", "lead", "code"))
    if held:
        yield closed(True)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (smallest identifier
    among equal texts), ``group_size``, ``kept`` and ``text_sha256`` of the
    normalised text."""
    keyed = (texts(docs).select("doc_id", squeezed(F.col("text")).alias("norm"))
             .select("doc_id", "norm", F.substring("norm", 1, LEAD).alias("lead"),
                     F.xxhash64("norm").alias("code"), F.sha2("norm", 256).alias("sha"),
                     F.monotonically_increasing_id().alias("place")))
    last = F.col("doc_id").asc_nulls_last()
    dealt = (keyed.repartitionByRange(partitions(docs.sparkSession), "lead", "code", last, "place")
             .sortWithinPartitions("lead", "code", "norm", last))
    rows = written(dealt.drop("place").mapInArrow(neighbours, OUT), "runs")
    inside = rows.where(F.col("run").isNull())
    edge = rows.where(F.col("run").isNotNull())
    heads = edge.where("kept").select("run", "run_text", "keep_id", "group_size")
    # a group that goes over partitions has one head in each; whole texts are compared
    groups = heads.groupBy("run_text").agg(
        F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"),
        F.min(F.struct(F.col("keep_id").isNull().alias("n"), "keep_id", "run"))["run"].alias("keeps"))
    of_run = heads.select("run", "run_text").join(groups, "run_text").drop("run_text")
    joined = edge.drop("run_text").join(of_run, "run").select(
        "doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"),
        (F.col("kept") & (F.col("run") == F.col("keeps"))).alias("kept"), "text_sha256")
    return inside.drop("run", "run_text").unionByName(joined)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, columns as they were, without all but one document of equal texts.

    The kept identifier of a normalised text's digest finds the row again; of
    repeated rows with that identifier, one stays."""
    stays = exact_dedup(docs).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("at"), F.col("text_sha256").alias("sha"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                        F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("at"),
                        F.sha2(squeezed(F.coalesce(docs["text"].cast("string"), F.lit(""))), 256).alias("sha"))
    one = Window.partitionBy("at", "sha").orderBy(F.xxhash64("doc"))
    return keyed.join(stays.distinct(), ["at", "sha"]).withColumn("n", F.row_number().over(one)).where("n = 1").select("doc.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d"""
