"""Near-duplicates: ProbMinHash, banding, verification.

1. One pass turns each text into its five-word shingles with their counts,
   a ProbMinHash signature (``probminhash``) and 40 band keys. Texts that repeat
   a shingle get a second signature, with all weights 1, and its band keys too
   (without repeats the two are one): links by plain and by weighted similarity
   have the same chance to share a band. Texts with the same words
   in the same order are one node; copies never meet pairwise.
2. Nodes that share a band key are a bucket. Buckets with the same members
   are kept once, in their lowest band.
3. The shingles of the nodes in buckets are joined to their places in them.
   A task compares the members of one block of a bucket, each pair only in
   the first band it shares, exactly, and passes on a spanning forest of the
   links it finds. Buckets beyond ``BLOCK`` members are cut into blocks; each
   block also gets the bucket's first member. After the components of those
   links, blocks of buckets that still hold several components are compared
   two by two, skipping pairs that are connected by then: no cap, no pairs
   in tables, no bucket in one task.
4. Components of all links are the classes.

Two texts are linked if the plain Jaccard similarity of their five-word
shingles, or the probability Jaccard similarity with counts as weights, is
at least ``SIMILAR``. Shingles are compared by 64-bit hashes.

Defined results: texts without words (null, empty, blank) are alone in their
class, whatever their number; texts of fewer than five words have one
shingle, of all their words; the class is named by its smallest identifier
(null if it has none) and keeps that document, of repeated rows one. Extra
columns are ignored. No rows in, no rows out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, texts, written
from .components import components
from .probminhash import BANDS, band_keys, signature, similarity
from .shingles import of_words, word_hashes

SIMILAR = 0.8
#: Members of a bucket that one task compares with each other.
BLOCK = 256


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        digests, keys = [], []
        for text in batch["text"].to_pylist():
            words = word_hashes(text)
            if not len(words):
                digests.append(None)
                keys.append(None)
                continue
            items, counts = np.unique(of_words(words), return_counts=True)
            digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
            own = band_keys(signature(items, counts.astype(float))).tolist()
            if (counts > 1).any():
                plain = band_keys(signature(items, np.ones(len(items)))).tolist()
                own += [None if b == a else b for a, b in zip(own, plain)]      # a key once a text
            keys.append(own)
        yield pa.record_batch({"doc_id": batch["doc_id"], "code": batch["code"], "digest": pa.array(digests, pa.binary()),
                               "keys": pa.array(keys, pa.list_(pa.int64()))})


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        items, counts = [], []
        for text in batch["text"].to_pylist():
            x, n = np.unique(of_words(word_hashes(text)), return_counts=True)
            items.append(x.tobytes())
            counts.append(n.astype(np.uint32).tobytes() if (n > 1).any() else None)
        yield pa.record_batch({"node": batch["node"], "keys": batch["keys"], "items": pa.array(items, pa.binary()),
                               "counts": pa.array(counts, pa.binary())})


def _weighted_and_plain(keys: list[int | None]) -> np.ndarray:
    """Two rows of band keys, equal for a text without repeated shingles."""
    weighted, plain = keys[:BANDS], keys[BANDS:] or keys[:BANDS]
    return np.array([weighted, [a if b is None else b for a, b in zip(weighted, plain)]])


def _linked(a: tuple, b: tuple) -> bool:
    """Members (.., items as a set, items and counts)."""
    if min(len(a[3]), len(b[3])) * 10 < 7 * max(len(a[3]), len(b[3])) and not (a[5] or b[5]):
        return False
    both = len(a[3] & b[3])
    if both >= SIMILAR * (len(a[3]) + len(b[3]) - both):
        return True
    return (a[5] or b[5]) and both > 0 and similarity(a[4], b[4])[1] >= SIMILAR


def _forest(left: list[tuple], right: list[tuple] | None, band: int) -> Iterator[tuple[int, int]]:
    """Links among the members of ``left`` or, given ``right``, between the
    two: enough of them to connect what is linked. Members: (node, component, keys, ...)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    others = left if right is None else right
    keys = np.array([m[2] for m in others]) if others else np.empty((0, 2, BANDS))
    kinds = [(0, 0), (0, 1), (1, 0), (1, 1)] if any(m[5] for m in [*left, *others]) else [(0, 0)]
    for i, a in enumerate(left):
        start = i + 1 if right is None else 0
        earlier = np.any([(keys[start:, k, :band] == a[2][of, :band]).any(axis=1) for k, of in kinds], axis=0)    # compared in a lower band
        for j in np.flatnonzero(~earlier) + start:
            b = others[j]
            x, y = root(a[1]), root(b[1])
            if x != y and _linked(a, b):
                parent[y] = x
                yield a[0], b[0]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (bucket and block, or pair of blocks) and side."""
    task, band, sides = None, 0, ([], [])

    def links():
        left, right = sides
        return list(_forest(left, right or None, band)) if len(left) + len(right) > 1 and left else []

    for batch in slices(batches):
        found = []
        for row in zip(*(batch[c].to_pylist() for c in ("task", "band", "side", "node", "component", "keys", "items", "counts"))):
            if row[0] != task:
                found += links()
                task, band, sides = row[0], row[1], ([], [])
            items = np.frombuffer(row[6], np.uint64)
            counts = np.ones(len(items), np.uint32) if row[7] is None else np.frombuffer(row[7], np.uint32)
            sides[row[2]].append((row[3], row[4], _weighted_and_plain(row[5]), set(items.tolist()), (items, counts), row[7] is not None))
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
    if found := links():
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _links(places: DataFrame, shingled: DataFrame, n: int) -> DataFrame:
    """``places``: task, band, side, node, component."""
    return (places.join(shingled, "node").repartition(n, "task").sortWithinPartitions("task", "side", "node")
            .select("task", "band", "side", "node", "component", "keys", "items", "counts")
            .mapInArrow(_compared, "a long, b long"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``code`` (hash of the text),
    ``class_id`` (its class's smallest doc_id), ``class_size``, ``kept``."""
    n = partitions(docs.sparkSession)
    coded = texts(docs).withColumn("code", F.xxhash64("text"))
    rows = written(coded.mapInArrow(_signed, "doc_id long, code long, digest binary, keys array<bigint>")
                   .withColumn("row", F.monotonically_increasing_id()), "signed")
    of_digest = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("f")).select("digest", "f.row")
    # a node is the first row of a digest
    nodes = written(rows.drop("digest").join(of_digest, "row"), "nodes")

    banded = (nodes.select(F.col("row").alias("node"), F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
              .select("node", (F.col("at") % BANDS).alias("band"), "key"))
    buckets = (banded.groupBy("key").agg(F.count("*").alias("members"), F.min("band").alias("band"), F.min("node").alias("low"),
                                         F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
               .where("members > 1"))
    kept = (buckets.groupBy("members", "low", "high", "mark").agg(F.min(F.struct("band", "key")).alias("b"))
            .select("b.key", "members", "low"))
    places = written(banded.join(kept, "key"), "places")

    wanted = places.select("node").distinct().join(nodes.withColumnRenamed("row", "node"), "node").select(
        "node", "keys", F.coalesce("doc_id", F.lit(0)).alias("at"), "code")
    sources = coded.select(F.coalesce("doc_id", F.lit(0)).alias("at"), "code", "text")
    one = Window.partitionBy("at", "code", "node").orderBy(F.lit(0))
    shingled = written(wanted.join(sources, ["at", "code"]).withColumn("n", F.row_number().over(one)).where("n = 1")
                       .select("node", "keys", "text")
                       .mapInArrow(_with_shingles, "node long, keys array<bigint>, items binary, counts binary"), "shingles")

    blocks = F.ceil(F.col("members") / BLOCK)
    blocked = places.withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("node", "key"), blocks)).otherwise(F.lit(0)))
    first = blocked.where((F.col("node") == F.col("low")) & (blocks > 1)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    inner = blocked.where((blocks == 1) | (F.col("node") != F.col("low"))).unionByName(first).select(
        F.xxhash64("key", "block").alias("task"), "band", F.lit(0).alias("side"), "node", F.col("node").alias("component"))
    links = written(_links(inner, shingled, n), "inner")

    roots = components(links)
    large = blocked.where(blocks > 1).join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    mixed = large.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    mine, theirs = F.col("block"), F.col("other")
    pairs = (large.join(mixed, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .where(mine != theirs)
             .select(F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("task"), "band",
                     (mine > theirs).cast("int").alias("side"), "node", "component"))
    across = written(_links(pairs, shingled, n), "across")

    member = (nodes.select("row").join(components(links.unionByName(across)).withColumnRenamed("node", "row"), "row", "left")
              .select("row", F.coalesce("root", "row").alias("class")))
    of_node = of_digest.join(member, "row").select("digest", "class")
    worded = rows.where("digest IS NOT NULL").drop("keys").join(of_node, "digest")
    alone = rows.where("digest IS NULL").drop("keys").withColumn("class", F.col("row"))
    classed = written(worded.unionByName(alone).select("row", "doc_id", "code", "class"), "classed")
    # written, so that the join has two plain sides and Spark can split a class of very many documents
    named = written(classed.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))["row"].alias("keeps")), "named")
    return classed.join(named, "class").select("doc_id", "code", "class_id", "class_size",
                                               (F.col("row") == F.col("keeps")).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each class, columns as they were."""
    stays = near_classes(docs).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("at"), "code")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                        F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("at"),
                        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("code"))
    # repeated rows without words are classes of their own: as many stay as there are
    numbered = keyed.withColumn("n", F.row_number().over(Window.partitionBy("at", "code").orderBy(F.xxhash64("doc"))))
    copies = stays.withColumn("n", F.row_number().over(Window.partitionBy("at", "code").orderBy(F.lit(0))))
    return numbered.join(copies, ["at", "code", "n"]).select("doc.*")
