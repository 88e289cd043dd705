"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within its source, the documents are
ordered by key: the range of keys is cut into equal ranges, about the square
root of the largest source's rows of them, which the hash fills evenly. The
tokens of each (source, range) are summed, a window over a source's ranges
turns those sums into offsets, and a window inside each range adds the
prefix sum of its documents. No task sees more than one range's documents or
one source's ranges; a source with a third of all rows is spread over all of
its ranges. Where the prefix sum reaches the budget, the source is cut
exactly; whole epochs before that repeat the source.

Defined results: a null text has size 0; a null source is a source of its
own, after all others; documents of size 0 take 0; documents that tie on
key and identifier are ordered by size, and equal ones are interchangeable;
a null identifier is hashed as the text ``null``. Extra columns are
ignored unless carried. No rows in, no rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, written

#: Weights of the sources in code point order, repeating, and the most epochs of one source.
WEIGHTS, EPOCHS = (1, 2, 3), 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``src``, ``source_size``, ``target`` and ``budget`` (the target as a
    whole number). ``sizes``: ``src`` and ``size`` per document.

    Sharing the excess again and again until no target is above ``epochs``
    times its source ends where the targets are min(epochs * size, weight *
    level). The sources that stop are those with the least size per weight;
    in that order each source's stop is decided from the sums before it. One
    row per source takes part."""
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.row_number().over(Window.orderBy("src")) - 1) % len(weights) + 1)
    before = Window.orderBy("per_weight", "src").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.lit(epochs) * F.col("source_size")
    sums = (totals.withColumn("weight", weight)
            .withColumn("per_weight", stop / F.col("weight"))
            .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(stop).over(before), F.lit(0)))
            .withColumn("weights_left", F.sum("weight").over(every)
                        - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("level", F.col("left").cast("double") / F.col("weights_left"))
            .withColumn("stops", F.col("per_weight") < F.col("level")))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    target = F.when(F.col("stops"), stop.cast("double")).otherwise(F.col("weight") * level)
    return (sums.withColumn("target", target)
            .select("src", "source_size", "target", F.round("target").cast("long").alias("budget")))


def mix(docs: DataFrame, carry: Sequence[str] = (), weights: Sequence[int] = WEIGHTS,
        epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``,
    ``target``, ``taken`` (words, repeats counted), then the carried columns."""
    def sized(*more):
        source = docs["source"].cast("string")
        return docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            # nulls after every source in code point order, and equal to each other
            F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit(""))).alias("src"),
            F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")))).alias("key"),
            *[docs[c].alias(f"carried_{i}") for i, c in enumerate(more)])

    sizes = written(sized().select("doc_id", "src", "size", "key"), "sizes")
    largest = sizes.groupBy("src").count().agg(F.max("count")).first()[0] or 1   # one number
    ranges = max(1, int(largest ** 0.5))
    cut = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(2 ** 32)).cast("long")
    of_range = sizes.withColumn("range", cut).groupBy("src", "range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (of_range.withColumn("offset", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)))
               .drop("in_range").join(source_targets(sizes, weights, epochs), "src"))
    rows = (sized(*carry) if carry else sizes).withColumn("range", cut)
    inner = (Window.partitionBy("src", "range").orderBy("key", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(offsets, ["src", "range"]).withColumn(
        "before", F.col("offset") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("budget") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
                         *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken k times
    and r words comes as k rows, and once more cut to its first r words
    (joined by single spaces; ``n_chars`` as its new length) if r > 0."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    each = mix(packed, ["doc"]).select("doc", F.explode(parts).alias("first"))
    words = F.filter(F.split("doc.text", SPACE), lambda w: w != "")
    cut = F.when(F.col("first") == 0, F.col("doc.text")).otherwise(
        F.array_join(F.slice(words, 1, F.greatest(F.col("first"), F.lit(1))), " "))
    columns = {c: F.col("doc")[c] for c in docs.columns} | {"text": cut}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("first") == 0, columns["n_chars"]).otherwise(
            F.length(cut).cast(docs.schema["n_chars"].dataType))
    return each.select(*[v.alias(c) for c, v in columns.items()])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER AS weight
      FROM d GROUP BY source),
-- at level v the targets add up to sum(least(3 * size, weight * v)); a source stops if v is above its own level
l AS (SELECT a.source, (SELECT sum(least(3.0 * b.source_size, b.weight * (3.0 * a.source_size / a.weight))) FROM s b) AS reached
      FROM s a),
c AS (SELECT s.*, reached < (SELECT sum(source_size) FROM s) AS stops FROM s JOIN l ON s.source IS NOT DISTINCT FROM l.source),
t AS (SELECT source, source_size,
             CASE WHEN stops THEN 3.0 * source_size ELSE weight *
               (((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM c WHERE stops))::DOUBLE
                / (SELECT sum(weight) FROM c WHERE NOT stops)) END::DOUBLE AS target
      FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + least(greatest(budget % source_size - before, 0), size) END::BIGINT AS taken
FROM p"""
