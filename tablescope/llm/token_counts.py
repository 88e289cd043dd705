"""Token counts without token ids.

A tokenizer never lets a piece cross pre-tokens. So the pieces of each
distinct pre-token are counted once, and a document's count is the sum over
its pre-tokens of frequency times pieces, a join and a grouping.

Pre-tokens that nearly all documents share would be hot join keys and most
of the join's rows. The commonest ones of a bounded sample (at most
``COMMON`` of at most ``LONGEST`` characters, so a few MB at any scale) are
therefore counted first, broadcast, and joined where the frequencies are
made; all others go through the shuffled join. Which way a pre-token takes
has no bearing on any count.

Defined results: a null text is an empty one, with 0 bytes and 0 tokens;
every row gets its own count, whether its identifier is null or repeated.
Extra columns are ignored. No rows in, no rows out."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer_files
from .common import slices, texts, written

#: Documents of the sample, about; common pre-tokens and their most characters.
SAMPLE, COMMON, LONGEST = 4000, 1 << 17, 40

LIMIT = 2048


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` per document.
    ``tokenizer``: path of a .json (tokenizers) or .model (sentencepiece) file."""
    context, kind = docs.sparkSession.sparkContext, tokenizer.rpartition(".")[2]
    file = context.broadcast(tokenizer_files.read(tokenizer))

    def seen(batches):
        """Of a sample: in how many documents a pre-token is."""
        tokens, found = tokenizer_files.load(file.value, kind), Counter()
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                found.update(tokens.split(text)[0].keys())
        yield pa.record_batch({"token": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    def pieces(batches):
        tokens = tokenizer_files.load(file.value, kind)
        for batch in slices(batches):
            yield pa.record_batch({"token": batch["token"], "pieces": pa.array(
                [tokens.count(t) for t in batch["token"].to_pylist()], pa.int64())})

    rows = texts(docs)
    sample = rows.select("text").sample(min(1.0, SAMPLE / max(1, docs.count())), seed=9)
    top = (sample.mapInArrow(seen, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
           .where((F.col("n") > 1) & (F.length("token") <= LONGEST)).orderBy(F.desc("n"), "token").limit(COMMON))
    common = context.broadcast({r.token: r.pieces for r in top.select("token").mapInArrow(pieces, "token string, pieces long").collect()})

    def frequencies(batches):
        tokens, known = tokenizer_files.load(file.value, kind), common.value
        for batch in slices(batches):
            sizes, sums, ends, rest, times = [], [], [0], [], []
            for text in batch["text"].to_pylist():
                found, special = tokens.split(text)
                total = special
                for token, n in found.items():
                    count = known.get(token)
                    if count is None:
                        rest.append(token)
                        times.append(n)
                    else:
                        total += n * count
                sizes.append(len(text.encode("utf-8", "replace")))
                sums.append(total)
                ends.append(len(rest))
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "common": pa.array(sums, pa.int64()),
                "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest, pa.string())),
                "times": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32()))})

    counted = written(rows.mapInArrow(
        frequencies, "doc_id long, n_bytes long, common long, tokens array<string>, times array<int>")
        .withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rest = counted.select("row", F.inline(F.arrays_zip("tokens", "times"))).withColumnRenamed("tokens", "token")
    each = rest.select("token").distinct().mapInArrow(pieces, "token string, pieces long")
    sums = rest.join(each, "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    total = F.col("common") + F.coalesce("others", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "common").join(sums, "row", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
