"""A corpus pipeline of the training-data operators: toxicity, exact and near
duplicates, mixing, SentencePiece encoding and decoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that the caller writes as Parquet and reads again as the
next one's ``docs``. ``run`` does so in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import exact_dedup, mixing, near_dedup, sentence_pieces, toxicity
from tablescope.llm.common import fold, table, written
from tablescope.llm.queries import tokenizer_file


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the nearest labelled examples call toxic (score >= 0.3).
    Learns from the labels, as op1 does; the documents scored are ``docs``."""
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.kept(docs, index)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest identifier stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: documents repeat, or end at the cut, as the budgets say."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with ``text_sha256`` of the text, that of
    the ids decoded again, and whether the two are one (``round_trip``)."""
    both = sentence_pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), ["doc_id", "lang", "source"], decoded=True)
    return both.withColumn("decoded_sha256", F.sha2("text", 256)).drop("text").withColumn(
        "round_trip", F.col("decoded_sha256") == F.col("text_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("SentencePiece encoding and decoding", tokenised),
]

#: The first stage is learned and the third and last are no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
