"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, exact_dedup, fingerprints, language, mixing, near_dedup, packing, periodic_runs, personal_data,
    sentence_pieces, spelling, token_counts, toxicity,
)
from .common import fold, table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; callers with files of their own pass their path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)
    found = toxicity.score(docs, index)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "evidence")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs, fold(docs["doc_id"], 3) != 1)
    found = language.identify(docs, profiles)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded text."""
    model, docs = tokenizer_file("piece_bpe_32k.model"), table(spark, sf_dir, "documents")
    both = sentence_pieces.encode(docs, model, ["doc_id"], decoded=True)
    decoded = F.sha2("text", 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), decoded.alias("decoded_sha256"),
                       (decoded == F.col("text_sha256")).alias("round_trip"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return rendered.select("conv_id", "perspective", "part", "n_turns", F.length("text").cast("long").alias("n_chars"),
                           spans.alias("masks"), F.sha2("text", 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).drop("code")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), spelling.one_letter_less))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For one document in ten, by its identifier's crc32, the words from some place on repeat a few of them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    at = g % n
    unit = words[at:at + 1 + (n - at) // (3 + g % 8)]
    return words[:at] + (unit * ((n - at) // len(unit) + 1))[:n - at]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), repeated_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = found.select("*", periodic_runs.longest_run().alias("best"))
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), closing_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_language, op3_personal_data, op4_fingerprints, op5_sentence_pieces, op6_exact_dedup, op7_chat,
    op8_mixing, op9_token_counts, op10_near_dedup, op11_spelling_variants, op12_periodic_runs, op13_packing)}

ORACLE = {"op6_exact_dedup": exact_dedup.ORACLE, "op7_chat": chat.ORACLE, "op8_mixing": mixing.ORACLE,
          "op11_spelling_variants": spelling.ORACLE, "op12_periodic_runs": periodic_runs.ORACLE}
