"""Spelling variants of words, by PartEnum signatures.

Words are counted over all texts. Two words are near if one inserted, deleted
or replaced letter makes one of the other. Their multisets of letters, taken
as binary vectors (dimension: a letter and how many of it came before), then
differ in at most two dimensions: in one if their lengths differ, in two if
not. Signatures are those of partition and enumeration: the dimensions fall
into ``PARTS`` parts, and for every choice of parts that leaves out as many as
can differ, a signature is the vector's projection on them; near words agree
in at least one. As one edit leaves the first or the last half of the shorter
word as it is, each signature is made with either half, and with the length,
so words of the same letters in another order seldom meet. Signatures are
equal-joined and the pairs verified letter by letter. Signatures are hashes of
64 bits; equal ones of different words only add pairs to verify.

A word's form is its near word of largest count, if that is at least
``TIMES`` its own; its root is where forms lead, found by doubling the step
until no word moves (counts at least double, so a few rounds do).

Copies and common words meet in the counting only, which is summed up where
texts are read. A word has few near words (at most some hundred letters fit),
and a signature's words are met by a join that splits where it is uneven. Every
join is a merge join: all tables grow with the words, and Spark would broadcast
some, taking each word's signatures for one row and Parquet's bytes for those of rows.

Defined results: a null text has no word; a null identifier changes no run.
Extra columns are ignored. No rows in, no rows out; words without a near word
are their own root."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, crc_sql, slices, texts, written

#: Letters of a word, its occurrences, how much commoner a form is.
SHORTEST, LEAST, TIMES = 5, 3, 2
#: Parts of the dimensions where two, where one may differ.
PARTS = {2: 5, 1: 3}
#: Distinct words a task sums up before it passes them on.
SUMMED = 1 << 18

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_MASK = (1 << 64) - 1


def lowered(run: str) -> str:
    """A to Z in lower case, all else as it is."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def word_counts(docs: DataFrame, edit: Callable[[int | None], Callable[[str], str]] | None = None) -> DataFrame:
    """``word``, ``n``: the words of at least ``SHORTEST`` letters that occur at least ``LEAST`` times.
    ``edit``: for an identifier, what a lower-cased run of its text counts as."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own: Counter = Counter()
                for word, n in Counter(_RUNS.findall(text)).items():
                    if len(word) >= SHORTEST:
                        own[lowered(word)] += n
                change = edit(doc) if edit else None
                if change:
                    for word, n in own.items():
                        sums[change(word)] += n
                else:
                    sums.update(own)
            if len(sums) >= SUMMED:
                yield counted(sums)
                sums.clear()
        yield counted(sums)

    return (texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.length("word") >= SHORTEST) & (F.col("n") >= LEAST)))


def counted(sums: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(sums.keys(), pa.string()), "n": pa.array(sums.values(), pa.int64())})


class Signatures:
    """The signatures of words, as (role, key): role 0 meets role 0 among words of one length,
    1 (the shorter word) meets 2 (the longer)."""

    def __init__(self):
        self.known: dict[tuple[str, int], int] = {}
        self.chosen = {differ: list(combinations(range(parts), parts - differ)) for differ, parts in PARTS.items()}

    def projections(self, word: str) -> dict[int, list[int]]:
        """By how many dimensions may differ: of each choice of parts a hash of the word's letters there."""
        parts = {differ: [0] * n for differ, n in PARTS.items()}
        times: dict[str, int] = {}
        for letter in word:
            nth = times[letter] = times.get(letter, -1) + 1
            at = self.known.get((letter, nth))
            if at is None:
                at = self.known[letter, nth] = xxhash.xxh3_64_intdigest(f"{letter}{nth}".encode())
            for differ, n in PARTS.items():
                parts[differ][at % 1000003 % n] += at
        return {differ: [sum((k + 1) * parts[differ][k] for k in choice) for choice in self.chosen[differ]] for differ in PARTS}

    def of(self, word: str) -> Iterator[tuple[int, int]]:
        found, size = self.projections(word), len(word)
        for role, differ, shorter in ((0, 2, size), (1, 1, size), (2, 1, size - 1)):
            half = shorter // 2
            for side, kept in enumerate((word[:half], word[size - half:])):
                for choice, value in enumerate(found[differ]):
                    yield role, xxhash.xxh3_64_intdigest(f"{differ} {shorter} {side} {choice} {value & _MASK} {kept}".encode()) - (1 << 63)


def near_pairs(counts: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: both directions of every two near words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        for batch in slices(batches):
            rows = [(word, n, role, key) for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist())
                    for role, key in signatures.of(word)]
            yield pa.record_batch({name: pa.array(c, kind) for name, kind, c in zip(
                ("word", "n", "role", "key"), (pa.string(), pa.int64(), pa.int8(), pa.int64()), zip(*rows))})

    signed = counts.mapInArrow(run, "word string, n long, role byte, key long")
    a, b = merged(signed.where("role != 2")).alias("a"), signed.where("role != 1").alias("b")
    met = a.join(b, F.expr("a.key = b.key AND (a.role = 0 AND b.role = 0 AND a.word < b.word OR a.role = 1 AND b.role = 2)"))
    pairs = met.where("levenshtein(a.word, b.word, 1) = 1").selectExpr(
        "inline(array(struct(a.word AS word, a.n AS n, b.word AS near, b.n AS near_n), "
        "struct(b.word AS word, b.n AS n, a.word AS near, a.n AS near_n)))")
    return pairs.repartition("word").distinct()               # grouped by word already when it is counted by word


def merged(df: DataFrame) -> DataFrame:
    """One side of a join that is to sort and merge, whatever size Spark takes either side for."""
    return df.hint("merge")


def spelling_variants(counts: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each counted word (``word``, ``n``)."""
    counts = written(counts, "words")
    # of largest count, ties: the first in code point order, as Spark compares strings
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(counts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    formed = written(counts.join(merged(near), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    to = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:                                           # every round doubles the step
        to = written(to, "roots")
        on = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = to.join(merged(on), "root", "left")
        if further.where("further IS NOT NULL").isEmpty():
            break
        to = further.select("word", F.coalesce("further", "root").alias("root"))
    return formed.join(merged(to), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def one_letter_less(doc_id: int | None) -> Callable[[str], str] | None:
    """Deletes a letter of the runs that crc32 of ``<doc_id>:<run>`` marks, 1 of 97."""
    if doc_id is None:
        return None
    begun = zlib.crc32(f"{doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), begun)
        if h % 97:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1:]

    return change


#: Near words by definition: a letter deleted gives the other word, or the same letter's place deleted of both the same rest.
ORACLE = f"""WITH RECURSIVE {CRC_SQL},
seen AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) GROUP BY ALL),
marked AS (SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM seen, crc_table WHERE length(run) >= {SHORTEST}),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
  sum(n)::BIGINT AS n FROM marked GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {LEAST}),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(struct_pack(w := other, n := n), struct_pack(less := -n, w := encode(other))) AS b
  FROM near JOIN words ON words.word = near.other GROUP BY near.word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {TIMES} * words.n THEN b.w END AS form,
  CASE WHEN b.n >= {TIMES} * words.n THEN b.n END AS form_n FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM formed UNION ALL SELECT path.word, f.form FROM path JOIN formed f ON f.word = path.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, path.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN path USING (word)
JOIN formed last ON last.word = path.at AND last.form IS NULL"""
