"""Language by rank-order profiles (Cavnar and Trenkle, "N-Gram-Based Text
Categorization", 1994).

A profile is the list of a text's or a language's most frequent letter
n-grams, n from 1 to 3, in order. The out-of-place distance of a document to
a language adds, for each n-gram of the document's profile, how far its
ranks in the two lists are apart, or the list's length where the language
lacks it. The nearest language wins.

The languages' profiles are learned from a bounded sample: of each language
the ``PER_LANGUAGE`` labelled documents whose identifiers hash smallest.
Texts are read whole, block by block.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and where no document has a language to learn; ties go to the language that
is first by code point; ties in a profile go to the smaller n-gram. The
score is the share of the largest possible distance that is left. Extra
columns are ignored. No rows in, no rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, shipped, slices, texts

#: Length of a profile; labelled documents of a language to learn from; letters counted at a time.
TOP, PER_LANGUAGE, BLOCK = 300, 400, 1 << 18

_WORDS = re.compile(r"[^\W\d_]+")
_U = np.uint64


def letters(text: str) -> str:
    """Lower-case words of letters, each between single spaces; empty without a letter."""
    words = _WORDS.findall(text.lower())
    if not "".join(words).isalpha():        # superscripts and the like count as neither digit nor letter
        words = [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return f" {' '.join(words)} " if words else ""


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text of ``letters`` and their counts. An n-gram is
    its code points, 21 bits each; n-grams with a space inside or of spaces alone are left out."""
    seen, times = np.empty(0, _U), np.empty(0, np.int64)
    for at in range(0, len(text), BLOCK):
        a = np.frombuffer(text[max(0, at - 2):at + BLOCK].encode("utf-32-le", "replace"), np.uint32).astype(_U)
        fresh = min(at, 2)                   # the first characters were counted in the block before
        gap = a == 32
        one, two = a[fresh:][~gap[fresh:]], (a[:-1] << _U(21)) | a[1:]
        three = (a[:-2] << _U(42)) | (a[1:-1] << _U(21)) | a[2:]
        skip = max(0, fresh - 1)
        values, counts = np.unique(np.concatenate([one, two[skip:], three[~gap[1:-1]]]), return_counts=True)
        both, where = np.unique(np.concatenate([seen, values]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, where, np.concatenate([times, counts]))
        seen, times = both, total
    return seen, times


def profile(text: str, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order."""
    seen, times = grams(text)
    return seen[np.lexsort((seen, -times))[:top]]


class Profiles:
    """The languages' ranks side by side: one look-up serves all of them."""

    def __init__(self, lists: dict[str, list[int]], top: int = TOP):
        self.top, self.languages = top, sorted(lists)
        self.known = np.unique(np.array([g for x in lists.values() for g in x], _U))
        self.ranks = np.full((len(self.known) + 1, len(lists)), -1, np.int64)
        for j, name in enumerate(self.languages):
            own = np.array(lists[name], _U)
            self.ranks[np.searchsorted(self.known, own), j] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        plain = letters(text or "")
        if not plain or not self.languages:
            return "und", 0.0
        own = profile(plain, self.top)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = self.ranks[np.where(self.known[at] == own, at, len(self.known))]
        apart = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (self.top * len(own)))


def learn(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, top: int = TOP) -> Profiles:
    """Profiles of the languages in ``lang`` among the rows where ``usable`` holds."""
    spark_rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                             docs["lang"].cast("string").alias("lang"), usable.alias("usable")).where("usable AND lang IS NOT NULL")
    chosen = hash_sample(spark_rows.select("lang", "doc_id"), "lang", "doc_id", per_language).select("lang", "doc_id").distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                seen, times = grams(letters(text or ""))
                if len(seen):
                    yield pa.record_batch({"lang": pa.array([lang] * len(seen), pa.string()),
                                           "gram": pa.array(seen.astype(np.int64)), "n": pa.array(times)})

    sums = (spark_rows.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "text")
            .mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).orderBy("lang", "rank").collect()
    lists: dict[str, list[int]] = {}
    for r in rows:                            # at most ``top`` a language
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists, top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` per document, from the text alone."""
    model = shipped(docs.sparkSession, profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in slices(batches):
            found = [own.predict(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "lang_pred": pa.array([x for x, _ in found], pa.string()),
                                   "score": pa.array([x for _, x in found], pa.float64())})

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
