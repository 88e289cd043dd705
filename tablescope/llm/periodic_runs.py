"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q and at least 4 * q (and
``LEAST``) words that neither neighbour extends. Periods of less than
``FIRST`` words are seen by comparing the words with themselves shifted. For
every scale t = 4, 8, 16, ... the synchronising set holds the places whose
hash of the next t words, or that of the t words t later, is the least of the
t + 1 hashes from there on; what a place's membership depends on are the next
2 t words alone. Windows of t words with a period of at most t / 4 lie in runs
that smaller scales have found; they are left out, which keeps the set sparse.
Every run of a period q in [t, 2 t) then has a place of the set among its
first t, and the next place with the same 2 t words is q words later. So the
pairs of neighbouring places with equal contexts propose all periods; each
proposal is verified, and extended to both sides, by comparing the words.

Texts are read whole; a slice of texts is one array of word numbers with a
number of its own between two texts, the longest first, so that large scales
see long texts alone. Word hashes have 64 bits: two contexts that differ and
agree in all bits, 1 in 2^64, could hide a proposal; nothing is reported by
hash.

Defined results: null, empty and blank texts have no word and no run; each
row counts by itself, with null or repeated identifiers too. Extra columns
are ignored. No rows in, no rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, crc_sql, slices, texts

#: Words of a run; its least exponent; the smallest scale; bytes of texts that are one array.
LEAST, EXPONENT, FIRST, TOGETHER = 6, 4, 4, 1 << 21
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_OUT = np.uint64(2 ** 64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-bit number."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * ``size`` words from those of ``size`` words."""
    return mixed(hashes[:-size] * np.uint64(0xD6E8FEB86659FD93) + hashes[size:])


def window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` + 1 neighbouring values; ``size`` is a power of two."""
    least, have = values, 1
    while have < size:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    return np.minimum(least[:len(values) - size], values[size:])


def short_periods(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all stretches with a smallest period below ``FIRST``."""
    found = []
    for q in range(1, FIRST):
        same = np.concatenate(([0], (words[:-q] == words[q:]).view(np.int8), [0]))
        step = np.diff(same)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        for s, e in zip(starts[(ends - starts) >= (EXPONENT - 1) * q].tolist(), ends[(ends - starts) >= (EXPONENT - 1) * q].tolist()):
            if q == 1 or not (words[s:s + q] == words[s]).all():            # 2 and 3 have no other divisor than 1
                found.append((s, e - s + q, q))
    return found


def extent(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The places around ``at`` that equal the place ``q`` later, first and behind the last."""
    end, step = at, 64
    while end < len(words) - q:
        some = slice(end, min(end + step, len(words) - q))
        differ = np.flatnonzero(words[some] != words[some.start + q:some.stop + q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = some.stop, step * 2
    first, step = at, 64
    while first > 0:
        some = slice(max(0, first - step), first)
        differ = np.flatnonzero(words[some] != words[some.start + q:some.stop + q])
        if len(differ):
            first = some.start + int(differ[-1]) + 1
            break
        first, step = some.start, step * 2
    return first, end


def periodic(words: np.ndarray, ends: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of an array of texts, longest text
    first; ``ends``: where each one ends, its separator included."""
    if not len(words):
        return []
    found = short_periods(words)
    hashes, size = mixed(words.astype(np.uint64)), 1
    sizes = np.diff([0, *ends]) - 1
    while True:
        texts_here = int(np.searchsorted(-sizes, -EXPONENT * max(size, FIRST), side="right"))     # those long enough for a run
        if not texts_here:
            break
        words, hashes = words[:ends[texts_here - 1]], hashes[:ends[texts_here - 1] - size + 1]
        if size >= FIRST:
            chosen = hashes.copy()
            for s, length, q in found:
                if q <= size // EXPONENT and length >= size and s < len(words):
                    chosen[s:s + length - size + 1] = _OUT
            least = window_minimum(chosen, size)
            inside = ((least == chosen[:len(least)]) | (least == chosen[size:])) & (least != _OUT)
            places, hashes = np.flatnonzero(inside), joined(hashes, size)
            order = np.argsort(hashes[places], kind="stable")
            context, places = hashes[places][order], places[order]
            apart = np.diff(places)
            proposed = np.flatnonzero((context[1:] == context[:-1]) & (apart >= size) & (apart < 2 * size))
            seen: dict[int, int] = {}
            for at, q in sorted(zip(places[proposed].tolist(), apart[proposed].tolist())):
                if at >= seen.get(q, 0):
                    first, end = extent(words, at, q)
                    seen[q] = max(end, at + 1)
                    if end - first >= (EXPONENT - 1) * q:
                        found.append((first, end - first + q, q))
        else:
            hashes = joined(hashes, size)
        size *= 2
    return [r for r in found if r[1] >= LEAST]


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, by start and then period."""
    number: dict[bytes, int] = {}
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    coded = [[number.setdefault(w, len(number)) for w in documents[i]] for i in order]
    ends = np.cumsum([len(c) + 1 for c in coded]).tolist()
    codes = np.fromiter(chain.from_iterable(chain(c, (len(number) + k,)) for k, c in enumerate(coded)), np.int64, ends[-1] if ends else 0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for start, length, q in sorted(periodic(codes, ends)):
        place = int(np.searchsorted(ends, start, side="right"))
        out[order[place]].append((start - (ends[place - 1] if place else 0), length, q))
    return [sorted(o, key=lambda r: (r[0], r[2])) for o in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that repeat a run's first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text with each run's first period only. ``edit``: changes a document's
    words before they are looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch["text"].cast(pa.binary()).to_pylist()
            ids = batch["doc_id"].to_pylist()
            at = 0
            while at < len(raw):
                end, size = at, 0
                while end < len(raw) and (end == at or size + len(raw[end]) <= TOGETHER):
                    size, end = size + len(raw[end]), end + 1
                words = [t.split() for t in raw[at:end]]              # bytes split at ASCII white space alone
                if edit:
                    words = [edit(i, w) for i, w in zip(ids[at:end], words)]
                runs = runs_of(words)
                yield pa.record_batch({
                    "doc_id": pa.array(ids[at:end], pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()),
                    "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs],
                                     pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    "collapsed": pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())})
                at = end

    return texts(docs).mapInArrow(run, SCHEMA)


def longest_run() -> Column:
    """Of the ``runs`` the longest, of equal ones the first, of these the one with the smallest period; null without a run."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short")))
    best = F.array_max(ranked)
    return F.when(F.size("runs") > 0, F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["short"]).alias("period")))


#: By definition: stretches of places that equal the place q later, of every q, without those that lie in one of a smaller period.
ORACLE = f"""WITH {CRC_SQL},
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc_sql("doc_id::VARCHAR")} AS h FROM documents, crc_table),
sized AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM split),
edited AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1]) AS w FROM sized),
placed AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM edited),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same) GROUP BY doc_id, q, part),
long AS (SELECT * FROM stretches WHERE length >= greatest({LEAST}, {EXPONENT} * q)),
runs AS (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM stretches s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start
  AND s.start + s.length >= r.start + r.length)),
summed AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := q), struct_pack(a := -length, b := start, c := q)) AS best,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM edited e LEFT JOIN summed USING (doc_id) LEFT JOIN left_over USING (doc_id)"""
