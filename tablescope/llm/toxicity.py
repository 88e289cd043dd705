"""Toxicity by the nearest labelled examples.

Examples: of each label the ``PER_LABEL`` labelled documents whose
identifiers hash smallest, a documented bound; terms are the words that any of
them holds, none left out, with the number of examples that hold each. A
document's vector holds (1 + ln frequency) * idf * lean, scaled to length 1;
words that no example holds don't count. The lean is the square root of 1 + the
likelihood ratio statistic of a term that is commoner with label 1, and 1 for
every other term: it weighs terms, it leaves none out.

Search: a block-max inverted index. Examples that resemble each other are next
to each other, ``BLOCK`` to a block, and every term's postings (example, weight)
are in that order. Most of all postings are those of the ``COMMON`` commonest
terms; they are kept a slab a block, with the largest weight of each term in
each block. A slice of documents is searched at a time: the postings of a
document's other terms, few each, are added up; with the largest weights of its
common terms they bound its cosine with any example of a block. Blocks are
scored in the order of their bounds, the first ``FIRST``, then all whose bound
reaches the ``NEAREST``-th best cosine found; the others are skipped. What comes
within ``SLACK`` of the best, single precision's share, is computed again in
double, so the neighbours are those of a search of all. Ties go to the example
that comes first by identifier hash.

Score: neighbours vote with weight 1 / (1 - cosine + ``NEAR``), times the
number of labelled documents each stands for; examples that share no term with
the document are no neighbours. The share of the vote is calibrated to a
probability by isotonic regression over the examples, each scored without
itself. Documents without any term get the examples' own rate of that case,
0 if no example is without.
The evidence is the neighbours with their cosines and labels.

Defined results: null and empty texts have no term; without labelled
examples every score is 0, with examples of label 1 alone it is 1; labels other than 0 and 1 and nulls are not
examples; of several labels of one identifier the largest counts. Extra
columns are ignored. No rows in, no rows out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, hash_sample, shipped, slices, texts

#: Labelled documents of a label; neighbours; examples of a block; the votes' least distance.
PER_LABEL, NEAREST, BLOCK, NEAR = 3000, 15, 64, 0.05
#: Terms whose postings are slabs; blocks scored first; what single precision may be off by.
COMMON, FIRST, SLACK = 512, 8, 1e-5
#: Coordinates of the sketches that resemblance of examples is judged by, rounds of grouping them.
SKETCH, ROUNDS = 64, 5
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W\d_]+")
_NONE = np.empty(0, np.int64), np.empty(0)


def words_of(text: str) -> Counter:
    """Words in lower case, with frequencies."""
    return Counter(_WORDS.findall(text.lower()))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in parts so small that the library keeps to this task's own thread."""
    out, some = np.empty((len(a), b.shape[1]), np.float32), max(1, (1 << 18) // max(1, b.size))
    for at in range(0, len(a), some):
        np.matmul(a[at:at + some], b, out=out[at:at + some])
    return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Index:
    """Examples as a block-max inverted index, with votes and calibration.
    ``held``: of each example the places in ``words`` of what it holds, one
    example after the other; ``times``: how often; ``ends``: where each one ends."""

    def __init__(self, words: pa.Array, ids: np.ndarray, labels: np.ndarray, held: np.ndarray, times: np.ndarray,
                 ends: np.ndarray, sizes: tuple[float, float], nearest: int = NEAREST):
        self.words, self.nearest = words, nearest
        self.number: dict[str, int] | None = None
        each = np.array([n / max(1, (labels == label).sum()) for label, n in enumerate(sizes)])[labels] if len(labels) else np.empty(0)
        empty = np.diff(ends, prepend=0) == 0
        weight = each[empty].sum()
        self.without = float((each * labels)[empty].sum() / weight) if weight else float(len(labels) > 0 and labels.all())
        place = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        self.idf = self._idf(held, labels[place], labels, len(words))
        weights = (1 + np.log(times)) * self.idf[held]
        weights /= np.sqrt(np.bincount(place, weights ** 2, len(ids)))[place]
        # examples with any term, those that resemble each other side by side
        used = np.flatnonzero(~empty)
        order = used[self._grouped(place, held, weights, len(ids))[used].argsort(kind="stable")]
        new = np.full(len(ids), -1)
        new[order] = np.arange(len(order))
        self.ids, self.labels, self.each, self.first = ids[order], labels[order], each[order], order
        # example by example: what each holds; term by term: the postings of all but the commonest
        by_example = np.lexsort((held, new[place]))
        self.held, self.weight = held[by_example], weights[by_example]
        self.ends = np.append(0, np.cumsum(np.bincount(new[place], minlength=len(order))))
        self.common = np.full(len(words), -1, np.int32)
        commonest = (-np.bincount(held, minlength=len(words))).argsort(kind="stable")[:COMMON]
        self.common[commonest] = np.arange(len(commonest))
        by_term = np.lexsort((new[place], held))
        by_term = by_term[self.common[held[by_term]] < 0]
        self.example, self.posted = new[place][by_term].astype(np.int32), weights[by_term]
        self.starts = np.searchsorted(held[by_term], np.arange(len(words) + 1))
        self.blocks = -(-len(order) // BLOCK)
        self.slabs: np.ndarray | None = None
        self.room: np.ndarray | None = None
        self.steps, self.levels = np.empty(0), np.empty(0)
        if len(order):
            votes: list[float] = []
            for at in range(0, len(order), SLICE):
                some = range(at, min(at + SLICE, len(order)))
                own = [slice(self.ends[i], self.ends[i + 1]) for i in some]
                votes += [self.vote(*n) for n in self.searches([(self.held[o], self.weight[o]) for o in own], list(some))]
            self.steps, self.levels = isotonic(np.array(votes), self.labels.astype(float), self.each)

    @staticmethod
    def _idf(held: np.ndarray, held_by: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
        """idf times the lean of each word."""
        b, n1 = np.bincount(held, held_by, n), float(labels.sum())
        a, n0 = np.bincount(held, minlength=n) - b, len(labels) - n1
        idf = np.log((1 + len(labels)) / (1 + a + b)) + 1
        if not n0 or not n1:
            return idf

        def part(seen: np.ndarray, of: float, all_seen: np.ndarray) -> np.ndarray:
            return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(all_seen * of / (n0 + n1), 1e-300)), 0)
        statistic = part(a, n0, a + b) + part(b, n1, a + b) + part(n0 - a, n0, n0 + n1 - a - b) + part(n1 - b, n1, n0 + n1 - a - b)
        return idf * np.where(b * n0 > a * n1, np.sqrt(1 + 2 * np.maximum(statistic, 0)), 1)

    @staticmethod
    def _grouped(place: np.ndarray, held: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """A number of the group each example falls in, by sketches of their vectors."""
        hashed = (held + 1) * 0x9E3779B1 % (1 << 32)
        signs = np.where(hashed >> 31, weights, -weights)
        sketch = np.bincount(place * SKETCH + (hashed >> 16) % SKETCH, signs, n * SKETCH).astype(float).reshape(n, SKETCH)
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-12)
        groups = max(1, n // BLOCK)
        centres = sketch[np.linspace(0, n - 1, groups).astype(int)] if n else sketch
        group = np.zeros(n, np.int64)
        for _ in range(ROUNDS if n else 0):
            group = (sketch @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, group, sketch)
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if groups > 2:                                              # groups that resemble each other are neighbours
            along = np.linalg.svd(centres, full_matrices=False)[0][:, 0]
            group = along.argsort(kind="stable").argsort(kind="stable")[group]
        return group

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The places of a document's known words and their weights."""
        if self.number is None:
            self.number = {w: i for i, w in enumerate(self.words.to_pylist())}
        known = np.array([self.number.get(w, -1) for w in counts], np.int64)
        times = np.fromiter(counts.values(), float, len(counts))[known >= 0]
        known = known[known >= 0]
        weights = (1 + np.log(times)) * self.idf[known]
        return known, weights / np.sqrt((weights ** 2).sum()) if len(known) else weights

    def __getstate__(self):
        return {**self.__dict__, "number": None, "slabs": None, "largest": None, "room": None}            # made again where it is used

    def _slabs(self) -> np.ndarray:
        """Blocks by common terms by examples; sets ``largest`` too, terms by blocks."""
        if self.slabs is None:
            slabs = np.zeros((self.blocks, (self.common >= 0).sum(), BLOCK), np.float32)
            example = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
            row = self.common[self.held]
            mine = row >= 0
            slabs[example[mine] // BLOCK, row[mine], example[mine] % BLOCK] = self.weight[mine]
            self.slabs, self.largest = slabs, np.ascontiguousarray(slabs.max(axis=2).T) if self.blocks else np.zeros((0, 0), np.float32)
        return self.slabs

    def searches(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each document the places and cosines of the nearest examples, best
        first; only those that share a term. ``but``: the example each one is itself."""
        return self.searches_counted(vectors, but)[0]

    def searches_counted(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Also how many blocks were scored, of all documents together."""
        if not len(self.ids) or not vectors:
            return [_NONE] * len(vectors), 0
        slabs, n = self._slabs(), len(vectors)
        common = np.zeros((n, slabs.shape[1]), np.float32)
        sums = np.zeros((n, self.blocks * BLOCK), np.float32)
        for k, (terms, weights) in enumerate(vectors):
            row = self.common[terms]
            common[k, row[row >= 0]] = weights[row >= 0]
            rest, by = terms[row < 0], weights[row < 0]
            sizes = self.starts[rest + 1] - self.starts[rest]
            at = _spans(self.starts[rest], sizes)
            sums[k] = np.bincount(self.example[at], self.posted[at] * np.repeat(by, sizes), sums.shape[1])
        if but is not None:
            sums[np.arange(n), but] = -np.inf
        by_block = sums.reshape(n, self.blocks, BLOCK)
        bounds = by_block.max(axis=2) + _product(common, self.largest) + np.float32(SLACK)
        order = (-bounds).argsort(axis=1, kind="stable")[:, :FIRST]
        chosen = np.zeros((n, self.blocks), bool)
        np.put_along_axis(chosen, order, True, axis=1)
        known = np.full_like(sums, -np.inf).reshape(by_block.shape)
        scored = 0
        for _ in range(2):
            for b in np.flatnonzero(chosen.any(axis=0)).tolist():
                mine = np.flatnonzero(chosen[:, b])
                known[mine, b] = by_block[mine, b] + _product(common[mine], slabs[b])
                scored += len(mine)
            flat = known.reshape(n, -1)
            some = min(self.nearest, flat.shape[1])
            least = np.maximum(np.partition(flat, -some, axis=1)[:, -some], 0)[:, None]
            chosen = (bounds >= least) & ~chosen
        return [self._exact(*v, np.flatnonzero((row > 0) & (row >= low - SLACK))) for v, row, low in zip(vectors, flat, least)], scored

    def _exact(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of some examples, in double precision."""
        if not len(places):
            return _NONE
        own = self._scratch
        own[terms] = weights
        sizes = self.ends[places + 1] - self.ends[places]
        at = _spans(self.ends[places], sizes)
        cosines = np.round(np.add.reduceat(own[self.held[at]] * self.weight[at], np.cumsum(sizes) - sizes), 12)
        own[terms] = 0
        best = np.lexsort((self.first[places], -cosines))[:self.nearest]
        return places[best], cosines[best]

    @property
    def _scratch(self) -> np.ndarray:
        if self.room is None:
            self.room = np.zeros(len(self.words))
        return self.room

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        if not len(places):
            return 0.0
        votes = self.each[places] / (1 - np.minimum(cosines, 1) + NEAR)
        return float((votes * self.labels[places]).sum() / votes.sum())

    def scores(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        """Of each document its score and its neighbours."""
        out: list[tuple[float, list[dict]]] = []
        for places, cosines in self.searches([self.vector(words_of(t)) for t in texts]):
            near = [{"doc_id": i, "cosine": c, "toxic": t} for i, c, t in
                    zip(self.ids[places].tolist(), cosines.tolist(), self.labels[places].tolist())]
            out.append((float(np.interp(self.vote(places, cosines), self.steps, self.levels)) if near else self.without, near))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling equal x, then neighbours that are out of order: each pool's mean x and level."""
    values, at = np.unique(np.round(x, 12), return_inverse=True)
    mass, hits = np.bincount(at, weight, len(values)), np.bincount(at, weight * y, len(values))
    pools: list[list[float]] = []
    for pool in zip((mass * values).tolist(), hits.tolist(), mass.tolist()):
        pools.append(list(pool))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = PER_LABEL) -> Index:
    """The index from ``labels`` (doc_id, toxic) of documents where ``usable``,
    a condition on ``doc_id``, holds. All that reaches the driver: the distinct
    words of at most ``per_label`` examples a label, as one table of columns."""
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = hash_sample(known, "toxic", "doc_id", per_label).withColumnRenamed("u", "hash")
    examples = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "hash", "text")    # at most 2 * per_label identifiers

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [words_of(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "hash": batch["hash"],
                                   "words": pa.array([list(f.keys()) for f in found], pa.list_(pa.string())),
                                   "times": pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))})

    counted = examples.mapInArrow(held, "doc_id long, toxic int, hash double, words array<string>, times array<int>")
    got = (counted.withColumn("text", F.xxhash64("words", "times")).toArrow()
           .sort_by([("hash", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).combine_chunks())
    toxic = got["toxic"].to_numpy().astype(np.int64)
    if not toxic.any():                                       # nothing that could be called toxic
        got, toxic = got.slice(0, 0), toxic[:0]
    words = got["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    return Index(coded.dictionary, got["doc_id"].to_numpy(), toxic, coded.indices.to_numpy().astype(np.int64),
                 got["times"].combine_chunks().flatten().to_numpy().astype(float), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64),
                 (sizes.get(0, 0), sizes.get(1, 0)))


def kept(docs: DataFrame, index: Index) -> DataFrame:
    """``docs``, columns as they were, without the rows whose text is called toxic."""
    model, names = shipped(docs.sparkSession, index), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in slices(batches):
            yield batch.filter(pa.array([s < THRESHOLD for s, _ in own.scores([t or "" for t in batch["text"].to_pylist()])]))

    return docs.select(*names).mapInArrow(run, docs.schema)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``evidence`` (the neighbours) per document, from the text alone."""
    model = shipped(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in slices(batches):
            got = own.scores(batch["text"].to_pylist())
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "score": pa.array([s for s, _ in got], pa.float64()),
                "predicted": pa.array([int(s >= THRESHOLD) for s, _ in got], pa.int32()),
                "evidence": pa.array([e for _, e in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))})

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")
