"""SentencePiece encoding and decoding as a max-plus scan over chunks.

A text is a lattice whose edges are pieces; its encoding is the best path.
Weights add along a path and the best of several counts (max-plus), so what
a chunk does to a path is a matrix from the states in which a piece may
cross its left border to those of its right border, and matrices of
neighbouring chunks combine associatively: ``FAN`` at a time, wherever Spark
puts them, then ``FAN`` of the products, until a document has one. From the
top down the products' border states give those of their factors, and every
chunk traces its own part back from the states at its borders. No task holds
more than ``FAN`` matrices of a document, however long it is.

* Unigram models: an edge weighs its piece's score; a state is how far the
  crossing piece reaches into the next chunk.
* BPE models: a sequence of pieces is what the merges yield exactly if every
  two neighbours are what the merges yield for the two alone, so an edge
  weighs 0 after such a neighbour and minus infinity after any other; a
  state also names the crossing piece. The best path is the library's own
  encoding, not an approximation of it.

Chunks of about ``CHUNK`` characters end where a word begins, if one does:
pieces have white space only in front, so no piece crosses that border, the
matrix has one entry, its weight that of the library's encoding of the chunk,
which is then the chunk's part of the best path. Only texts without white space
for a chunk's length need the lattice itself. A text of one chunk has no border.

Defined results: a null or empty text has no ids and decodes to the empty
text; every row is encoded by itself, whether its identifier is null or
repeated. Characters outside the vocabulary become their bytes' pieces.
Decoding returns the text, but a U+2581 in it returns as a space, which the
format cannot tell apart, and a lone surrogate as U+FFFD. Extra columns are
ignored unless carried. No rows in, no rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, written

#: Characters of a chunk; matrices that are multiplied at a time.
CHUNK, FAN = 16384, 64
MARK = "▁"
NEVER = float("-inf")
_WORD_START = re.compile("(?<![ ▁])[ ▁]")

State = tuple[int, str]         # how far into the next chunk; the last piece ("" where it doesn't matter)


class Model:
    """A sentencepiece file: the library, with and without its leading space, and the lattice's edges."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(raw)
        norm = spec.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces or \
                any(MARK in p.piece.lstrip(MARK) for p in spec.pieces):
            raise ValueError("only models that keep the text and have white space in front of pieces are supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.unigram = spec.trainer_spec.model_type == spec.trainer_spec.UNIGRAM
        norm.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE}
        self.unknown = spec.trainer_spec.unk_id
        self.longest = max(map(len, self.pieces))
        self.least = min(s for _, s in self.pieces.values())
        self.fits: dict[tuple[str, str], float] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.plain.encode([self.prefix + t if t else "" for t in texts], num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [t[len(self.prefix):] for t in self.plain.decode(ids, num_threads=1)] if ids else []

    def merged(self, text: str) -> list[str]:
        """The merges' result: of all neighbours whose union is a piece, the best scored, leftmost, first."""
        parts = list(text)
        while True:
            found = [(-self.pieces[u][1], i) for i in range(len(parts) - 1) if (u := parts[i] + parts[i + 1]) in self.pieces]
            if not found:
                return parts
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def total(self, ids: list[int]) -> float:
        """What an encoding by the library weighs."""
        return float(sum(self.plain.get_score(ids))) if self.unigram and ids else 0.0

    def weight(self, last: str, piece: str) -> float:
        if self.unigram:
            return self.pieces[piece][1] if piece in self.pieces else self.least - 10
        if (last, piece) not in self.fits:
            if len(self.fits) > 1 << 18:
                self.fits.clear()
            self.fits[last, piece] = 0.0 if self.merged(last + piece) == [x for x in (last, piece) if x] else NEVER
        return self.fits[last, piece]

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that begin there; a character that is none is one of its own."""
        found = [p for n in range(1, self.longest + 1) if len(p := text[at:at + n]) == n and p in self.pieces]
        return found if found and len(found[0]) == 1 else [text[at], *found]

    def ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def crossing(self, text: str, cut: int) -> list[State]:
        """All states a path may have at a cut."""
        return sorted({(a + len(p) - cut, "" if self.unigram else p) for a in range(max(0, cut - self.longest), cut)
                       for p in self.starting(text, a) if a + len(p) >= cut})

    def walk(self, text: str, begin: int, end: int, start: State, closed: bool) -> dict[tuple[int, str], tuple]:
        """Best paths from a state at ``begin`` over the pieces that begin
        before ``end``: by (position, last piece) the weight, the state before
        and the piece. ``closed``: no piece crosses ``end``."""
        best: dict[tuple[int, str], tuple] = {(begin + start[0], start[1]): (0.0, None, "")}
        at_place: dict[int, list] = {begin + start[0]: [(begin + start[0], start[1])]}
        for at in range(begin, end):
            for state in at_place.pop(at, ()):
                total = best[state][0]
                for piece in self.starting(text, at):
                    to = at + len(piece)
                    if closed and to > end or (w := self.weight(state[1], piece)) == NEVER:
                        continue
                    key = (to, "" if self.unigram else piece)
                    if key not in best:
                        at_place.setdefault(to, []).append(key)
                    if key not in best or total + w > best[key][0]:
                        best[key] = (total + w, state, piece)
        return best

    def matrix(self, text: str, begin: int, end: int, opened: bool, closed: bool) -> list[tuple[State, State, float]]:
        """The chunk's transfer matrix, finite entries only. ``opened``: nothing crosses ``begin``."""
        out = []
        for start in [(0, "")] if opened else self.crossing(text, begin):
            ends: dict[State, float] = {}
            for (at, last), (total, *_) in self.walk(text, begin, end, start, closed).items():
                if at >= end:
                    key = (0, "") if closed else (at - end, last)
                    ends[key] = max(ends.get(key, NEVER), total)
            out += [(start, to, w) for to, w in ends.items()]
        return out

    def trace(self, text: str, begin: int, end: int, start: State, to: State, closed: bool) -> list[int]:
        """The ids of the chunk's own pieces on the best path between two states."""
        best = self.walk(text, begin, end, start, closed)
        state = max(((v[0], k) for k, v in best.items() if k[0] == end + to[0] and (closed or k[1] == to[1])))[1]
        path = []
        while best[state][1] is not None:
            path.append(best[state][2])
            state = best[state][1]
        return [i for piece in reversed(path) for i in self.ids(piece)]


def combined(a: list[tuple[State, State, float]], b: list[tuple[State, State, float]]) -> list[tuple[State, State, float]]:
    """Max-plus product of two neighbouring chunks' matrices."""
    after: dict[State, list] = {}
    for x, y, w in b:
        after.setdefault(x, []).append((y, w))
    best: dict[tuple[State, State], float] = {}
    for x, y, w in a:
        for z, v in after.get(y, ()):
            best[x, z] = max(best.get((x, z), NEVER), w + v)
    return [(x, z, w) for (x, z), w in best.items()]


def product(matrices: list[list[tuple[State, State, float]]]) -> list[tuple[State, State, float]]:
    """Of neighbours from left to right, halves first."""
    while len(matrices) > 1:
        matrices = [combined(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def states_between(matrices: list[list[tuple[State, State, float]]], start: State, to: State) -> list[tuple[State, State]]:
    """The states at each factor's borders on the best path between two states."""
    before: list[dict[State, float]] = [{start: 0.0}]
    for m in matrices:
        after: dict[State, float] = {}
        for x, y, w in m:
            if x in before[-1]:
                after[y] = max(after.get(y, NEVER), before[-1][x] + w)
        before.append(after)
    out = []
    for m, reached in zip(reversed(matrices), reversed(before[:-1])):
        x = max((reached.get(x, NEVER) + w, x) for x, y, w in m if y == to)[1]
        out.append((x, to))
        to = x
    return out[::-1]


def cuts(text: str, size: int = CHUNK) -> list[tuple[int, bool]]:
    """Borders of chunks and whether no piece can cross them."""
    found = [(0, True)]
    for nominal in range(size, len(text), size):
        if nominal > found[-1][0]:
            word = _WORD_START.search(text, nominal, min(len(text), nominal + size))
            found.append((word.start(), True) if word else (nominal, False))
    return [*found, (len(text), True)]


_CHUNKS = "row long, chunk long, before string, body string, after string, opened boolean, closed boolean"
_ENTRIES = "array<struct<x:int,p:string,y:int,q:string,w:double>>"
_ENCODED = f"row long, node long, ids array<int>, matrix {_ENTRIES}"


def _chunked(prefix: str, size: int, longest: int, heads: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        for batch in slices(batches):
            for i, (row, text) in enumerate(zip(batch["row"].to_pylist(), batch["text"].to_pylist())):
                text = prefix + text
                borders = cuts(text, size)
                out = [(row, j, text[max(0, a - longest):a], text[a:b], text[b:b + longest], opened, closed)
                       for j, ((a, opened), (b, closed)) in enumerate(zip(borders, borders[1:]))]
                # what the document carries goes with its first chunk only
                first = [pa.concat_arrays([batch[h].slice(i, 1), pa.nulls(len(out) - 1, batch[h].type)]) for h in heads]
                yield pa.record_batch([*[pa.array(c) for c in zip(*out)], *first], names=[*names, *heads])
    return run


def _chunk_texts(batch: pa.RecordBatch):
    """Whole text with context, where the chunk begins and ends in it, and its borders' kinds."""
    for r in batch.select(["before", "body", "after", "opened", "closed"]).to_pylist():
        text = (r["before"] + r["body"] + r["after"]).replace(" ", MARK)
        yield text, len(r["before"]), len(r["before"]) + len(r["body"]), r["opened"], r["closed"], r["body"]


def encode(docs: DataFrame, model: str, carry: Sequence[str] = (), chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """The carried columns of ``docs``, ``text_sha256`` of the text and ``ids``
    (array of int) per document. ``model``: path of a sentencepiece file.
    ``decoded``: also the ids decoded again, as ``text``, in the same pass
    over the texts of one chunk, so that no second worker holds them."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    mine = Model(file.value)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    names = [f"carried_{i}" for i in range(len(carry))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(carry, names)], text.alias("text"), F.sha2(text, 256).alias("text_sha256"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def short(batches):
        own = Model(file.value)
        for batch in slices(batches):
            ids = own.encode(batch["text"].to_pylist())
            more = [pa.array(own.decode(ids), pa.string())] if decoded else []
            yield pa.record_batch([*[batch[f.name] for f in kept], pa.array(ids, pa.list_(pa.int32())), *more],
                                  names=[*[f.name for f in kept], "ids", *["text"] * decoded])

    def chunks(batches):
        own = Model(file.value)
        for batch in slices(batches):
            ids, matrices = [], []
            for whole, begin, end, opened, closed, body in _chunk_texts(batch):
                clean = opened and closed
                ids.append(own.plain.encode(body) if clean else None)
                matrices.append([((0, ""), (0, ""), own.total(ids[-1]))] if clean else own.matrix(whole, begin, end, opened, closed))
            yield pa.record_batch({"row": batch["row"], "node": batch["chunk"], "ids": pa.array(ids, pa.list_(pa.int32())),
                                   "matrix": _packed(matrices)})

    def traced(batches):
        own = Model(file.value)
        for batch in slices(batches):
            states = zip(*(batch[c].to_pylist() for c in "xpyq"))
            ids = [own.trace(whole, begin, end, (x, p), (y, q), closed)
                   for (whole, begin, end, _, closed, _), (x, p, y, q) in zip(_chunk_texts(batch), states)]
            yield pa.record_batch({"row": batch["row"], "node": batch["chunk"], "ids": pa.array(ids, pa.list_(pa.int32()))})

    small = rows.where(F.length("text") <= chunk).mapInArrow(short, f"{schema}, ids array<int>" + ", text string" * decoded)
    giants = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    heads = [f.name for f in kept]
    pieces = written(giants.mapInArrow(_chunked(mine.prefix, chunk, mine.longest, heads), f"{_CHUNKS}, {schema}")
                     .repartition(partitions(spark), "row", "chunk"), "chunks")
    first = written(pieces.mapInArrow(chunks, _ENCODED), "encoded")
    knots = border_states(levels(first.select("row", "node", "matrix")))
    second = (pieces.where("NOT (opened AND closed)").join(knots.withColumnRenamed("node", "chunk"), ["row", "chunk"])
              .mapInArrow(traced, "row long, node long, ids array<int>"))
    whole = (first.where("ids IS NOT NULL").select("row", "node", "ids").unionByName(second)
             .groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("node", "ids"))), lambda s: s["ids"])).alias("ids")))
    large = pieces.where("chunk = 0").select("row", *heads).join(whole, "row").drop("row")
    out = small.unionByName(decode(large, model) if decoded else large)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "text_sha256", "ids", *["text"] * decoded)


_MATRIX = pa.list_(pa.struct([("x", pa.int32()), ("p", pa.string()), ("y", pa.int32()), ("q", pa.string()), ("w", pa.float64())]))


def _packed(matrices: list[list[tuple[State, State, float]]]) -> pa.Array:
    return pa.array([[{"x": x[0], "p": x[1], "y": y[0], "q": y[1], "w": w} for x, y, w in m] for m in matrices], _MATRIX)


def _unpacked(entries: list[dict]) -> list[tuple[State, State, float]]:
    return [((e["x"], e["p"]), (e["y"], e["q"]), e["w"]) for e in entries]


def _factors(nodes: DataFrame) -> DataFrame:
    """Each next level's nodes with their factors in order, ``FAN`` at most."""
    return (nodes.groupBy("row", F.floor(F.col("node") / FAN).alias("above"))
            .agg(F.sort_array(F.collect_list(F.struct("node", "matrix"))).alias("factors")))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The chunks' matrices (row, node, matrix), the products of ``FAN`` of them, of these, ... up to one a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [product([_unpacked(f["matrix"]) for f in factors]) for factors in batch["factors"].to_pylist()]
            yield pa.record_batch({"row": batch["row"], "node": batch["above"], "matrix": _packed(found)})

    out = [nodes]
    while not out[-1].where("node > 0").isEmpty():
        out.append(written(_factors(out[-1]).mapInArrow(run, f"row long, node long, matrix {_ENTRIES}"), "products"))
    return out


def border_states(products: list[DataFrame]) -> DataFrame:
    """row, node, x, p, y, q: the states at the borders of every chunk, from the products down."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                found = states_between([_unpacked(f["matrix"]) for f in r["factors"]], (r["x"], r["p"]), (r["y"], r["q"]))
                out += [(r["row"], f["node"], *a, *b) for f, (a, b) in zip(r["factors"], found)]
            yield pa.record_batch({n: pa.array(c, t) for n, t, c in zip(
                ("row", "node", "x", "p", "y", "q"), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()), zip(*out))})

    ends = {"x": F.lit(0), "p": F.lit(""), "y": F.lit(0), "q": F.lit("")}
    states = products[-1].select("row", "node").withColumns(ends)
    for nodes in reversed(products[:-1]):
        states = (_factors(nodes).join(states.withColumnRenamed("node", "above"), ["row", "above"])
                  .mapInArrow(run, "row long, node long, x int, p string, y int, q string"))
    return states


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with its ``ids`` decoded into a column ``text``."""
    with open(model, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = encoded.columns

    def run(batches):
        own = Model(file.value)
        for batch in slices(batches):
            texts = pa.array(own.decode([x or [] for x in batch["ids"].to_pylist()]), pa.string())
            yield pa.record_batch([*batch.columns, texts], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, text string")
