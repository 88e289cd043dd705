"""Records that may span lines, cut where they truly end by many tasks at once.

A file is read in blocks, as Spark splits it. Whether a block begins inside
a quoted cell or string, and how deep in brackets, depends on all before it.
So each block is first summed up for both cases, begun outside and inside: how it ends then,
and by how much the depth changes. Run over a file's blocks in their order,
these sums tell how each one truly begins, and a second pass cuts every block
from there, once, for its pieces are kept in the shared folder. A record that lies
across blocks is left as its parts, at most two of a block, which are put together afterwards. Nothing but ten
numbers a block, for every 128 MB or so of text, reaches the driver.

The cutting runs on Arrow batches in the order of the file; what follows,
parsing included, is Spark's own."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need not have the package

#: What a piece of text is: a record, or the first, the last, another part of one.
WHOLE, BEGINS, ENDS, WITHIN = range(4)
_PIECES = "file long, start long, part int, header boolean, record binary"
_SUMMED = "file long, start long, block long, size long, read long, array boolean, end array<int>, change array<int>"
#: Marks of a block: of a file that is a JSON array; the file's last; that one, not ended by a separator.
ARRAY, LAST, SHORT = 1, 2, 4
_BOM = b"\xef\xbb\xbf"
_ESCAPED = re.compile(rb"\\.", re.S)


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Text between separators with the number of its file and its block's place there."""
    return spark.read.option("lineSep", sep).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """(file, start, block, size) and the texts of each block; a task reads its blocks one after the other."""
    def runs() -> Iterator[tuple[tuple, list[bytes]]]:
        for batch in batches:
            block = batch["block"].to_numpy()
            ends = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for at, end in zip(ends, ends[1:]):
                if at < end:
                    yield tuple(batch[c][at].as_py() for c in ("file", "start", "block", "size")), batch["value"].slice(at, end - at).to_pylist()

    some = runs()
    ahead = next(some, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                values, ahead = ahead[1], None
                yield from values
                ahead = next(some, None)

        yield key, own()


def _begun(summed: DataFrame) -> np.ndarray:
    """How each block begins, a column a block in order of their numbers: number,
    inside quotes, depth, marks. One pass over a file's blocks in their order."""
    found, file = [], None
    rows = sorted(summed.collect(), key=lambda r: (r["file"], r["start"]))       # Spark's sort would read all text twice, once to sample
    for r, after in zip(rows, [*rows[1:], None]):
        if r["file"] != file:
            file, inside, depth, read = r["file"], 0, 0, 0
            marks = ARRAY if r["array"] else 0
        read += r["read"]
        if after is None or after["file"] != file:
            # a file that ends with its separator has as many bytes as were read; the reader takes a byte order mark away
            marks |= LAST | (SHORT if read - r["size"] in (1, 1 - len(_BOM)) else 0)
        found.append((r["block"], inside, depth, marks))
        depth += r["change"][inside]
        inside = r["end"][inside]
    return np.array(sorted(found), np.int64).reshape(-1, 4).T


def _cut(lines: DataFrame, begun: np.ndarray, cutter: Callable[..., Iterator[tuple]], glue: bytes) -> DataFrame:
    """``record`` (binary) and ``header`` (the file's first) of all records. The cutter gets a
    block's place, state and texts and yields (part, whether it is the file's first, text)."""
    states = lines.sparkSession.sparkContext.broadcast(begun)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = states.value
        rows: list[tuple] = []
        size = 0
        for key, texts in _blocks(batches):
            _, *state = known[:, np.searchsorted(known[0], key[2])].tolist()
            for part, header, text in cutter(key[1], *state, texts):
                rows.append((key[0], key[1], part, header, text))
                size += len(text)
                if len(rows) >= 4096 or size >= 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    kept = scratch_path(lines.sparkSession, "pieces")
    lines.withColumn("value", F.col("value").cast("binary")).mapInArrow(run, _PIECES).write.parquet(kept)
    pieces = lines.sparkSession.read.schema(_PIECES).parquet(kept)
    parts = pieces.where(F.col("part") != WHOLE).withColumn("begins", (F.col("part") == BEGINS).cast("int"))
    order = Window.partitionBy("file").orderBy("start", "begins").rowsBetween(Window.unboundedPreceding, 0)
    joined = (parts.withColumn("number", F.sum("begins").over(order)).groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("start", "begins", F.hex("record").alias("record")))).alias("all"),
                   F.max("header").alias("header"))
              .select("header", F.unhex(F.array_join(F.col("all.record"), glue.hex())).alias("record")))
    return pieces.where(F.col("part") == WHOLE).select("header", "record").unionByName(joined)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.record_batch({name: pa.array(c, kind) for name, kind, c in zip(("file", "start", "part", "header", "record"), kinds, zip(*rows))})


def _summed(lines: DataFrame, sums: Callable[[Iterator[bytes]], tuple[list[int], list[int]]]) -> DataFrame:
    """A row a block: its bytes, whether the first sign opens an array, how it ends and how depth changes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, block, size), texts in _blocks(batches):
            read, array = 0, None

            def seen() -> Iterator[bytes]:
                nonlocal read, array
                for text in texts:
                    read += len(text) + 1
                    if array is None and (bare := text.removeprefix(_BOM).strip()):
                        array = bare.startswith(b"[")
                    yield text

            end, change = sums(seen())
            yield pa.record_batch({
                **{n: pa.array([v], pa.int64()) for n, v in (("file", file), ("start", start), ("block", block), ("size", size), ("read", read))},
                "array": pa.array([bool(array)]), "end": pa.array([end], pa.list_(pa.int32())), "change": pa.array([change], pa.list_(pa.int32()))})

    return lines.withColumn("value", F.col("value").cast("binary")).mapInArrow(run, _SUMMED)


# -- delimited text -----------------------------------------------------------

def may_be_open(line: Column, sep: str) -> Column:
    """Whether a line holds a quote that doesn't belong to a cell quoted within
    the line, so that a record may go on in the next line."""
    bare, edge = F.replace(line, F.lit('""'), F.lit("")), re.escape(sep)
    return F.when(line.contains('"'), F.regexp_replace(bare, f'(?<=^|{edge})"[^"]*"(?={edge}|$)', "").contains('"')).otherwise(F.lit(False))


def _inside_after(line: bytes, inside: int, sep: bytes) -> int:
    """Whether a quoted cell is open behind a line, if one is (or none is) in front of it. A
    quote opens a cell at its beginning only; elsewhere in an unquoted cell it is a letter."""
    at = 0
    while True:
        if inside:
            end = line.find(b'"', at)
            if end < 0:
                return 1
            if line.startswith(b'"', end + 1):
                at = end + 2
                continue
            inside, at = 0, end + 1
        elif line.startswith(b'"', at) and (not at or line.startswith(sep, at - len(sep))):
            inside, at = 1, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return 0
        at += len(sep)


def _csv_block(sep: bytes, start: int, inside: int, depth: int, marks: int, lines: Iterator[bytes]) -> Iterator[tuple]:
    fresh, whole = start == 0, not inside
    held: list[bytes] = []
    for line in lines:
        if fresh and not held:
            line = line.removeprefix(_BOM)
        held.append(line)
        inside = _inside_after(line, inside, sep) if b'"' in line else inside
        if not inside:
            text = b"\n".join(held).removesuffix(b"\r")
            held = []
            if not whole:
                yield ENDS, False, text
                whole = True
            elif text.strip():                                # blank lines are no records
                yield WHOLE, fresh, text
                fresh = False
    if held:
        yield (BEGINS if whole else WITHIN), fresh, b"\n".join(held)


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The records of delimited text in which quoted cells hold line breaks
    (``record``, binary; ``header``: it is its file's first). Quotes in a cell are
    doubled. Line feeds end lines, with or without a carriage return."""
    mark = sep.encode()

    def sums(texts: Iterator[bytes]) -> tuple[list[int], list[int]]:
        end = [0, 1]
        for text in texts:
            if b'"' in text:
                end = [_inside_after(text, x, mark) for x in end]
        return end, [0, 0]

    lines = _lines(spark, path, "\n")
    return _cut(lines, _begun(_summed(lines, sums)), partial(_csv_block, mark), b"\n")


# -- JSON ---------------------------------------------------------------------

def _depth(texts: list[bytes]) -> int:
    return sum(t.count(b"{") + t.count(b"[") - t.count(b"}") - t.count(b"]") for t in texts)


def _between_quotes(text: bytes) -> list[bytes]:
    return (_ESCAPED.sub(b"", text) if b"\\" in text else text).split(b'"')


def _json_sums(texts: Iterator[bytes]) -> tuple[list[int], list[int]]:
    parity, change = 0, [0, 0]
    for text in texts:
        parts = _between_quotes(text)
        for begun in (0, 1):
            change[begun] += _depth(parts[begun ^ parity::2])
        parity ^= len(parts) - 1 & 1
        change[parity] -= 1                # the brace that ends the text is outside if so many quotes came before
    return [parity, 1 - parity], change


def _json_block(start: int, inside: int, depth: int, marks: int, texts: Iterator[bytes]) -> Iterator[tuple]:
    base, whole, fresh = marks & ARRAY, not inside and depth <= (marks & ARRAY), start == 0
    held: list[bytes] = []

    def record(closing: bytes) -> bytes:
        nonlocal fresh
        text = b"".join(held).replace(b"\n", b" ").replace(b"\r", b" ")
        if whole:
            text = text.removeprefix(_BOM).lstrip()
            if fresh and base:
                text = text.removeprefix(b"[")
            text = text.lstrip(b" \t,")
            fresh = False
        return text + closing

    ahead = next(texts, None)
    while ahead is not None:
        text, ahead = ahead, next(texts, None)
        held.append(text)
        if ahead is None and marks & SHORT:
            break                                        # what follows the last brace
        parts = _between_quotes(text)
        depth += _depth(parts[inside::2])
        inside ^= len(parts) - 1 & 1
        depth -= not inside
        if inside or depth > base:
            held.append(b"}")
            continue
        yield (WHOLE if whole else ENDS), False, record(b"}")
        held, whole = [], True
    if marks & LAST:                                     # only white space and the array's end are no record
        rest = record(b"")
        if not whole or rest.rstrip().removeprefix(b"[").removesuffix(b"]").strip():
            yield (WHOLE if whole else ENDS), False, rest
    elif held:
        yield (BEGINS if whole else WITHIN), False, record(b"")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a JSON array, or the objects of a file of pretty-printed
    ones, each as one line (``record``, binary). What is no object comes out as
    it stands, so that parsing it fails."""
    lines = _lines(spark, path, "}")
    return _cut(lines, _begun(_summed(lines, _json_sums)), _json_block, b"").select("record")
