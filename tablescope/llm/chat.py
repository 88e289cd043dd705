"""Chat rendering with rotated perspectives.

For every participant of a dialogue, the dialogue is rendered with that
speaker as the assistant, all others as users by name, system messages as
system, and the mask covers what the assistant writes: its messages and
their end marks.

A message's place in its dialogue comes from one distributed numbering of
all messages, so a dialogue with very many messages is not gathered in a
task: it is rendered in parts of ``PART`` messages, and only a part's messages meet.

Defined results: order within a dialogue is turn (nulls last), speaker,
the message's first ``LEAD`` characters, its md5; repeated rows are repeated messages.
A null role is the speaker ``unknown``, a null text an empty message, rows
with a null conv_id are one dialogue. System messages have no perspective of
their own, so a dialogue of system messages alone renders to no row. ``<|``
in a message or name becomes ``< |``, so that no message can forge a mark;
line ends in names become spaces. Extra columns are ignored. No rows in, no rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowid import with_row_number
from .common import slices

PART, LEAD = 256, 64
SYSTEM, UNKNOWN = "system", "unknown"
#: Marks of the rendered form.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"

OUT = "conv_id long, perspective string, part long, n_turns long, text string, masks array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def render(messages: list[dict], perspective: str) -> tuple[str, list[dict]]:
    """The text and its masked spans (code points, end exclusive)."""
    out, masks, at = [], [], 0
    for m in messages:
        mine = m["speaker"] == perspective
        name = m["speaker"].replace("<|", "< |").replace("\n", " ")
        who = "assistant" if mine else SYSTEM if m["speaker"] == SYSTEM else f"user name={name}"
        head, body = f"{BEGIN}{who}\n", m["content"] + END
        if mine:
            masks.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body]
        at += len(head) + len(body)
    return "".join(out), masks


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        messages = batch["messages"].to_pylist()
        both = [render(m, p) for m, p in zip(messages, batch["perspective"].to_pylist())]
        yield pa.record_batch([batch["conv_id"], batch["perspective"], batch["part"],
                               pa.array([len(m) for m in messages], pa.int64()), pa.array([t for t, _ in both], pa.string()),
                               pa.array([s for _, s in both], _SPANS)], names=["conv_id", "perspective", "part", "n_turns", "text", "masks"])


def perspectives(conversations: DataFrame, part: int = PART) -> DataFrame:
    """A row per dialogue, participant and part: ``conv_id``, ``perspective``,
    ``part``, ``n_turns``, ``text``, ``masks``."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), F.coalesce(c["conv_id"].cast("string"), F.lit("null")).alias("dialogue"),
                    c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit(UNKNOWN)).alias("speaker"),
                    F.replace(F.coalesce(c["text"].cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"))
    numbered = with_row_number(rows, ["dialogue", F.col("turn").asc_nulls_last(), "speaker",
                                      F.substring("content", 1, LEAD), F.md5("content")], "n")
    first = numbered.groupBy("dialogue").agg(F.min("n").alias("first"))
    parts = (numbered.join(first, "dialogue").withColumn("part", F.floor((F.col("n") - F.col("first")) / part))
             .groupBy("conv_id", "dialogue", "part")               # at most ``part`` messages each
             .agg(F.sort_array(F.collect_list(F.struct("n", "speaker", "content"))).alias("messages")))
    speakers = numbered.where(F.col("speaker") != SYSTEM).select("dialogue", F.col("speaker").alias("perspective")).distinct()
    return parts.join(speakers, "dialogue").select("conv_id", "perspective", "part", "messages").mapInArrow(_rendered, OUT)


ORACLE = r"""
WITH m AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'null') AS dialogue, coalesce(role, 'unknown') AS speaker, turn,
         replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY dialogue ORDER BY turn NULLS LAST, speaker, left(content, 64), md5(content)) - 1 AS place FROM m),
p AS (SELECT DISTINCT dialogue, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (
  SELECT n.conv_id, perspective, place // 256 AS part, place, speaker = perspective AS mine,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
           ELSE 'user name=' || replace(replace(speaker, '<|', '< |'), chr(10), ' ') END || chr(10) AS head,
         content || '<|im_end|>' || chr(10) AS body
  FROM n JOIN p ON n.dialogue = p.dialogue),
s AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM r)
SELECT conv_id, perspective, part::BIGINT AS part, count(*) AS n_turns,
       sum(length(head) + length(body))::BIGINT AS n_chars,
       coalesce(string_agg(begins || ':' || (begins + length(body)), ',' ORDER BY place) FILTER (WHERE mine), '') AS masks,
       sha256(string_agg(head || body, '' ORDER BY place)) AS text_sha256
FROM s GROUP BY conv_id, perspective, part"""
