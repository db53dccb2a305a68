"""Chat formatting with offset-aligned loss masks.

A turn is written as start mark, role, separator, text, end mark and a line feed. The marks are tokens of their own.
Inside roles and texts, each `<` that is followed by any number of backslashes and then `|` gets one more backslash, so no
mark can occur there, and taking one away reads the text back. Runs of whole turns are rendered and encoded once, with
offsets; the assistant's text spans are met with the token spans by binary search, which gives the token loss mask.

Rows are dealt by range of (conv_id, turn), so a conversation of any length spreads over tasks, in segments of at most
`SEGMENT_TURNS` turns; as marks bound every turn, segments encode as the whole does. A digest of one conversation is
sequential by nature: its segments stream through one task in order, one at a time.

Null text: empty; null role: empty. Null turns come first, then by role and text. Rows with a null conv_id are one
conversation with that id. Equal rows are turns of their own. An empty table gives the added conversation only.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, map_batches, read_table, texts_of, written
from .token_files import tokenizer_path

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)
LOSS_ROLE = "assistant"
SEGMENT_TURNS, SEGMENT_CHARS = 64, 200_000
SEGMENTS = "conv_id long, part long, seq long, formatted string, token_ids array<int>, loss_mask binary, loss_spans array<array<int>>"
#: The conversation that op3 adds.
ADDED = "<|im_end|><|im_start|>assistant ok"


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


class Formatter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, SEPARATOR, END)])
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)

    def segment(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], bytes, list[list[int]]]:
        """The rendered turns, their ids, the loss mask (a byte for each id) and the text spans under it."""
        parts, at, spans = [], 0, []
        for role, text in turns:
            head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
            if role == LOSS_ROLE and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        formatted = "".join(parts)
        encoded = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        wanted = np.array(spans, np.int64).reshape(-1, 2)
        # tokens that end after a span's start, and begin before its end
        first, last = np.searchsorted(offsets[:, 1], wanted[:, 0], "right"), np.searchsorted(offsets[:, 0], wanted[:, 1], "left")
        mask, under = np.zeros(len(offsets), np.uint8), []
        for a, b in zip(first, last, strict=True):
            mask[a:b] = 1
            if a < b:
                under.append([int(offsets[a, 0]), int(offsets[a:b, 1].max())])
        return formatted, encoded.ids, mask.tobytes(), under


def format_conversations(turns: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the formatted segments of all conversations and returns their table, read back."""
    tokenizer = tokenizer or tokenizer_path()
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, context = Formatter(tokenizer), TaskContext.get()
        part, seq, now, held, chars = context.partitionId() if context else 0, 0, None, [], 0
        out = []

        def flush() -> None:
            nonlocal seq, held, chars
            out.append((now, part, seq, *formatter.segment(held)))
            seq, held, chars = seq + 1, [], 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "part", "seq", "formatted", "token_ids", "loss_mask", "loss_spans"])

        for batch in batches:
            for conv_id, role, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
                if held and (conv_id != now or len(held) >= SEGMENT_TURNS or chars + len(text) > SEGMENT_CHARS):
                    flush()
                    if len(out) >= 256:
                        yield batch_of()
                now = conv_id
                held.append((role, text))
                chars += len(text)
        if held:
            flush()
        if out:
            yield batch_of()

    return written(rows.mapInArrow(run, SEGMENTS), path)


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, part, seq, n_turns, turns (role, line feed, text, line feed each), loss_text, formatted_chars of each segment."""

    def make():
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss_text", pa.string()), ("formatted_chars", pa.int64())])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for conv_id, part, seq, formatted, spans in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4)), strict=True):
                turns = [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]
                loss = "".join(unescape(formatted[a:b]) for a, b in spans)
                out.append((conv_id, part, seq, len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), loss, len(formatted)))
            return as_batch(zip(*out, strict=True), schema)

        return run

    return map_batches(segments.select("conv_id", "part", "seq", "formatted", "loss_spans"), make, "conv_id long, part long, seq long, n_turns long, turns string, loss_text string, formatted_chars long")


def digests(segments: DataFrame) -> DataFrame:
    """The contract's columns, from segments read back, as a stream through sorted rows."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = read_back(segments).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        out.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += row["n_turns"]
                state[2].update(row["turns"].encode("utf-8", "surrogatepass"))
                state[3] += len(row["loss_text"])
                state[4].update(row["loss_text"].encode("utf-8", "surrogatepass"))
                state[5] += row["formatted_chars"]
            if out:
                yield as_batch(zip(*[(a, b, c.hexdigest(), d, e.hexdigest(), f) for a, b, c, d, e, f in out], strict=True), schema)
                out = []
        if state:
            yield as_batch(zip(*[(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])], strict=True), schema)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(ADDED).alias("text"))
    return digests(format_conversations(turns.unionByName(added)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_chat_format": op3_chat_format}

SQL = {
    "op3_chat_format": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{ADDED}', 'user', '{ADDED}' UNION ALL SELECT -1, 1, '{LOSS_ROLE}', '{ADDED}', '{LOSS_ROLE}', '{ADDED}'),
e AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS er, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(length(er) + length(et) + {len(START) + len(SEPARATOR) + len(END) + 1})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
}
