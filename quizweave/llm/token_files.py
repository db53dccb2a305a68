"""Token-ID output as directly addressable codes.

Every document is encoded whole and ends with an end id. Ids go into shards in ascending doc_id order. A shard cuts each
id into chunks of `CHUNK` bits: level 0 holds the lowest chunk of every id, level i the next chunk of those ids that have
one; a bitmap beside each level tells which ids continue, and a rank directory holds the number of set bits before each
block of 512. So id i is read by one look at each of its levels: its place in level i + 1 is the rank of its place in level
i. Nothing is decoded around it.

Shards are rows of a Parquet table in the shared folder (part, shard, doc ids, lengths, payload), written by tasks that
each hold one shard at a time. Only the number of ids of each part comes to the driver, a row for each part.

Null or empty text: the end id alone. Null doc_ids come first; equal doc_ids lie next to each other, by a hash of their text,
each with its own row. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, written

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Bits of a chunk; bits of a rank block; ids of a shard at most, but for one document that is longer.
CHUNK, BLOCK, SHARD_IDS = 8, 512, 1 << 20
#: Pieces kept by an encoder, and documents encoded at a time.
CACHE, AT_ONCE = 800_000, 128
SHARDS = "part long, shard long, start long, doc_ids array<long>, lengths array<long>, payload binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin letters and ASCII marks behind it: the byte-level rule always cuts between them.
WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)").fullmatch


#: Byte-level models spell each byte as a character: printable ones as they are, the others from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}


class Pieces(dict):
    """Ids of `before` + piece, learned at the first look-up.

    Words go to the model directly, apart from the marks behind them; others are encoded by the tokenizer. Pieces that touch white
    space give None, as what is around them decides. Pieces with white space inside are not kept, as few texts have them; those of
    single line feeds are put together from their lines. All pieces of an encoder go once it keeps `most` of them.
    """

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.start = encoder, before, before.translate(SPELLED)
        self.tokenize = encoder.tokenizer.model.tokenize if encoder.by_piece else None

    def __missing__(self, piece: str) -> bytes | None:
        if piece.isascii() and piece.isalpha():
            out = array("I", [t.id for t in self.tokenize(self.start + piece)]).tobytes()
        elif m := WORD(piece):
            word, marks = m.groups()
            out = self[word] + self.encoder.mark(marks) if marks else array("I", [t.id for t in self.tokenize(self.start + word.encode().decode("latin-1").translate(SPELLED))]).tobytes()
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        elif len(lines := piece.split()) > 1:
            if lines != piece.split("\n") or self.encoder.added(piece):  # the space before an added token would join the line feed before that
                return self.encoder.raw(self.before + piece)
            return self.encoder.line_feed.join([self[lines[0]], *map(self.encoder.lines.__getitem__, lines[1:])])
        else:
            out = self.encoder.raw(self.before + piece)
        self.encoder.make_room()
        self[piece] = out
        return out


class Encoder:
    """Text to little-endian 32-bit ids, by the tokenizers library.

    A byte-level tokenizer never joins letters across a single space between two other characters, so each piece up to
    such a space is encoded once and remembered, and so is each line of a piece, with no space before it but the first's.
    Added tokens (<|endoftext|>) are ids of their own, as the library has it; pieces that hold
    one are encoded by themselves. A tokenizer that cuts text by another rule encodes whole texts.
    """

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        rules = json.loads(self.tokenizer.to_str())
        cut = rules.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not rules.get("normalizer") and rules["model"]["type"] == "BPE"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.known, self.lines, self.marks = Pieces(self, " "), Pieces(self, ""), {}
        self.line_feed = self.raw("\n")

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def mark(self, text: str) -> bytes:
        if (out := self.marks.get(text)) is None:
            out = self.marks[text] = self.raw(text)
        return out

    def make_room(self) -> None:
        if len(self.known) + len(self.lines) + len(self.marks) >= self.most:
            for kept in (self.known, self.lines, self.marks):
                kept.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> np.ndarray:
        if not self.by_piece:
            return np.frombuffer(self.raw(text), "<u4")
        parts = text.split(" ")
        if len(parts) > 1 and (not parts[0] or parts[0][-1].isspace()):
            return np.frombuffer(self.with_white_space(parts), "<u4")
        try:
            rest = b"".join(map(self.known.__getitem__, parts[1:]))
        except TypeError:  # one of them is None
            return np.frombuffer(self.with_white_space(parts), "<u4")
        return np.frombuffer(self.raw(parts[0]) + rest, "<u4")

    def with_white_space(self, parts: list[str]) -> bytes:
        """A space is a boundary only between two characters that are no white space; other parts stay together."""
        groups = [[parts[0]]]
        for before, part in zip(parts, parts[1:], strict=False):
            if not part or not before or part[0].isspace() or before[-1].isspace():
                groups[-1].append(part)
            else:
                groups.append([part])
        out = [self.raw(" ".join(groups[0]))]
        for g in groups[1:]:
            piece = self.known[g[0]] if len(g) == 1 else None
            out.append(piece if piece is not None else self.raw(" " + " ".join(g)))
        return b"".join(out)


ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, most: int = CACHE) -> Encoder:
    """One for each worker process, which keeps what it knows from task to task."""
    if path not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path] = Encoder(path)
    ENCODERS[path].most = most
    return ENCODERS[path]


def pack(ids: np.ndarray, chunk: int = CHUNK) -> bytes:
    """ids as levels of chunks, bitmaps and rank directories, each after its length."""
    out, rest = [np.array([len(ids), chunk], "<u4").tobytes()], ids.astype(np.uint32)
    while True:
        low, rest = rest & np.uint32((1 << chunk) - 1), rest >> np.uint32(chunk)
        more = rest > 0
        padded = np.append(more, np.zeros(-len(more) % BLOCK, bool))
        ranks = np.cumsum(np.append(0, padded.reshape(-1, BLOCK).sum(1)[:-1] if len(padded) else [])).astype("<u4")
        for part in (low.astype(np.uint8 if chunk <= 8 else np.uint16).tobytes(), np.packbits(padded, bitorder="little").tobytes(), ranks.tobytes()):
            out += [np.array([len(part)], "<u4").tobytes(), part]
        rest = rest[more]
        if not len(rest):
            return b"".join(out)


class Codes:
    """A packed shard: random access to any id, or ranges of them."""

    def __init__(self, payload: bytes):
        self.n, self.chunk = (int(x) for x in np.frombuffer(payload, "<u4", 2))
        self.levels, at = [], 8
        while at < len(payload):
            parts = []
            for kind in (np.uint8 if self.chunk <= 8 else "<u2", np.uint8, "<u4"):
                size = int(np.frombuffer(payload, "<u4", 1, at)[0])
                parts.append(np.frombuffer(payload[at + 4 : at + 4 + size], kind))
                at += 4 + size
            self.levels.append(tuple(parts))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift, i = 0, 0, int(i)
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * (BLOCK // 8)
            before = int.from_bytes(bits[start : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - start * 8)) - 1)
            i, shift = int(ranks[i // BLOCK]) + before.bit_count(), shift + self.chunk
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """ids [start, end): at each level the ones wanted lie side by side."""
        out, to, shift = np.zeros(end - start, np.uint32), np.arange(end - start), 0
        for chunks, bits, ranks in self.levels:
            if start >= end:
                break
            out[to] |= chunks[start:end].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + end - start].astype(bool)
            block = start // BLOCK
            before = int(ranks[block]) + int(np.unpackbits(bits[block * (BLOCK // 8) : (start + 7) >> 3], bitorder="little")[: start - block * BLOCK].sum())
            to, shift = to[more], shift + self.chunk
            start, end = before, before + int(more.sum())
        return out


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None, parts: int | None = None, most_pieces: int = CACHE) -> DataFrame:
    """Writes the shards of all rows of docs and returns their table, read back."""
    tokenizer = tokenizer or tokenizer_path()
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = encoder_of(tokenizer, most_pieces), TaskContext.get()
        part, shard, start, held, ids, n = context.partitionId() if context else 0, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held))], pa.binary())], names=["part", "shard", "start", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                for doc_id, found in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    held.append(np.append(found, np.uint32(end_id)))
                    ids.append(doc_id)
                    n += len(held[-1])
                    if n >= SHARD_IDS:
                        yield flush()
                        shard, start, held, ids, n = shard + 1, start + n, [], [], 0
        if held:
            yield flush()

    # the sampler of a range sends its keys to the driver, so texts are not among them; rows of one doc_id lie by a hash of theirs
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    return written(dealt.mapInArrow(run, SHARDS), path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards alone."""
    totals = shards.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)).alias("n")).orderBy("part").collect()  # a row for each part
    before = dict(zip([r["part"] for r in totals], np.cumsum([0, *(r["n"] for r in totals)]).tolist(), strict=False))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for part, start, ids, lengths, payload in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), batch.column(5), strict=True):
                codes, at, base = Codes(payload.as_py()), 0, before[part] + start
                for doc_id, n in zip(ids, lengths, strict=True):
                    out.append((doc_id, base + at, n, zlib.crc32(codes.slice(at, at + n).astype("<u4").tobytes())))
                    at += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return run

    return map_batches(shards, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_token_ids": op5_token_ids}
SQL: dict[str, str] = {}
