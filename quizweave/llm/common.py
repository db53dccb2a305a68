"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Both with A-Z in lower case; the second with a space for each ASCII character that is neither letter nor digit.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode a new one where none is set."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if (have := context._jsc.sc().getCheckpointDir()).isDefined():
        return have.get()
    if not context.master.startswith(("local[", "local,")) and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


#: For rows of a megabyte or more: Parquet's own limit looks at the size after a hundred rows only, so a row group would be as large as they are, and
#: so would what a task holds to write or read it.
LARGE_ROWS = {"parquet.block.row.count.limit": "8", "parquet.page.size.row.check.min": "1"}


def written(df: DataFrame, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/quizweave-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing that is still to run reads it."""
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes of the strings of a piece of a batch, in lists too, but for one row that has more.
PIECE = 8 << 20


def string_bytes(column: pa.Array) -> np.ndarray | int:
    """Bytes of the strings of each row, 0 where a column has none."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(column.type) and isinstance(of_all := string_bytes(column.values), np.ndarray):
        return np.diff(np.append(0, np.cumsum(of_all))[column.offsets.to_numpy()])
    return 0


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        size += string_bytes(column)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")))
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str) -> DataFrame:
    """make() runs once a task and gives the function for its batches; a batch may give None.

    Batches are cut to about `PIECE` bytes, so that what a function makes of one stays small where texts are long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for piece in pieces(batch):
                if (out := f(piece)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def spaced_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, [^\\x20\\x09-\\x0D]+, of UTF-8 text, with A-Z in lower case."""
    return text.translate(LOWER_BYTES).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text, with A-Z in lower case."""
    return text.translate(ALNUM_BYTES).split()


class WordHashes(dict):
    """64-bit hashes of words. It is emptied at `most` words, so that a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; of fewer words, one for all of them; of none, none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * MIX + hashes[i : n - k + 1 + i] + np.uint64(i + 1))
    return out


def texts_of(column: pa.Array) -> list[str]:
    """A null text is an empty one."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The same in UTF-8."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def as_batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
