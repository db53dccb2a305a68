"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item; an item of fewer words is one window. A window is taken as the
set of its shingles of up to three words. All shingles are ordered by how often the documents hold them; as a window must
be contained wholly, one prefix shingle, its rarest, must occur in a document that holds the window. Documents are joined
with these prefix shingles; the place of the shingle in the window and the length of the window bound where it can lie,
and each place that is left is verified word by word.

The prefix index of at most `block_windows` windows is broadcast at a time; a larger benchmark goes in more blocks, each
over all documents, and what earlier blocks found travels with the rows. Documents never move.

Null or empty text has no words and no hits; an item without words has no window. A null item_id is listed as `null`.
Equal items count once, equal documents each for itself. Very long texts are searched whole; shingles of equal rarity are
taken by place. Other columns stay as they are. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WordHashes, alnum_words, as_batch, bytes_of, map_batches, read_table, shingles, written

SIZE, SHINGLE = 10, 3
#: About so many (item, window) rows are broadcast at a time, about 20 MB: rows are dealt to blocks by hash.
BLOCK_WINDOWS = 100_000
#: Columns that annotated rows get.
N_WORDS, SPANS, ITEMS = "__overlap_n_words", "__overlap_spans", "__overlap_items"


def windows_of(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item, window): the item's id as text, and the window's words joined by spaces."""

    def make():
        schema = pa.schema([("item", pa.string()), ("window", pa.string())])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                words = alnum_words(text)
                if words:
                    out += [("null" if item is None else item, b" ".join(words[i : i + size]).decode()) for i in range(max(1, len(words) - size + 1))]
            return as_batch(zip(*out, strict=True), schema) if out else None

        return run

    return map_batches(benchmark.select(F.col("item_id").cast("string"), "text"), make, "item string, window string").distinct()


class PrefixIndex:
    """The windows of one block by the hash of their prefix shingle."""

    def __init__(self, rows: list[tuple[str, str]]):
        items: dict[str, list[str]] = defaultdict(list)
        for item, window in rows:
            items[window].append(item)
        hashes = WordHashes()
        self.windows = sorted(items)
        self.words = [w.encode().split(b" ") for w in self.windows]
        self.items = [sorted(items[w]) for w in self.windows]
        self.shingles = [shingles(hashes.of(w), SHINGLE) for w in self.words]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.all = np.unique(np.concatenate([*self.shingles, np.empty(0, np.uint64)]))
        self.order_by(np.zeros(len(self.all), np.int64))

    def order_by(self, counts: np.ndarray) -> None:
        """counts: how often documents hold each of self.all."""
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for w, found in enumerate(self.shingles):
            offset = int(np.lexsort((found, counts[np.searchsorted(self.all, found)]))[0])
            self.at[int(found[offset])].append((w, offset))

    @staticmethod
    def sieve(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        out[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return out


def places(sieve: np.ndarray, wanted: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where `found` holds hashes of the sorted array `wanted`."""
    at = np.flatnonzero(sieve[(found & np.uint64(len(sieve) - 1)).astype(np.int64)])
    if len(at):
        i = np.minimum(np.searchsorted(wanted, found[at]), len(wanted) - 1)
        at = at[wanted[i] == found[at]]
    return at


def shingle_counts(docs: DataFrame, index: PrefixIndex) -> np.ndarray:
    """How often all documents hold each shingle of the index: summed in each task, then by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast((index.all, index.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sizes = shared.value
        sieve, hashes, total = PrefixIndex.sieve(wanted), WordHashes(), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                found = hashes.of(alnum_words(text))
                for k in sizes:
                    if len(found) >= k:
                        s = shingles(found, k)
                        np.add.at(total, np.searchsorted(wanted, s[places(sieve, wanted, s)]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(len(index.all), np.int64)
    if len(out):
        for i, n in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n")).collect():  # at most a row for each of index.all
            out[i] = n
    return out


def overlaps(words: list[bytes], hashes: WordHashes, index: PrefixIndex, sieve: np.ndarray, wanted: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
    """Verified [start, end) in words, and the windows found."""
    spans, seen = [], set()
    found = hashes.of(words)
    for k in index.sizes:
        if len(found) < k:
            continue
        s = shingles(found, k)
        for p in places(sieve, wanted, s).tolist():
            for w, offset in index.at[int(s[p])]:
                window = index.words[w]
                start = p - offset
                if start >= 0 and start + len(window) <= len(words) and words[start : start + len(window)] == window:
                    spans.append((start, start + len(window)))
                    seen.add(w)
    return spans, seen


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def annotate_overlaps(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_windows: int = BLOCK_WINDOWS, names: tuple[str, str, str] = (N_WORDS, SPANS, ITEMS)) -> DataFrame:
    """docs with the number of words, the merged spans of words that windows cover, and the items found; columns of these names before are replaced."""
    docs = docs.drop(*names)
    spark = docs.sparkSession
    windows = written(windows_of(benchmark, size))
    blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))  # a window of many items is dealt over blocks
    kept = docs.columns
    out = docs.select(*kept, F.lit(0).cast("long").alias(names[0]), F.lit(None).cast("array<array<int>>").alias(names[1]), F.lit(None).cast("array<string>").alias(names[2]))
    for block in range(blocks):
        index = PrefixIndex([(r[0], r[1]) for r in windows.where(F.col("block") == block).select("item", "window").collect()])
        index.order_by(shingle_counts(docs, index))
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            index, hashes = shared.value, WordHashes()
            wanted = np.array(sorted(index.at), np.uint64)
            sieve = PrefixIndex.sieve(wanted)
            text_at, n = kept.index("text"), len(kept)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, spans, items = [], [], []
                for text, old, had in zip(bytes_of(batch.column(text_at)), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
                    words = alnum_words(text)
                    new, seen = overlaps(words, hashes, index, sieve, wanted)
                    counts.append(len(words))
                    spans.append(merged([*(old or []), *new]))
                    items.append(sorted({*(had or []), *(i for w in seen for i in index.items[w])}))
                return pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

            return run

        out = map_batches(out, make, out.schema)
        if block < blocks - 1:
            out = written(out)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate_overlaps(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(SPANS, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", F.col(N_WORDS).alias("n_words"), hit.alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256).alias("items_sha256"), (F.size(SPANS) > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_decontamination": op2_decontamination}

SQL = {
    "op2_decontamination": f"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least({SIZE}, len(ws)) AS n, array_to_string(ws[i:i + {SIZE} - 1], ' ') AS w
        FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - {SIZE} + 2))) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
placed AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, item_id, p, placed.n FROM placed JOIN win USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
