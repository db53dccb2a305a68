"""How filters of a corpus depend on each other: what each removes in every order of application.

With k filters (five at most) there are 2**k subsets, and a document survives a subset if it fails none of its filters. So each document
becomes a word of 2**k bits, bit s for subset s. Survivors of every subset are positional popcounts of the words: carry-save
adders bring three words of one weight to a sum and a carry until two of each weight are left, whose bits are then added.
Such counts are taken for each part of the corpus, of all documents and of those with a label, and they answer every question on orders:
what a step removes is the difference of two of them.

The filters here (a document fails): A too few words, B too few distinct words, C too many capitals, D marks of markup, E
the text of a document with a smaller doc_id. Texts are compared by 128 bits of SHA-256.

Null or empty text: no words, so it fails A alone, and E if a smaller doc_id has none either. A null part counts as an empty one. Rows of one doc_id are counted one by one and
fail E only by a smaller doc_id; a row without a doc_id never fails E, fails no other and has no labels. Of several labels
of one doc_id the greatest counts. Very long texts are read whole. Columns other than doc_id, text and lang are not looked at, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, bytes_of, map_batches, read_table, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 3, "#$%&*|"
LABELS = ("quality", "toxic")
#: A text that is held by more than this share of all rows meets its rows by broadcast; there are at most 1 / HEAVY such texts.
HEAVY = 1 / 1000
CAPITALS, NOT_FIRST = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0))


def survival_words(filters: int) -> np.ndarray:
    """For each set of failed filters (a bit each) the word of the subsets that a document survives."""
    sets = np.arange(1 << filters, dtype=np.uint64)
    survives = (sets[:, None] & sets[None, :]) == 0
    return (survives.astype(np.uint64) << sets[None, :]).sum(1, dtype=np.uint64).astype(np.uint32)


def positional_popcounts(words: np.ndarray, bits: int) -> np.ndarray:
    """How many of the words have each bit, by carry-save addition."""
    planes, out = [words.astype(np.uint32)], np.zeros(bits, np.int64)
    for weight, plane in enumerate(planes):
        carries = []
        while len(plane) > 2:
            third = len(plane) // 3
            a, b, c = (plane[i * third : (i + 1) * third] for i in range(3))
            half = a ^ b
            carries.append((a & b) | (c & half))
            plane = np.concatenate([half ^ c, plane[3 * third :]])
        if carries:
            planes.append(np.concatenate(carries))
        left = (plane[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
        out += left.sum(0, dtype=np.int64) << weight
    return out


def survivors(rows: DataFrame, filters: int, labels: tuple[str, ...] = ()) -> DataFrame:
    """rows: part, failed (long, a bit for each filter), a boolean for each label. part, subset and how many survive it: `n`, and one column a label."""
    names = ["n", *labels]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("subset", T.IntegerType()), *[T.StructField(name, T.LongType()) for name in names]])

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        table = survival_words(filters)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = batch.column(0).dictionary_encode()
            part = coded.indices.to_numpy(zero_copy_only=False)
            words = table[batch.column(1).to_numpy(zero_copy_only=False)]
            marked = [np.ones(len(words), bool), *[batch.column(2 + i).to_numpy(zero_copy_only=False).astype(bool) for i in range(len(labels))]]
            counts = [np.concatenate([positional_popcounts(words[(part == p) & m], 1 << filters) for p in range(len(coded.dictionary))]) for m in marked]
            parts = coded.dictionary.take(pa.array(np.repeat(np.arange(len(coded.dictionary)), 1 << filters)))
            subsets = np.tile(np.arange(1 << filters, dtype=np.int32), len(coded.dictionary))
            return pa.RecordBatch.from_arrays([parts, pa.array(subsets), *map(pa.array, counts)], names=["part", "subset", *names])

        return count

    counted = map_batches(rows.select("part", "failed", *labels), start, schema)
    return counted.groupBy("part", "subset").agg(*[F.sum(name).alias(name) for name in names])


def audit_orders(counts: DataFrame, filters: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """Survivors as `survivors` counts them to one row a part, order of the filters and step.

    kept and removed by this step; redundant: fail the step's filter, but went before; unique_fails: fail that filter alone; `<label>_lost`:
    removed with the label; shapley: removed by the filter in all orders together.
    """
    k = len(filters)
    lost = [f"{name}_lost" for name in labels]
    columns = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    head = [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    schema = T.StructType([*head, *[T.StructField(c, T.LongType()) for c in columns]])
    orders = list(permutations(range(k)))

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        at = np.array(orders)
        after = np.cumsum(1 << at, 1)
        before, everything = after - (1 << at), (1 << k) - 1
        texts = ["".join(filters[f] for f in o) for o in orders for _ in o]
        weight = np.array([factorial(s) * factorial(k - 1 - s) for s in range(k)])

        def shapley(n: np.ndarray) -> np.ndarray:
            out = np.zeros(k, np.int64)
            for f in range(k):
                for s in range(1 << k):
                    if not s >> f & 1:
                        out[f] += weight[s.bit_count()] * (n[s] - n[s | 1 << f])
            return out

        def expand(batch: pa.RecordBatch) -> pa.RecordBatch:
            made: list[list[np.ndarray]] = [[] for _ in columns]
            for counted in batch.column(1).to_pylist():
                n, *marked = np.array([[c[name] for name in ("n", *labels)] for c in counted], np.int64).T
                removed = n[before] - n[after]
                values = [n[after], removed, n[0] - n[1 << at] - removed, n[everything - (1 << at)] - n[everything], *[m[before] - m[after] for m in marked], shapley(n)[at]]
                for column, value in zip(made, values, strict=True):
                    column.append(value.ravel())
            rows = batch.num_rows
            parts = batch.column(0).take(pa.array(np.repeat(np.arange(rows), len(texts))))
            steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * rows)
            return pa.RecordBatch.from_arrays([parts, pa.array(texts * rows), pa.array(steps), *[pa.array(np.concatenate(c)) for c in made]], names=schema.fieldNames())

        return expand

    whole = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", *labels))).alias("counted"))
    return map_batches(whole, start, schema)


def local_failures(text: bytes) -> int:
    """Bits of the filters that a text alone decides."""
    words = text.split()  # at [\x20\x09-\x0D]
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, NOT_FIRST))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words), 100 * capitals > MOST_CAPITALS_PERCENT * points, MARK.search(text) is not None)
    return sum(1 << i for i, f in enumerate(fails) if f)


MARK = re.compile(f"[{re.escape(MARKS)}]".encode())


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed: which of the five filters each row of docs fails.

    Texts are read once; later only 16 bytes of their hash travel. The least doc_id of each text that several rows hold goes back to these rows: to
    those of texts with a large share of all rows by broadcast, to others by a join, so no task takes a large group.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("failed", T.LongType())])

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def read(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = bytes_of(batch.column(2))
            digests = [hashlib.sha256(t).digest()[:16] for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(map(local_failures, texts), pa.int64())], names=schema.fieldNames())

        return read

    rows = written(map_batches(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text"), start, schema))
    shared = written(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")).where("held > 1"))
    most = int(rows.count() * HEAVY)
    heavy = F.broadcast(shared.where(F.col("held") > most).select("digest", "least"))
    light = shared.where(F.col("held") <= most).select("digest", "least")
    met = rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest", "left"), allowMissingColumns=True)
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("long")
    return met.select("doc_id", "part", (F.col("failed") + F.lit(1 << FILTERS.index("E")) * repeats).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with a boolean for each label."""
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[(F.max(name) == 1).alias(name) for name in LABELS])
    met = rows.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    return met.select(*rows.columns, *[F.coalesce(F.col(name), F.lit(False)).alias(name) for name in LABELS])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters in all 120 orders, for each value of lang."""
    return audit_orders(survivors(labelled(judged(docs), labels), len(FILTERS), LABELS), FILTERS, LABELS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("quality_lost", "good_lost")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_filter_audit": op11_filter_audit}

_STEPS = ", ".join(f"o[{i}]" for i in range(1, 6))
SQL = {
    "op11_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, [len(ws) < {LEAST_WORDS}, 100 * len(list_distinct(ws)) < {LEAST_DISTINCT_PERCENT} * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS_PERCENT} * length(t),
      regexp_matches(t, '[{MARKS}]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM (SELECT unnest(string_split('A B C D E', ' ')) AS x) a, (SELECT unnest(string_split('A B C D E', ' ')) AS x) b,
      (SELECT unnest(string_split('A B C D E', ' ')) AS x) c, (SELECT unnest(string_split('A B C D E', ' ')) AS x) d, (SELECT unnest(string_split('A B C D E', ' ')) AS x) e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, o, n, good, toxic, fails, [fails[ascii(x) - 64] FOR x IN [{_STEPS}]] AS by_step FROM c, o),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM g),
e AS (SELECT *, list_position(by_step, true) AS gone, len(list_filter(fails, lambda x: x)) AS n_fails FROM s),
r AS (SELECT part, o, step, coalesce(sum(n) FILTER (WHERE gone IS NULL OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (WHERE by_step[step] AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE by_step[step] AND n_fails = 1), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (WHERE gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone = step), 0)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, substr(o, step, 1))::BIGINT AS shapley FROM r"""
}
