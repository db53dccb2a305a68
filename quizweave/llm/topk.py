"""Exact top-k inner products by no-random-access aggregation.

Components are taken as floor(1024 * x). Each block of candidates has two sorted lists for every component, one from
its greatest value down and one from its least up; a query reads the first where its own component is positive, else the
second. All lists are read from their best end in growing stretches, and each entry is added once to its candidate's sum. The last
value read bounds what is unread of a candidate from above, the far end of the list from below. A query first looks at its
candidates when even one of which nothing has been read could no longer reach the k-th best so far (of earlier blocks; in
the first block, the k-th best lower bound). A candidate whose upper bound lies under that is out; reading stops when few are
left, whose scores are then resolved. Bounds are integers below 2^53, so floating point holds them exactly; vectors
too large for that are scored with Python's integers, and scores outside 64 bits are set to its ends.

Candidates stay where they are; queries come in broadcast blocks of about `QUERY_BLOCK`, and each task gives its k best
for each query, which a window ranks.

Vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part. Vectors of
different lengths are not compared. A query's own row is every row of its vec_id; of several rows with the id of a
query, the least vector is the query. Equal rows are candidates one by one. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

K, SCALE, EVERY = 10, 1024.0, 100
#: Candidates of a block, queries broadcast at a time, shares of the lists where stretches end, open candidates at which reading stops.
BLOCK, QUERY_BLOCK, DEPTHS, FEW = 4096, 2048, (1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1), 1 / 16
EXACT, LIMIT = float(1 << 53), (1 << 63) - 1


class Best:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]

    def least(self) -> np.ndarray:
        """What a newcomer must reach."""
        return np.array([f[-1][0] if len(f) == self.k else -np.inf for f in self.found], float)

    def add(self, query: int, scores: list[int], ids: list[int]) -> None:
        self.found[query] = sorted([*self.found[query], *zip(scores, ids, strict=True)], key=lambda x: (-x[0], x[1]))[: self.k]


def exact_scores(x: np.ndarray, q: np.ndarray) -> list[int]:
    if not x.size or np.abs(x).max() * np.abs(q).max() * len(q) < EXACT:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q]
    return [max(-LIMIT - 1, min(LIMIT, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x]


def search_block(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, which: np.ndarray, best: Best) -> np.ndarray:
    """x: n x d candidates; queries: m x d, which are numbers `which` of best. Returns how many entries each query has read, with those
    of the candidates it resolved."""
    (n, d), m, k = x.shape, len(which), best.k
    own = ids[:, None] == query_ids[None, :]
    few = max(4 * k, int(n * FEW))
    if not d or np.abs(x).max() * np.abs(queries).max() * d >= EXACT / 4 or n <= few:
        for j, w in enumerate(which):
            at = np.flatnonzero(~own[:, j])
            best.add(w, exact_scores(x[at], queries[j]), ids[at].tolist())
        return np.full(m, n * d)
    lists = np.argsort(x, axis=0, kind="stable")
    rank = np.empty((n, d), np.int32)
    np.put_along_axis(rank, lists, np.arange(n, dtype=np.int32)[:, None].repeat(d, 1), axis=0)
    # columns: the d lists from the top, the d lists from the bottom; a query's weight is 0 in those it doesn't read
    place = np.concatenate([n - 1 - rank, rank], axis=1)
    value = np.concatenate([x, x], axis=1)
    far = np.concatenate([x.min(0), x.max(0)])
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    sums, summed, reads = np.zeros((n, m)), np.zeros(m, np.int64), np.zeros(m, np.int64)
    left = np.arange(m)
    for depth in DEPTHS:
        read = max(1, int(n * depth))
        last = np.concatenate([x[lists[n - read], np.arange(d)], x[lists[read - 1], np.arange(d)]])
        known = best.least()[which[left]]
        now = (weights[left] @ last < known) | np.isinf(known) | (read == n)
        due, known = left[now], known[now]
        for start in np.unique(summed[due]):
            those = due[summed[due] == start]
            sums[:, those] += np.where((place >= start) & (place < read), value, 0) @ weights[those].T
        summed[due] = read
        unread = (place >= read).astype(float)
        upper = sums[:, due] + unread @ (weights[due] * last).T
        upper[own[:, due]] = -np.inf
        if len(first := np.flatnonzero(np.isinf(known))):
            lower = sums[:, due[first]] + unread @ (weights[due[first]] * far).T
            lower[own[:, due[first]]] = -np.inf
            known[first] = np.partition(lower, n - k, axis=0)[n - k]
        open_ = upper >= known  # a tie may still win by its id
        done = np.flatnonzero((open_.sum(0) <= few) | (read == n))
        for j in done:
            at = np.flatnonzero(open_[:, j] & (upper[:, j] > -np.inf))
            best.add(which[due[j]], exact_scores(x[at], queries[due[j]]), ids[at].tolist())
            reads[due[j]] = (read + len(at)) * d
        left = np.setdiff1d(left, due[done])
        if not len(left):
            break
    return reads


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def matrices(ids: np.ndarray, rows: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(places, ids, n x d values) of the vectors of each length."""
    lengths = rows.value_lengths().to_numpy()
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        flat = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, ids[at], np.floor(flat.reshape(len(at), d) * SCALE)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates (vec_id, embedding) of every query."""
    spark = candidates.sparkSession
    candidates = usable(candidates)
    queries = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about query_block rows
        rows = mine.column("embedding").combine_chunks() if mine.num_rows else pa.array([], pa.list_(pa.float32()))
        shared = spark.sparkContext.broadcast([*matrices(mine.column("vec_id").to_numpy(), rows)] if mine.num_rows else [])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups = {q.shape[1]: (i, q, at) for at, i, q in shared.value}
            names = np.zeros(sum(len(at) for at, _, _ in shared.value), np.int64)
            for at, i, _ in shared.value:
                names[at] = i
            best, held, n = Best(len(names), k), [], 0

            def search() -> None:
                table = pa.Table.from_batches(held)
                for _, ids, x in matrices(table.column(0).to_numpy(), table.column(1).combine_chunks()):
                    if x.shape[1] in groups:
                        query_ids, q, at = groups[x.shape[1]]
                        search_block(x, ids, q, query_ids, at, best)

            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    held.append(batch.slice(start, BLOCK))
                    n += held[-1].num_rows
                    if n >= BLOCK:
                        search()
                        held, n = [], 0
            if held:
                search()
            out = [(names[w], i, s) for w, f in enumerate(best.found) for s, i in f]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        part = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
        part = part if blocks == 1 else written(part)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_topk": op4_topk}

SQL = {
    "op4_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS f FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.f, c.f)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.f) = len(c.f) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
}
