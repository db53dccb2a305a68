"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set is its distinct shingles; equal sets fall together first, by a 128-bit hash, so groups of copies cost
one row, a node. Every node gets a signature of N coordinates and is posted under its coordinate-value pairs. Nodes that
agree in at least T coordinates are candidates; T is the most that a pair at the similarity asked for misses less than
twice in a million times. Two such nodes share one of the first N - T + 1 pairs in any common order, so the pairs are
ordered by how many nodes hold them and only that prefix is merged: pairs that one node holds need no list, and very
common ones are skipped. Collisions in the merged lists are counted, those in skipped lists are looked up in the signatures
of what is left, and every link is confirmed on whole sets.

A list of m near copies has m * m pairs, which are not needed: each node is tried against one head, the node with
which most of its lists begin, and what is confirmed falls into components. Lists that still hold several components are
open. The nodes of open lists, which often share a long passage without being similar, are posted once more: under their
rarest shingles, those that the fewest components hold, as many as a pair at the similarity asked for can't all miss. There
heads are tried again while they join much, and then all pairs of nodes of different components that are near enough in size
and whose places in the common order leave room for the overlap. So no link that could join two components is left out.

Null or empty text or no words: an empty set, linked with nothing. A null doc_id takes part in no link; it is kept, with
a null component. Each row is a document of its own, equal rows too: rows of one doc_id are linked by their texts only, and
a component's id is the least doc_id of its rows. Very long texts: one set, whole. An empty table gives an empty result. Columns
other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WordHashes, bytes_of, dropped, map_batches, read_table, shingles, spaced_words, written
from .components import connected_components

N, MISSED = 48, 2e-6
SEEDS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, (2, N), np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are hashed at a time; rounds of heads at most before all pairs between components are tried; ids that are
#: broadcast at most, beyond which they are joined by a shuffle.
AT_ONCE, ROUNDS, BROADCAST_IDS = 1 << 18, 8, 500_000
#: Bands of size between a set and the smallest that can be similar to it.
BANDS = 4


def match_threshold(percent: int) -> int:
    """The most agreeing coordinates that a pair of this similarity has, but for MISSED of such pairs."""
    p, below, t = percent / 100, 0.0, 0
    while (below := below + math.comb(N, t) * p**t * (1 - p) ** (N - t)) <= MISSED:
        t += 1
    return max(1, t)


def set_of(text: bytes, hashes: WordHashes, k: int) -> np.ndarray:
    return np.unique(shingles(hashes.of(spaced_words(text)), k))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of N values for each non-empty set: the least of each of N keyed hashes, its upper 32 bits."""
    out = np.empty((len(sets), N), np.uint32)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= AT_ONCE):
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        with np.errstate(over="ignore"):
            for c in range(N):
                out[at:end, c] = np.minimum.reduceat((flat ^ SEEDS[0, c]) * SEEDS[1, c], starts) >> np.uint64(32)
        at = end
    return out


def digest_of(members: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None


def sketch(docs: DataFrame, k: int, carried: str | None = None) -> DataFrame:
    """doc_id, n_shingles, the set's hash and its signature; and the column `carried`, a long, as row_key."""

    def make():
        hashes = WordHashes()
        names = ["doc_id", "row_key", "n_shingles", "set_hash", "signature"]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [set_of(t, hashes, k) for t in bytes_of(batch.column(2))]
            full = [s for s in sets if len(s)]
            values = iter(signatures(full).view(np.int32)) if full else iter(())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest_of, sets), pa.binary()), pa.array([next(values) if len(s) else None for s in sets], pa.list_(pa.int32()))],
                names=names,
            )

        return run

    key = F.col(carried) if carried else F.lit(None).cast("long")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row_key"), "text"), make, "doc_id long, row_key long, n_shingles long, set_hash binary, signature array<int>")


def merged(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A join that broadcasts neither side. Spark sizes an exploded column as one element and a column of a file by its type, so a side of
    a gigabyte may look small enough to be gathered on the driver."""
    return left.join(right.hint("merge"), on)


def prefix_postings(nodes: DataFrame, match: int) -> DataFrame:
    """(key, node, weight): each node under the rarest N - T + 1 of its coordinate-value pairs, without those that no other
    node has. The weight grows with the number of nodes that share its pairs."""
    pairs = nodes.select("node", F.posexplode("signature")).select("node", (F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(0xFFFFFFFF))).alias("key"))
    common = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = merged(pairs, common, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))  # at most N for a node
    weight = F.aggregate("own", F.lit(0.0), lambda sum_, p: sum_ + F.log(p["n"].cast("double")))
    left = F.greatest(F.lit(0), F.lit(1 - match) + F.size("own"))
    return mine.select("node", weight.alias("weight"), F.explode(F.slice("own", F.lit(1), left)).alias("p")).select(F.col("p.key").alias("key"), "node", "weight")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, members) for wanted (node, set_hash, doc_id): their sets anew from the texts, so that only those travel that are needed."""

    def make():
        hashes = WordHashes()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [set_of(t, hashes, k) for t in bytes_of(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(map(digest_of, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_hash", "members"])

        return run

    ids = written(wanted.select("doc_id").distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    found = map_batches(texts.select("text"), make, "set_hash binary, members binary").groupBy("set_hash").agg(F.first("members").alias("members"))
    out = written(merged(found, wanted.select("set_hash", "node"), "set_hash").select("node", "members"))
    dropped(ids)
    return out


class Links:
    """Confirms pairs (a, b) of nodes: signatures first, then whole sets."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        # the low byte of each value is enough here: it can only make more pairs likely
        low = F.transform("signature", lambda v: (v.bitwiseAND(255) - 128).cast("tinyint"))
        self.heads, self.sets, self.percent = nodes.select("node", "n_shingles", low.alias("low")), sets, percent

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
        near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
        met = merged(merged(pairs, self.heads.toDF("a", "n_a", "sig_a"), "a"), self.heads.toDF("b", "n_b", "sig_b"), "b")
        likely = written(met.where(near & (agree >= match_threshold(percent))).select("a", "b"))

        def make():
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

            return run

        met = likely.join(self.sets.toDF("b", "set_b"), "b").join(self.sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
        out = written(map_batches(met, make, "a long, b long"))
        dropped(likely)
        return out


def head_pairs(postings: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each node b that lists hold with other components, the head a of most of these lists.

    The head of a list is its first node by weight, which puts the original before its altered copies; later turns move all
    weights more and more by chance, so that others come first.
    """
    chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1024)) / 1024
    rank = F.struct(F.col("weight") * (1 - 0.02 * turn * chance), -F.col("node"))
    heads = postings.groupBy("key", "band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by(F.struct("node", "component"), rank).alias("head")).where("low < high")
    votes = merged(postings, heads, ["key", "band"]).where("component <> head.component").groupBy("node", F.col("head.node").alias("head")).count()
    best = votes.groupBy("node").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("head"))
    return best.select(F.col("head").alias("a"), F.col("node").alias("b"))


def in_bands(postings: DataFrame, percent: int) -> DataFrame:
    """Each posting in bands of size: as the smaller of a pair in its own, as the larger in those of all smaller sizes it can be similar to.

    What comes before a shingle's place is not shared, so a partner has `most` shingles at most.
    """
    postings = postings.withColumn("most", F.expr(f"({100 + percent} * (n - place)) div {percent} - n")).drop("place")
    n, most, least = F.col("n"), F.col("most"), F.expr(f"({percent} * n + 99) div 100")
    band = lambda size: F.floor(F.log(size.cast("double")) / (math.log(100 / percent) / BANDS))
    small = F.when(most >= n, F.array(F.struct(band(n).alias("band"), F.lit(1).alias("small"), F.lit(0).alias("large")))).otherwise(F.array())
    up = F.least(n, most)
    large = F.when(up >= least, F.transform(F.sequence(band(least), band(F.greatest(up, least))), lambda x: F.struct(x.alias("band"), F.lit(0).alias("small"), F.lit(1).alias("large")))).otherwise(F.array())
    return postings.select("*", F.inline(F.concat(small, large)))


def open_parts(postings: DataFrame) -> DataFrame:
    """(key, band, component, small, large, pairs, ...): how many smaller and larger nodes of each component a list has, for lists
    in which these meet other components, and the least n and the greatest `most` of either; pairs: how often they meet, on
    one row of the list."""
    sums = [f(F.when(F.col(role) == 1, F.col(c))).alias(f"{role}_{c}") for role in ("small", "large") for f, c in ((F.min, "n"), (F.max, "most"))]
    parts = postings.groupBy("key", "band", "component").agg(F.sum("small").alias("small"), F.sum("large").alias("large"), *sums)
    lists = parts.groupBy("key", "band").agg((F.sum("small") * F.sum("large") - F.sum(F.col("small") * F.col("large"))).alias("pairs"), F.min("component").alias("first")).where("pairs > 0")
    pairs = F.when(F.col("component") == F.col("first"), F.col("pairs")).otherwise(0)
    return written(merged(parts, lists, ["key", "band"]).select(*parts.columns, pairs.alias("pairs")))


def shingle_postings(sets: DataFrame, open_nodes: DataFrame, percent: int) -> DataFrame:
    """(key, band, node, n, most, weight, small, large): each node of open_nodes (node, component) under its rarest shingles.

    Shingles are ordered by how many components hold them. Two similar sets share one of the first n - ceil(percent * n / 100) + 1
    of n; those that one component holds come first and join nothing.
    The weight grows with the number of nodes that share the node's shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(2)).to_numpy() // 8
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
                at = np.repeat(np.arange(start, end), sizes[start:end])
                keys = np.frombuffer(b"".join(batch.column(2).slice(start, end - start).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(i).take(pa.array(at)) for i in (0, 1)), pa.array(sizes[at], pa.int64())], names=["key", "node", "component", "n"])
                start = end

    met = open_nodes.join(sets, "node").select("node", "component", "members")
    flat = written(met.mapInArrow(run, "key long, node long, component long, n long"))
    lists = flat.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("often"), F.sum("m").alias("m")).where("m > 1")
    mine = Window.partitionBy("node")
    met = merged(flat, lists, "key").withColumn("weight", F.sum(F.log("m")).over(mine)).where("often > 1")
    ranked = met.withColumn("rank", F.row_number().over(mine.orderBy("often", "key"))).withColumn("n_common", F.count("*").over(mine))
    place = F.col("n") - F.col("n_common") + F.col("rank") - 1
    prefix = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    out = written(in_bands(ranked.withColumn("place", place).where(F.col("place") < prefix).select("key", "node", "n", "place", "weight"), percent))
    dropped(flat)
    return out


def between_components(postings: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes of different components in one of the lists that can be similar by their sizes and the shingle's places.

    Components of a list meet first, then their nodes, each time within the sizes that the other side can have.
    """
    side = lambda x, role: parts.where(f"{role} > 0").select("key", "band", F.struct("component", F.col(f"{role}_n").alias("n"), F.col(f"{role}_most").alias("most")).alias(x))
    fits = lambda a, b: (F.col(f"{a}.n") <= F.col(f"{b}.most")) & (F.col(f"{b}.n") <= F.col(f"{a}.most"))
    node = lambda x, role: postings.where(f"{role} = 1").select("key", "band", F.struct("component", "node", "n", "most").alias(x))

    def joined(left: DataFrame, right: DataFrame, a: str, b: str, more) -> DataFrame:
        left, right = left.alias("left"), right.alias("right")
        same = (F.col("left.key") == F.col("right.key")) & (F.col("left.band") == F.col("right.band"))
        names = [c for c in left.columns if c not in ("key", "band")]
        return merged(left, right, same & more & fits(a, b)).select("left.key", "left.band", *names, *[c for c in right.columns if c not in ("key", "band")])

    across = joined(side("c", "small"), side("d", "large"), "c", "d", F.col("c.component") != F.col("d.component"))
    met = joined(across, node("a", "small"), "a", "d", F.col("c.component") == F.col("a.component"))
    near = (F.col("a.n") <= F.col("b.n")) & (F.lit(100) * F.col("a.n") >= F.lit(percent) * F.col("b.n"))
    met = joined(met, node("b", "large"), "a", "b", (F.col("d.component") == F.col("b.component")) & near)
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) after edges (a, b) between nodes; `labels` and `edges` are dropped."""
    ends = edges.join(labels.toDF("a", "c_a"), "a").join(labels.toDF("b", "c_b"), "b")
    found = connected_components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    out = written(labels.join(found.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
    dropped(labels, edges, found)
    return out


def with_classes(docs: DataFrame, k: int, percent: int, carried: str | None = None) -> DataFrame:
    """doc_id, row_key, n_shingles, class_id and component for each row of docs: the least doc_id and a number of its class.

    Both are null for a null doc_id, and the component for an empty set. Two classes have the same class_id if rows of that doc_id
    are in both.
    """
    rows = written(sketch(docs, k, carried))
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = full.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    postings = written(prefix_postings(nodes, match_threshold(percent)).withColumn("band", F.lit(0)))
    labels = written(postings.select("node", F.col("node").alias("component")).distinct())
    listed = written(nodes.join(labels.select("node"), "node", "left_semi"))
    sets = sets_of(docs, listed, k)
    links = Links(listed, sets, percent)
    labels = joined_labels(labels, links.confirmed(head_pairs(postings.withColumn("component", F.col("node")), 0)))
    labelled = written(postings.join(labels, "node"))
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_nodes = labelled.join(several, "key", "left_semi").select("node", "component").distinct()
    rare = shingle_postings(sets, open_nodes, percent)
    dropped(labelled, postings)
    total, turn, last = rare.count(), 0, False
    while not last:
        labelled = written(rare.join(labels, "node"))
        parts = open_parts(labelled)
        labelled_open = labelled.join(parts.select("key", "band").distinct(), ["key", "band"], "left_semi")
        many = parts.agg(F.sum("pairs")).first()[0] or 0
        last = many <= total or turn == ROUNDS
        new = links.confirmed(between_components(labelled, parts, percent) if last else head_pairs(labelled_open, turn))
        if not last and new.isEmpty():
            dropped(new)
            new, last = links.confirmed(between_components(labelled, parts, percent)), True
        dropped(labelled, parts)
        labels, turn = joined_labels(labels, new), turn + 1
    met = nodes.join(labels, "node", "left").select("set_hash", "doc_id", F.coalesce("component", "node").alias("component"))
    classes = met.join(met.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("set_hash", "class_id", "component")
    dropped(rare, sets, listed)
    alone = F.col("doc_id").isNull()
    return rows.join(classes, "set_hash", "left").select("doc_id", "row_key", "n_shingles", F.when(~alone, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(~alone, F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs: linked where 100 * |A and B| >= percent * |A or B|."""
    own = F.col("class_id")
    return with_classes(docs, k, percent).select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), 3, 85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_near_dedup": op7_near_dedup}

SQL = {
    "op7_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.to_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(to_id) AS component_id, doc_id = min(to_id) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
}
