"""Language-model scoring with a log-frequency Bloom filter.

Unigrams and bigrams of all training documents are counted exactly. A count c is quantised to the level
q = 1 + floor(log2 c), and the filter holds (n-gram, 1) to (n-gram, q). A level is read back by probing one after another
until one is missing; each distinct n-gram of some documents is probed once.

The probability of a word after another is WEIGHT times its bigram estimate and the rest times its unigram estimate. Unigrams
are middle counts of their level plus one, over the sum of these over all words and one unknown word. Bigrams take the least count of the
pair's level over the greatest of the first word's, so all that can follow a word sums to one at most, and no score is above 0.

The filter is cut into parts; an n-gram has all its bits in one, and a part is as large as its own entries need, so its rate of false
hits is the same everywhere: about 1.7 % a level with 10 bits and 3 probes. Each task builds whole parts from the
n-grams that it is dealt, adding them up as they come. A filter of at most `FILTER_BYTES` is broadcast. A larger one stays where it is: the distinct
n-grams of groups of documents are dealt to the runs of `RUN` parts that they belong to, probed there, and their levels join the group
again. So texts are read as often for a large filter as for a small one, and nothing but its size comes to the driver.

The base score needs exact counts: words of high count come from a broadcast table of at most `HOT_WORDS` rows, the
others of each document are joined with the table of counts.

Null or empty text: the end token alone. A null doc_id counts as an empty text when it is dealt to a fold. Equal rows are
counted and scored one by one. Very long texts are read whole. With no training documents every count is 0. Other columns
of docs are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LARGE_ROWS, MIX, WordHashes, bytes_of, fold_of, map_batches, mixed, read_table, spaced_words, written

#: No word holds a space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))
FILTER_BYTES, HOT_WORDS = 128 << 20, 500_000
PROBES, BITS_PER_ENTRY = 3, 10.0
#: Share of the bigram estimate; tokens counted and probed at a time in a task; bytes of training text for each part.
WEIGHT, AT_ONCE, PROBED_AT_ONCE, PART_BYTES = 0.6, 1 << 20, 1 << 18, 8 << 20
LOW = np.uint64(0xFFFFFFFF)
#: Parts that a task probes together where the filter is not broadcast.
RUN = 16
#: Words whose hashes a probing worker keeps.
WORDS = 150_000


def tokens_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    return np.append(hashes.of(spaced_words(text)), END)


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens ^ MIX)


def bigram_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of concatenated documents that begin at `starts`."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    with np.errstate(over="ignore"):
        return mixed(mixed(before + np.uint64(1)) * MIX + tokens)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c); 0 of 0


def least_of(levels: np.ndarray) -> np.ndarray:
    """The least count that has a level."""
    return np.where(levels > 0, np.exp2(levels.astype(np.float64) - 1), 0.0)


def most_of(levels: np.ndarray) -> np.ndarray:
    return np.exp2(levels.astype(np.float64)) - 1


def middle_of(levels: np.ndarray) -> np.ndarray:
    return (least_of(levels) + most_of(levels)) / 2


def summed(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(keys)
    if counts is None:
        return np.unique(flat, return_counts=True)
    order = np.argsort(flat)
    flat, n = flat[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[first], np.add.reduceat(n, first)


def flat_batches(batches: Iterator[pa.RecordBatch], column: int, hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of some documents together, and where each begins."""
    held, n = [], 0
    for batch in batches:
        for text in bytes_of(batch.column(column)):
            held.append(tokens_of(text, hashes))
            n += len(held[-1])
            if n >= AT_ONCE:
                yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
                held, n = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])


def count_words(train: DataFrame) -> DataFrame:
    """(h, c): every word's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in flat_batches(batches, 0, WordHashes()):
            h, c = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def places(keys: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places in a part of `sizes` bits."""
    with np.errstate(over="ignore"):
        h = mixed(mixed(keys * MIX + np.uint64(level)))
        for i in range(PROBES):
            yield (((h + np.uint64(i) * (h >> np.uint64(32))) & LOW) * sizes >> np.uint64(32)).astype(np.int64)


def bits_of(keys: np.ndarray, counts: np.ndarray, bits_per_entry: float) -> bytes:
    """A part with (key, 1) to (key, level) of each key."""
    levels = level_of(counts)
    size = 8 * max(8, math.ceil(levels.sum() * bits_per_entry / 8))
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max()) + 1):
        for place in places(keys[levels >= level], level, np.uint64(size)):
            bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Sums:
    """Counts of keys, added up as they come, so that only distinct keys stay."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > max(AT_ONCE, 2 * len(self.keys[0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, counts = summed(self.keys, self.counts)
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return self.keys[0], self.counts[0]


def build_parts(train: DataFrame, parts: int, bits_per_entry: float) -> DataFrame:
    """(part, bits): the finished parts, from all n-grams of the training rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, starts in flat_batches(batches, 0, WordHashes()):
            keys, counts = summed([unigram_keys(tokens), bigram_keys(tokens, starts)])
            part = part_of(keys, parts)  # sorted, as the keys are
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(at[1:], len(part))
            counts = counts.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["part", "ks", "cs"])

    def finish(part: int, sums: Sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([bits_of(*sums.total(), bits_per_entry)], pa.binary())], names=["part", "bits"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Sums()
        for batch in batches:
            for part, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != now and now is not None:
                    yield finish(now, sums)
                    sums = Sums()
                now = part
                sums.add(np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
        if now is not None:
            yield finish(now, sums)

    dealt = train.select("text").mapInArrow(emit, "part long, ks binary, cs binary").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(build, "part long, bits binary")


class FilterShard:
    """Some parts of the filter, `first` and those after it; `fill` probes until a level is missing."""

    def __init__(self, parts: int, rows: list, first: int = 0, count: int | None = None):
        self.parts, self.first, self.bytes = parts, first, np.frombuffer(b"".join(bits for _, bits in rows) or b"\0", np.uint8)
        count = parts if count is None else count
        self.sizes, self.starts = np.zeros(count, np.uint64), np.zeros(count, np.int64)
        at = 0
        for part, bits in rows:
            self.sizes[part - first], self.starts[part - first] = 8 * len(bits), 8 * at
            at += len(bits)

    def fill(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Sets out for keys of these parts."""
        part = part_of(keys, self.parts) - self.first
        sizes, starts, level = self.sizes[part], self.starts[part], 0
        active = np.flatnonzero(sizes > 0)
        while len(active):
            level += 1
            active = self.having(keys, active, level, sizes, starts)
            out[active] = level

    def having(self, keys: np.ndarray, active: np.ndarray, level: int, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        base, found = starts[active], np.ones(len(active), bool)
        for place in places(keys[active], level, sizes[active]):
            place += base
            found &= (self.bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return active[found]


def score_documents(docs: DataFrame, is_training, filter_bytes: int = FILTER_BYTES, hot_words: int = HOT_WORDS, bits_per_entry: float = BITS_PER_ENTRY, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, held_out of each row; is_training is a column of docs."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~is_training).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    words = written(count_words(train))
    level = F.length(F.bin("c"))  # 1 + floor(log2 c)
    middle = (F.lit(3.0) * F.pow(F.lit(2.0), level - 1) - 1) / 2
    n, v, mass = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(middle + 1), F.lit(0.0))).first()
    n_docs, size = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    low = 0
    if v:
        above = {r[0]: r[1] for r in words.groupBy(level.alias("q")).count().collect()}  # a row for each level
        while sum(m for q, m in above.items() if q > low) > hot_words:
            low += 1
    hot = words.where(F.col("c") >= 1 << low).toArrow()  # at most hot_words rows
    order = np.argsort(h := hot.column(0).to_numpy())
    hot_shared = spark.sparkContext.broadcast((h[order], hot.column(1).to_numpy()[order]))
    parts = 1 + size // part_bytes
    built = written(build_parts(train, parts, bits_per_entry)) if n else None
    filter_size = built.agg(F.sum(F.octet_length("bits"))).first()[0] if n else 0
    total = Totals(mass, n_docs, hot_shared)
    if filter_size <= filter_bytes:
        shard = spark.sparkContext.broadcast(FilterShard(parts, built.collect() if n else []))  # at most filter_bytes
        done = written(map_batches(rows, total.of_rows(shard), DONE))
    else:
        groups = written(map_batches(rows, grouped, GROUPS), options=LARGE_ROWS)
        done = written(map_batches(groups.join(dealt_levels(groups, built, parts), "group_id").select("doc_ids", "held_outs", "texts", "levels"), total.of_groups(), DONE))
    # Spark sizes a list as one word, so the rare words of all documents could be broadcast
    few = words.where(F.col("c") < 1 << low)
    rare = done.select("row_id", F.explode("rare").alias("h")).join(F.broadcast(few) if v <= hot_words else few.hint("merge"), "h").groupBy("row_id").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("rare_log"))
    none = F.lit(math.log10(n + v + 1))
    return done.join(rare, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"), "score",
    )


def groups_of(texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The tokens of some documents at a time, and the number of the first."""
    start, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append(tokens_of(text, hashes))
        n += len(held[-1])
        if n >= PROBED_AT_ONCE or i + 1 == len(texts):
            yield start, held
            start, held, n = i + 1, [], 0


GROUPS = "group_id long, doc_ids array<long>, held_outs array<boolean>, texts array<binary>"
DONE = "row_id long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, score double, rare array<long>"


def numbers() -> Iterator[int]:
    """Numbers that no other task of the job gives out."""
    context = TaskContext.get()
    return itertools.count((context.partitionId() if context else 0) << 40)


def keys_of(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some documents begins and ends, and their unigram keys with the bigram keys behind."""
    bounds, flat = np.cumsum([0, *map(len, each)]), np.concatenate(each)
    return bounds, np.concatenate([unigram_keys(flat), bigram_keys(flat, bounds[:-1])])


def grouped() -> Callable:
    """Rows as groups of some documents."""
    hashes, number = WordHashes(WORDS), numbers()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, held_outs, texts = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist(), bytes_of(batch.column(1))
        out = []
        for start, held in groups_of(texts, hashes):
            end = start + len(held)
            out.append((next(number), ids[start:end], held_outs[start:end], texts[start:end]))
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["group_id", "doc_ids", "held_outs", "texts"])

    return run


def dealt_levels(groups: DataFrame, built: DataFrame, parts: int) -> DataFrame:
    """(group_id, levels): the levels of a group's distinct keys in ascending order, in pieces.

    Keys are dealt to runs of parts. A run's parts come first, as rows whose group_id is negative, and are all that a task holds.
    """

    def emit() -> Callable:
        hashes = WordHashes(WORDS)

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs, ids, data = [], [], []
            for group_id, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.unique(keys_of([tokens_of(t, hashes) for t in texts.as_py()])[1])
                run = part_of(keys, parts) // RUN  # sorted, as the keys are
                at = np.flatnonzero(np.append(True, run[1:] != run[:-1])).tolist()
                runs += run[at].tolist()
                ids += [group_id] * len(at)
                data += [keys[a:b].tobytes() for a, b in zip(at, [*at[1:], len(keys)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["run", "group_id", "data"])

        return of

    def probe() -> Callable:
        now, bits, table = None, [], None

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal now, bits, table
            runs, ids, levels = [], [], []
            for run, group_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if run != now:
                    now, bits, table = run, [], None
                if group_id < 0:
                    bits.append((group_id + parts, data.as_py()))
                    continue
                if table is None:
                    table, bits = FilterShard(parts, bits, run * RUN, RUN), []
                keys = np.frombuffer(data.as_buffer(), np.uint64)
                found = np.zeros(len(keys), np.uint8)
                table.fill(keys, found)
                runs.append(run)
                ids.append(group_id)
                levels.append(found.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(ids, pa.int64()), pa.array(levels, pa.binary())], names=["run", "group_id", "levels"])

        return of

    keys = map_batches(groups.select("group_id", "texts"), emit, "run long, group_id long, data binary")
    filters = built.select((F.col("part") / RUN).cast("long").alias("run"), (F.col("part") - parts).alias("group_id"), F.col("bits").alias("data"))
    dealt = filters.unionByName(keys).repartition("run").sortWithinPartitions("run", "group_id")
    found = map_batches(dealt, probe, "run long, group_id long, levels binary")
    return found.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("run", "levels"))), lambda x: x["levels"]).alias("levels"))  # of one group


class Totals:
    """Adds up levels and exact counts for each document."""

    def __init__(self, mass: float, n_docs: int, hot_shared):
        self.mass, self.n_docs, self.hot_shared = mass, n_docs, hot_shared

    def of_rows(self, shard) -> Callable:
        """Of rows, whose levels are in a broadcast filter."""

        def make():
            table, hashes, number = shard.value, WordHashes(WORDS), numbers()
            hot, logs = self.hot()

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, held_outs, out = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist(), []
                for start, each in groups_of(bytes_of(batch.column(1)), hashes):
                    bounds, keys = keys_of(each)
                    own, back = np.unique(keys, return_inverse=True)
                    found = np.zeros(len(own), np.uint8)
                    table.fill(own, found)
                    end = start + len(each)
                    out += self.summed(each, bounds, found[back], ids[start:end], held_outs[start:end], number, hot, logs)
                return done_batch(out)

            return run

        return make

    def of_groups(self) -> Callable:
        """Of groups with the levels of their distinct keys."""

        def make():
            hashes, number = WordHashes(WORDS), numbers()
            hot, logs = self.hot()

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = []
                for ids, held_outs, texts, levels in zip(*batch.columns, strict=True):
                    each = [tokens_of(t, hashes) for t in texts.as_py()]
                    bounds, keys = keys_of(each)
                    found = np.frombuffer(b"".join(levels.as_py()), np.uint8)[np.unique(keys, return_inverse=True)[1]]
                    out += self.summed(each, bounds, found, ids.as_py(), held_outs.as_py(), number, hot, logs)
                return done_batch(out)

            return run

        return make

    def hot(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequent words, and the logarithms of their counts plus one."""
        words, counts = self.hot_shared.value
        return words, np.log10(counts + 1.0)

    def summed(self, each: list[np.ndarray], bounds: np.ndarray, levels: np.ndarray, ids: list, held_outs: list, number: Iterator[int], hot: np.ndarray, logs: np.ndarray) -> Iterator[tuple]:
        word, pair = levels[: bounds[-1]], levels[bounds[-1] :]
        before = np.append(0, most_of(word[:-1]))
        before[bounds[:-1]] = self.n_docs
        alone = (middle_of(word) + 1) / (self.mass + 1)
        after = np.divide(least_of(pair), before, out=np.zeros(len(word)), where=before > 0)
        scores = np.add.reduceat(np.log10(np.where(before > 0, (1 - WEIGHT) * alone + WEIGHT * np.minimum(after, 1), alone)), bounds[:-1])
        for doc_id, held_out, tokens, score in zip(ids, held_outs, each, scores.tolist(), strict=True):
            tokens = tokens.view(np.int64)
            at = np.minimum(np.searchsorted(hot, tokens), max(len(hot) - 1, 0))
            known = hot[at] == tokens if len(hot) else np.zeros(len(tokens), bool)
            yield next(number), doc_id, held_out, len(tokens), int(known.sum()), float(logs[at[known]].sum()), score, tokens[~known]


def done_batch(rows: list[tuple]) -> pa.RecordBatch | None:
    if not rows:
        return None
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["row_id", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "score", "rare"])


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fold_of("doc_id", 7) != 2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_lm_score": op9_lm_score}
SQL: dict[str, str] = {}
