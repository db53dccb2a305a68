"""Toxicity by a convolutional text classifier.

Each word has four hashed rows of one embedding table: two for the word (so that two words seldom share both), two for its
first four and five letters. Filters of widths 1 to 3 run over the whole text, the greatest answer of each filter is
kept, and a logistic layer weighs them. The network is trained in numpy on the driver, on at most `SAMPLE_ROWS` labelled
rows and `SAMPLE_WORDS` words, which are all that comes to the driver; the table starts from the log odds of its rows in that sample. The sample is the rows
of least hash of the id, so it is the same at each run.

A threshold is calibrated for each language on rows kept back from the gradient steps. A text's language is guessed from
its letters alone, so that a score depends on nothing but the text; scores are shifted so that each threshold is 0.7.

Null or empty text: the score of a text without words. A null doc_id or toxic label is not learnt from. With no labels,
or only one kind, every score is 0. Equal rows count and come out one by one. Very long texts are scored whole, and so are equal
texts alike. Other columns stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, bytes_of, fold_of, map_batches, read_table, written

SAMPLE_ROWS, SAMPLE_WORDS = 8_000, 6_000_000
ROWS, DIM, FEATURES, FILTERS, WIDTHS = 1 << 20, 4, 4, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.1, 1e-4
THRESHOLD = 0.7
SCORE = "__toxicity_score"
#: Longer words go to the driver as their rows, in as many bytes and one.
LONG_WORD = 8 * FEATURES
#: Letters by which a language is guessed; none of them: the first.
LETTERS = {"en": "", "de": "äöüßÄÖÜ", "fr": "çèêàùœÇÈÊÀ", "es": "ñóíáúÑÓÍÁÚ¿¡"}
LANGUAGES = tuple(LETTERS)
MARKED = [re.compile(f"[{letters}]") for letters in list(LETTERS.values())[1:]]
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
POOLED = FILTERS * len(WIDTHS)


def language_of(text: bytes) -> int:
    if text.isascii():
        return 0
    letters = text.decode()
    found = [len(p.findall(letters)) for p in MARKED]
    return 1 + int(np.argmax(found)) if any(found) else 0


def rows_of(word: bytes) -> tuple[int, ...]:
    """The rows of a word, or of one that packed_word has packed."""
    if word.startswith(b"\0"):
        return tuple(int(word[i : i + 8], 16) for i in range(1, 1 + 8 * FEATURES, 8))
    letters = word.decode()
    return tuple(1 + xxhash.xxh3_64_intdigest(k.encode(), i + 1) % (ROWS - 1) for i, k in enumerate((letters, letters, letters[:4], letters[:5])))


def packed_word(word: bytes) -> bytes:
    """A long word as its rows; no word has a byte of 0."""
    return word if len(word) <= LONG_WORD else b"\0" + b"".join(b"%08x" % r for r in rows_of(word))


class Rows(dict):
    """A word's rows of the table; it is emptied at `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.rows: list[tuple[int, ...]] = [(0,) * FEATURES]

    def __missing__(self, word: bytes) -> int:
        self.rows.append(rows_of(word))
        self[word] = out = len(self.rows) - 1
        return out

    def trim(self) -> bool:
        if len(self) <= self.most:
            return False
        self.clear()
        self.rows = [(0,) * FEATURES]
        return True

    def of(self, words: list[bytes]) -> np.ndarray:
        """Local numbers, after which come blanks so that each filter fits."""
        return np.fromiter([*map(self.__getitem__, words), *[0] * max(WIDTHS)], np.int64, len(words) + max(WIDTHS))


class Network:
    def __init__(self, table: np.ndarray, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.table, self.filters, self.bias, self.out, self.out_bias = table, filters, bias, out, out_bias
        self.thresholds = np.zeros(len(LANGUAGES))

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to each filter in each of its places: words x (slots * filters)."""
        return self.table[rows].reshape(len(rows), -1) @ self.filters

    def pooled(self, answers: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest answer of each filter over [start, end) of each text; with `where`, also its place."""
        best, places, slot = np.empty((len(starts), POOLED), np.float32), np.zeros((len(starts), POOLED), np.int64), 0
        for k, w in enumerate(WIDTHS):
            n = len(answers) - w + 1
            total = answers[:n, slot * FILTERS : (slot + 1) * FILTERS].copy()
            for j in range(1, w):
                total += answers[j : n + j, (slot + j) * FILTERS : (slot + j + 1) * FILTERS]
            slot += w
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            if where:
                for d, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    at = total[a : b - max(WIDTHS) + 1].argmax(0)
                    places[d, columns] = a + at
                    best[d, columns] = total[a + at, np.arange(FILTERS)]
            else:
                # windows that begin in the last blanks of a text would reach into the next one
                blank = (ends[:, None] - np.arange(1, max(WIDTHS))[None, :]).ravel()
                total[blank[blank < n]] = -np.inf
                best[:, columns] = np.maximum.reduceat(total, starts, axis=0)
        return best, places if where else None

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def score(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[languages] + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


def train_network(texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray) -> Network:
    """texts: local numbers of the words of each text; rows: the rows of the table of each local number."""
    rng = np.random.default_rng(7)
    pos, neg = np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float32)
    for text, label in zip(texts, labels, strict=True):
        (pos if label else neg)[np.unique(rows[np.unique(text)])] += 1
    n_pos, n_neg, seen = labels.sum(), len(labels) - labels.sum(), pos + neg
    table = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
    table[:, 0] = (np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))) * seen / (seen + 5)
    table[(seen == 0) | (np.arange(ROWS) == 0)] = 0
    filters = rng.normal(0, 0.1, (FEATURES * DIM, len(SLOTS) * FILTERS)).astype(np.float32)
    filters[::DIM] = np.abs(filters[::DIM]) + 0.1
    net = Network(table, filters, np.full(POOLED, -0.5, np.float32), np.full(POOLED, 0.1, np.float32), -1.0)
    squares = {"table": np.full((ROWS, DIM), 1e-2, np.float32), "filters": np.full_like(filters, 1e-2), "bias": np.full_like(net.bias, 1e-2), "out": np.full_like(net.out, 1e-2), "out_bias": 1e-2}
    weight = np.where(labels == 1, n_neg / max(n_pos, 1), 1.0) ** 0.5
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            chosen = order[b : b + BATCH]
            flat = np.concatenate([texts[i] for i in chosen])
            ends = np.cumsum([len(texts[i]) for i in chosen])
            starts = np.append(0, ends[:-1])
            local, back = np.unique(flat, return_inverse=True)
            best, places = net.pooled(net.projected(rows[local])[back], starts, ends, where=True)
            active = best + net.bias > 0
            error = (weight[chosen] * (1 / (1 + np.exp(-net.logits(best))) - labels[chosen]) / len(chosen)).astype(np.float32)
            g_best = error[:, None] * net.out[None, :] * active
            g_filters, g_rows, g_values, slot = np.zeros_like(filters), [], [], 0
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    columns = slice((slot + j) * FILTERS, (slot + j + 1) * FILTERS)
                    at = rows[flat[places[:, k * FILTERS : (k + 1) * FILTERS] + j]]  # texts x filters x features
                    inputs = net.table[at].reshape(*at.shape[:2], -1)
                    g = g_best[:, k * FILTERS : (k + 1) * FILTERS]
                    g_filters[:, columns] += np.einsum("tf,tfi->if", g, inputs)
                    g_rows.append(at.reshape(-1))
                    g_values.append((g[:, :, None] * filters[:, columns].T[None]).reshape(-1, DIM))
                slot += w
            step = {"filters": g_filters + DECAY * filters, "bias": g_best.sum(0), "out": error @ np.maximum(best + net.bias, 0) + DECAY * net.out, "out_bias": float(error.sum())}
            for name, g in step.items():
                squares[name] = squares[name] + g * g
                setattr(net, name, getattr(net, name) - RATE * g / np.sqrt(squares[name]))
            filters = net.filters = net.filters.astype(np.float32)
            touched, to = np.unique(np.concatenate(g_rows), return_inverse=True)
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, to, np.concatenate(g_values))
            g[touched == 0] = 0
            squares["table"][touched] += g * g
            net.table[touched] -= RATE * g / np.sqrt(squares["table"][touched])
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, languages: np.ndarray) -> None:
    """For each language the threshold of best F1 on rows that the gradient steps didn't see; of few rows, that of all."""

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
        i = int(f1.argmax())
        below = z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 1
        return float((z[order[i]] + below) / 2)

    net.thresholds[:] = best(logits, labels) if labels.sum() >= 5 else float(logits.max()) + 1 if not labels.sum() else float(logits[labels == 1].min())
    for k in range(len(LANGUAGES)):
        own = languages == k
        if own.sum() >= 100 and labels[own].sum() >= 10:
            net.thresholds[k] = best(logits[own], labels[own])


def packed_sample(one: DataFrame) -> DataFrame:
    """doc_id, toxic, n_words, language and packed words of doc_id, text and toxic."""
    out = one.select("doc_id", "toxic", F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("language"), F.lit(b"").alias("packed")).schema

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = bytes_of(batch.column(2))
            words = [alnum_words(t) for t in texts]
            more = [pa.array(map(len, words), pa.int64()), pa.array(map(language_of, texts), pa.int32()), pa.array((b" ".join(map(packed_word, w)) for w in words), pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=out.names)

        return run

    return map_batches(one.select("doc_id", "toxic", "text"), make, out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, may_learn, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> Network | None:
    """may_learn: a column over doc_id; other rows' labels are never read. Rows of one doc_id are one text here, the least."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = written(packed_sample(one))
    counts = sample.select("doc_id", "n_words").toArrow()  # at most sample_rows rows
    order, taken, n = np.argsort([xxhash.xxh3_64_intdigest(str(i).encode()) for i in counts["doc_id"].to_pylist()], kind="stable"), {}, 0
    for i in order.tolist():
        words = counts["n_words"][i].as_py()
        if n + words > sample_words:
            continue
        n += words
        taken[counts["doc_id"][i].as_py()] = len(taken)
    if len(taken) < len(counts):
        ids = docs.sparkSession.createDataFrame([(i,) for i in taken], sample.select("doc_id").schema)
        sample = sample.join(F.broadcast(ids), "doc_id", "left_semi")
    sample = sample.toArrow()  # at most sample_rows rows and sample_words words
    cache, texts, y, languages = Rows(1 << 62), [], [], []
    for i in np.argsort([taken[i] for i in sample["doc_id"].to_pylist()]).tolist():
        packed = sample["packed"][i].as_py()
        texts.append(cache.of(packed.split(b" ") if packed else []).astype(np.int32))
        y.append(1 if sample["toxic"][i].as_py() else 0)
        languages.append(sample["language"][i].as_py())
    y, languages = np.array(y, np.int64), np.array(languages, np.int64)
    if not 0 < y.sum() < len(y):
        return None
    rows = np.array(cache.rows, np.int32)
    back = np.arange(len(y)) % 4 == 3  # a quarter is kept back
    if not 0 < y[~back].sum() < (~back).sum():
        back[:] = False
    train = np.flatnonzero(~back)
    net = train_network([texts[i] for i in train], y[train], rows)
    held = np.flatnonzero(back) if y[back].sum() else train
    logits = np.concatenate([net.logits(pool_texts(net, [texts[i]], rows)) for i in held])
    calibrate(net, logits, y[held], languages[held])
    return net


def pool_texts(net: Network, texts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    flat = np.concatenate(texts)
    local, back = np.unique(flat, return_inverse=True)
    ends = np.cumsum([len(t) for t in texts])
    return net.pooled(net.projected(rows[local])[back], np.append(0, ends[:-1]), ends)[0]


class Scorer:
    """Scores texts; what a word adds to the filters is computed once for each word and kept while memory allows."""

    def __init__(self, net: Network | None):
        self.net, self.cache = net, Rows()
        self.answers = np.zeros((0, len(SLOTS) * FILTERS), np.float32)

    def scores(self, texts: list[bytes], at_once: int = 200_000) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        out, held, n = [], [], 0
        for text in texts:
            held.append(self.cache.of(alnum_words(text)))
            n += len(held[-1])
            if n >= at_once:
                out.append(self._logits(held))
                held, n = [], 0
        if held:
            out.append(self._logits(held))
        return self.net.score(np.concatenate(out), np.array([language_of(t) for t in texts]))

    def _logits(self, held: list[np.ndarray]) -> np.ndarray:
        new = np.array(self.cache.rows[len(self.answers) :], np.int64).reshape(-1, FEATURES)
        if len(new):
            self.answers = np.concatenate([self.answers, self.net.projected(new)])
        ends = np.cumsum([len(t) for t in held])
        best, _ = self.net.pooled(self.answers[np.concatenate(held)], np.append(0, ends[:-1]), ends)
        if self.cache.trim():
            self.answers = self.answers[:0]
        return self.net.logits(best)


def score_toxicity(docs: DataFrame, net: Network | None, name: str = SCORE) -> DataFrame:
    """docs with the score as a last column, in one pass without a shuffle; a column of that name before is replaced."""
    docs = docs.drop(name)
    shared, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.scores(bytes_of(batch.column(at))), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def may_learn() -> object:
    return fold_of("doc_id", 3) != 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), may_learn())
    return score_toxicity(docs, net).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
