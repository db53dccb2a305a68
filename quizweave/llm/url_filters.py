"""Verdicts on urls: a few ordered rules first, then a list of domains and addresses as a cascade of Bloom filters.

The first level of the cascade encodes the listed keys. Keys of the corpus that are not listed and yet pass it are encoded in the second
level, listed ones that pass the second in the third, and so on until nothing passes wrongly. A key goes up until it fails a level: at an even
one it isn't listed, at an odd one it is. As all keys of the corpus took part, the answer is exact for each of them, and
no page is joined with the list. Levels after the first have one probe and let half of what they should not through, the first one as
few as make the whole smallest.

Keys are known by two 64-bit hashes. They are dealt over parts by the first; each part has its own cascade, which one task builds from the part's keys. At
most `FILTER_BYTES` of finished parts are broadcast at a time. A larger cascade goes in several shards: pages, then only ids and hashes, pass once for each.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case, with port and user if there are any. Keys of a
page: its host and each domain over it of at most 253 characters, which is what a domain name can have, and the address, `=`, host and path together.
Null urls and those without `://` have no host, path or keys and are allowed. Very long urls are read whole. Repeated rows come out one by one. Columns other
than page_id and url are not looked at, whatever their names. An empty table gives an empty result, an empty list blocks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, MIX, UPPER, dropped, mixed, read_table, written

#: action, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Own list of the query: domains that begin with one of these labels, and addresses with less html than this.
JUNK_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
THIN_CHARS = 1000
FILTER_BYTES, PART_KEYS, DOMAIN_CHARS = 64 << 20, 1 << 16, 253
#: Two keys that share both hashes, one of them listed, would never be told apart.
MOST_LEVELS = 200
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
LOW = np.uint64(0xFFFFFFFF)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a host, or one over it, and the path's beginning, and what it says; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    action = F.coalesce(*[F.when(f, F.lit(a)) for f, (a, _, _) in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    return name, action


def domains_of(host: Column) -> Column:
    """The host and each domain over it, of those that are no longer than a domain name can be."""
    cut = F.char_length(host) > DOMAIN_CHARS + 1
    tail = F.when(cut, F.substring(host, -(DOMAIN_CHARS + 1), DOMAIN_CHARS + 1)).otherwise(host)
    labels = F.split(tail, "\\.")
    whole = F.size(labels) - cut.cast("int")  # a cut tail begins within a label or with its dot
    every = F.when((host != "") & (whole > 0), F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.array_join(F.slice(labels, -i, i), "."))


def address_of(host: Column, path: Column) -> Column:
    return F.concat(F.lit("="), host, path)


def keys_of(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(domains_of(host), F.array(address_of(host, path)))).otherwise(F.array().cast("array<string>"))


def places(a: np.ndarray, b: np.ndarray, level: int, probes: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of keys with hashes (a, b) in a level of `sizes` bits."""
    with np.errstate(over="ignore"):
        h = mixed(mixed(a + MIX * np.uint64(level + 1)) ^ b)
        for i in range(probes):
            yield (((h + np.uint64(i) * (h >> np.uint64(32))) & LOW) * sizes >> np.uint64(32)).astype(np.int64)


def first_probes(listed: int, others: int) -> int:
    """Probes of the first level: it should let a share of listed / (others * sqrt 2) through."""
    return max(1, round(math.log2(max(2.0, math.sqrt(2) * others / max(1, listed)))))


def cascade_of(a: np.ndarray, b: np.ndarray, listed: np.ndarray, probes: int) -> list[bytes]:
    """The levels' bits."""
    levels: list[bytes] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed key and another one share both hashes")
        k = 1 if levels else probes
        size = 8 * math.ceil(k * len(inside) / math.log(2) / 8)
        bits = np.zeros(size, bool)
        for place in places(a[inside], b[inside], len(levels), k, np.uint64(size)):
            bits[place] = True
        passed = np.ones(len(outside), bool)
        for place in places(a[outside], b[outside], len(levels), k, np.uint64(size)):
            passed &= bits[place]
        levels.append(np.packbits(bits, bitorder="little").tobytes())
        inside, outside = outside[passed], inside
    return levels


def build_cascade(universe: DataFrame) -> tuple[DataFrame, int, int]:
    """universe: key, listed. The finished parts (part, levels, size), the number of parts and the first level's probes."""
    hashes = (F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), F.col("key")).alias("b"))
    keys = written(universe.groupBy("key").agg(F.max("listed").alias("listed")).select(*hashes, "listed"))
    n, listed = keys.agg(F.count("*"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    # A small table is dealt as well, over up to 256 parts.
    parts = max(1, math.ceil(n / PART_KEYS), min(256, math.ceil(n / 256)))
    probes = first_probes(listed, n - listed)

    def finish(part: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, flags = map(np.concatenate, zip(*held, strict=True))
        levels = cascade_of(a.view(np.uint64), b.view(np.uint64), flags, probes)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([levels], pa.list_(pa.binary())), pa.array([sum(map(len, levels))], pa.int64())], names=["part", "levels", "size"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for start, end in zip(at, [*at[1:], len(part)], strict=True):
                if part[start] != now and held:
                    yield finish(now, held)
                    held = []
                now = part[start]
                held.append(tuple(np.array(c[start:end]) for c in columns))
        if held:
            yield finish(now, held)

    dealt = keys.select(F.pmod("a", F.lit(parts)).alias("part"), "a", "b", "listed").repartition("part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(build, "part long, levels array<binary>, size long")), parts, probes


class Shard:
    """The parts whose number leaves `shard` over when divided by `shards`."""

    def __init__(self, rows: list, parts: int, shards: int, shard: int, probes: int):
        self.parts, self.shards, self.shard, self.probes = parts, shards, shard, probes
        depth = max((len(levels) for _, levels in rows), default=0)
        self.sizes, self.starts = (np.zeros((math.ceil(parts / shards), depth + 1), np.int64) for _ in range(2))
        at = 0
        for part, levels in rows:
            for i, bits in enumerate(levels):
                self.sizes[part // shards, i], self.starts[part // shards, i] = 8 * len(bits), 8 * at
                at += len(bits)
        self.bytes = np.frombuffer(b"".join(bits for _, levels in rows for bits in levels) or b"\0", np.uint8)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed; keys of other shards are not."""
        out = np.zeros(len(a), bool)
        part = a.view(np.int64) % self.parts
        left = np.flatnonzero(part % self.shards == self.shard)
        for level in range(self.sizes.shape[1]):
            own = part[left] // self.shards
            sizes, starts = self.sizes[own, level], self.starts[own, level]
            passed = sizes > 0
            for place in places(a[left], b[left], level, 1 if level else self.probes, sizes.astype(np.uint64)):
                at = np.where(passed, starts + place, 0)
                passed &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            out[left[~passed]] = level % 2 == 1
            left = left[passed]
        return out


def with_membership(rows: DataFrame, parts_table: DataFrame, parts: int, probes: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """rows with arrays `a` and `b` of the hashes of their keys; these are replaced by `listed`, whether any of the keys is."""
    size = parts_table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / filter_bytes))
    while shards < parts and parts_table.groupBy((F.col("part") % shards).alias("s")).agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] > filter_bytes:
        shards += math.ceil(shards / 4)
    spark, others = rows.sparkSession, [c for c in rows.columns if c not in ("a", "b")]
    now = rows.withColumn("listed", F.lit(False))
    schema = now.select(*others, "a", "b", "listed").schema
    last = None
    for shard in range(shards):
        found = parts_table.where(F.col("part") % shards == shard).select("part", "levels").collect()  # at most filter_bytes
        sent = spark.sparkContext.broadcast(([(r.part, [bytes(x) for x in r.levels]) for r in found], parts, shards, shard, probes))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            filters = Shard(*sent.value)
            for batch in batches:
                *rest, a, b, before = batch.columns
                ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(a).to_numpy(zero_copy_only=False))]).astype(np.int64)
                hit = np.concatenate([[0], np.cumsum(filters.listed(*(x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))))])
                listed = before.to_numpy(zero_copy_only=False) | (hit[ends[1:]] > hit[ends[:-1]])
                yield pa.RecordBatch.from_arrays([*rest, a, b, pa.array(listed, pa.bool_())], names=batch.schema.names)

        now = now.select(*others, "a", "b", "listed").mapInArrow(probe, schema)
        if shards > 1:
            now = written(now)
            if last is not None:
                dropped(last)
            last = now
    return now.select(*others, "listed")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, listed (whether the cascade lists one of its keys) and verdict of each row of pages; listed: a table of keys."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = cut.select(F.explode(keys_of(F.col("host"), F.col("path"))).alias("key"))
    universe = keys.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")).where("key IS NOT NULL"))
    table, parts, probes = build_cascade(universe)
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = cut.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), keys_of(F.col("host"), F.col("path")).alias("keys"))
    hashed = rows.select("page_id", "host", "path", "rule", "action", F.transform("keys", lambda k: F.xxhash64(k)).alias("a"), F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)).alias("b"))
    met = with_membership(hashed, table, parts, probes, filter_bytes)
    verdict = F.coalesce("action", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return met.select("page_id", "host", "path", "rule", "listed", verdict.alias("verdict"))


def junk_keys(pages: DataFrame) -> DataFrame:
    """key: domains of the pages that begin with a junk label, and addresses that some page has with little html."""
    cut = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.coalesce(F.char_length("html"), F.lit(0)) < THIN_CHARS).alias("thin"))
    domains = F.filter(domains_of(F.col("host")), lambda d: F.substring_index(d, ".", 1).isin(*JUNK_LABELS))
    thin = F.when(F.col("thin") & (F.col("host") != ""), F.array(address_of(F.col("host"), F.col("path")))).otherwise(F.array().cast("array<string>"))
    return cut.select(F.explode(F.concat(domains, thin)).alias("key")).distinct()


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge_urls(pages, junk_keys(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_url_filter": op13_url_filter}

_RULES = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, a) for a, h, p in _RULES]
_JUNK = ", ".join(f"'{x}'" for x in JUNK_LABELS)
SQL = {
    "op13_url_filter": f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path, coalesce(length(html), 0) < {THIN_CHARS} AS thin FROM pages),
t AS (SELECT DISTINCT host, path FROM p WHERE thin AND host <> ''),
r AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in _FITS)} END AS rule, CASE {" ".join(f"WHEN {c} THEN '{a}'" for c, _, a in _FITS)} END AS action,
      list_has_any(string_split(host, '.'), [{_JUNK}]) OR (host, path) IN (SELECT (host, path) FROM t) AS listed FROM p)
SELECT page_id, host, path, rule, listed, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM r"""
}
