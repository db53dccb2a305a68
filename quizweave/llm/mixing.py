"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing: a source's weight is its share of all words to the power of an exponent, normalised. An exponent under 1
makes sources more even, one over 1 less. Entropy only falls as the exponent grows, so it is bisected in [0, `MOST_EXPONENT`] to the largest
one at which the entropy of the weights reaches `target_entropy` of the most possible; sources that all have the same share keep it at any exponent. If
then a source would have to be repeated more than `max_repeats` times, the exponent is bisected anew, towards 1, to the nearest one that holds the
limit. A target of 0 asks for nothing: all stays as it is. Weights become word budgets. A source's budget is met by whole epochs and a part of one more; for that part its
documents lie in blocks, blocks are permuted by a keyed hash, so are the documents of each block, and documents are taken
that begin within the budget. Prefix sums go over blocks first and inside each block then, so a source that holds a third
of all rows is spread over all tasks.

Documents without words cost nothing and are not taken. A null source is a source. Equal rows are mixed one by one. With
no words at all nothing is taken. Documents of one source and hash lie by doc_id and row key. Very long texts count whole; one may
begin within a budget and end beyond it. Other columns stay as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, read_table, written

TARGET_ENTROPY, MAX_REPEATS, BLOCK_DOCS, SEED = 0.97, 4.0, 1024, 17
MOST_EXPONENT = 64.0
#: Halvings of the exponent's range, and how many of them one look at the sources settles.
HALVINGS, AT_ONCE = 24, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def keyed(*parts: Column | str) -> Column:
    """60 bits of a hash of the seed and the parts."""
    joined = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def bisect(sources: DataFrame, holds: Callable[[float], Column], rising: bool, least: float, most: float) -> float:
    """The edge in [least, most] of where an aggregate over sources holds: it does below the edge, or with `rising` above it.

    One look tries the points of AT_ONCE halvings; only truth values come to the driver.
    """
    place = lambda p: least + (most - least) * p / (1 << HALVINGS)
    low, high = 0, 1 << HALVINGS
    for _ in range(HALVINGS // AT_ONCE):
        step = (high - low) >> AT_ONCE
        points = [low + step * i for i in range(1, 1 << AT_ONCE)]
        row = sources.agg(*[holds(place(p)).alias(f"p{i}") for i, p in enumerate(points)]).first()
        for point, yes in zip(points, row, strict=True):
            if bool(yes) != rising:
                low = point
            else:
                high = point
                break
    return place(high if rising else low)


def fit_exponent(sources: DataFrame, target_entropy: float, max_repeats: float) -> float:
    """sources: key, words (over 0), share, part (its share of the greatest share, whose powers don't all vanish)."""
    n = sources.count()
    if n < 2 or target_entropy <= 0:
        return 1.0

    def entropy_reached(a: float) -> Column:
        power, log = F.pow("part", F.lit(a)), F.lit(a) * F.log("part")
        return F.log(F.sum(power)) - F.sum(power * log) / F.sum(power) >= F.lit(target_entropy) * F.log(F.lit(float(n)))

    def limit_held(a: float) -> Column:
        power = F.pow("part", F.lit(a))
        return F.max(power / F.col("share")) / F.sum(power) <= F.lit(max_repeats)

    exponent = bisect(sources, entropy_reached, False, 0.0, MOST_EXPONENT)
    if not sources.agg(limit_held(exponent)).first()[0]:
        exponent = bisect(sources, limit_held, True, 0.0, 1.0) if exponent < 1 else bisect(sources, limit_held, False, 1.0, MOST_EXPONENT)
    return exponent


def plan_mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, row_key, n_words, block, before (words of its source before it in the last epoch's order), copies of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row_key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))
    rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), row_key.alias("row_key"), word_count(F.col("text")).alias("n_words")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("key")
    rows = rows.select("*", key)
    sums = rows.where("n_words > 0").groupBy("key").agg(F.sum("n_words").alias("words"), F.count("*").alias("docs"))
    total, greatest = (x or 1 for x in sums.agg(F.sum("words"), F.max("words")).first())
    sources = written(sums.select("*", (F.col("words") / F.lit(float(total))).alias("share"), (F.col("words") / F.lit(float(greatest))).alias("part")))
    exponent = fit_exponent(sources, target_entropy, max_repeats)
    scale = sources.agg(F.sum(F.pow("part", F.lit(exponent)))).first()[0] or 1.0
    budget = F.round(F.pow("part", F.lit(exponent)) / F.lit(scale) * F.lit(float(total))).cast("long")
    sources = sources.select("key", "words", budget.alias("budget"), F.ceil(F.col("docs") / F.lit(float(block_docs))).alias("blocks"))
    sources = sources.select("key", "blocks", F.expr("budget div words").alias("epochs"), F.expr("budget % words").alias("rest"))
    full = rows.where("n_words > 0").join(sources, "key").withColumn("block", F.pmod(keyed("block", F.col("doc_id")), F.col("blocks")))
    blocks = full.groupBy("key", "block").agg(F.sum("n_words").alias("words"))
    by_key = Window.partitionBy("key").orderBy(keyed("order", F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("words").over(by_key), F.lit(0)).alias("block_before"))
    in_block = Window.partitionBy("key", "block").orderBy(keyed("doc", F.col("doc_id")), "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_words").over(in_block), F.lit(0)) + F.col("block_before")
    taken = full.join(blocks, ["key", "block"]).withColumn("before", before)
    taken = taken.select("doc_id", "source", "row_key", "n_words", "block", "before", (F.col("epochs") + (F.col("before") < F.col("rest")).cast("long")).alias("copies"))
    none = rows.where("n_words = 0").select("doc_id", "source", "row_key", "n_words", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("copies"))
    return taken.unionByName(none)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the plan says. Equal rows get the most copies that one of them has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key, copies, copy = (free_name(docs, name) for name in ("mix_key", "mix_copies", "mix_copy"))
    plan = plan_mix(docs, **how).where("copies > 0").groupBy(F.col("row_key").alias(key)).agg(F.max("copies").alias(copies))
    row_key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))
    met = docs.withColumn(key, row_key).join(plan, key)
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_words", "block", "before", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_mix_sources": op10_mix_sources}

SQL = {
    "op10_mix_sources": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM documents),
s0 AS (SELECT source, sum(n_words)::BIGINT AS words, count(*) AS docs FROM d WHERE n_words > 0 GROUP BY source),
tot AS (SELECT sum(words)::BIGINT AS total, count(*) AS n, list(words / (SELECT sum(words)::DOUBLE FROM s0)) AS sh, list(words / (SELECT max(words)::DOUBLE FROM s0)) AS pt FROM s0),
ent(step, lo, hi, pt, n) AS (SELECT 0, 0.0::DOUBLE, {MOST_EXPONENT}::DOUBLE, pt, n FROM tot UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, pt, n FROM
  (SELECT *, (lo + hi) / 2 AS mid, ln(list_sum(list_transform(pt, lambda x: pow(x, (lo + hi) / 2)))) - list_sum(list_transform(pt, lambda x: pow(x, (lo + hi) / 2) * (lo + hi) / 2 * ln(x))) / list_sum(list_transform(pt, lambda x: pow(x, (lo + hi) / 2))) >= {TARGET_ENTROPY} * ln(n::DOUBLE) AS ok FROM ent WHERE step < {HALVINGS})),
e1 AS (SELECT CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE lo END AS a, pt, n FROM ent WHERE step = {HALVINGS}),
rep(step, side, lo, hi, sh, pt) AS (SELECT 0, side, CASE side WHEN 0 THEN 0.0 ELSE 1.0 END::DOUBLE, CASE side WHEN 0 THEN 1.0 ELSE {MOST_EXPONENT} END::DOUBLE, sh, pt FROM tot, (SELECT unnest([0, 1]) AS side) UNION ALL
  SELECT step + 1, side, CASE WHEN ok = (side = 1) THEN mid ELSE lo END, CASE WHEN ok = (side = 1) THEN hi ELSE mid END, sh, pt FROM
  (SELECT *, (lo + hi) / 2 AS mid, list_max(list_transform(sh, lambda x, i: pow(pt[i], (lo + hi) / 2) / x)) / list_sum(list_transform(pt, lambda x: pow(x, (lo + hi) / 2))) <= {MAX_REPEATS} AS ok FROM rep WHERE step < {HALVINGS})),
al AS (SELECT CASE WHEN list_max(list_transform(tot.sh, lambda x, i: pow(tot.pt[i], a) / x)) / list_sum(list_transform(tot.pt, lambda x: pow(x, a))) <= {MAX_REPEATS} THEN a
       WHEN a < 1 THEN (SELECT hi FROM rep WHERE step = {HALVINGS} AND side = 0) ELSE (SELECT lo FROM rep WHERE step = {HALVINGS} AND side = 1) END AS a FROM e1, tot),
s1 AS (SELECT source, words, docs, total, pow(words / (SELECT max(words)::DOUBLE FROM s0), a) AS p FROM s0, tot, al),
s2 AS (SELECT source, words, ceil(docs / {float(BLOCK_DOCS)})::BIGINT AS blocks, round(p / (SELECT sum(p) FROM s1) * total::DOUBLE)::BIGINT AS budget FROM s1),
f AS (SELECT d.*, ('0x' || substr(md5('{SEED}:block:' || doc_id), 1, 15))::BIGINT % blocks AS block, budget // words AS epochs, budget % words AS rest FROM d JOIN s2 ON d.source IS NOT DISTINCT FROM s2.source WHERE n_words > 0),
b AS (SELECT source, block, coalesce(sum(w) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('{SEED}:order:' || block), 1, 15))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bb
      FROM (SELECT source, block, sum(n_words) AS w FROM f GROUP BY ALL)),
g AS (SELECT f.doc_id, f.source, f.n_words, f.block, epochs, rest, (bb + coalesce(sum(n_words) OVER (PARTITION BY f.source, f.block ORDER BY ('0x' || substr(md5('{SEED}:doc:' || doc_id), 1, 15))::BIGINT, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
      FROM f JOIN b ON f.block = b.block AND f.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, n_words, block, before, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS copies FROM g
UNION ALL SELECT doc_id, source, n_words, 0, 0, 0 FROM d WHERE n_words = 0"""
}
