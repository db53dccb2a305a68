"""Line dedup with DataFrame functions only.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Keys of at least
`min_chars` code points that occur in at least `min_docs` distinct documents, by doc_id, lose all their lines.

Null or empty text: one empty line. An empty table: an empty result. Rows of one doc_id count as one document and come out one
by one; rows without a doc_id count for none, but lose lines as others do. Very long texts are split whole. Columns other than
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read_table, written

WHITE = " \t\n\x0b\x0c\r"
#: So many keys of 16 bytes are broadcast at most; beyond it the join shuffles.
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits as text."""
    return F.unhex(F.md5(key))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, for each row of docs.

    Only doc_ids and 16-byte hashes of the distinct lines of each row are shuffled, by both together, then counts summed before the next
    shuffle, so a line in a third of all documents is spread over all tasks. Texts move once, to meet the few hashes they lose.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Equal rows share one key and one answer.
    rows = rows.withColumn("row_key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))))
    lines = F.split("text", "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars))
    exploded = rows.select("row_key", "doc_id", F.explode(keys).alias("key")).select("row_key", "doc_id", key_hash(F.col("key")).alias("hash"))
    spread = written(exploded.groupBy("hash").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docs).select("hash"))
    if spread.count() <= BROADCAST_KEYS:
        spread = F.broadcast(spread)
    lost = exploded.join(spread, "hash", "left_semi").groupBy("row_key").agg(F.collect_set("hash").alias("lost"))
    kept = F.filter("lines", lambda line: ~F.coalesce(F.array_contains(F.col("lost"), key_hash(line_key(line))), F.lit(False)))
    return (
        rows.join(lost, "row_key", "left")
        .select("doc_id", "lost", lines.alias("lines"))
        .select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), F.col("lines")).otherwise(kept).alias("left_lines"))
        .select("doc_id", "n_lines", (F.col("n_lines") - F.size("left_lines")).cast("long").alias("n_dropped"), F.array_join("left_lines", "\n").alias("kept_text"))
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_line_dedup": op8_line_dedup}

SQL = {
    "op8_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM k GROUP BY doc_id"""
}
