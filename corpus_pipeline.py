"""A training-data pipeline over `documents`: toxicity, near-dedup, benchmark decontamination, mixing, token files.

Each stage is written as Parquet in the shared folder and read again by the next. All but the last return the columns of
documents, more than the usual ones too, whatever their names. Null, empty, repeated and very long texts and ties: as the operators
say. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizweave.llm.common import free_name, read_table, written
from quizweave.llm.decontaminate import ITEMS, N_WORDS, SPANS, annotate_overlaps
from quizweave.llm.mixing import mix
from quizweave.llm.near_dups import with_classes
from quizweave.llm.token_files import read_tokens, write_tokens
from quizweave.llm.toxicity import SCORE, THRESHOLD, fit_toxicity, may_learn, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold."""
    net = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), may_learn())
    score = free_name(docs, SCORE)
    return score_toxicity(docs, net, score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked at five words and 0.8: that of least doc_id, among texts of one doc_id that of least
    hash. Rows without words or without a doc_id stay."""
    key, doc_id, text_key = free_name(docs, "row_key"), free_name(docs, "kept_id"), free_name(docs, "kept_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    rows = written(with_classes(keyed, 5, 80, key))
    linked = rows.where("component IS NOT NULL")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select("r.*", F.lit(True).alias("once"))
    others = rows.where("component IS NULL AND doc_id IS NOT NULL").select("doc_id", "row_key", F.lit(False).alias("once")).distinct()
    once = free_name(docs, "once")
    kept = first.unionByName(others).toDF(doc_id, text_key, once)
    out = keyed.join(kept, (F.col("doc_id") == F.col(doc_id)) & (F.col(key) == F.col(text_key)))
    if not linked.groupBy("component", "doc_id", "row_key").count().where("count > 1").isEmpty():  # equal rows
        out = out.where(~F.col(once)).unionByName(out.where(once).dropDuplicates([doc_id, text_key]))
    return out.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    names = tuple(free_name(docs, name) for name in (N_WORDS, SPANS, ITEMS))
    return annotate_overlaps(docs, read_table(spark, sf_dir, "benchmark"), names=names).where(F.size(names[1]) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs as often as their source's budget says."""
    return mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row's ids lie in the token files, read back from these."""
    # fewer pieces than by itself, as workers hold the word tables of other stages too
    return read_tokens(write_tokens(docs, most_pieces=500_000))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_ids", encode_tokens)]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
