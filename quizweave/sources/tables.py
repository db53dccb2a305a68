"""Readers. Every reader gives a lazy DataFrame; unreadable records become rows that say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import is_valid_pdf_name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files with acceptable names, without download markers; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(is_valid_pdf_name(F.col("name")) & ~F.col("name").contains(".Zone.Identifier"))


def pages_of(docs: DataFrame) -> DataFrame:
    """Each line of a text document is a page, from 1; an empty or null text is one empty page."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return docs.select(F.col("doc_id").alias("lecture_id"), F.posexplode(lines).alias("pos", "page_text")).select(
        "lecture_id", F.concat(F.lit("lec_"), F.col("lecture_id"), F.lit(".pdf")).alias("lecture_name"), (F.col("pos") + 1).cast("long").alias("page_no"), "page_text"
    )


def page_stats(pages: DataFrame) -> DataFrame:
    return pages.select("lecture_id", "page_no", (F.length("page_text") > 0).alias("has_text"), F.length("page_text").cast("long").alias("text_length"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("lecture_id", "lecture_name").agg(F.max("page_no").alias("page_count"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSE_LOG).option("multiLine", True).json(path)


def read_chunk_results(spark: SparkSession, folder: str) -> DataFrame:
    """Readable results without an error that hold pages, in order of the file names."""
    rows = spark.read.schema(schemas.CHUNK_RESULT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    rows = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return valid_results(rows).orderBy("file")


def valid_results(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_corrupt").isNull() & F.col("result.error").isNull() & F.col("result.exam_pages").isNotNull())


def read_session_states(spark: SparkSession, folder: str, sessions: DataFrame) -> DataFrame:
    """sessions (session_id) with their state: `no_state` where none is stored, `error` where it can't be read."""
    rows = spark.read.schema(schemas.SESSION_STATE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(folder)
    parts = F.split(F.input_file_name(), "/")
    rows = rows.withColumn("folder", F.element_at(parts, -2)).withColumn("state", F.when(F.col("_corrupt").isNotNull(), "error").otherwise(F.coalesce("status", F.lit("unknown"))))
    return sessions.join(rows.select(F.col("folder").alias("session_id"), "state", "mode", "total_lectures", "processed_lectures"), "session_id", "left").withColumn("state", F.coalesce("state", F.lit("no_state")))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOB).json(path)


def job_files(jobs: DataFrame) -> DataFrame:
    """One row for each file of a job; its name is the last part but one of the key."""
    keys = jobs.select("job_id", F.explode(F.concat("exam_keys", "lecture_keys")).alias("key"))
    return keys.select("job_id", "key", F.try_element_at(F.split("key", ":"), F.lit(-2)).alias("file_name"))
