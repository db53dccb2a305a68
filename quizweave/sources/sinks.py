"""Writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where none is set."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def staged(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again, so that several uses compute it once; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quizweave_{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Deletes what `staged` wrote, once nothing that is still to run reads it."""
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_chunk_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Appends results by session, so that a run can go on after a stop."""
    df.write.partitionBy("session_id").mode("append").format(kind).save(path)


def write_session_state(df: DataFrame, path: str) -> None:
    """Replaces the states of the sessions in df and no others."""
    df.write.partitionBy("session_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_study_pages(df: DataFrame, path: str) -> None:
    """One folder for each output, its rows in order of seq within each file."""
    df.repartition("output_name").sortWithinPartitions("output_name", "seq").write.partitionBy("output_name").mode("overwrite").parquet(path)


def manifest(outputs: DataFrame) -> DataFrame:
    """outputs (job_id, output_name) to the outputs of each job."""
    return outputs.groupBy("job_id").agg(F.count("*").alias("n_outputs"), F.array_join(F.array_sort(F.collect_set("output_name")), ",").alias("outputs"))


def write_manifest(df: DataFrame, path: str) -> None:
    manifest(df).write.mode("overwrite").json(path)
