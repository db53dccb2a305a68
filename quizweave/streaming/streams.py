"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calls import KeyState
from ..operators.current import CurrentMerge
from ..operators.joins import align_results
from ..operators.relevance import dedupe_links, top_links


def stream_progress(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """results (job_id, chunk_no, ts) to the finished chunks of each job; a chunk that comes again counts once."""
    once = results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "chunk_no"])
    return once.groupBy("job_id").agg(F.count("*").alias("done"))


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Percent, at most 100, and whether all chunks are in."""
    met = totals.join(done, "job_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    percent = F.least(F.lit(100), F.floor(F.col("done") * 100 / F.greatest(F.lit(1), F.col("total"))))
    return met.select("job_id", "done", "total", percent.cast("long").alias("percent"), (F.col("done") >= F.col("total")).alias("finished"))


def stream_outcomes(expected: DataFrame, results: DataFrame, wait: str = "1 hour") -> DataFrame:
    """What became of each task as soon as it is certain: job_id, task, sent, error (null, `failed` or `No result`).

    expected: job_id, task, sent; results: job_id, task, failed, ts. A result counts if it comes from the time at which its task was sent up to `wait`
    after it; of those that come again within that time the first does. A task without one is `No result` once all that is
    out reaches two waits beyond its time: one for results, one for events out of order. Both sides are kept no longer than that.
    """
    asked = expected.withWatermark("sent", wait).alias("e")
    came = results.withWatermark("ts", wait).dropDuplicatesWithinWatermark(["job_id", "task"]).withColumn("there", F.lit(True)).alias("r")
    in_time = F.expr(f"e.job_id = r.job_id AND e.task = r.task AND r.ts >= e.sent AND r.ts <= e.sent + INTERVAL {wait}")
    error = F.when(F.col("there").isNull(), "No result").when(F.col("failed"), "failed")
    return asked.join(came, in_time, "left_outer").select("e.job_id", "e.task", "sent", error.alias("error"))


def settled(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The outcome of every task of expected (job_id, task) once nothing more can come: those that aren't out yet have no result."""
    came = outcomes.where("error IS NULL OR error <> 'No result'").select("job_id", "task", F.col("error").isNotNull().alias("failed"))
    return align_results(expected, came)


KEY_STATE = "key_id long, failures long, cooldown_until timestamp_ntz"
KEY_HEALTH = "event_id long, key_id long, ts timestamp_ntz, action string, failures long, cooldown_until timestamp_ntz"


def replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Calls in order of key and time to what became of them, frame by frame; of a key only its two state values are held."""
    now, keeper = None, KeyState()
    for frame in frames:
        actions, failures, until = [], [], []
        for no_key, key, ts, ok, had, had_until in zip(frame["no_key"], frame["key"], frame["ts"], frame["ok"], frame["had"], frame["had_until"], strict=True):
            if (no_key, key) != now:
                now, keeper = (no_key, key), KeyState(int(had), None if pd.isna(had_until) else had_until)
            actions.append(keeper.call(ts, bool(ok)))
            failures.append(keeper.failures)
            until.append(keeper.until)
        yield pd.DataFrame({"event_id": frame["event_id"], "key_id": frame["key"].astype("Int64").mask(frame["no_key"]), "ts": frame["ts"], "action": actions, "failures": failures, "cooldown_until": pd.Series(until, dtype="datetime64[ns]", index=frame.index)})


def stream_key_health(calls: DataFrame, table: str):
    """A writer of each call with what became of it, as `key_cooldown_replay` says, to Parquet at `table`/out (read by
    `key_health`); a micro-batch holds calls later than those before it.

    Spark sorts a micro-batch by key and time, on disk where it is large, so no key's rows are held in Python. The states
    after each batch lie beside its rows; a batch that comes again starts from those before it and gives the same rows.
    """
    spark = calls.sparkSession
    for part, schema in (("state", KEY_STATE), ("out", KEY_HEALTH)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/{part}/batch=-1")

    def replay(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(KEY_STATE).parquet(f"{table}/state/batch={batch_id - 1}")
        had = state.select(F.col("key_id").alias("had_key"), F.col("failures").alias("had"), F.col("cooldown_until").alias("had_until"))
        rows = batch.join(had, F.col("key_id").eqNullSafe(F.col("had_key")), "left")
        rows = rows.select("event_id", F.col("key_id").isNull().alias("no_key"), F.coalesce("key_id", F.lit(0)).cast("long").alias("key"), "ts", "ok", F.coalesce("had", F.lit(0)).alias("had"), "had_until")
        rows = rows.repartition("no_key", "key").sortWithinPartitions("no_key", "key", "ts", "event_id")
        rows.mapInPandas(replayed, KEY_HEALTH).write.mode("overwrite").parquet(f"{table}/out/batch={batch_id}")
        done = spark.read.schema(KEY_HEALTH).parquet(f"{table}/out/batch={batch_id}")
        last = done.groupBy("key_id").agg(F.max_by(F.struct("failures", "cooldown_until"), F.struct("ts", "event_id")).alias("s")).select("key_id", "s.failures", "s.cooldown_until")
        rest = state.join(last.select(F.col("key_id").alias("had_key")), F.col("key_id").eqNullSafe(F.col("had_key")), "left_anti")
        last.unionByName(rest).write.mode("overwrite").parquet(f"{table}/state/batch={batch_id}")

    return calls.select("event_id", "key_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "ok").writeStream.outputMode("append").foreachBatch(replay)


def key_health(spark, table: str) -> DataFrame:
    return spark.read.schema(KEY_HEALTH).parquet(f"{table}/out/*").select("event_id", "key_id", "action", "failures")


def stream_expiry(touches: DataFrame, ttl: str, delay: str = "1 hour") -> DataFrame:
    """touches (session_id, ts): a session window ends where no touch came for the time to live; its end is the expiry."""
    windows = touches.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("touches"))
    return windows.select("session_id", F.col("w.start").alias("first_touch"), F.col("w.end").alias("expires_at"), "touches")


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions of a table that are written to their end, ascending."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [v for v in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/v{v}/_SUCCESS"))]


def stream_top_links(links: DataFrame, table: str, k: int = 2, min_score: int = 50):
    """A writer that keeps the k best links of each question in Parquet tables under `table`, read by `current_top_links`.

    Each batch writes a new version from the newest one before it, which stays for those who read it; older ones are
    deleted. A batch that comes again starts from the same version and gives the same rows.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in versions(spark, table) if v < batch_id]
        # what is under the score can't be the best of its page and reach it
        rows = batch.select("item_id", "lecture_id", "page_no", "score").where(F.coalesce("score", F.lit(0)) >= min_score)
        if earlier:
            rows = rows.unionByName(spark.read.parquet(f"{table}/v{earlier[-1]}").select(*rows.columns))
        top_links(dedupe_links(rows), min_score, k).drop("rank").withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/v{batch_id}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for v in earlier[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/v{v}"), True)

    return links.writeStream.outputMode("append").foreachBatch(merge)


def current_top_links(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/v{versions(spark, table)[-1]}").drop("version")


def stream_merge(results: DataFrame, current: CurrentMerge):
    """A writer that adds each batch of results to the merged questions; a batch that comes again counts once."""
    return results.writeStream.outputMode("append").foreachBatch(lambda batch, batch_id: current.add(batch, f"batch {batch_id}") and None)


def drop_cancelled(stream: DataFrame, cancels: DataFrame) -> DataFrame:
    return stream.join(cancels.select("job_id"), "job_id", "left_anti")


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a Parquet table, or for updates into memory; returns the rows."""
    spark = stream.sparkSession
    name = f"quizweave_{uuid.uuid4().hex[:12]}"
    writer = stream.writeStream.option("checkpointLocation", f"{checkpoint}/{name}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{checkpoint}/{name}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{checkpoint}/{name}/out")
    # complete results: the rows of the last batch that had any
    writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{checkpoint}/{name}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{checkpoint}/{name}/out")
