"""Analytics over call logs (event_id, ts, key_id, request_id, attempt, ok, error, finish_reason)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_seconds

FAILURES, COOLDOWN_MINUTES, MOST = 3, 10, 3
REPLAY = "event_id long, key_id long, ts timestamp_ntz, action string, failures long, cooldown_until timestamp_ntz"


def stretch_runs(calls: DataFrame, stretch: str = "HOUR") -> DataFrame:
    """Runs of calls of one kind within each stretch of time of a key: n, first and last call, the first and the last three times, and
    whether the run begins and ends with the stretch. A run over several stretches comes in pieces, which `call_runs` puts together."""
    cut = calls.withColumn("stretch", F.date_trunc(stretch, "ts"))
    by_time = Window.partitionBy("key_id", "stretch").orderBy("ts", "event_id")
    by_kind = Window.partitionBy("key_id", "stretch", "ok").orderBy("ts", "event_id")
    placed = cut.select("key_id", "stretch", "ok", "ts", "event_id", F.row_number().over(by_time).alias("rn"), F.lead("ts").over(by_time).isNull().alias("final"), (F.row_number().over(by_time) - F.row_number().over(by_kind)).alias("island"))
    in_run = Window.partitionBy("key_id", "stretch", "ok", "island").orderBy("ts", "event_id")
    near = lambda f: F.array(F.col("ts"), f("ts", 1).over(in_run), f("ts", 2).over(in_run))
    near_ts = placed.withColumn("head", near(F.lead)).withColumn("tail", near(F.lag))
    at = F.struct("ts", "event_id")
    return near_ts.groupBy("key_id", "stretch", "ok", "island").agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.min_by("head", at).alias("head"), F.max_by("tail", at).alias("tail"), (F.min("rn") == 1).alias("starts"), F.max("final").alias("ends")
    ).drop("island")


def call_runs(calls: DataFrame) -> DataFrame:
    """Runs of calls of one kind of each key: key_id, ok, n, first, last, third (time of the third call) and last_third (of the last whose place in the run three divides).

    Runs are found in each key's hours apart, so five keys keep all tasks busy. Only pieces at the border of an hour, two an hour at most, are
    brought together by key: a piece goes on with the one before it if both are of one kind and nothing lies between.
    """
    pieces = stretch_runs(calls)
    by_key = Window.partitionBy("key_id").orderBy("stretch", "first")
    border = pieces.where("starts OR ends")
    goes_on = F.col("starts") & (F.lag("ok").over(by_key) == F.col("ok")) & F.lag("ends").over(by_key)
    chained = border.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(by_key)).drop("new")
    run = Window.partitionBy("key_id", "run")
    before = F.coalesce(F.sum("n").over(run.orderBy("stretch", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = chained.withColumn("before", before).withColumn("total", F.sum("n").over(run))
    closed = pieces.where("NOT starts AND NOT ends").select("*", F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("before"), F.col("n").alias("total"))
    whole = F.floor(F.col("total") / FAILURES) * FAILURES
    through = F.col("before") + F.col("n")
    third = F.when((F.col("before") < FAILURES) & (through >= FAILURES), F.get("head", FAILURES - 1 - F.col("before").cast("int")))
    last_third = F.when((F.col("before") < whole) & (through >= whole), F.get("tail", (through - whole).cast("int")))
    columns = ("key_id", "ok", "run", "n", "first", "last", third.alias("third"), last_third.alias("last_third"))
    joined = counted.select(*columns).groupBy("key_id", "ok", "run").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("third").alias("third"), F.max("last_third").alias("last_third"))
    return joined.unionByName(closed.select(*columns)).drop("run")


def key_status(calls: DataFrame, as_of: Column) -> DataFrame:
    """Per key at a moment: requests and failures so far, success rate, failures in a row, the error of the last call if it failed, and
    whether the key may be called. Each third failure in a row starts a cooldown of ten minutes, after which they are counted anew.

    The log is one of calls that were made: all of them count, those within a cooldown too.
    """
    past = calls.where(F.col("ts") <= as_of)
    sums = past.groupBy("key_id").agg(F.count("*").alias("requests"), F.sum((~F.col("ok")).cast("long")).alias("failures"), F.max_by("error", F.struct("ts", "event_id")).alias("error"), F.max("ts").alias("last_used"))
    until = F.max(F.when(~F.col("ok"), F.col("last_third"))) + F.expr(f"INTERVAL '{COOLDOWN_MINUTES}' MINUTE")
    runs = call_runs(past).groupBy("key_id").agg(F.max_by(F.struct("ok", "n"), "last").alias("run"), until.alias("until"))
    out = sums.join(runs.withColumnRenamed("key_id", "run_key"), F.col("key_id").eqNullSafe(F.col("run_key"))).withColumn("cooldown_until", F.when(F.col("until") > as_of, F.col("until"))).withColumn("available", F.col("cooldown_until").isNull())
    row = F.col("run.n") % FAILURES
    in_a_row = F.when(F.col("run.ok") | ((row == 0) & F.col("available")), 0).when(row == 0, FAILURES).otherwise(row)
    return out.select(
        "key_id", "requests", "failures", F.round((F.col("requests") - F.col("failures")) / F.col("requests"), 6).alias("success_rate"), in_a_row.cast("long").alias("in_a_row"),
        F.when(~F.col("run.ok"), F.col("error")).alias("last_error"), "last_used", "cooldown_until", "available",
    )


def key_totals(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("available").cast("long")), F.lit(0)).alias("available"))


def failure_streaks(calls: DataFrame) -> DataFrame:
    """Runs of failures of a key: length, first and last call, and from the third failure a cooldown of ten minutes."""
    until = F.col("third") + F.expr(f"INTERVAL '{COOLDOWN_MINUTES}' MINUTE")
    runs = call_runs(calls).where(~F.col("ok"))
    return runs.select("key_id", F.col("n").alias("failures"), F.col("first.ts").alias("first_ts"), F.col("last.ts").alias("last_ts"), (F.col("n") >= FAILURES).alias("cooldown"), until.alias("cooldown_until"))


def retry_ledger(calls: DataFrame) -> DataFrame:
    """Per request: attempts up to the first success or the third failure, seconds waited between them, and the outcome."""
    order = Window.partitionBy("request_id").orderBy("attempt", "event_id")
    tried = calls.withColumn("n", F.row_number().over(order)).withColumn("won_before", F.coalesce(F.max(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = tried.where((F.col("won_before") == 0) & (F.col("n") <= MOST))
    wait = F.when(~F.col("ok"), F.coalesce(backoff_seconds(F.col("n") - 1, MOST), F.lit(0))).otherwise(0)
    return used.groupBy("request_id").agg(F.count("*").alias("attempts"), F.sum(wait).cast("long").alias("waited"), F.when(F.max(F.col("ok").cast("int")) == 1, "success").otherwise("failed").alias("outcome"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("n"))).alias("last_error"))


def round_robin(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests (job_id, request_id) dealt in turn to the available keys of keys (key_id), each job from the first."""
    ranked = keys.select("key_id", (F.row_number().over(Window.orderBy("key_id")) - 1).alias("slot"))  # a row for each key
    n = keys.agg(F.count("*").alias("n_keys"))
    turn = requests.withColumn("turn", F.row_number().over(Window.partitionBy("job_id").orderBy("request_id")) - 1)
    return turn.crossJoin(F.broadcast(n)).withColumn("slot", F.pmod("turn", "n_keys")).join(ranked, "slot").select("job_id", "request_id", "key_id")


def best_key(status: DataFrame) -> DataFrame:
    """The key of highest success rate, then fewest requests, then least id."""
    return status.agg(F.min_by("key_id", F.struct(-F.col("success_rate"), F.col("requests"), F.col("key_id"))).alias("key_id"))


class KeyState:
    """Failures in a row and the end of a cooldown; times are pandas timestamps."""

    def __init__(self, failures: int = 0, until: pd.Timestamp | None = None):
        self.failures, self.until = failures, until

    def call(self, ts: pd.Timestamp, ok: bool) -> str:
        """What becomes of a call: skipped in a cooldown, else it counts."""
        if self.until is not None:
            if ts < self.until:
                return "skipped"
            self.failures, self.until = 0, None
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= FAILURES:
            self.until = ts + pd.Timedelta(minutes=COOLDOWN_MINUTES)
            return "cooldown"
        return "ok" if ok else "failed"


def key_cooldown_replay(calls: DataFrame) -> DataFrame:
    """Each call with what became of it. The state depends on all earlier calls of the key, so a key streams through one
    task in time order, without being held there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, KeyState()
        for frame in frames:
            actions, failures, until = [], [], []
            for key, ts, ok in zip(frame["key_id"], frame["ts"], frame["ok"], strict=True):
                if key != now:
                    now, state = key, KeyState()
                actions.append(state.call(ts, bool(ok)))
                failures.append(state.failures)
                until.append(state.until)
            yield pd.DataFrame({"event_id": frame["event_id"], "key_id": frame["key_id"], "ts": frame["ts"], "action": actions, "failures": failures, "cooldown_until": pd.Series(until, dtype="datetime64[ns]", index=frame.index)})

    rows = calls.select("event_id", "key_id", "ts", "ok").repartition("key_id").sortWithinPartitions("key_id", "ts", "event_id")
    return rows.mapInPandas(run, REPLAY)


def outcome_counts(calls: DataFrame) -> DataFrame:
    """Per key and in total (null key): done, skipped (403) and failed."""
    skipped = F.coalesce(F.col("error").contains("403"), F.lit(False))
    return calls.rollup("key_id").agg(F.sum(F.col("ok").cast("long")).alias("done"), F.sum(skipped.cast("long")).alias("skipped"), F.sum((~F.col("ok") & ~skipped).cast("long")).alias("failed"))
