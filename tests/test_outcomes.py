"""Outcomes of tasks as they fall due, against the join over all that came."""

from datetime import datetime, timedelta

from quizweave.operators import joins
from quizweave.streaming import streams

ASKED, CAME = "job_id long, task long, sent timestamp", "job_id long, task long, failed boolean, ts timestamp"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


class Outcomes:
    """Both streams of a folder, run whenever something was added."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        for name in ("asked", "came"):
            (folder / name).mkdir()

    def add(self, asked=(), came=()):
        for name, rows, schema in (("asked", asked, ASKED), ("came", came, CAME)):
            if rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        asked, came = (self.spark.readStream.schema(s).parquet(f"{self.folder}/{n}") for n, s in (("asked", ASKED), ("came", CAME)))
        out = streams.stream_outcomes(asked, came, "1 hour").writeStream.option("checkpointLocation", f"{self.folder}/ck")
        out.trigger(availableNow=True).format("parquet").option("path", f"{self.folder}/out").start().awaitTermination()
        return self

    def rows(self):
        return self.spark.read.schema("job_id long, task long, sent timestamp, error string").parquet(f"{self.folder}/out")

    def known(self):
        return sorted((r.job_id, r.task, r.error) for r in self.rows().collect())


def test_missing_results_come_out_when_they_fall_due(spark, tmp_path):
    run = Outcomes(spark, tmp_path)
    run.add([(1, t, at(0)) for t in range(5)], [(1, 0, False, at(5)), (1, 1, True, at(60)), (1, 2, False, at(61)), (1, 0, True, at(30))])
    # in time to the minute; one minute too late counts for nothing; of two results the first
    assert sorted((j, t) for j, t, _ in run.known()) == [(1, 0), (1, 1)]
    assert run.known()[1] == (1, 1, "failed")
    run.add([(2, 0, at(100))], [(1, 3, False, at(50)), (2, 0, False, at(100))])  # out of order, but in time
    assert [x for x in run.known() if x[2] == "No result"] == []
    assert (1, 3, None) in run.known() and (2, 0, None) in run.known()
    run.add([(3, 0, at(300))])  # one side alone moves nothing on
    assert [x for x in run.known() if x[2] == "No result"] == []
    run.add([(3, 1, at(300))], [(3, 1, False, at(300))])
    assert [x for x in run.known() if x[2] == "No result"] == [(1, 2, "No result"), (1, 4, "No result")]
    run.add([], [(1, 4, False, at(10))])  # long past: it stays missing
    assert [x for x in run.known() if x[:2] == (1, 4)] == [(1, 4, "No result")]
    whole = [(j, t) for j, t in [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (3, 0), (3, 1)]]
    got = streams.settled(spark.createDataFrame(whole, "job_id long, task long"), run.rows())
    assert [tuple(r)[:2] for r in got.orderBy("job_id", "task").collect()] == whole
    assert {(r.job_id, r.task) for r in got.collect() if r.error == "No result"} == {(1, 2), (1, 4), (3, 0)}


def test_outcomes_in_any_batches_are_the_join(spark, tmp_path):
    asked = [(j, t, at(40 * j + t)) for j in range(6) for t in range(4)]
    came = [(j, t, (j + t) % 5 == 0, at(40 * j + t + 7 * t)) for j in range(6) for t in range(4) if (j * t) % 3 != 2]
    end = ([(99, 0, at(10_000))], [(99, 0, False, at(10_000))])
    want = joins.align_results(spark.createDataFrame(asked, ASKED).select("job_id", "task"), spark.createDataFrame(came, CAME).select("job_id", "task", "failed"))
    want = sorted((r.job_id, r.task, r.error) for r in want.collect())
    assert {e for *_, e in want} == {None, "failed", "No result"}
    for cuts in ([24], [5, 6, 24]):
        (tmp_path / str(len(cuts))).mkdir()
        run, low = Outcomes(spark, tmp_path / str(len(cuts))), 0
        for high in cuts:
            tasks = {a[:2] for a in asked[low:high]}
            run.add(asked[low:high], [c for c in came if c[:2] in tasks])
            low = high
        run.add(*end)
        assert [x for x in run.known() if x[0] != 99] == want
        done = run.rows().groupBy("job_id").count().withColumnRenamed("count", "done")
        totals = spark.createDataFrame([(j, 4) for j in range(6)], "job_id long, total long")
        assert all(r.finished and r.percent == 100 for r in streams.progress(done, totals).collect())


def test_no_tasks_no_outcomes(spark, tmp_path):
    assert Outcomes(spark, tmp_path).add([], [(1, 0, False, at(0))]).known() == []
