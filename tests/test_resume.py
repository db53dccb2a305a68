"""Runs that stop and go on, results that come in parts, and call runs put together from hours."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quizweave.operators import calls, merge, relevance
from quizweave.operators.current import CurrentMerge
from quizweave.sources.results import ResultStore, chunk_result_store, read_stored_results
from quizweave.streaming import streams

Q = "item_id long, question_text string"
P = "lecture_id long, page_no long, page_text string"


def store_of(spark, path):
    return ResultStore(spark, str(path), "id long, v string", ("id",))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_run_that_is_killed_between_files_and_manifest(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    assert rows(store.read()) == []
    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_commit", lambda self, number, folders: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.append(first)
    assert rows(store.read()) == [] and len(list((tmp_path / "data").iterdir())) == 1  # the rest of that run
    assert store.append(first) == 2
    assert store.append(first) == 0
    assert store.append(spark.createDataFrame([(2, "other"), (3, "c")], "id long, v string")) == 1
    assert rows(store.read()) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(store.missing(spark.createDataFrame([(3,), (4,)], "id long"))) == [(4,)]
    assert store.clean(older_than_seconds=3600) == 0 and store.clean(older_than_seconds=-60) >= 1
    assert rows(store_of(spark, tmp_path).read()) == [(1, "a"), (2, "b"), (3, "c")]
    store.compact()
    assert len(store.snapshot()[1]) == 1 and rows(store.read()) == [(1, "a"), (2, "b"), (3, "c")]
    store.clean(older_than_seconds=-60)
    assert len(list((tmp_path / "data").iterdir())) == 1 and rows(store.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_two_runs_that_commit_at_once(spark, tmp_path):
    one, other = store_of(spark, tmp_path), store_of(spark, tmp_path)
    plain, late = one._commit, []

    def beaten(number, folders):
        if not late:
            late.append(other.append(spark.createDataFrame([(1, "first"), (2, "b")], "id long, v string")))
        return plain(number, folders)

    one._commit = beaten
    assert one.append(spark.createDataFrame([(1, "second"), (3, "c")], "id long, v string")) == 1
    assert rows(one.read()) == [(1, "first"), (2, "b"), (3, "c")]

    def replaced(number, folders):
        other.append(spark.createDataFrame([(9, "x")], "id long, v string"))
        return plain(number, folders)

    one._commit = replaced
    with pytest.raises(RuntimeError):
        one.replace(one.read().where("id = 1"))
    assert len(rows(one.read())) == 4


def test_an_unfinished_manifest_is_not_read(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.append(spark.createDataFrame([(1, "a")], "id long, v string"))
    (tmp_path / "manifests" / "half.tmp").write_text('{"fol')
    assert rows(store.read()) == [(1, "a")]


def test_stored_results_are_parsed_as_files_are(spark, tmp_path):
    store = chunk_result_store(spark, str(tmp_path))
    good = '{"exam_pages":[{"exam_page":1,"questions":[]}]}'
    store.append(spark.createDataFrame([("s", 0, "l.pdf", good), ("s", 1, "l.pdf", "{"), ("s", 2, None, '{"error":"no"}'), ("s", 3, None, None), ("t", 0, None, '{"exam_pages":[]}')], "session_id string, lecture_idx int, lecture_path string, result string"))
    assert rows(read_stored_results(store).select("session_id", "lecture_idx")) == [("s", 0), ("t", 0)]


def test_a_bad_row_costs_one_row(spark, tmp_path):
    q = spark.createDataFrame([(i, "alpha beta") for i in range(100)], Q)
    p = spark.createDataFrame([(1, 1, "alpha beta gamma")], P)

    def scorer(frame):
        if (frame["item_id"] % 40 == 7).any():
            raise ValueError("bad row")
        return frame.assign(score=80, reason="r" + frame["item_id"].astype(str))[["score", "reason"]]

    got = relevance.score_links(q, p, 50, scorer, 5)
    assert rows(got.where("error IS NOT NULL").select("item_id", "score", "error")) == [(47, None, "bad row"), (7, None, "bad row"), (87, None, "bad row")]
    assert got.where("error IS NULL AND reason = concat('r', item_id) AND score = 80").count() == 97
    short = relevance.tried(lambda f: [1, 2], got.limit(1).select("item_id", F.lit("").alias("question_text"), F.lit("").alias("page_text")).toPandas())
    assert short["error"].tolist() == ["2 scores for 1 rows"]


def test_a_second_run_scores_only_what_is_new(spark, tmp_path):
    q = spark.createDataFrame([(i, "alpha beta") for i in range(20)], Q)
    p = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 1, "beta")], P)
    seen = str(tmp_path / "seen")
    Path(seen).mkdir()
    healthy = tmp_path / "healthy"

    def scorer(frame):
        if (frame["item_id"] == 5).any() and not healthy.exists():
            raise ValueError("later")
        for i, lecture in zip(frame["item_id"], frame["lecture_id"]):
            with open(f"{seen}/{i}-{lecture}", "a") as f:
                f.write("x")
        return frame.assign(score=60, reason="why")[["score", "reason"]]

    store = ResultStore(spark, str(tmp_path / "store"), relevance.REQUESTS, relevance.REQUEST_KEYS)
    errors = ResultStore(spark, str(tmp_path / "errors"), f"{relevance.REQUESTS}, error string", relevance.REQUEST_KEYS)
    some = relevance.score_requests(q.where("item_id < 10"), p, 5, "v1")
    whole = relevance.score_requests(q, p, 5, "v1")
    assert relevance.score_pending(some, store, scorer, errors) == 18
    assert {r.error for r in errors.read().collect()} == {"later"} and errors.read().count() == 2
    assert relevance.score_pending(whole, store, scorer) == 20
    healthy.touch()
    assert relevance.score_pending(whole, store, scorer) == 2
    assert relevance.score_pending(whole, store, scorer) == 0
    assert {f.name: f.read_text() for f in Path(seen).iterdir()} == {f"{i}-{lec}": "x" for i in range(20) for lec in (1, 2)}
    links = relevance.stored_links(whole, store)
    assert links.count() == 40 and links.where("reason = 'why' AND score = 60").count() == 40
    # another text or scorer is another request
    assert store.missing(relevance.score_requests(q.where("item_id = 1").withColumn("question_text", F.lit("beta")), p, 5, "v1")).count() == 2
    assert store.missing(relevance.score_requests(q, p, 5, "v2")).count() == 40


RESULTS = "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<long>, input_order long, lecture_id long, page_no long, score long, reason string, error string"


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_come_to_the_merge_of_all(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(e, n % 3, n, e * 10 + n, f"text {order}", [n], order, lec, page, 5 * rng.randrange(10, 20), rng.choice([None, "why"]), "failed" if rng.random() < 0.1 else None) for e in range(3) for n in range(4) for order, lec, page in [(rng.randrange(4), rng.randrange(3), rng.randrange(5)) for _ in range(6)]]
    # what comes first must not hang on ties of whole places
    data = list({(*r[:4], *r[6:10]): r for r in data}.values())
    want = merge.merge_by_question(spark.createDataFrame(data, RESULTS))
    now = CurrentMerge(spark, str(tmp_path / "m"))
    rng.shuffle(data)
    cuts = sorted(rng.sample(range(len(data)), 3))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
        delta = spark.createDataFrame(data[a:b], RESULTS)
        assert now.add(delta, f"d{i}") and not now.add(delta, f"d{i}")
        if i == 1:
            now.compact()
            assert not now.add(delta, "d0")
    columns = ["exam_id", "exam_page", "question_number", "first", "links"]
    assert rows(now.read().select(columns)) == rows(want.select(columns))
    assert now.add(spark.createDataFrame([], RESULTS), "empty") and not now.add(spark.createDataFrame([], RESULTS), "empty")


def test_a_stream_of_results_is_merged_once(spark, tmp_path):
    data = [(1, 1, 1, 7, "t", [1], i, 1, i, 60, None, None) for i in range(6)]
    now = CurrentMerge(spark, str(tmp_path / "m"))
    for i in range(3):
        spark.createDataFrame(data[2 * i : 2 * i + 2], RESULTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second time as if the first had not been noted
        streams.stream_merge(stream, now).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert rows(now.read()) == rows(merge.merge_by_question(spark.createDataFrame(data, RESULTS)))


def test_old_versions_of_top_links_go(spark, tmp_path):
    schema = "item_id long, lecture_id long, page_no long, score long"
    for i in range(5):
        spark.createDataFrame([(1, i, 1, 50 + 5 * i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_top_links(stream, str(tmp_path / "top")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert streams.versions(spark, str(tmp_path / "top")) == [3, 4]
    (tmp_path / "top/v9").mkdir()  # not written to its end
    assert rows(streams.current_top_links(spark, str(tmp_path / "top"))) == [(1, 3, 1, 65), (1, 4, 1, 70)]


def slow_runs(log):
    out, state = [], {}
    for key, ts, event, ok in sorted(log, key=lambda c: (str(c[0]), c[1], c[2])):
        run = state.get(key)
        if run is None or run[0] != ok:
            run = state[key] = (ok, [])
            out.append((key, *run))
        run[1].append((ts, event))
    return sorted(((k, ok, len(c), c[0], c[-1], c[2][0] if len(c) >= 3 else None, c[len(c) // 3 * 3 - 1][0] if len(c) >= 3 else None) for k, ok, c in out), key=str)


@pytest.mark.parametrize("gap", [1, 17, 45, 200])
def test_runs_put_together_from_hours(spark, gap):
    rng, log = random.Random(gap), []
    for key in (1, 2, None):
        ts, ok = datetime(2024, 1, 1), True
        for _ in range(250):
            ts += timedelta(minutes=rng.choice([0, 0, 1, gap]))
            ok = ok if rng.random() < 0.8 else not ok
            log.append((key, ts, len(log), ok))
    df = spark.createDataFrame(log, "key_id long, ts timestamp_ntz, event_id long, ok boolean")
    got = calls.call_runs(df).collect()
    assert sorted(((r.key_id, r.ok, r.n, tuple(r["first"]), tuple(r["last"]), r.third, r.last_third) for r in got), key=str) == slow_runs(log)


def test_no_calls(spark):
    none = spark.createDataFrame([], "key_id long, ts timestamp_ntz, event_id long, ok boolean, error string")
    assert calls.call_runs(none).count() == 0 and calls.key_status(none, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).count() == 0
    one = spark.createDataFrame([(None, datetime(2024, 1, 1), 1, False, "e")], none.schema)
    assert rows(calls.key_status(one, F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")).select("key_id", "requests", "in_a_row", "last_error")) == [(None, 1, 1, "e")]


def test_recovered_links_are_not_read_from_lists(spark):
    from quizweave.plans import pipelines

    results = [(1, 1, 5, 9, "q", [5], 3, 7, 1, 60, None), (1, 2, 5, 9, "q", [5], 1, 7, 2, 80, None), (1, 2, 5, 8, "r", [5], 2, 7, 2, 90, None), (1, 2, 5, 9, "q", [5], 0, 7, 3, 99, "failed"), (None, 1, 5, 4, "n", [5], 1, 8, 1, 70, None)]
    frame = spark.createDataFrame(results, "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<long>, input_order long, lecture_id long, page_no long, score long, error string")
    out = pipelines.recover(frame)
    assert rows(out["links"].select("item_id", "lecture_id", "page_no", "score", "rank")) == [(4, 8, 1, 70, 1), (9, 7, 1, 60, 2), (9, 7, 2, 90, 1)]
    assert rows(out["questions"].select("exam_id", "exam_page", "item_id")) == [(1, 2, 9), (None, 1, 4)]
    assert "collect_list" not in out["links"]._jdf.queryExecution().optimizedPlan().toString() and "Join" not in out["links"]._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_links_are_gathered_without_the_questions_fields(spark):
    results = spark.createDataFrame([(1, 1, 5, 9, "q", [5], 3, 7, 1, 60)], "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<long>, input_order long, lecture_id long, page_no long, score long")
    merged = merge.partial_merge(results)
    assert [(r["first"]["question_text"], r["order"]["input_order"], len(r["links"])) for r in merged.collect()] == [("q", 3, 1)]
    gathered = [line for line in merged._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in line]
    assert gathered and not [line for line in gathered if "question_text" in line]


def test_a_batch_of_links_is_cut_to_the_score_before_pages_are_compared(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(streams, "dedupe_links", lambda links: seen.append(rows(links)) or relevance.dedupe_links(links))
    spark.createDataFrame([(1, 2, 3, 49), (1, 2, 3, 50), (1, 2, 4, None)], relevance.LINKS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(relevance.LINKS).parquet(f"{tmp_path}/in")
    streams.stream_top_links(stream, f"{tmp_path}/top").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(1, 2, 3, 50)]] and rows(streams.current_top_links(spark, f"{tmp_path}/top")) == [(1, 2, 3, 50)]
