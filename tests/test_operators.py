import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizweave.functions import scalars as S
from quizweave.operators import assemble, calls, joins, merge, relevance, responses, sessions, windows
from quizweave.plans import pipelines
from quizweave.sources import sinks, tables
from quizweave.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one(spark, column, **values):
    kinds = {int: "bigint", str: "string", bool: "boolean", type(None): "bigint"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("page", "want"), [(0, None), (1, 41), (40, 80), (41, None), (None, None)])
def test_adjust_chunk_page(spark, page, want):
    assert one(spark, S.adjust_chunk_page(*map(F.col, "pset")), p=page, s=41, e=80, t=80) == want


@pytest.mark.parametrize(("score", "want"), [(45, 45), (49, 45), (50, 50), (110, 110), (109, 100), (0, 5), (None, None)])
def test_snap_score(spark, score, want):
    assert one(spark, S.snap_score(F.col("x")), x=score) == want


@pytest.mark.parametrize(("number", "want"), [("21", 21), ("21번", 21), ("번호없음", None), (None, None), ("Q7-8", 7)])
def test_question_sort_key(spark, number, want):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(S.question_sort_key(F.col("n"))).first()[0] == want


@pytest.mark.parametrize(("number", "want"), [("21", 21), ("21번", None), ("7 a", 7), ("", None)])
def test_leading_number(spark, number, want):
    assert spark.createDataFrame([(number,)], "n string").select(S.leading_number(F.col("n"))).first()[0] == want


def test_names(spark):
    df = spark.createDataFrame([("a.pdf",), ("",), (None,), ("../a.pdf",), ("a.PDF",), ("x" * 255 + ".pdf",), ("a.txt",)], "n string")
    assert [r[0] for r in df.select(S.is_valid_pdf_name(F.col("n"))).collect()] == [True, False, False, False, True, False, False]


def test_backoff(spark):
    df = spark.range(4)
    assert [r[0] for r in df.select(S.backoff_seconds(F.col("id"))).collect()] == [1, 2, None, None]


def test_offset_nested(spark):
    df = spark.sql("SELECT array(named_struct('exam_page', 1, 'questions', array(named_struct('n', '1', 'links', array(named_struct('lecture_page', 3)))))) AS p")
    out = df.select(S.offset_nested(F.col("p"), F.lit(41)).alias("p")).first().p
    assert out[0].questions[0].links[0].lecture_page == 43


@pytest.mark.parametrize(("pages", "want"), [(0, []), (40, [(0, 1, 40)]), (41, [(0, 1, 40), (1, 41, 41)]), (80, [(0, 1, 40), (1, 41, 80)])])
def test_chunk_pages(spark, pages, want):
    df = spark.createDataFrame([(1, pages)], "lecture_id long, page_count long")
    assert rows(windows.chunk_pages(df), "chunk_no", "start_page", "end_page") == want


def brute(questions, pages, least):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    out = []
    for i, q in questions:
        qw = words(q)
        for lec, no, p in pages:
            pw = words(p)
            if not qw:
                continue
            score = 5 * (20 * len(set(qw) & set(pw)) // len(set(qw)))
            if len(qw) >= 5 and f" {' '.join(qw)} " in f" {' '.join(pw)} ":
                score = 110
            if score >= least and score:
                out.append((i, lec, no, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [5, 50, 55, 100, 110])
def test_score_links_is_the_cross_join(spark, least):
    qs = [(1, "alpha beta gamma delta epsilon"), (2, "beta"), (3, "unseen words only here"), (4, ""), (5, "the the cat sat on the mat"), (6, "one two three four")]
    ps = [(1, 1, "Alpha, beta. Gamma delta epsilon zeta"), (1, 2, "beta the cat sat"), (2, 1, ""), (2, 2, "the the cat sat on the mat!"), (3, 1, "one two three"), (3, 2, "one two three four five"), (4, 1, "delta beta")]
    q = spark.createDataFrame(qs, "item_id long, question_text string")
    p = spark.createDataFrame(ps, "lecture_id long, page_no long, page_text string")
    assert rows(relevance.score_links(q, p, least), "item_id", "lecture_id", "page_no", "score") == brute(qs, ps, least)


def test_pluggable_scorer(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, question_text string")
    p = spark.createDataFrame([(1, 1, "alpha beta gamma")], "lecture_id long, page_no long, page_text string")
    out = relevance.score_links(q, p, 50, lambda f: [63] * len(f), 5)
    assert rows(out, "item_id", "score", "error") == [(1, 60, None), (2, 60, None)]

    def fails(frame: pd.DataFrame):
        raise ValueError("no")

    assert {r.error for r in relevance.score_links(q, p, 50, fails, 5).collect()} == {"no"}


def test_top_links_cut_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 1, 50), (1, 2, 1, 50), (1, 1, 2, 50), (1, 9, 9, 45), (2, 1, 1, None), (3, 1, 1, 110)], "item_id long, lecture_id long, page_no long, score long")
    assert rows(relevance.top_links(df), "item_id", "lecture_id", "page_no") == [(1, 1, 1), (1, 1, 2), (3, 1, 1)]
    twice = relevance.dedupe_links(df.union(df.withColumn("score", F.col("score") + 5)))
    assert twice.count() == 6 and twice.where("item_id = 3").first().score == 115


def test_merge_keeps_numbers_on_page(spark):
    schema = "exam_id long, exam_page long, question_number string, item_id long, question_text string, numbers_on_page array<string>, input_order long, lecture_id long, page_no long, score long"
    data = [(1, 9, "59", 7, "text", ["58", "59"], 2, 5, 1, 60), (1, 9, "59", 7, "text", ["58", "59"], 1, 4, 2, 70)]
    out = merge.merge_by_question(spark.createDataFrame(data, schema)).first()
    assert out["first"].numbers_on_page == ["58", "59"] and [(x.lecture_id, x.score) for x in out.links] == [(4, 70), (5, 60)]
    back = merge.merge_by_question(spark.createDataFrame(data[::-1], schema)).first()
    assert back == out


def test_extent(spark):
    schema = "item_id long, exam_id long, exam_page long, question_number long, explicit_end long"
    q = spark.createDataFrame([(1, 1, 1, 1, None), (2, 1, 1, 2, None), (3, 1, 3, 3, None), (4, 1, 2, 4, 9), (5, 1, 2, 5, 1), (6, 1, 4, 6, None)], schema)
    counts = spark.createDataFrame([(1, 3)], "exam_id long, page_count long")
    assert rows(windows.question_extent(q, counts), "item_id", "start_page", "end_page") == [(1, 1, 1), (2, 1, 2), (3, 3, 3), (4, 2, 2), (5, 2, 2)]


def test_responses(spark):
    page = lambda n, answers=True: {"exam_page": n, "questions": [{"question_number": str(n), "question_text": "t{"} | ({"answer": "1"} if answers else {})]}
    whole = json.dumps({"exam_pages": [page(1), page(2)]})
    cut_in_string = whole[: whole.rindex("t{") + 2]
    after_page = whole[: whole.index(', {"exam_page": 2')]
    texts = [(1, whole), (2, cut_in_string), (3, after_page), (4, "{}"), (5, ""), (6, json.dumps({"exam_pages": [page(1, False)]})), (7, None)]
    df = spark.createDataFrame(texts, "response_id long, text string")
    got = {r.response_id: (r.status, r.n_pages, r.n_questions) for r in responses.parse_responses(df).collect()}
    assert got == {1: ("ok", 2, 2), 2: ("recovered", 1, 1), 3: ("recovered", 1, 1), 4: ("quarantine", 0, 0), 5: ("quarantine", 0, 0), 6: ("ok", 0, 0), 7: ("quarantine", 0, 0)}


def test_key_state():
    t = pd.Timestamp("2024-01-01")
    minutes = lambda m, us=0: t + pd.Timedelta(minutes=m, microseconds=us)
    k = calls.KeyState()
    assert [k.call(minutes(m), False) for m in range(3)] == ["failed", "failed", "cooldown"]
    assert k.call(minutes(12, -1), True) == "skipped"
    assert k.call(minutes(12), False) == "failed" and k.failures == 1
    assert k.call(minutes(13), True) == "ok" and k.failures == 0


def test_sessions(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-25 00:00:00'), (2, TIMESTAMP_NTZ'2024-01-24 00:00:00') AS t(conv_id, created)")
    now = F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")
    assert rows(sessions.expired_sessions(df, now), "conv_id") == [(2,)]
    assert rows(sessions.expired_sessions(df, now, at_least=True), "conv_id") == [(1,), (2,)]


def test_nearest_page(spark):
    q = spark.createDataFrame([(1, 1, 5, 4), (2, 1, 9, 4), (3, 1, None, 2)], "item_id long, exam_id long, number long, hint long")
    index = merge.question_index(spark.createDataFrame([(1, 3, "5. a\nx"), (1, 5, " 5) b"), (1, 0, "9. c")], "exam_id long, page_no long, page_text string"))
    assert rows(joins.nearest_page(q, index), "item_id", "start_page") == [(1, 3), (2, 4), (3, 2)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("a.pdf", "b.txt", "c.pdf"):
        (tmp_path / "docs" / name).write_bytes(b"x")
    assert rows(tables.list_documents(spark, str(tmp_path / "docs")), "name") == [("a.pdf",), ("c.pdf",)]
    folder = tmp_path / "chunks"
    folder.mkdir()
    good = {"lecture_idx": 1, "lecture_path": "x", "result": {"exam_pages": [{"exam_page": 1, "questions": []}]}}
    (folder / "chunk_1.json").write_text(json.dumps(good))
    (folder / "chunk_2.json").write_text("{broken")
    (folder / "chunk_3.json").write_text(json.dumps({"lecture_idx": 3, "result": {"error": "x"}}))
    assert rows(tables.read_chunk_results(spark, str(folder)), "file") == [("chunk_1.json",)]
    states = tmp_path / "states"
    for name, text in (("s1", json.dumps({"session_id": "s1", "status": "complete"})), ("s2", "{oops")):
        (states / name).mkdir(parents=True)
        (states / name / "state.json").write_text(text)
    ids = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "session_id string")
    assert rows(tables.read_session_states(spark, str(states), ids), "session_id", "state") == [("s1", "complete"), ("s2", "error"), ("s3", "no_state")]
    (tmp_path / "jobs.json").write_text(json.dumps({"job_id": "j", "exam_keys": ["exam:j:e.pdf:h"], "lecture_keys": ["short"]}))
    assert rows(tables.job_files(tables.read_jobs(spark, str(tmp_path / "jobs.json"))), "file_name") == [("e.pdf",), (None,)]
    (tmp_path / "log.json").write_text(json.dumps({"response_id": "1", "response": "{}", "response_length": 2}))
    assert tables.read_responses(spark, str(tmp_path / "log.json")).first().response_length == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "session_id string, n long")
    sinks.write_chunk_results(df, str(tmp_path / "k1"))
    sinks.write_chunk_results(df.where("n = 1"), str(tmp_path / "k1"))
    assert spark.read.json(str(tmp_path / "k1")).count() == 3
    sinks.write_session_state(df, str(tmp_path / "k2"))
    sinks.write_session_state(df.where("n = 1").withColumn("n", F.lit(9)), str(tmp_path / "k2"))
    assert rows(spark.read.json(str(tmp_path / "k2")), "session_id", "n") == [("s1", 9), ("s2", 2)]
    pages = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "output_name string, seq long, text string")
    sinks.write_study_pages(pages, str(tmp_path / "k3"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "k3/output_name=a")).collect()] == ["x", "y"]
    sinks.write_manifest(pages.select(F.lit("j").alias("job_id"), "output_name").distinct(), str(tmp_path / "k4"))
    assert spark.read.json(str(tmp_path / "k4")).first().outputs == "a,b"


def test_streams(spark, tmp_path):
    source = tmp_path / "links"
    schema = "item_id long, lecture_id long, page_no long, score long"
    data = [[(1, 1, 1, 50), (1, 2, 1, 70), (2, 1, 1, 55)], [(1, 3, 1, 90), (1, 2, 1, 70), (2, 1, 1, 60)]]
    for part in data:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(source))
        streams.stream_top_links(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "top")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    have = spark.read.parquet(str(tmp_path / "top/*"))
    have = have.where(F.col("version") == have.agg(F.max("version")).first()[0])
    want = relevance.top_links(relevance.dedupe_links(spark.createDataFrame(data[0] + data[1], schema)))
    assert rows(have, "item_id", "lecture_id", "page_no", "score") == rows(want, "item_id", "lecture_id", "page_no", "score")
    stream = spark.readStream.schema(schema).parquet(str(source)).withColumn("job_id", F.col("item_id"))
    kept = streams.run_available(streams.drop_cancelled(stream, spark.createDataFrame([(1,)], "job_id long")), str(tmp_path / "x"))
    assert {r.job_id for r in kept.collect()} == {2}


def test_stream_key_health(spark, tmp_path):
    """Batch by batch as in one go, with a null key; and frames pass one at a time."""
    schema = "event_id long, key_id long, ts timestamp_ntz, ok boolean"
    at = lambda i: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)
    log = [(i, [1, 2, None][i % 3], at(i).to_pydatetime(), i % 7 == 0) for i in range(120)]
    for low, high in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame(log[low:high][::-1], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))  # the whole log in one batch, then in three
    streams.stream_key_health(stream, str(tmp_path / "one")).option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start().awaitTermination()
    (tmp_path / "in3").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in3"))
    writer = streams.stream_key_health(stream, str(tmp_path / "three"))
    for low, high in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame(log[low:high][::-1], schema).write.mode("append").parquet(str(tmp_path / "in3"))
        writer.option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start().awaitTermination()
    want = []
    for key in (1, 2, None):
        state = calls.KeyState()
        want += [(i, k, state.call(pd.Timestamp(ts), ok), state.failures) for i, k, ts, ok in log if k == key]
    for table in ("one", "three"):
        assert rows(streams.key_health(spark, str(tmp_path / table)), "event_id", "key_id", "action", "failures") == sorted(want, key=str)
    assert {"skipped", "cooldown", "ok", "failed"} == {w[2] for w in want}

    taken = []
    frames = (taken.append(i) or pd.DataFrame({"event_id": [i], "no_key": False, "key": 1, "ts": [at(i)], "ok": [False], "had": 0, "had_until": [pd.NaT]}) for i in range(5))
    for n, out in enumerate(streams.replayed(frames), 1):
        assert len(taken) == n and len(out) == 1


def test_stream_expiry(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:00'), ('a', TIMESTAMP'2024-01-01 00:30:00'), ('a', TIMESTAMP'2024-01-01 05:00:00'), ('b', TIMESTAMP'2024-01-03 00:00:00') AS t(session_id, ts)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, ts timestamp").parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.stream_expiry(stream, "1 hour"), str(tmp_path / "x"))
    assert {("a", 2), ("a", 1)} <= {(r.session_id, r.touches) for r in got.collect()}


def test_pipelines_and_views(spark):
    q = spark.createDataFrame([(1, 1, "e.pdf", 1, 1, "alpha beta gamma", "1", "why", {"2번": "no"})], "item_id long, exam_id long, exam_name string, question_number long, exam_page long, question_text string, answer string, explanation string, wrong_answers map<string,string>")
    p = tables.pages_of(spark.createDataFrame([(1, "alpha beta\nalpha beta gamma\n"), (2, None)], "doc_id long, text string"))
    counts, lectures = spark.createDataFrame([(1, "e.pdf", 1)], "exam_id long, exam_name string, page_count long"), tables.page_counts(p)
    out = pipelines.link_exam_centric(q, p, counts, lectures)
    assert rows(out["links"], "lecture_id", "page_no", "score") == [(1, 1, 65), (1, 2, 100)]
    assert [r.kind for r in out["study"].orderBy("seq").collect()] == [1, 2, 2, 3, 9]
    both = pipelines.link_lecture_centric(q, p, counts)
    assert {(r.lecture_id, r.page_no, r.importance, tuple(map(tuple, r.links))) for r in both["slides"].collect()} == {(1, 1, 65, ((1, 65),)), (1, 2, 100, ((1, 100),))}
    assert [(r.importance, [tuple(x) for x in r.links]) for r in out["groups"].collect()] == [(100, [(1, 2, 100), (1, 1, 65)])]
    assert [r.kind for r in both["study"].where("output_name = 'filtered_lec_1_all_exams'").orderBy("seq").collect()] == [0, 1, 3, 0, 1, 3, 0, 9]
    pipelines.register({"links": out["links"]})
    assert spark.sql("SELECT count(*) FROM links").first()[0] == 2
    assert pipelines.exam_only(q).count() == 2
    assert pipelines.EXAM.output("exam_name") is not None and assemble.PAGE == 0


def test_key_status_at_a_moment(spark):
    log = [(1, "00:00", 1, False, "a"), (2, "00:01", 1, False, "b"), (3, "00:02", 1, False, "c"), (4, "00:20", 1, False, "d"), (5, "00:21", 1, True, None), (6, "00:05", 2, False, "e")]
    df = spark.createDataFrame([(i, f"2024-01-01 {t}:00", k, ok, e) for i, t, k, ok, e in log], "event_id long, ts string, key_id long, ok boolean, error string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {"00:01": [(1, 2, 2, "b", True)], "00:02": [(1, 3, 3, "c", False)], "00:11": [(1, 3, 3, "c", False), (2, 1, 1, "e", True)], "00:12": [(1, 3, 0, "c", True), (2, 1, 1, "e", True)], "00:20": [(1, 4, 1, "d", True), (2, 1, 1, "e", True)], "00:21": [(1, 5, 0, None, True), (2, 1, 1, "e", True)]}
    for at, expected in want.items():
        status = calls.key_status(df, F.expr(f"TIMESTAMP_NTZ'2024-01-01 {at}:00'"))
        assert rows(status, "key_id", "requests", "in_a_row", "last_error", "available") == expected
        assert tuple(calls.key_totals(status).first()) == (len(expected), sum(x[-1] for x in expected))
    assert tuple(calls.key_totals(calls.key_status(df.where("false"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))).first()) == (0, 0)


def test_recover_merges_by_number_and_drops_unlinked(spark):
    fields = "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<string>, input_order long, lecture_id long, page_no long, score long, error string"
    rows_ = [
        (1, 2, 59, 7, "spleen question", ["58", "59"], 2, 20, 3, 60, None),
        (1, 1, 59, 7, "spleen question", ["59"], 1, 10, 3, 70, None),
        (1, 1, 59, 7, "spleen question", ["59"], 3, 10, 3, 90, None),
        (1, 1, 60, 8, "liver question", ["60"], 1, 10, 4, 40, None),
        (1, 1, 59, 7, None, None, 0, None, None, None, "boom"),
    ]
    out = pipelines.recover(spark.createDataFrame(rows_, fields))
    assert [(r.question_number, r.exam_page, r.numbers_on_page) for r in out["questions"].collect()] == [(59, 1, ["59"])]
    assert [(r.lecture_id, r.score, r.rank) for r in out["links"].orderBy("rank").collect()] == [(10, 90, 1), (20, 60, 2)]
    assert out["summary"].first().total_links == 2 and out["pages"].count() == 1


def test_merge_keeps_numbers_on_page_and_skips_errors(spark):
    fields = "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<string>, input_order long, lecture_id long, page_no long, score long, error string"
    rows_ = [(1, 9, 59, 3, "q", ["57", "58", "59"], 1, 5, 6, 80, None), (1, 9, 59, 3, "q", ["57", "58", "59"], 0, None, None, None, "boom")]
    out = merge.merge_by_question(spark.createDataFrame(rows_, fields)).collect()
    assert [(r.first.numbers_on_page, [x.score for x in r.links]) for r in out] == [(["57", "58", "59"], [80])]
