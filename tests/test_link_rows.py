"""Links of one question that are more than a task should hold as a list."""

import hashlib
import random

from pyspark.sql import functions as F

from quizweave.operators import merge
from quizweave.operators.current import CurrentMerge
from quizweave.plans import queries
from quizweave.sources.results import ResultStore


def test_digests_of_lists_are_those_of_their_rows_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([7, None]), rng.choice([None, *range(9)]), rng.randrange(5)) for _ in range(900)] + [(3, 7, 1, 1)]
    df = spark.createDataFrame(rows, "a long, b long, x long, y long").repartition(5)
    got = {(r.a, r.b): (r.n, r.md5) for r in merge.listed_md5(df, ("a", "b"), ("x", "y"), F.concat_ws(":", "x", "y")).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r[2:] for r in rows if r[:2] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want[key] = (len(own), hashlib.md5(",".join(":".join(str(v) for v in r if v is not None) for r in own).encode()).hexdigest())
    assert got == want
    assert merge.listed_md5(df.where("false"), ("a", "b"), ("x", "y"), F.lit("")).count() == 0


def test_deltas_are_kept_as_rows(spark, tmp_path):
    fields = "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<long>, input_order long, lecture_id long, page_no long, score long"
    now = CurrentMerge(spark, f"{tmp_path}/m")
    now.add(spark.createDataFrame([(1, 1, 5, 9, "q", [5], 3, 7, 1, 60)] * 2 + [(None, 1, 5, 9, "r", [5], 3, 7, 1, 60)], fields), "a")
    now.compact()
    assert now.add(spark.createDataFrame([(1, 1, 5, 8, "p", [5], 1, 7, 2, 80)], fields), "b") and not now.add(spark.createDataFrame([], fields), "a")
    assert sorted(map(str, now.links().select("exam_id", "input_order", "score").collect())) == sorted(f"Row(exam_id={e}, input_order={o}, score={s})" for e, o, s in [(1, 3, 60), (1, 3, 60), (1, 1, 80), (None, 3, 60)])
    assert sorted((str(r.exam_id), r["first"].question_text) for r in now.questions().collect()) == [("1", "p"), ("None", "r")]
    assert sorted((str(r.exam_id), len(r.links)) for r in now.read().collect()) == [("1", 3), ("None", 1)]


def test_the_query_gathers_no_list_of_links(spark, monkeypatch):
    fields = "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<long>, input_order long, lecture_id long, page_no long, score long"
    rows = spark.createDataFrame([(1, 1, 5, 9, "q", [5], i, i, 1, 60) for i in range(8)], fields)
    monkeypatch.setattr(queries, "merged_rows", lambda spark, sf: rows)
    out = queries.merge_in_deltas(spark, "")
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 1, 5, "5", 8, hashlib.md5(",".join(f"{i}:1:60" for i in range(8)).encode()).hexdigest())]


def test_results_of_several_rows_come_in_once_and_whole(spark, tmp_path):
    one, other = (ResultStore(spark, f"{tmp_path}/s", "id string, v long", ("id",), one_row=False) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v long")
    plain, late = one._commit, []

    def beaten(number, folders):
        if not late:
            late.append(other.append(rows(("a", 1), ("a", 1))))
        return plain(number, folders)

    one._commit = beaten
    assert one.append(rows(("a", 5), ("b", 2), ("b", 2), ("b", 3))) == 3
    assert one.append(rows(("b", 9), ("c", 1))) == 1
    assert sorted(map(tuple, one.read().collect())) == [("a", 1), ("a", 1), ("b", 2), ("b", 2), ("b", 3), ("c", 1)]
