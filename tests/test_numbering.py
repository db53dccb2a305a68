"""Numbering of very long outputs, matching of files, recovery's study document."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quizweave.operators import assemble, joins, merge, windows
from quizweave.plans import pipelines

STUDY = "output_name string, major long, minor long, kind long, doc_name string, page_no long, text string"


def plain(df, group, *order):
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def held(df):
    return sorted(map(str, df.collect()))


def test_long_outputs_are_numbered_in_stretches(spark):
    """One output holds most rows, many of them at one place; gaps, negative and null places, a null output."""
    rng = random.Random(5)
    rows = [("long", rng.choice([7, rng.randrange(-50, 9_000), rng.randrange(10**12)]), i, i % 4, None, rng.randrange(9), "x") for i in range(3_000)]
    rows += [(name, rng.choice([None, 1, 4095, 4096, 2**62]), i, 0, "d", 1, None) for i, name in enumerate(["a", "b", None] * 30)]
    df = spark.createDataFrame(rows, STUDY)
    for width in (1, 64, 4096):
        got = windows.numbered(df, "output_name", "major", "minor", width=width)
        assert got.columns == [*df.columns, "seq"]
        assert held(got) == held(plain(df, "output_name", "major", "minor"))
    plan = assemble.ordered(df, "minor")._jdf.queryExecution().optimizedPlan().toString()
    windows_ = [line for line in plan.split("\n") if "Window [row_number" in line]
    assert windows_ and all("stretch" in line for line in windows_)
    assert assemble.ordered(df.where("false"), "minor").count() == 0


def test_chunks_of_a_long_lecture(spark):
    rows = [(1, str(p) if p % 9 else "?", p % 5, i, 50) for i, p in enumerate(range(1, 1_500))] + [(2, "3", 0, 1, 60), (2, None, 0, 2, 60)]
    df = spark.createDataFrame(rows, "lecture_id long, page_no string, input_order long, item_id long, score long")
    want = plain(df, "lecture_id", F.coalesce(F.col("page_no").try_cast("bigint"), F.lit(0)), "input_order", "item_id", "score")
    assert held(merge.concat_chunks(df)) == held(want)


def test_session_files(spark):
    at = lambda rows, fields: spark.createDataFrame(rows, fields.replace("timestamp_ntz", "string")).withColumn(fields.split(", ")[-1].split()[0], F.col(fields.split(", ")[-1].split()[0]).cast("timestamp_ntz"))
    sessions = at([("s", "2024-01-01 10:05:40"), ("late", "2024-01-01 23:00:00"), ("none", "2024-01-09 00:00:00"), ("x", None)], "session_id string, created timestamp_ntz")
    files = at([("a_lec_1.pdf.json", "2024-01-01 10:05:01"), ("b_lec_1.pdf.json", "2024-01-01 10:04:59"), ("z_lec_9.pdf.json", "2024-01-01 12:00:00"), ("c_lec_2.pdf.json", "2024-01-02 12:00:00")], "file_name string, modified timestamp_ntz")
    lectures = spark.createDataFrame([("lec_1.pdf",), ("lec_1.pdf",), ("lec_2.pdf",)], "lecture_name string")
    got = sorted(map(tuple, joins.match_session_files(sessions, files, lectures).collect()))
    assert got == [("late", "z_lec_9.pdf.json", False), ("s", "a_lec_1.pdf.json", True)]


def test_recovery_gives_a_study_document(spark):
    fields = "exam_id long, exam_page long, question_number long, item_id long, question_text string, numbers_on_page array<string>, input_order long, lecture_id long, page_no long, score long, error string"
    results = [(1, 2, 5, 7, "q", ["5"], 2, 20, 3, 60, None), (1, 1, 5, 7, "q", ["5"], 1, 10, 3, 70, None), (1, 1, 5, 7, "q", ["5"], 3, 10, 99, 90, None), (1, 1, 6, 8, "r", ["6"], 1, 10, 4, 40, None)]
    details = spark.createDataFrame([(i, "e.pdf", "1", "why", {"2번": "no"}) for i in (7, 8)], "item_id long, exam_name string, answer string, explanation string, wrong_answers map<string,string>")
    counts = spark.createDataFrame([(1, "e.pdf", 3)], "exam_id long, exam_name string, page_count long")
    lectures = spark.createDataFrame([(10, "lec_10.pdf", 50), (20, "lec_20.pdf", 50)], "lecture_id long, lecture_name string, page_count long")
    study = pipelines.recover(spark.createDataFrame(results, fields), details=details, counts=counts, lectures=lectures)["study"]
    rows = [(r.seq, r.kind, r.doc_name, r.page_no) for r in study.orderBy("seq").collect()]
    # of the two best links one is to a page that the lecture doesn't have, and no third takes its place; question 6 has no link of 50
    assert rows == [(1, 1, "e.pdf", 1), (2, 1, "e.pdf", 2), (3, 2, "lec_10.pdf", 3), (4, 3, None, None), (5, 9, None, None)]
