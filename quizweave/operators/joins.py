"""Joins between questions, pages, chunks, sessions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import page_in_range


def fan_out(primaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every primary document with every chunk of the secondary ones: the work list itself, so each pair is a row."""
    return primaries.crossJoin(chunks)


def total_chunks(primaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """max(1, primaries * max(1, chunks)), from two counts."""
    p, c = primaries.agg(F.count("*").alias("p")), chunks.agg(F.count("*").alias("c"))
    return p.crossJoin(c).select(F.greatest(F.lit(1), F.col("p") * F.greatest(F.lit(1), F.col("c"))).alias("total"))


def page_spine(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Every lecture page with its questions, or none."""
    return pages.join(links.select("lecture_id", "page_no", "item_id", "score"), ["lecture_id", "page_no"], "left")


def valid_questions(questions: DataFrame, counts: DataFrame, page: str = "reported_page") -> DataFrame:
    """Questions whose page the exam has, under the exam's true name."""
    known = counts.select("exam_id", F.col("exam_name").alias("true_name"), "page_count")
    return questions.join(known, "exam_id").where(page_in_range(F.col(page), F.col("page_count"))).drop("exam_name").withColumnRenamed("true_name", "exam_name")


def valid_links(links: DataFrame, lectures: DataFrame) -> DataFrame:
    """Links to a lecture that exists, on a page that it has."""
    known = lectures.select(F.col("lecture_id").alias("known_id"), "page_count")
    return links.join(known, (F.col("lecture_id") == F.col("known_id")) & page_in_range(F.col("page_no"), F.col("page_count")), "left_semi")


def nearest_page(questions: DataFrame, index: DataFrame) -> DataFrame:
    """questions (item_id, exam_id, number, hint) with start_page: the page of the index nearest to the hint, the smaller on a tie, else the hint."""
    near = questions.join(index.select("exam_id", F.col("number").alias("index_number"), F.explode("pages").alias("page")), (questions["exam_id"] == index["exam_id"]) & (F.col("number") == F.col("index_number")))
    best = near.groupBy("item_id").agg(F.min_by("page", F.struct(F.abs(F.col("page") - F.col("hint")), F.col("page"))).alias("found"))
    return questions.join(best, "item_id", "left").withColumn("start_page", F.coalesce("found", "hint")).drop("found")


def unmatched_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.join(links, ["lecture_id", "page_no"], "left_anti")


def unlinked_questions(questions: DataFrame, links: DataFrame) -> DataFrame:
    return questions.join(links, "item_id", "left_anti")


def linked_questions(questions: DataFrame, links: DataFrame) -> DataFrame:
    return questions.join(links, "item_id", "left_semi")


def align_results(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected (job_id, task) with results (job_id, task, failed): a missing one says so."""
    met = expected.join(results.withColumn("there", F.lit(True)), ["job_id", "task"], "left")
    error = F.when(F.col("there").isNull(), "No result").when(F.col("failed"), "failed")
    return met.select("job_id", "task", error.alias("error"))


def attribute_questions(questions: DataFrame, exams: DataFrame) -> DataFrame:
    """(item_id, exam_id) of the owners: by source name, or for questions without one every exam whose pages hold the page.

    An equi-join for the named ones and a range join for the few others; the range join goes over page numbers that
    the exams explode to, so it hashes as well.
    """
    known = exams.select(F.col("exam_id").alias("owner_id"), F.col("exam_name").alias("owner_name"), "page_count")
    named = questions.join(known, F.col("source_name") == F.col("owner_name")).select("item_id", "owner_id")
    untagged = questions.where("source_name IS NULL").select("item_id", "reported_page")
    by_page = known.where("page_count > 0").select("owner_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))).alias("page"))
    ranged = untagged.join(by_page, F.col("reported_page") == F.col("page")).select("item_id", "owner_id")
    open_ended = untagged.join(known.where("page_count IS NULL OR page_count <= 0"), F.lit(True)).select("item_id", "owner_id")
    return named.unionByName(ranged).unionByName(open_ended)


def match_session_files(sessions: DataFrame, files: DataFrame, lectures: DataFrame) -> DataFrame:
    """session_id with the files of its day, at or after its minute, that name a known lecture; without any, the greatest name of the day.

    Sessions meet only files that name a known lecture, within the join only those from their minute on; the rest take the one name of their day.
    """
    days = files.withColumn("day", F.to_date("modified"))
    known = days.withColumn("lecture_name", F.regexp_extract("file_name", r"(lec_\d+\.pdf)", 1)).join(lectures.select("lecture_name"), "lecture_name", "left_semi").select("day", "file_name", F.date_trunc("MINUTE", "modified").alias("minute"))
    asked = sessions.select("session_id", F.to_date("created").alias("day"), F.date_trunc("MINUTE", "created").alias("from_minute"))
    named = asked.join(known, (asked["day"] == known["day"]) & (F.col("minute") >= F.col("from_minute"))).select("session_id", "file_name", F.lit(True).alias("matched"))
    last = days.groupBy("day").agg(F.max("file_name").alias("file_name"))
    rest = asked.join(named.select("session_id").distinct(), "session_id", "left_anti").join(last, "day").groupBy("session_id").agg(F.max("file_name").alias("file_name")).withColumn("matched", F.lit(False))
    return named.unionByName(rest)


def recoverable_sessions(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions with a readable state and at least one chunk file."""
    chunks = files.where("class = 'results'").groupBy("conv_id").agg(F.count("*").alias("n_chunks"))
    return sessions.where(~F.col("status").isin("no_state", "error")).join(chunks, "conv_id")


def tracked_files(listed: DataFrame, tracked: DataFrame) -> DataFrame:
    return listed.intersect(tracked)


def except_center(files: DataFrame, center: DataFrame) -> DataFrame:
    return files.exceptAll(center)


def distinct_inputs(*inputs: DataFrame) -> DataFrame:
    out = inputs[0]
    for more in inputs[1:]:
        out = out.unionByName(more)
    return out.distinct().orderBy(*out.columns)


def union_results(*results: DataFrame) -> DataFrame:
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
