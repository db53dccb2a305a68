"""Ordered study documents as rows (output_name, seq, kind, ...). Rendering them is left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import explanation_text, output_name
from .joins import page_spine
from .windows import first_by_number, numbered, question_extent

#: Order of the rows of one question, and of the summary.
PAGE, QUESTION, SLIDE, TEXT, SUMMARY = 0, 1, 2, 3, 9
LAST = 2**62


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place in each output; a very long output is numbered by many tasks."""
    return numbered(rows, "output_name", "major", *order)


def row(kind: int, name: Column, a: Column, b: Column, doc: Column, page: Column, text: Column) -> list[Column]:
    return [name.alias("output_name"), a.cast("long").alias("major"), b.cast("long").alias("minor"), F.lit(kind).cast("long").alias("kind"), doc.cast("string").alias("doc_name"), page.cast("long").alias("page_no"), text.cast("string").alias("text")]


def one(*args) -> Column:
    return F.array(F.struct(*row(*args)))


def pages_of(make) -> Column:
    """Rows for the exam pages of a question; make: from a page to its columns."""
    return F.transform(F.sequence("start_page", "end_page"), lambda p: F.struct(*make(p)))


def lecture_study(pages: DataFrame, links: DataFrame, questions: DataFrame, counts: DataFrame) -> DataFrame:
    """For each lecture every page; behind it, for each linked question the exam's pages and an explanation; a summary last."""
    name = output_name("lecture", F.col("lecture_name"))
    null = F.lit(None)
    linked = page_spine(pages, links).where("item_id IS NOT NULL").select("lecture_name", "page_no", "item_id", *[c for c in ("reason",) if c in links.columns])
    base = pages.select(*row(PAGE, name, F.col("page_no"), F.lit(0), F.col("lecture_name"), F.col("page_no"), null))
    met = linked.join(question_extent(questions, counts).drop("page_no"), "item_id")
    reason = F.concat(F.lit("Lecture page: "), F.col("page_no").cast("string"), *([F.coalesce(F.concat(F.lit(". "), F.col("reason")), F.lit(""))] if "reason" in links.columns else []))
    text = explanation_text(F.col("question_number").cast("string"), F.col("exam_name"), F.col("exam_page"), F.col("answer"), F.col("explanation"), F.col("wrong_answers"), reason=reason)
    asked = pages_of(lambda p: row(QUESTION, name, F.col("page_no"), F.col("item_id"), F.col("exam_name"), p, null))
    told = met.select(F.inline(F.concat(asked, one(TEXT, name, F.col("page_no"), F.col("item_id"), null, null, text))))
    sums = linked.groupBy("lecture_name").agg(F.countDistinct("page_no").alias("p"), F.count("*").alias("q"))
    last = sums.select(*row(SUMMARY, name, F.lit(LAST), F.lit(0), null, null, F.concat(F.lit("Linked pages: "), F.col("p"), F.lit(", questions: "), F.col("q"))))
    return ordered(base.unionByName(told).unionByName(last), "minor", "kind", "page_no")


def exam_study(questions: DataFrame, links: DataFrame, counts: DataFrame, lectures: DataFrame) -> DataFrame:
    """For each exam its linked questions by number: exam pages, best lecture pages, explanation; a summary last."""
    name = output_name("exam", F.col("exam_name"))
    null = F.lit(None)
    number, item = F.col("question_number"), F.col("item_id")
    reason = F.col("reason") if "reason" in links.columns else F.lit(None).cast("string")
    named = links.withColumn("reason", reason).join(lectures.select("lecture_id", "lecture_name"), "lecture_id")
    best = F.array_sort(F.collect_list(F.struct("rank", "lecture_name", F.col("page_no").alias("lecture_page"), "score", "reason")))
    per_question = named.groupBy("item_id").agg(F.transform(best, lambda x: F.struct(*[x[c].alias(c) for c in ("lecture_name", "lecture_page", "score", "reason")])).alias("links"))
    kept = first_by_number(questions, "question_number").join(per_question, "item_id")
    met = kept.join(question_extent(questions, counts).select("item_id", "start_page", "end_page"), "item_id")
    asked = pages_of(lambda p: row(QUESTION, name, number, item, F.col("exam_name"), p, null))
    slides = F.transform("links", lambda x, i: F.struct(*row(SLIDE, name, number, item, x["lecture_name"], x["lecture_page"], F.concat(F.lit("#"), (i + 1).cast("string")))))
    text = explanation_text(number.cast("string"), F.col("exam_name"), F.col("exam_page"), F.col("answer"), F.col("explanation"), F.col("wrong_answers"), links=F.col("links"))
    told = met.select(F.inline(F.concat(asked, slides, one(TEXT, name, number, item, null, null, text))))
    last = met.groupBy("exam_name").agg(F.countDistinct("exam_page").alias("p"), F.count("*").alias("q"), F.sum(F.size("links")).alias("l")).select(*row(SUMMARY, name, F.lit(LAST), F.lit(0), null, null, F.concat(F.lit("Pages: "), F.col("p"), F.lit(", questions: "), F.col("q"), F.lit(", links: "), F.col("l"))))
    return ordered(told.unionByName(last), "minor", "kind", "text", "page_no", "doc_name")


def region_parts(questions: DataFrame, regions: DataFrame) -> DataFrame:
    """questions (exam_id, question_number, start_page) with page_no and part: a row for each page of the question's region, which begins with the
    first heading of its number on its start page; where there is none, the start page and no part."""
    place = Window.partitionBy("exam_id", "number", "start_page")
    first = regions.withColumn("first_line", F.min("start_line").over(place)).where("start_line = first_line").select("exam_id", F.col("number").alias("question_number"), "start_page", "page_no", "part")
    return questions.join(first, ["exam_id", "question_number", "start_page"], "left").withColumn("page_no", F.coalesce("page_no", "start_page"))


def told_text(questions: DataFrame, page: str) -> Column:
    background = F.col("background") if "background" in questions.columns else None
    return explanation_text(F.col("question_number").cast("string"), F.col("exam_name"), F.col(page), F.col("answer"), F.col("explanation"), F.col("wrong_answers"), background=background)


def exam_only(questions: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Each question, then its explanation, by (page, next start with null last, number).

    The question is its page; with regions (of `question_regions`; questions then have a start_page) it is the text of each page of its region.
    A column background goes into the explanation.
    """
    name = output_name("exam_only", F.col("exam_name"))
    order = F.struct(F.col("exam_page"), F.coalesce("next_start", F.lit(10**9)).alias("n"), F.col("question_number"))
    ranked = questions.withColumn("ord", F.row_number().over(Window.partitionBy("exam_id").orderBy(order)).cast("long"))
    null = F.lit(None)
    if regions is None:
        asked = ranked.select(*row(QUESTION, name, F.col("ord"), F.col("item_id"), F.col("exam_name"), F.col("exam_page"), null))
    else:
        asked = region_parts(ranked, regions).select(*row(QUESTION, name, F.col("ord"), F.col("item_id"), F.col("exam_name"), F.col("page_no"), F.col("part")))
    told = ranked.select(*row(TEXT, name, F.col("ord"), F.col("item_id"), null, null, told_text(questions, "exam_page")))
    return ordered(asked.unionByName(told), "minor", "kind", "page_no")


def partial_exam(questions: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """questions (with start_page resolved): the page, or with regions the text of each page of the question's region, and the explanation only."""
    name = F.lit("partial_exam")
    told = questions.select(*row(TEXT, name, F.col("item_id"), F.lit(0), F.lit(None), F.lit(None), F.coalesce("explanation", F.lit(""))))
    if regions is not None:
        asked = region_parts(questions, regions).select(*row(QUESTION, name, F.col("item_id"), F.lit(0), F.col("exam_name"), F.col("page_no"), F.col("part")))
        return ordered(asked.unionByName(told), "kind", "page_no")
    asked = questions.select(*row(QUESTION, name, F.col("item_id"), F.lit(0), F.col("exam_name"), F.col("start_page"), F.lit(None)))
    rows = asked.unionByName(told)
    # one output for all questions: numbered by item, two rows each, without a window over everything
    return rows.withColumn("seq", F.col("major") * 2 + F.when(F.col("kind") == QUESTION, 1).otherwise(2))
