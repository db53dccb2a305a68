"""End-to-end pipelines. Both modes are one links table, grouped two ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import output_name
from ..operators import assemble, joins, merge, relevance, responses, windows
from ..sources.sinks import staged


@dataclass(frozen=True)
class Mode:
    """The name, as in a response's mode and an output's name; the columns that say what a link's primary and secondary are."""

    name: str
    keys: tuple[str, ...]
    others: tuple[str, ...]

    def output(self, document: str):
        return output_name(self.name, F.col(document))


EXAM = Mode("exam", ("item_id",), ("lecture_id", "page_no"))
LECTURE = Mode("lecture", ("lecture_id", "page_no"), ("item_id",))


def prompt_requests(primaries: DataFrame, chunks: DataFrame, template: str) -> DataFrame:
    """One request for each primary document and chunk: the filled template and its id. primaries: primary_name; chunks: secondary_name, start_page, end_page."""
    text = F.lit(template)
    for key in ("primary_name", "secondary_name", "start_page", "end_page"):
        text = F.replace(text, F.lit("{" + key + "}"), F.col(key).cast("string"))
    return joins.fan_out(primaries, chunks).withColumn("prompt", text).withColumn("request_id", F.sha2("prompt", 256))


def grouped(links: DataFrame, mode: Mode) -> DataFrame:
    """Links by the mode's primary side: the greatest score, and the secondary side of each link, best first."""
    each = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("order"), *mode.others, "score")))
    without = F.transform(each, lambda x: F.struct(*[x[c].alias(c) for c in (*mode.others, "score")]))
    return links.groupBy(*mode.keys).agg(F.max("score").alias("importance"), without.alias("links"))


def link_exam_centric(questions: DataFrame, pages: DataFrame, counts: DataFrame, lectures: DataFrame, min_score: int = 50, k: int = 2, scorer="lexical") -> dict[str, DataFrame]:
    links = joins.valid_links(relevance.top_links(relevance.score_links(questions, pages, min_score, scorer), min_score, k), lectures)
    return {"links": links, "groups": grouped(links, EXAM), "summary": merge.summarize(links, questions), "study": assemble.exam_study(questions, links, counts, lectures)}


def link_lecture_centric(questions: DataFrame, pages: DataFrame, counts: DataFrame, min_score: int = 50, scorer="lexical") -> dict[str, DataFrame]:
    links = relevance.score_links(questions, pages, min_score, scorer)
    return {"links": links, "slides": grouped(links, LECTURE), "study": assemble.lecture_study(pages, links, questions, counts)}


def exam_only(questions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """With the exam's pages each question is the text of its region: from its heading, looked up next to its page, to the next one."""
    started = windows.next_question_start(questions)
    if pages is None:
        return assemble.exam_only(started)
    asked = started.withColumn("number", F.col("question_number")).withColumn("hint", F.col("exam_page"))
    return assemble.exam_only(joins.nearest_page(asked, merge.question_index(pages)).drop("number", "hint"), windows.question_regions(pages))


def partial_exam(questions: DataFrame, pages: DataFrame, regions: bool = False) -> DataFrame:
    """questions with number and hint: their pages are looked up in the exam's pages; with regions their text is cut from these."""
    found = joins.nearest_page(questions, merge.question_index(pages))
    return assemble.partial_exam(found.drop("number", "hint"), windows.question_regions(pages)) if regions else assemble.partial_exam(found)


def recover(results: DataFrame, min_score: int = 50, k: int = 2, details: DataFrame | None = None, counts: DataFrame | None = None, lectures: DataFrame | None = None) -> dict[str, DataFrame]:
    """From chunk results (as merge_by_question takes them): questions merged by number that have links, their best links, the
    questions of each page, and a summary; with details (item_id, exam_name, answer, explanation, wrong_answers), the exams' page counts and the
    lectures also the study document. There a question stands on the page where it was first reported."""
    keys, results = ("exam_id", "question_number"), merge.without_errors(results)
    # links are read from the results, not from lists of all that a question has
    merged = staged(merge.first_results(results, keys))
    each = merge.with_keys(results, merged.select(*keys, F.col("first.item_id").alias("first_item")), keys, "first_item").select(F.col("first_item").alias("item_id"), "lecture_id", "page_no", "score")
    links = staged(relevance.top_links(relevance.dedupe_links(each), min_score, k))
    questions = joins.linked_questions(merged.select("exam_id", "question_number", "first.*"), links)
    out = {"questions": questions, "links": links, "pages": merge.nest_by_page(questions), "summary": merge.summarize(links, questions)}
    if details is not None:
        told = questions.join(details.select("item_id", "exam_name", "answer", "explanation", "wrong_answers"), "item_id")
        out["study"] = assemble.exam_study(told, joins.valid_links(links, lectures), counts, lectures)
    return out


def recover_responses(rows: DataFrame) -> DataFrame:
    return responses.parse_responses(rows)


def register(views: dict[str, DataFrame]) -> None:
    """Results as temporary views for spark.sql."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
