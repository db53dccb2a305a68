"""Window operators over questions and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import staged


def last_on_page(questions: DataFrame) -> DataFrame:
    order = Window.partitionBy("exam_id", "exam_page").orderBy("question_number")
    return questions.withColumn("is_last", F.lead("question_number").over(order).isNull())


def question_extent(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """start_page and end_page: an explicit end, else the next page for the last question of a page that has one, else the page.

    An end that the exam doesn't have, or before the start, becomes the start. Starts out of range are dropped.
    """
    met = last_on_page(questions).join(counts.select("exam_id", "page_count"), "exam_id").where(F.col("exam_page").between(F.lit(1), F.col("page_count")))
    explicit = F.col("explicit_end") if "explicit_end" in questions.columns else F.lit(None).cast("long")
    guess = F.coalesce(explicit, F.when(F.col("is_last") & (F.col("exam_page") < F.col("page_count")), F.col("exam_page") + 1).otherwise(F.col("exam_page")))
    end = F.when((guess > F.col("page_count")) | (guess < F.col("exam_page")), F.col("exam_page")).otherwise(guess)
    return met.withColumn("start_page", F.col("exam_page")).withColumn("end_page", end)


def next_question_start(questions: DataFrame) -> DataFrame:
    order = Window.partitionBy("exam_id").orderBy("exam_page", "question_number")
    return questions.withColumn("next_start", F.lead("exam_page").over(order))


#: A line that begins a question, and its number.
HEADING = r"^\s*(\d+)[.)번]"
#: Pages that one task goes through to carry headings forward.
BLOCK_PAGES = 64


def heading_number(line: Column) -> Column:
    """The number that a line begins a question with; null for other lines, and for numbers under 1."""
    number = F.regexp_extract(line, HEADING, 1).try_cast("bigint")
    return F.when(number > 0, number)


def page_segments(text: Column) -> Column:
    """A page's text cut at its headings: structs (line, number, text); what comes before the first heading has line 0 and no number."""
    lines = F.split(text, "\n", -1)
    numbers = F.transform(lines, heading_number)
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(numbers, i - 1).isNotNull())
    cut = lambda a, b: F.array_join(F.slice(lines, a, b - a), "\n")
    end_of = lambda k: F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
    before = F.coalesce(F.get(starts, F.lit(0)), F.size(lines) + 1)
    lead = F.when(before > 1, F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit(None).cast("long").alias("number"), cut(F.lit(1), before).alias("text"))))
    headed = F.transform(starts, lambda i, k: F.struct(i.cast("long").alias("line"), F.get(numbers, i - 1).alias("number"), cut(i, end_of(k)).alias("text")))
    return F.concat(F.coalesce(lead, F.array().cast("array<struct<line:bigint,number:bigint,text:string>>")), headed)


def heads_of(last: Column) -> Column:
    """The heading of a page's last segment; null where that has none."""
    return F.when(last["number"].isNotNull(), F.struct(last["number"].alias("number"), F.col("page_no").alias("start_page"), last["line"].alias("start_line")))


def question_regions(pages: DataFrame) -> DataFrame:
    """The text of each question from its heading to the next one, over as many pages as lie between, a row for each page of it.

    pages: exam_id, page_no, page_text. Gives exam_id, number, start_page, start_line, page_no, part. What stands before an exam's first
    heading belongs to no question. The last heading of each page is carried to the pages after it that begin without one: within blocks of
    pages first, then from block to block, so an exam with a great share of all pages is gone through by many tasks.
    """
    cut = pages.withColumn("block", F.expr(f"(page_no - 1) div {BLOCK_PAGES}")).withColumn("segments", page_segments(F.col("page_text")))
    cut = cut.withColumn("head", heads_of(F.element_at("segments", -1)))
    in_block = Window.partitionBy("exam_id", "block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy("exam_id", "block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("page_no"))).alias("block_head"))
    by_block = Window.partitionBy("exam_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("exam_id", "block", F.last("block_head", ignorenulls=True).over(by_block).alias("carried"))
    held = cut.select("exam_id", "page_no", "block", "segments", F.last("head", ignorenulls=True).over(in_block).alias("held")).join(carried, ["exam_id", "block"])
    parts = held.select("exam_id", "page_no", F.coalesce("held", "carried").alias("open"), F.inline("segments"))
    own = F.struct("number", F.col("page_no").alias("start_page"), F.col("line").alias("start_line"))
    met = parts.select("exam_id", F.when(F.col("number").isNotNull(), own).otherwise(F.col("open")).alias("region"), "page_no", F.col("text").alias("part"))
    return met.where("region IS NOT NULL").select("exam_id", "region.*", "page_no", "part")


def numbered(rows: DataFrame, group: str, major: str, *order: str, width: int = 4096) -> DataFrame:
    """rows with `seq` from 1 in each group, in the order of major, a whole number, and order.

    Stretches of `width` values of major are numbered apart and the rows of those before added, so one long group is dealt over many tasks.
    rows is written once, as it is gone through twice. A null group is one of its own; a null major comes first in its group.
    """
    dealt = staged(rows).withColumn("stretch", F.expr(f"coalesce(floor({major} / {width}), {-(2**62)})"))
    before = Window.partitionBy(group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(group, "stretch").agg(F.count("*").alias("n")).select(group, "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(group, "stretch").orderBy(major, *order))
    offsets = offsets.withColumnRenamed(group, "of_group").withColumnRenamed("stretch", "of_stretch")
    met = dealt.withColumn("place", place).join(offsets, F.col(group).eqNullSafe(F.col("of_group")) & (F.col("stretch") == F.col("of_stretch")))
    return met.withColumn("seq", (F.col("offset") + F.col("place")).cast("long")).select(*rows.columns, "seq")


def question_groups(questions: DataFrame, counts: DataFrame, size: int = 20) -> DataFrame:
    """Ordinal groups of questions with their first and last page and number; an exam without questions is one group."""
    order = Window.partitionBy("exam_id").orderBy("exam_page", "question_number")
    numbered = questions.withColumn("group_no", F.floor((F.row_number().over(order) - 1) / size))
    groups = numbered.groupBy("exam_id", "group_no").agg(F.min("exam_page").alias("start_page"), F.max("exam_page").alias("end_page"), F.min("question_number").alias("first_question"), F.max("question_number").alias("last_question"))
    met = counts.select("exam_id", "page_count").join(groups, "exam_id", "left")
    return met.select("exam_id", F.coalesce("group_no", F.lit(0)).cast("long").alias("group_no"), F.coalesce("start_page", F.lit(1)).alias("start_page"), F.coalesce("end_page", "page_count").alias("end_page"), F.coalesce("first_question", F.lit(1)).alias("first_question"), F.coalesce("last_question", F.lit(size)).alias("last_question"))


def chunk_pages(counts: DataFrame, max_pages: int = 40) -> DataFrame:
    """Ranges of at most max_pages pages: chunk_no from 0, start_page, end_page, both inclusive."""
    starts = counts.where("page_count > 0").select("lecture_id", "page_count", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("page_count"), F.lit(max_pages).cast("long"))).alias("chunk_no", "start_page"))
    return starts.select("lecture_id", F.col("chunk_no").cast("long").alias("chunk_no"), "start_page", F.least(F.col("start_page") + max_pages - 1, F.col("page_count")).alias("end_page"))


def first_by_number(questions: DataFrame, number: str = "raw_number") -> DataFrame:
    """One entry for each number of an exam: the first by page."""
    order = Window.partitionBy("exam_id", number).orderBy("exam_page", "item_id")
    return questions.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
