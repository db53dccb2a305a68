"""Views of the exam and lecture world on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relevance import score_links
from .tables import page_counts, pages_of, read_table

AS_OF = "2024-02-01 00:00:00"
#: Amid the calls.
CALLS_AS_OF = "2024-01-20 12:00:00"


def as_of():
    return F.expr(f"TIMESTAMP_NTZ'{AS_OF}'")


def calls_as_of():
    return F.expr(f"TIMESTAMP_NTZ'{CALLS_AS_OF}'")


def lecture_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_of(read_table(spark, sf, "documents"))


def lectures(spark: SparkSession, sf: str) -> DataFrame:
    return page_counts(lecture_pages(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("item_id") % 20 + 1
    answer = F.col("item_id") % 5 + 1
    wrong = F.map_from_entries(F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: k != answer), lambda k: F.struct(F.concat(k.cast("string"), F.lit("번")), F.concat(F.lit("not "), k.cast("string")))))
    return read_table(spark, sf, "benchmark").select(
        "item_id", F.expr("item_id div 20").alias("exam_id"), F.concat(F.lit("exam_"), F.expr("item_id div 20"), F.lit(".pdf")).alias("exam_name"), number.alias("question_number"),
        (F.expr("(item_id % 20) div 5") + 1).alias("exam_page"), F.coalesce("text", F.lit("")).alias("question_text"), answer.cast("string").alias("answer"),
        F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("explanation"), wrong.alias("wrong_answers"),
    )


def exam_pages(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("question_number").cast("string"), F.lit(". "), F.replace("question_text", F.lit("\n"), F.lit(" ")))
    lines = F.array_sort(F.collect_list(F.struct("question_number", line.alias("line"))))
    return questions(spark, sf).groupBy("exam_id", "exam_name", F.col("exam_page").alias("page_no")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("page_text"))


SCAN_CHARS, SCAN_LINES = 60, 15


def exam_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The exams as scanned: a title, then each question from its number on in lines of 60 characters, 15 lines a page, so questions run on over pages."""
    text = F.replace("question_text", F.lit("\n"), F.lit(" "))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(text) / SCAN_CHARS)).cast("int") - 1)
    lines = F.transform(cuts, lambda k: F.concat(F.when(k == 0, F.concat(F.col("question_number").cast("string"), F.lit(". "))).otherwise(""), F.substring(text, k * SCAN_CHARS + 1, F.lit(SCAN_CHARS))))
    exams = questions(spark, sf).groupBy("exam_id", "exam_name").agg(F.array_sort(F.collect_list(F.struct("question_number", lines.alias("lines")))).alias("qs"))
    whole = exams.select("exam_id", "exam_name", F.concat(F.array(F.concat(F.lit("Exam "), "exam_id")), F.flatten(F.transform("qs", lambda q: q["lines"]))).alias("lines"))
    numbers = F.sequence(F.lit(1), F.ceil(F.size("lines") / SCAN_LINES).cast("int"))
    pages = F.transform(numbers, lambda p: F.struct(p.cast("long").alias("page_no"), F.array_join(F.slice("lines", (p - 1) * SCAN_LINES + 1, F.lit(SCAN_LINES)), "\n").alias("page_text")))
    return whole.select("exam_id", "exam_name", F.inline(pages))


def exam_page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).groupBy("exam_id", "exam_name").agg(F.max("exam_page").alias("page_count"))


def reported_questions(spark: SparkSession, sf: str) -> DataFrame:
    """questions with wrong pages, missing sources and odd numbers."""
    off = F.when(F.col("item_id") % 7 == 0, 4).otherwise(0) - F.when(F.col("item_id") % 11 == 0, 4).otherwise(0)
    return questions(spark, sf).select(
        "*", (F.col("exam_page") + off).alias("reported_page"), F.when(F.col("item_id") % 9 != 0, F.col("exam_name")).alias("source_name"),
        F.when(F.col("item_id") % 13 == 0, "번호없음").otherwise(F.concat(F.col("question_number").cast("string"), F.lit("번"))).alias("raw_number"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    return score_links(questions(spark, sf), lecture_pages(spark, sf), 50)


def chunk_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links from 25 up as chunks of 40 pages report them; some twice."""
    found = score_links(questions(spark, sf), lecture_pages(spark, sf), 25)
    twice = found.withColumn("copy", F.explode(F.when(F.col("item_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    chunk = F.expr("(page_no - 1) div 40")
    return twice.select("*", chunk.alias("chunk_no"), (F.expr("(page_no - 1) % 40") + 1).alias("local_page"), (F.col("lecture_id") * 1000 + chunk).alias("input_order"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """An exam's pages as JSON text; every other one is cut after 70 % of its characters. Every sixth question has no answer."""
    answer = F.when(F.col("item_id") % 6 == 0, "").otherwise(F.concat(F.lit(',"answer":"'), F.col("answer"), F.lit('"')))
    one = F.concat(F.lit('{"question_number":"'), F.col("question_number").cast("string"), F.lit('","question_text":"'), F.md5("question_text"), F.lit('"'), answer, F.lit("}"))
    pages = questions(spark, sf).groupBy("exam_id", "exam_page").agg(F.array_sort(F.collect_list(F.struct("question_number", one.alias("q")))).alias("qs"))
    page = F.concat(F.lit('{"exam_page":'), F.col("exam_page").cast("string"), F.lit(',"questions":['), F.array_join(F.transform("qs", lambda x: x["q"]), ","), F.lit("]}"))
    text = F.concat(F.lit('{"exam_pages":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exam_page", page.alias("p")))), lambda x: x["p"]), ","), F.lit('],"summary":{"done":true}}'))
    return pages.groupBy("exam_id").agg(text.alias("whole")).select(F.col("exam_id").alias("response_id"), F.when(F.col("exam_id") % 2 == 1, F.substring(F.col("whole"), F.lit(1), F.expr("cast(length(whole) * 7 div 10 as int)"))).otherwise(F.col("whole")).alias("text"))


def slide_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The same for lecture pages: each exam page as a slide of some importance and two concepts."""
    slide = F.concat(F.lit('{"lecture_page":'), F.col("exam_page").cast("string"), F.lit(',"importance":'), (F.col("exam_page") * 20 + 5).cast("string"), F.lit(',"key_concepts":["c'), F.col("exam_page").cast("string"), F.lit('","e'), F.col("exam_id").cast("string"), F.lit('"]}'))
    text = F.concat(F.lit('{"related_slides":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exam_page", slide.alias("s")))), lambda x: x["s"]), ","), F.lit("]}"))
    whole = questions(spark, sf).select("exam_id", "exam_page").distinct().groupBy("exam_id").agg(text.alias("whole"))
    return whole.select(F.col("exam_id").alias("response_id"), F.when(F.col("exam_id") % 2 == 1, F.substring(F.col("whole"), F.lit(1), F.expr("cast(length(whole) * 7 div 10 as int)"))).otherwise(F.col("whole")).alias("text"))


#: What stands before and behind an exam page's key in a messy response: marks within strings, nested objects with the same key.
MESSY_BEFORE = ("", '"note":"p} {\\"q\\": [ \\\\",', '"meta":{"exam_page":99,"tags":["]","{"]},')
MESSY_AFTER = ("", ',"tail":[[],[{"exam_page":98}]]', ',"end":"\\"]}"')


def messy_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses like those above, in which a page's keys stand in several orders and strings hold marks of JSON, each cut after a
    number of characters that depends on its id. For each exam there is one with pages and one with slides."""
    one = F.concat(F.lit('{"question_number":"'), F.col("question_number").cast("string"), F.lit('","question_text":"{'), F.md5("question_text"), F.lit('","answer":"'), F.col("answer"), F.lit(']"}'))
    qs = questions(spark, sf).groupBy("exam_id", "exam_page").agg(F.array_sort(F.collect_list(F.struct("question_number", one.alias("q")))).alias("qs"))
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("exam_page") % 3 + 1).cast("int"))
    page = F.concat(F.lit("{"), pick(MESSY_BEFORE), F.lit('"exam_page":'), F.col("exam_page").cast("string"), F.lit(',"questions":['), F.array_join(F.transform("qs", lambda x: x["q"]), ","), F.lit("]"), pick(MESSY_AFTER), F.lit("}"))
    slide = F.concat(F.lit("{"), F.replace(pick(MESSY_BEFORE), F.lit("exam_page"), F.lit("lecture_page")), F.lit('"importance":'), (F.col("exam_page") * 20 + 5).cast("string"), F.lit(',"key_concepts":["c}'), F.col("exam_page").cast("string"), F.lit('"],"lecture_page":'), F.col("exam_page").cast("string"), F.lit("}"))
    parts = qs.select("exam_id", "exam_page", F.inline(F.array(F.struct(F.lit("exam_pages").alias("list"), page.alias("part")), F.struct(F.lit("related_slides").alias("list"), slide.alias("part")))))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exam_page", "part"))), lambda x: x["part"]), ",")
    whole = parts.groupBy("exam_id", "list").agg(listed.alias("parts")).select("exam_id", "list", F.concat(F.lit('{"summary":{"done":[]},"'), "list", F.lit('":['), "parts", F.lit("]}")).alias("whole"))
    kept = F.expr("cast(length(whole) * (20 + exam_id * 37 % 80) div 100 as int)")
    return whole.select(F.concat("list", F.lit("_"), "exam_id").alias("response_id"), "exam_id", "list", F.substring(F.col("whole"), F.lit(1), kept).alias("text"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("try_cast(get_json_object(props, '$.k') as bigint) % 5")
    error = F.element_at(F.array(*map(F.lit, ("429 quota exceeded", "403 permission denied", "request timeout", "invalid api key", "internal error"))), (kind + 1).cast("int"))
    return read_table(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).alias("key_id"), F.expr("event_id div 3").alias("request_id"), (F.col("event_id") % 3).alias("attempt"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", error).alias("error"), F.when(F.col("event_type") == "signup", "MAX_TOKENS").when(F.col("event_type") == "purchase", "SAFETY").otherwise("STOP").alias("finish_reason"), F.col("user_id").alias("job_id"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.sum((F.col("role") == "user").cast("long")).alias("total_chunks"))
    created = F.expr("timestampadd(HOUR, conv_id * 7, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    status = F.when(F.col("conv_id") % 10 == 0, "no_state").when(F.col("conv_id") % 10 == 1, "error").when(F.col("last_role") == "assistant", "complete").otherwise("processing")
    return last.select("conv_id", "total_chunks", created.alias("created"), F.concat(F.date_format(created, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 6)).alias("session_id"), status.alias("status"))


def session_files(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    role = F.col("role")
    return turns.select(
        "conv_id", "turn", F.when(role == "assistant", "results").when(role == "user", "debug").otherwise("sessions").alias("class"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.expr("timestampadd(HOUR, conv_id * 7 + turn, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("modified"), F.concat(F.lit("chunk_"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit("_lec_"), F.col("conv_id") % 50, F.lit(".pdf.json")).alias("file_name"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    ids = read_table(spark, sf, "conversations").select("conv_id").distinct()
    digest = F.md5(F.col("conv_id").cast("string"))
    return ids.select(
        F.col("conv_id").alias("job_id"), F.array(F.concat(F.lit("exam:"), F.col("conv_id"), F.lit(":exam_"), F.col("conv_id") % 2, F.lit(".pdf:"), digest)).alias("exam_keys"),
        F.array(F.concat(F.lit("lecture:"), F.col("conv_id"), F.lit(":lec_"), F.col("conv_id") % 50, F.lit(".pdf:"), digest)).alias("lecture_keys"),
        F.when(F.col("conv_id") % 2 == 0, "pro").otherwise("flash").alias("model"), (F.lit(50) + 5 * (F.col("conv_id") % 5)).alias("min_relevance"),
    )


def chunk_status(spark: SparkSession, sf: str) -> DataFrame:
    return session_files(spark, sf).where("class = 'results'").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("chunk_no"), "file_name", (F.col("turn") % 5 == 3).alias("failed"))


def expected_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg(F.sum((F.col("role") == "user").cast("long")).alias("expected"))


#: A response for each document; its page as SQL that Spark and DuckDB share: numbers as texts and texts as numbers, keys that are unknown, missing or
#: null, lists that are objects, and texts that end too early.
DRIFTING_PAGE = """'{"exam_page":' || CASE WHEN doc_id % 2 = 0 THEN '"' || (doc_id % 9 + 1) || '"' ELSE '' || (doc_id % 9 + 1) END || CASE WHEN doc_id % 5 = 0 THEN ',"note":{"page":[1,null]}' ELSE '' END
    || ',"questions":[{"question_number":' || CASE WHEN doc_id % 3 = 0 THEN '' || (doc_id % 20 + 1) ELSE '"' || (doc_id % 20 + 1) || '"' END || ',"question_text":"' || md5(coalesce(text, '')) || '"'
    || CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN ',"answer":null' WHEN doc_id % 7 = 2 THEN ',"answer":2.5' ELSE ',"answer":"3"' END || CASE WHEN doc_id % 4 = 0 THEN ',"sure":true' ELSE '' END || '}]}'"""


def drifting_responses(spark: SparkSession, sf: str) -> DataFrame:
    page = F.expr(DRIFTING_PAGE)
    odd = F.when(F.col("doc_id") % 11 == 3, '{"exam_pages":{"a":1}}').when(F.col("doc_id") % 11 == 4, "[1,2]")
    more = ',{"exam_page":77,"questions":[{"question_number":"1","question_text":"t","answer":"1"}]},'
    whole = odd.otherwise(F.concat(F.lit('{"exam_pages":['), page, F.lit(more), page, F.lit('],"model":"m"}')))
    rows = read_table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("response_id"), whole.alias("whole"))
    return rows.select("response_id", F.when(F.col("response_id") % 6 == 1, F.expr("substr(whole, 1, cast(floor(length(whole) * 0.7) as int))")).otherwise(F.col("whole")).alias("text"))
