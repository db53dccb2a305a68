"""Column functions. They are built from Spark's own and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_page(page: Column, start: Column) -> Column:
    """Chunk-local to absolute page."""
    return page + start - 1


def offset_nested(exam_pages: Column, start: Column) -> Column:
    """The same for the lecture pages inside exam pages, their questions and links."""
    links = lambda q: q.withField("links", F.transform(q["links"], lambda s: s.withField("lecture_page", offset_page(s["lecture_page"], start))))
    return F.transform(exam_pages, lambda p: p.withField("questions", F.transform(p["questions"], links)))


def adjust_chunk_page(page: Column, start: Column, end: Column, total: Column) -> Column:
    """The absolute page, or null if the page isn't in the chunk or lies behind the document."""
    return F.when((page >= 1) & (page <= end - start + 1) & (page + start - 1 <= total), page + start - 1)


def page_in_range(page: Column, total: Column) -> Column:
    return page.between(F.lit(1), total)


def clamp_start(start: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.least(start, total))


def clamp_end(start: Column, end: Column, total: Column) -> Column:
    return F.greatest(clamp_start(start, total), F.least(end, total))


def snap_score(x: Column) -> Column:
    """Onto 5 to 100 in steps of 5; 110 stays. Null stays null."""
    return F.when(x >= 110, 110).when(x.isNotNull(), F.greatest(F.lit(5), F.least(F.lit(100), F.floor(x / 5) * 5))).cast("long")


#: The least score of each band.
BANDS = ((110, "verbatim"), (90, "core"), (70, "direct"), (50, "useful"), (25, "indirect"), (5, "weak"))


def score_band(score: Column) -> Column:
    out = F
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("none")


def score_badge(score: Column) -> Column:
    text = F.concat(score.cast("string"), F.lit("/100"))
    return F.when(score >= 95, F.concat(text, F.lit(" ★"))).when(score >= 90, F.concat(text, F.lit(" ◎"))).otherwise(text)


def question_sort_key(number: Column) -> Column:
    """The first digits; null without any, to be sorted last."""
    return F.regexp_extract(number, r"(\d+)", 1).try_cast("bigint")


def leading_number(number: Column) -> Column:
    """The first word if it is a whole number, else null."""
    return F.regexp_extract(F.trim(number), r"^(\d+)(?:\s|$)", 1).try_cast("bigint")


def is_valid_pdf_name(name: Column) -> Column:
    return F.coalesce((F.length(name) > 0) & ~name.contains("..") & ~name.contains("/") & ~name.contains("\\") & F.lower(name).endswith(".pdf") & (F.length(name) <= 255), F.lit(False))


def sanitize_name(name: Column) -> Column:
    """Separators, then double dots, then other unsafe characters become `_`; a `.pdf` ending is kept."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[/\\]", "_"), r"\.\.", "_"), '[<>:"|?*\\x00]', "_")
    return F.when(F.lower(name).endswith(".pdf") & ~F.lower(clean).endswith(".pdf"), F.concat(clean, F.lit(".pdf"))).otherwise(clean)


def session_created(session_id: Column) -> Column:
    return F.try_to_timestamp(F.substring(session_id, 1, 15), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def session_suffix(session_id: Column) -> Column:
    return F.split_part(session_id, F.lit("_"), F.lit(3))


#: Output names by mode.
OUTPUT_NAMES = {"lecture": ("filtered_", "_all_exams"), "exam": ("exam_centric_", "_all_lectures"), "exam_only": ("exam_only_", ""), "recovered": ("recovered_", "")}


def output_name(mode: str, name: Column) -> Column:
    before, after = OUTPUT_NAMES[mode]
    return F.concat(F.lit(before), F.regexp_replace(name, r"\.pdf$", ""), F.lit(after))


def classify_error(message: Column) -> Column:
    """struct(class, retry_after, retryable)."""
    low = F.lower(message)
    has = lambda *words: low.rlike("|".join(words))
    as_struct = lambda name, after, again: F.struct(F.lit(name).alias("class"), F.lit(after).cast("long").alias("retry_after"), F.lit(again).alias("retryable"))
    return (
        F.when(has("quota", "rate limit", "429"), as_struct("quota", 60, True))
        .when(has("timeout"), as_struct("timeout", None, True))
        .when(has("authentication", "api key"), as_struct("authentication", None, False))
        .when(has("403", "permission"), as_struct("permission", None, False))
        .when(has("encrypted", "password"), as_struct("encrypted", None, False))
        .when(has("corrupt", "invalid"), as_struct("corrupt", None, False))
        .when(low.contains("page") & low.contains("not found"), as_struct("missing_page", None, False))
        .otherwise(as_struct("other", None, False))
    )


def classify_finish(text: Column, reason: Column, attempt: Column, most: int = 3) -> Column:
    """What to do with a response; attempts count from 0."""
    last = attempt >= most - 1
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.when(last, "fail").otherwise("retry"))
        .when(reason.contains("MAX_TOKENS") | (reason == "2"), "accept_truncated")
        .when(reason.contains("SAFETY") | (reason == "3"), F.when(last, "accept_blocked").otherwise("retry"))
        .otherwise("accept")
    )


def backoff_seconds(attempt: Column, most: int = 3) -> Column:
    """2 ** attempt; none after the last."""
    return F.when(attempt < most - 1, F.pow(F.lit(2), attempt).cast("long"))


def token_budget(model: Column, chunks: Column, flash: int = 1, pro: int = 4) -> Column:
    return F.when(F.lower(model) == "pro", pro).otherwise(flash).cast("long") * F.greatest(F.lit(1), chunks)


def age_days(created: Column, as_of: Column) -> Column:
    return F.timestamp_diff("DAY", created, as_of)


def age_hours(created: Column, as_of: Column) -> Column:
    return F.timestamp_diff("HOUR", created, as_of)


def size_mb(size: Column) -> Column:
    return F.round(size / 1048576, 1)


def explanation_text(number: Column, source: Column, page: Column, answer: Column, explanation: Column, wrong: Column, links: Column | None = None, reason: Column | None = None, background: Column | None = None) -> Column:
    """The study text of a question; missing parts leave no line. wrong: a map; links: an array of (lecture_name, lecture_page, score, reason), best first; a link without a reason gets no line of it."""
    choices = F.array_join(F.transform(F.array_sort(F.map_entries(wrong)), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n")
    parts = [
        F.concat(F.lit("=== Question "), number, F.lit(" ===")),
        F.concat(F.lit("[Source: "), source, F.lit(", page "), page.cast("string"), F.lit("]")),
        F.concat(F.lit("Answer: "), answer),
        F.when(F.length(explanation) > 0, F.concat(F.lit("Explanation:\n"), explanation)),
        None if background is None else F.when(F.length(background) > 0, F.concat(F.lit("Background:\n"), background)),
        F.when(F.size(wrong) > 0, F.concat(F.lit("Other choices:\n"), choices)),
        reason,
    ]
    if links is not None:
        lines = F.transform(links, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["lecture_name"], F.lit(", page "), x["lecture_page"].cast("string"), F.lit(" ("), score_badge(x["score"]), F.lit(")"), F.coalesce(F.concat(F.lit("\n   "), x["reason"]), F.lit(""))))
        parts += [F.concat(F.lit("Lecture pages:\n"), F.array_join(lines, "\n")), F.when(F.size(links) == 1, F.lit("This is the page closest to the question.")).otherwise(F.lit("These are the pages closest to the question."))]
    return F.concat_ws("\n", *[p for p in parts if p is not None])
