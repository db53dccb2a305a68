"""Merging, de-duplicating, nesting and summing of results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import numbered


def joined(rows: Column) -> Column:
    return F.array_join(rows, ",")


def merge_by_question(results: DataFrame, keys: tuple[str, ...] = ("exam_id", "exam_page", "question_number")) -> DataFrame:
    """The fields of the first result of each question, and the links of all results in input order.

    results: keys, input_order, the question's fields, lecture_id, page_no, score and perhaps reason; where there is a column `error`,
    rows that have one are left out.
    """
    return merged_questions(partial_merge(results, keys), keys)


def partial_merge(results: DataFrame, keys: tuple[str, ...] = ("exam_id", "exam_page", "question_number")) -> DataFrame:
    """What `merge_by_question` needs to know of some results: keys, order (of the first result), first (its fields), links in order.

    Such states may be put together in any grouping and order, each result being in one of them.
    """
    results = without_errors(results)
    link = F.struct(*PLACE, *[c for c in ("reason",) if c in results.columns])
    lists = results.select(*keys, link.alias("link")).groupBy(*keys).agg(F.array_sort(F.collect_list("link")).alias("links"))
    return with_keys(first_results(results, keys), lists, keys, "links")


PLACE = ("input_order", "lecture_id", "page_no", "score")


def without_errors(results: DataFrame) -> DataFrame:
    return results.where("error IS NULL") if "error" in results.columns else results


def with_keys(rows: DataFrame, other: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    """rows with the columns more of other, by keys; null is a key like others."""
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"other.{k}")) for k in keys]
    return rows.alias("rows").join(other.alias("other"), reduce(and_, same)).select("rows.*", *[F.col(f"other.{c}") for c in more])


def first_results(results: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, order and first (the fields) of each question's first result; only places are compared and sorted, then the first rows' fields read."""
    fields = F.struct("item_id", *[c for c in ("exam_page",) if c in results.columns], "question_text", "numbers_on_page")
    order = results.select(*keys, F.struct(*PLACE).alias("order")).groupBy(*keys).agg(F.min("order").alias("order"))
    rows = with_keys(results.select(*keys, F.struct(*PLACE).alias("place"), fields.alias("first")), order, keys, "order")
    return rows.where("place = order").groupBy(*keys).agg(F.first("order").alias("order"), F.first("first").alias("first"))


def listed_md5(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], text: Column) -> DataFrame:
    """keys, n and md5: how many rows a key has, and the digest of their texts in order, joined by commas.

    A key's sorted rows stream through a task, which holds a digest's state and not the list. null is a key like others.
    """
    fields = rows.select(*keys).schema.fields
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("md5", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, digest, types = None, 0, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, n, digest.hexdigest()), (*types, pa.int64(), pa.string()), strict=True)], names=schema.fieldNames())

        for batch in batches:
            types = [c.type for c in batch.columns[: len(keys)]]
            texts, at = [t or "" for t in batch.column(len(keys)).to_pylist()], 0
            for key, same in groupby(zip(*[c.to_pylist() for c in batch.columns[: len(keys)]], strict=True)):
                end = at + sum(1 for _ in same)
                if digest is None or key != now:
                    if digest is not None:
                        yield done()
                    now, n, digest = key, 0, hashlib.md5()
                digest.update((("," if n else "") + ",".join(texts[at:end])).encode())
                n, at = n + end - at, end
        if digest is not None:
            yield done()

    placed = rows.select(*keys, *[F.col(c).alias(f"by_{c}") for c in order], text.alias("text"))
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, *[f"by_{c}" for c in order])
    return dealt.select(*keys, "text").mapInArrow(run, schema)


def combine_merges(states: DataFrame, keys: tuple[str, ...] = ("exam_id", "exam_page", "question_number")) -> DataFrame:
    """States of `partial_merge`, several for a key, to one for each key."""
    return states.groupBy(*keys).agg(F.min("order").alias("order"), F.min_by("first", "order").alias("first"), F.array_sort(F.flatten(F.collect_list("links"))).alias("links"))


def merged_questions(states: DataFrame, keys: tuple[str, ...] = ("exam_id", "exam_page", "question_number")) -> DataFrame:
    return states.select(*keys, "first", "links")


def concat_chunks(results: DataFrame) -> DataFrame:
    """All records of all chunks in page order, none left out; a page that isn't a number counts as 0. A lecture with very many
    pages is numbered by many tasks."""
    placed = results.withColumn("sort_page", F.coalesce(F.col("page_no").try_cast("bigint"), F.lit(0)))
    return numbered(placed, "lecture_id", "sort_page", "input_order", "item_id", "score", width=256).drop("sort_page")


def dedupe_pages(results: DataFrame) -> DataFrame:
    """One record for each page: the first."""
    order = Window.partitionBy("lecture_id", "page_no").orderBy("input_order", "item_id", "score")
    return results.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def merge_slides(results: DataFrame) -> DataFrame:
    """results (lecture_page, importance, key_concepts, question): the greatest importance, all concepts and questions once."""
    return results.groupBy("lecture_page").agg(F.max("importance").alias("importance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("key_concepts")))).alias("key_concepts"), F.array_sort(F.collect_set("question")).alias("questions"))


def nest_by_page(questions: DataFrame) -> DataFrame:
    """exam_id with an array of (exam_page, questions), both sorted."""
    pages = questions.groupBy("exam_id", "exam_page").agg(F.array_sort(F.collect_list(F.struct("question_number", "item_id"))).alias("questions"))
    return pages.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("exam_page", "questions"))).alias("exam_pages"))


def summarize(links: DataFrame, questions: DataFrame, n_topics: int = 5) -> DataFrame:
    """exam_id, pages, questions and links that stay, and the most frequent concepts (here: terms of six letters or more)."""
    kept = questions.join(links, "item_id")
    counts = kept.groupBy("exam_id").agg(F.countDistinct("exam_page").alias("total_pages"), F.countDistinct("item_id").alias("total_questions"), F.count("*").alias("total_links"))
    words = questions.join(links.select("item_id").distinct(), "item_id").select("exam_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("question_text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 6))).alias("topic")).groupBy("exam_id", "topic").count()
    order = Window.partitionBy("exam_id").orderBy(F.col("count").desc(), "topic")
    top = words.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n_topics).groupBy("exam_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("rn", "topic"))), lambda x: x["topic"])).alias("key_topics"))
    return counts.join(top, "exam_id", "left")


def question_index(pages: DataFrame) -> DataFrame:
    """exam_id, number, sorted distinct pages on which a line begins with that number; numbers and pages under 1 are dropped."""
    found = pages.select("exam_id", "page_no", F.explode(F.regexp_extract_all("page_text", F.lit(r"(?m)^\s*(\d+)[.)번]"), F.lit(1))).alias("n"))
    found = found.withColumn("number", F.col("n").try_cast("bigint")).where("number > 0 AND page_no > 0")
    return found.groupBy("exam_id", "number").agg(F.sort_array(F.collect_set("page_no")).alias("pages"))


def numbers_on_page(questions: DataFrame) -> DataFrame:
    return questions.groupBy("exam_id", "exam_page").agg(F.array_sort(F.collect_list("question_number")).alias("numbers"))


def job_warnings(results: DataFrame) -> DataFrame:
    """results (job_id, file_name, failed): distinct names of failed files, failed chunks, and whether any failed."""
    base = F.element_at(F.split("file_name", "/"), -1)
    return results.groupBy("job_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("failed"), base))), ",").alias("failed_files"),
        F.sum(F.col("failed").cast("long")).alias("failed_chunks"),
        F.max("failed").alias("partial"),
    )


def corpus_stats(pages: DataFrame) -> DataFrame:
    return pages.agg(F.countDistinct("lecture_id").alias("documents"), F.count("*").alias("pages"))
