"""Merged questions that are kept current as results come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import ResultStore
from .merge import first_results, with_keys, without_errors

KEYS = ("exam_id", "exam_page", "question_number")
PLACE = "input_order: bigint, lecture_id: bigint, page_no: bigint, score: bigint"


class CurrentMerge:
    """The merge of all deltas added so far, equal to `merge_by_question` over all their results at once.

    Each delta leaves its first result of each question and a row for each link beside those of earlier deltas; a reader puts them
    together by question, and `compact` stores what comes of it, so a delta costs as much as it has results and not as much as all
    before it. Links stay rows, as one question may have a great share of them. A delta is known by its name and counts once, however
    often it is added.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS):
        self.keys = keys
        columns = ", ".join(f"{k} bigint" for k in keys)
        state = f"order struct<{PLACE}>, first struct<item_id: bigint, exam_page: bigint, question_text: string, numbers_on_page: array<bigint>>, link struct<{PLACE}, reason: string>"
        self.store = ResultStore(spark, path, f"delta string, {columns}, {state}", ("delta",), one_row=False)

    def add(self, results: DataFrame, delta: str) -> bool:
        """Whether the delta was new."""
        if not self.store.read().where(F.col("delta") == delta).isEmpty():
            return False
        if "reason" not in results.columns:
            results = results.withColumn("reason", F.lit(None).cast("string"))
        results = without_errors(results)
        links = results.select(*self.keys, F.struct("input_order", "lecture_id", "page_no", "score", "reason").alias("link"))
        # a row without a question, so that a delta without results, or merged into others, is still known
        name = results.sparkSession.range(1).select()
        rows = [self._rows(df, delta) for df in (first_results(results, self.keys), links, name)]
        self.store.append(rows[0].unionByName(rows[1]).unionByName(rows[2]))
        return True

    def _rows(self, df: DataFrame, delta: str) -> DataFrame:
        """df with the store's columns, null where it has none."""
        fields = df.sparkSession.createDataFrame([], self.store.schema).schema
        held = df.withColumn("delta", F.lit(delta))
        return held.select(*[(F.col(f.name) if f.name in held.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def questions(self) -> DataFrame:
        """keys, order (the place of the first result) and first (its fields) of each question."""
        return self._questions(self.store.read())

    def _questions(self, rows: DataFrame) -> DataFrame:
        return rows.where("first IS NOT NULL").groupBy(*self.keys).agg(F.min("order").alias("order"), F.min_by("first", "order").alias("first"))

    def links(self) -> DataFrame:
        """keys, input_order, lecture_id, page_no, score, reason: a row for each link."""
        return self.store.read().where("link IS NOT NULL").select(*self.keys, "link.*")

    def read(self) -> DataFrame:
        """keys, first and the links of each question as a list, which one task holds."""
        rows = self.store.read()
        lists = rows.where("link IS NOT NULL").groupBy(*self.keys).agg(F.array_sort(F.collect_list("link")).alias("links"))
        return with_keys(self._questions(rows), lists, self.keys, "links").select(*self.keys, "first", "links")

    def compact(self) -> None:
        """One first result a question, and all links beside each other."""
        rows = self.store.read()
        links = self._rows(rows.where("link IS NOT NULL").select(*self.keys, "link"), "")
        self.store.replace(self._rows(self._questions(rows), "").unionByName(links).unionByName(rows.where("first IS NULL AND link IS NULL")))
