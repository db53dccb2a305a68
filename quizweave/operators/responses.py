"""Recovery of records from model responses, as a job over a table (response_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
#: The list that a response of each mode has, the key that its elements must have, and their schemas.
MODES = {"exam": ("exam_pages", "exam_page", schemas.EXAM_RESPONSE, schemas.EXAM_FRAGMENT), "lecture": ("related_slides", "lecture_page", schemas.SLIDE_RESPONSE, schemas.SLIDE_FRAGMENT)}

#: No key of interest is longer, with the white space around its colon.
MOST_NAME = 100


def whole(df: DataFrame, mode: str) -> DataFrame:
    return df.withColumn("parsed", F.from_json("text", MODES[mode][2], CORRUPT))


def is_whole(mode: str) -> Column:
    return F.col("parsed._corrupt").isNull() & F.col(f"parsed.{MODES[mode][0]}").isNotNull()


def has_valid_structure(df: DataFrame, mode: str) -> DataFrame:
    """Whether a text is JSON whose list is a list, whatever its elements are; null texts and objects with a key twice are not."""
    listed = F.try_variant_get(F.try_parse_json("text"), f"$.{MODES[mode][0]}", "variant")
    return df.select("response_id", F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False)).alias("valid"))


#: An escaped character, a mark of JSON, or what lies between; together the whole text.
TOKEN = r'(?s)\\.|["{}\[\]]|[^\\"{}\[\]]+|\\'


def scanned(df: DataFrame) -> DataFrame:
    """The braces and brackets of each text that lie outside its strings: response_id, at (from 1), mark, depth, follows.

    A mark is outside if an even number of unescaped quotes comes before it. depth counts the containers that are open, with the one that
    a mark opens or closes, so that the next mark at an opening one's depth closes it. `follows` is the key that an opening mark is the value of.
    """
    by_place = Window.partitionBy("response_id").orderBy("pos")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    tokens = df.select("response_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    # of what lies between the length is needed, and the name that may stand before a list
    short = F.when(F.length("token") <= MOST_NAME, F.col("token"))
    placed = tokens.select(
        "response_id", "pos", short.alias("token"), (F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)) + 1).alias("at"),
        (F.coalesce(F.sum((F.col("token") == '"').cast("long")).over(before), F.lit(0)) % 2 == 1).alias("inside"), *[F.lag(short, i).over(by_place).alias(f"back{i}") for i in (1, 2, 3, 4)],
    )
    opens, closes = F.col("token").isin("{", "["), F.col("token").isin("}", "]")
    follows = F.when(F.col("back1").rlike(r"^\s*:\s*$") & (F.col("back2") == '"') & (F.col("back4") == '"'), F.col("back3"))
    level = F.sum(F.when(opens, 1).otherwise(-1)).over(by_place) + F.when(closes, 1).otherwise(0)
    return placed.where(~F.col("inside") & (opens | closes)).select("response_id", "at", F.col("token").alias("mark"), level.alias("depth"), F.when(opens, follows).alias("follows"))


def elements(df: DataFrame, list_key: str) -> DataFrame:
    """response_id, pos (from 1), start, end (null if it is cut) of each object that is an element of a list under list_key, whatever comes before or in it."""
    marks = scanned(df)
    by_level = Window.partitionBy("response_id", "level").orderBy("at")
    # an opening mark is looked at on its own level, and on the one over it to see what it lies in
    opening = F.col("mark").isin("{", "[")
    levels = F.when(opening, F.array(F.col("depth"), F.col("depth") - 1)).otherwise(F.array("depth"))
    each = marks.select("*", F.explode(levels).alias("level"))
    own = F.col("level") == F.col("depth")
    is_list = (F.col("mark") == "[") & F.coalesce(F.col("follows") == list_key, F.lit(False))
    inner = each.withColumn("listed", F.last(F.when(own, is_list), ignorenulls=True).over(by_level)).where(~own & F.col("listed") & (F.col("mark") == "{")).select("response_id", "at")
    pair = Window.partitionBy("response_id", "depth").orderBy("at")
    ends = marks.select("response_id", "at", "mark", F.lead("mark").over(pair).alias("closing"), F.lead("at").over(pair).alias("end"))
    met = inner.join(ends.where("mark = '{'"), ["response_id", "at"])
    number = F.row_number().over(Window.partitionBy("response_id").orderBy("at"))
    return met.select("response_id", number.cast("long").alias("pos"), F.col("at").alias("start"), F.when(F.col("closing") == "}", F.col("end")).alias("end"))


def fragments(df: DataFrame, mode: str) -> DataFrame:
    """The complete elements of cut responses: response_id, pos, item. Keys may stand in any order, marks within strings count for nothing."""
    list_key, first, _, schema = MODES[mode]
    found = elements(df, list_key).where("end IS NOT NULL").groupBy("response_id").agg(F.collect_list(F.struct("pos", "start", "end")).alias("found"))
    rows = df.join(found, "response_id").select("response_id", "text", F.inline("found"))
    piece = F.substring(F.col("text"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    parsed = rows.select("response_id", "pos", F.from_json(piece, schema, CORRUPT).alias("item"))
    return parsed.where(F.col("item._corrupt").isNull() & F.col(f"item.{first}").isNotNull())


def complete_questions(questions: Column) -> Column:
    """Those with number, text and answer."""
    return F.filter(questions, lambda q: q["question_number"].isNotNull() & q["question_text"].isNotNull() & q["answer"].isNotNull())


def keep_complete_questions(pages: DataFrame) -> DataFrame:
    return pages.withColumn("questions", complete_questions(F.col("questions"))).where(F.size("questions") > 0)


def recover_exam_pages(df: DataFrame) -> DataFrame:
    rows = fragments(df, "exam").select("response_id", "pos", F.col("item.exam_page").cast("long").alias("exam_page"), F.col("item.questions").alias("questions"))
    return keep_complete_questions(rows)


def recover_slides(df: DataFrame) -> DataFrame:
    return fragments(df, "lecture").select("response_id", "pos", F.col("item.lecture_page").cast("long").alias("lecture_page"), F.col("item.importance").cast("long").alias("importance"), F.col("item.key_concepts").alias("key_concepts"))


def recovery_stats(df: DataFrame) -> DataFrame:
    """Of each response that isn't whole: pages and questions recovered, and whether it is partial."""
    cut = whole(df, "exam").where(~F.coalesce(is_whole("exam"), F.lit(False))).select("response_id", "text")
    found = recover_exam_pages(cut).groupBy("response_id").agg(F.count("*").alias("recovered_pages"), F.sum(F.size("questions")).cast("long").alias("recovered_questions"))
    return cut.select("response_id").join(found, "response_id", "left").select("response_id", F.coalesce("recovered_pages", F.lit(0)).alias("recovered_pages"), F.coalesce("recovered_questions", F.lit(0)).alias("recovered_questions"), F.coalesce(F.col("recovered_pages") > 0, F.lit(False)).alias("partial"))


def parse_responses(df: DataFrame) -> DataFrame:
    """response_id, status (ok, recovered or quarantine), pages and complete questions."""
    parsed = whole(df, "exam")
    ok = parsed.where(is_whole("exam"))
    pages = ok.select("response_id", F.explode_outer("parsed.exam_pages").alias("p")).select("response_id", complete_questions(F.col("p.questions")).alias("qs"))
    good = pages.groupBy("response_id").agg(F.sum(F.coalesce((F.size("qs") > 0).cast("long"), F.lit(0))).alias("n_pages"), F.sum(F.greatest(F.lit(0), F.size("qs"))).cast("long").alias("n_questions")).select("response_id", F.lit("ok").alias("status"), "n_pages", "n_questions")
    rest = recovery_stats(df)
    return good.unionByName(rest.select("response_id", F.when(F.col("partial"), "recovered").otherwise("quarantine").alias("status"), F.col("recovered_pages").alias("n_pages"), F.col("recovered_questions").alias("n_questions")))
