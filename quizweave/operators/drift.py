"""Responses whose fields are not those of the schema: what there is, counted, and reading them all the same.

A place is a path from the top of a response, `$`; `.key` goes into an object, `[]` into the elements of a list. Places are found by the
shape of the schema, so a key that holds a dot or brackets is never taken for a known place, however its path reads. Null
texts and texts that aren't JSON, or that give one object a key twice, are one place `$` of kind `unreadable`. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .responses import MODES, complete_questions, elements

PLACES = "array<struct<path:string,kind:string,expected:string>>"


def kind_of(v: Column) -> Column:
    """object, array, string, boolean, null or number; unreadable without a value."""
    shape = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    named = F.when(shape == "VOID", "null").when(shape.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(shape)).otherwise("number")
    return F.when(v.isNull(), "unreadable").otherwise(named)


def expected_kind(schema: DataType) -> str:
    return "object" if isinstance(schema, StructType) else "array" if isinstance(schema, ArrayType) else "string" if isinstance(schema, StringType) else "number"


def place(path: Column, kind: Column, expected: Column) -> Column:
    return F.array(F.struct(path.alias("path"), kind.alias("kind"), expected.alias("expected")))


def places(v: Column, path: Column, schema: DataType) -> Column:
    """The places of a value: its own, those in it that the schema knows, keys that it doesn't know, and as `missing` those that aren't there."""
    own = place(path, kind_of(v), F.lit(expected_kind(schema)))
    empty = F.array().cast(PLACES)
    if isinstance(schema, ArrayType):
        inner = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: places(e, F.concat(path, F.lit("[]")), schema.elementType)))
        return F.concat(own, F.when(kind_of(v) == "array", inner).otherwise(empty))
    if not isinstance(schema, StructType):
        return own
    held = F.try_variant_get(v, "$", "map<string,variant>")
    below = lambda key: F.concat(path, F.lit("."), key)

    def of_key(entry: Column) -> Column:
        out = place(below(entry["key"]), kind_of(entry["value"]), F.lit(None).cast("string"))
        for field in schema.fields:
            out = F.when(entry["key"] == field.name, places(entry["value"], below(entry["key"]), field.dataType)).otherwise(out)
        return out

    missing = [F.when(F.map_contains_key(held, f.name), empty).otherwise(place(below(F.lit(f.name)), F.lit("missing"), F.lit(expected_kind(f.dataType)))) for f in schema.fields]
    return F.concat(own, F.when(kind_of(v) == "object", F.concat(F.flatten(F.transform(F.map_entries(held), of_key)), *missing)).otherwise(empty))


def response_places(df: DataFrame, mode: str) -> DataFrame:
    """df (response_id, text) to response_id, path, kind, expected (null for keys that the schema doesn't know), n; one pass over the texts."""
    schema = StructType.fromDDL(MODES[mode][2])
    known = StructType([f for f in schema.fields if f.name != "_corrupt"])
    parsed = df.select("response_id", F.try_parse_json("text").alias("v"))
    each = parsed.select("response_id", F.inline(places(F.col("v"), F.lit("$"), known)))
    return each.groupBy("response_id", "path", "kind", "expected").agg(F.count("*").alias("n"))


def schema_report(df: DataFrame, mode: str) -> DataFrame:
    """path, kind, expected, status (fits, unknown, missing, unreadable or differs), how many responses have it, and how often."""
    status = F.when(F.col("kind").isin("missing", "unreadable"), F.col("kind")).when(F.col("expected").isNull(), "unknown").when(F.col("kind") == F.col("expected"), "fits").otherwise("differs")
    sums = response_places(df, mode).groupBy("path", "kind", "expected").agg(F.count("*").alias("responses"), F.sum("n").alias("n"))
    return sums.select("path", "kind", "expected", status.alias("status"), "responses", "n")


def response_drift(df: DataFrame, mode: str) -> DataFrame:
    """response_id, readable, and how many places are unknown, missing, or of another kind."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias
    kind, expected = F.col("kind"), F.col("expected")
    return response_places(df, mode).groupBy("response_id").agg(
        F.min(kind != "unreadable").alias("readable"), count(expected.isNull())("unknown"), count(kind == "missing")("missing"), count((kind != expected) & ~kind.isin("missing", "unreadable"))("differing")
    )


def exam_page_of(p: Column) -> Column:
    """A page by name, each value cast if it can be: numbers are texts where texts are asked for, and the other way round."""
    text = lambda q, key: F.try_variant_get(q, f"$.{key}", "string").alias(key)
    questions = F.transform(F.try_variant_get(p, "$.questions", "array<variant>"), lambda q: F.struct(*[text(q, k) for k in ("question_number", "question_text", "answer")]))
    return F.struct(F.try_variant_get(p, "$.exam_page", "bigint").alias("exam_page"), complete_questions(questions).alias("questions"))


def read_any_pages(df: DataFrame) -> DataFrame:
    """response_id, status, pos (from 1), exam_page, questions (the complete ones) of exam responses, whatever kinds their values are of.

    status: `whole`, or `cut` for pages that are complete in a text that isn't JSON. A page without a number stays, without one; pages without
    complete questions are left out, as in `recover_exam_pages`.
    """
    parsed = df.select("response_id", "text", F.try_parse_json("text").alias("v"))
    listed = F.try_variant_get("v", "$.exam_pages", "array<variant>")
    whole = parsed.where("v IS NOT NULL").select("response_id", F.lit("whole").alias("status"), F.posexplode(listed).alias("at", "p")).select("response_id", "status", (F.col("at") + 1).cast("long").alias("pos"), "p")
    torn = parsed.where("v IS NULL AND text IS NOT NULL").select("response_id", "text")
    found = elements(torn, MODES["exam"][0]).where("end IS NOT NULL").groupBy("response_id").agg(F.collect_list(F.struct("pos", "start", "end")).alias("found"))
    piece = F.substring(F.col("text"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    cut = torn.join(found, "response_id").select("response_id", "text", F.inline("found")).select("response_id", F.lit("cut").alias("status"), "pos", F.try_parse_json(piece).alias("p"))
    pages = whole.unionByName(cut).select("response_id", "status", "pos", exam_page_of(F.col("p")).alias("page"))
    return pages.select("response_id", "status", "pos", "page.*").where(F.size("questions") > 0)
