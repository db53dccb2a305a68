"""Scoring of (question, page) pairs: a similarity join with a prefix filter. Terms meet as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import snap_score
from ..sources.results import ResultStore
from ..sources.sinks import staged, unstaged

SPLIT = r"[^\p{L}\p{N}]+"
LINKS = "item_id long, lecture_id long, page_no long, score long"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def hashed_terms(text: str) -> Column:
    return F.transform(F.array_distinct(tokens(F.col(text))), lambda t: F.xxhash64(t))


#: A term on more pages than this, and with more than this share of all that are joined, is met in several tasks; there are at most 1 / HEAVY such terms.
HEAVY_ROWS, HEAVY = 100_000, 1 / 1000


def text_key(text: str) -> Column:
    """16 bytes by which equal texts fall together."""
    return F.unhex(F.md5(text)).alias("text_key")


def met_pairs(questions: DataFrame, pages: DataFrame, min_score: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, asked, rows). pairs: (row, item_id), once each, that share one of the question's rarest terms; asked: item_id, q_terms, n;
    rows: the distinct texts of the pages, with row, text_key, page_text, p_terms.

    A page that reaches the score holds at least ceil(t * n) of the question's n terms, so it holds one of any
    n - ceil(t * n) + 1 of them; the rarest ones leave the fewest pages. Equal texts are one row, however many pages have them. Texts are split
    into terms once; how often a term occurs and what a term meets is read from that table. What is shuffled are single terms with their row, and
    those of a term in very many texts go to several tasks, each of which has the few questions that ask for it.
    """
    if min_score < 5:
        raise ValueError("min_score must be at least 5")
    grid = min(100, -(-min_score // 5) * 5)
    asked = questions.select("item_id", hashed_terms("question_text").alias("q_terms")).where(F.size("q_terms") > 0).withColumn("n", F.size("q_terms"))
    texts = pages.where(F.length("page_text") > 0).select(text_key("page_text"), "page_text").distinct()
    rows = staged(texts.select(F.monotonically_increasing_id().alias("row"), "text_key", "page_text", hashed_terms("page_text").alias("p_terms")))
    terms = rows.select("row", F.explode("p_terms").alias("term"))
    words = asked.select("item_id", "n", F.explode("q_terms").alias("term"))
    counts = terms.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    ranked = words.join(counts, "term", "left").withColumn("rn", F.row_number().over(by_rarity))
    prefix = staged(ranked.where(F.col("rn") <= F.col("n") - F.expr(f"(n * {grid} + 99) div 100") + 1).where("df > 0").select("term", "item_id", "df"))
    often = prefix.select("term", "df").distinct()
    total, greatest = often.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    most = max(HEAVY_ROWS, int(total * HEAVY))
    met = terms.join(prefix.where(F.col("df") <= most), "term").select("row", "item_id")
    if greatest > most:
        heavy = F.broadcast(often.where(F.col("df") > most).select("term", F.ceil(F.col("df") / most).cast("int").alias("shares")))
        held = terms.join(heavy, "term").select("term", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int").alias("share"), "row")
        wanted = prefix.join(heavy, "term").select("term", "item_id", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        met = met.unionByName(held.join(wanted, ["term", "share"]).select("row", "item_id"))
    return met.repartition("row").distinct(), asked, rows


def on_pages(by_text: DataFrame, pages: DataFrame) -> DataFrame:
    """by_text (text_key and more) for each page that has the text: lecture_id, page_no and more."""
    # files of links are small for their rows, so they would be broadcast
    return pages.select("lecture_id", "page_no", text_key("page_text")).join(by_text.hint("merge"), "text_key").drop("text_key")


def candidates(questions: DataFrame, pages: DataFrame, min_score: int) -> DataFrame:
    """Distinct (item_id, lecture_id, page_no) that share one of the question's rarest terms."""
    pairs, _, rows = met_pairs(questions, pages, min_score)
    return met_pages(pairs, rows, pages)


def met_pages(pairs: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    found = on_pages(pairs.join(rows.select("row", "text_key"), "row").select("text_key", "item_id"), pages)
    return found.select("item_id", "lecture_id", "page_no").distinct()


def lexical_scores(questions: DataFrame, pages: DataFrame, min_score: int) -> DataFrame:
    """The pairs that reach min_score: the share of the question's terms on the page, or 110 where the page holds the question as it is.

    Terms meet as hashes; the pairs that these leave are scored by the words themselves, each once, and only where all terms are there
    is the question looked for as it is. A text is scored once for all pages that have it. The links are written, as most that comes after
    reads them more than once.
    """
    pairs, asked, rows = met_pairs(questions, pages, min_score)
    # from generators, here and below, so that the filters don't compute it again
    met = pairs.join(rows.select("row", "p_terms"), "row").join(asked, "item_id").select("item_id", "row", "n", F.explode(F.array(F.size(F.array_intersect("q_terms", "p_terms")))).alias("shared"))
    reached = met.where((F.expr("5 * ((20 * shared) div n)") >= min_score) | (F.col("shared") == F.col("n")))
    near = staged(reached.select("item_id", "row", (F.col("shared") == F.col("n")).alias("all_terms")))
    texts = rows.select("row", "text_key", "page_text").join(near.select("row").distinct(), "row", "left_semi")
    words = questions.select("item_id", tokens(F.col("question_text")).alias("q_tokens")).withColumn("n", F.size(F.array_distinct("q_tokens")))
    told = near.hint("merge").join(texts.select("row", "text_key", tokens(F.col("page_text")).alias("p_tokens")), "row").join(words, "item_id")
    verbatim = F.col("all_terms") & (F.size("q_tokens") >= 5) & F.contains(padded(F.col("p_tokens")), padded(F.col("q_tokens")))
    both = F.struct(F.size(F.array_intersect("q_tokens", "p_tokens")).alias("shared"), verbatim.alias("verbatim"))
    words_met = told.select("item_id", "text_key", "n", F.explode(F.array(both)).alias("met"))
    score = F.when(F.col("met.verbatim"), 110).otherwise(F.expr("5 * ((20 * met.shared) div n)")).cast("long")
    scored = staged(words_met.select("item_id", "text_key", score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= min_score)))
    out = staged(on_pages(scored, pages).select("item_id", "lecture_id", "page_no", "score"))
    unstaged(scored, near, rows)
    return out


SCORED = f"{LINKS}, reason string, error string"


def tried(scorer: Callable[[pd.DataFrame], pd.DataFrame], frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with the scorer's scores and reasons. A frame that makes it fail is halved until the rows that do so stand alone; these get an error."""
    todo, done = [frame], []
    while todo:
        part = todo.pop()
        out = part.drop(columns=["question_text", "page_text"])
        try:
            said = scorer(part)
            if len(said) != len(part):
                raise ValueError(f"{len(said)} scores for {len(part)} rows")
            both = isinstance(said, pd.DataFrame)
            out["score"] = pd.array(list(said["score"] if both else said), dtype="Int64")
            out["reason"] = list(said["reason"]) if both and "reason" in said else None
            out["error"] = None
        except Exception as e:  # a failing row must not end the job, nor take others with it
            if len(part) > 1:
                todo += [part.iloc[: len(part) // 2], part.iloc[len(part) // 2 :]]
                continue
            out["score"], out["reason"], out["error"] = pd.array([None], dtype="Int64"), None, str(e) or type(e).__name__
        done.append(out)
    return pd.concat(done) if done else frame.drop(columns=["question_text", "page_text"])


def scored_by(met: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """met: item_id, lecture_id, page_no, question_text, page_text and perhaps more columns. These without the texts, and score, reason, error."""
    kept = met.drop("question_text", "page_text")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())])
    order = schema.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield tried(scorer, frame)[order]

    return met.mapInPandas(run, schema)


def with_texts(pairs: DataFrame, questions: DataFrame, pages: DataFrame, digests: bool = False) -> DataFrame:
    """pairs with question_text and page_text; with digests also question_sha and page_sha, of each text once and not of each pair."""
    sides = [(pages, ["lecture_id", "page_no"], "page"), (questions, ["item_id"], "question")]
    for rows, keys, name in sides:
        text = F.col(f"{name}_text")
        pairs = pairs.join(rows.select(*keys, text, *([F.sha2(F.coalesce(text, F.lit("")), 256).alias(f"{name}_sha")] if digests else [])), keys)
    return pairs


def score_links(questions: DataFrame, pages: DataFrame, min_score: int = 50, scorer: str | Callable[[pd.DataFrame], pd.DataFrame] = "lexical", candidate_score: int | None = None) -> DataFrame:
    """item_id, lecture_id, page_no, score of the pairs that reach min_score.

    scorer: `lexical`, or a function that gets pandas frames of item_id, question_text, lecture_id, page_no, page_text and
    returns a score for each row, or a frame of score and reason; pairs are then those that share rare terms at
    `candidate_score`, and there are columns reason and error. A row for which it raises has an error and no score.
    """
    if scorer == "lexical":
        return lexical_scores(questions, pages, min_score)
    met = with_texts(candidates(questions, pages, candidate_score or min_score), questions, pages)
    scored = scored_by(met.select("item_id", "question_text", "lecture_id", "page_no", "page_text"), scorer)
    scored = scored.withColumn("score", snap_score(F.col("score")))
    return scored.where((F.col("score") >= min_score) | F.col("error").isNotNull())


#: Results of a scorer by request; a request is the pair, both texts and the scorer's name.
REQUESTS, REQUEST_KEYS = f"request_id string, {LINKS}, reason string", ("request_id",)


def score_requests(questions: DataFrame, pages: DataFrame, candidate_score: int, name: str) -> DataFrame:
    """The pairs to be scored with their texts and request_id."""
    return requests_of(candidates(questions, pages, candidate_score), questions, pages, name)


def requests_of(pairs: DataFrame, questions: DataFrame, pages: DataFrame, name: str, *more: str) -> DataFrame:
    met = with_texts(pairs, questions, pages, digests=True)
    parts = [F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("item_id", "lecture_id", "page_no")], "question_sha", "page_sha"]
    return met.select(F.sha2(F.concat_ws(":", *parts), 256).alias("request_id"), "item_id", "lecture_id", "page_no", "question_text", "page_text", *more)


def request_ids(questions: DataFrame, pages: DataFrame, candidate_score: int, name: str) -> DataFrame:
    """The pairs of `score_requests` without their texts, written: a text is as often among the pairs as it is asked for, so it is met
    where a pair is scored and no sooner."""
    pairs, _, rows = met_pairs(questions, pages, candidate_score)
    out = staged(requests_of(met_pages(pairs, rows, pages), questions, pages, name).drop("question_text", "page_text"))
    unstaged(rows)
    return out


def request_texts(ids: DataFrame, questions: DataFrame, pages: DataFrame, name: str) -> DataFrame:
    """ids, as `request_ids` gives them, with the texts that they were made of; two rows of one page each get their own."""
    pairs = ids.withColumnRenamed("request_id", "wanted_id")
    made = requests_of(pairs, questions, pages, name, "wanted_id")
    return made.where(F.col("request_id") == F.col("wanted_id")).drop("wanted_id")


def score_pending(requests: DataFrame, store: ResultStore, scorer: Callable[[pd.DataFrame], pd.DataFrame], errors: ResultStore | None = None, texts: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Scores the requests that have no result in the store and commits them; returns their number.

    Requests that fail get no result, so a later run tries them again; with a store for errors (REQUESTS and `error`) they are noted there.
    Requests may come without texts, which `texts` gives to those that are left.
    """
    pending = store.missing(requests)
    scored = scored_by(texts(pending) if texts else pending, scorer)
    if errors is None:
        return store.append(scored.where("error IS NULL"))
    scored = scored.persist()
    try:
        errors.append(scored.where("error IS NOT NULL"))
        return store.append(scored.where("error IS NULL"))
    finally:
        scored.unpersist()


def stored_links(requests: DataFrame, store: ResultStore, min_score: int = 50) -> DataFrame:
    """The links that the store's results give for these requests."""
    scored = store.read().join(requests.select("request_id"), "request_id", "left_semi").withColumn("score", snap_score(F.col("score")))
    return scored.where(F.col("score") >= min_score).select("item_id", "lecture_id", "page_no", "score", "reason")


def dedupe_links(links: DataFrame) -> DataFrame:
    """One row for each (question, lecture, page), with its best score, and the reason of that if there are reasons."""
    best = [F.max("score").alias("score")]
    if "reason" in links.columns:
        best.append(F.max(F.struct("score", "reason"))["reason"].alias("reason"))
    return links.groupBy("item_id", "lecture_id", "page_no").agg(*best)


def top_links(links: DataFrame, min_score: int | Column = 50, k: int = 2) -> DataFrame:
    """The k best links of each question that reach the score; a missing score is 0; ties by lecture and page."""
    least = min_score if isinstance(min_score, Column) else F.lit(min_score)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "lecture_id", "page_no")
    kept = links.withColumn("score", F.coalesce("score", F.lit(0))).where(F.col("score") >= least)
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
