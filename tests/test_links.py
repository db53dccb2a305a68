"""score_links where pages repeat and terms are on very many pages."""

import random

import pytest

from quizweave.operators import relevance

Q, P = "item_id long, question_text string", "lecture_id long, page_no long, page_text string"


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def cross_join(questions, pages, least):
    out = []
    for item, asked in questions:
        q = words(asked)
        for lecture, page, text in pages:
            p = words(text)
            if q:
                whole = len(q) >= 5 and f" {' '.join(q)} " in f" {' '.join(p)} "
                score = 110 if whole else 5 * (20 * len({*q} & {*p}) // len({*q}))
                if score >= max(1, least):
                    out.append((item, lecture, page, score))
    return sorted(out)


def got(spark, questions, pages, least):
    links = relevance.score_links(spark.createDataFrame(questions, Q), spark.createDataFrame(pages, P), least)
    return sorted(map(tuple, links.select("item_id", "lecture_id", "page_no", "score").collect()))


def test_two_rows_of_one_page_are_two_pages(spark):
    pages = [(7, 1, "alpha"), (7, 1, "beta"), (7, 1, "alpha beta gamma delta"), (7, 1, "alpha beta gamma delta"), (8, 1, "")]
    questions = [(1, "alpha beta gamma delta"), (2, "Alpha"), (3, "")]
    for least in (5, 25, 50, 100):
        assert got(spark, questions, pages, least) == cross_join(questions, pages, least)


@pytest.mark.parametrize("least", [25, 55])
def test_terms_on_many_pages_are_met_in_several_tasks(spark, monkeypatch, least):
    monkeypatch.setattr(relevance, "HEAVY_ROWS", 3)
    monkeypatch.setattr(relevance, "HEAVY", 1 / 50)
    rng = random.Random(least)
    common, rare = ["the", "of", "and", "Ünï"], [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(common, k=n) + rng.choices(rare, k=n // 2))
    pages = [(rng.randrange(9), rng.randrange(5), text(rng.randrange(12))) for _ in range(300)]
    questions = [(i, text(rng.randrange(1, 10))) for i in range(25)] + [(99, "the of and"), (98, "the, of and the of!")]
    pages += [(50, 1, "x the of and the of y"), (51, 1, "the of and the off")]
    assert got(spark, questions, pages, least) == cross_join(questions, pages, least)


def test_a_text_is_met_once_for_all_pages_that_have_it(spark):
    pages = [(i, 1 + i % 3, ("alpha beta gamma", "alpha delta", "", "alpha  beta gamma")[i % 4]) for i in range(40)] + [(40, 1, None)]
    questions = [(1, "alpha beta gamma delta"), (2, "delta")]
    pairs, _, rows = relevance.met_pairs(spark.createDataFrame(questions, Q), spark.createDataFrame(pages, P), 25)
    assert rows.count() == 3 and pairs.count() == 4
    assert got(spark, questions, pages, 25) == cross_join(questions, [p for p in pages if p[2]], 25)


def test_links_are_computed_once(spark):
    links = relevance.score_links(spark.createDataFrame([(1, "alpha")], Q), spark.createDataFrame([(1, 1, "alpha")], P))
    assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_requests_are_digested_before_they_meet_their_pairs(spark):
    requests = relevance.score_requests(spark.createDataFrame([(1, "alpha")], Q), spark.createDataFrame([(1, 1, "alpha")], P), 50, "s")
    plan = requests.select("request_id")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first_join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not [line for line in plan[: first_join + 1] if "page_text" in line or "question_text" in line]
