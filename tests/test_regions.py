"""Question regions against a walk line by line."""

import random
import re

from quizweave.operators import assemble, windows
from quizweave.plans import pipelines

PAGES = "exam_id long, page_no long, page_text string"


def slow_regions(pages):
    out, head = {}, {}
    for exam, page, text in sorted(pages, key=lambda p: p[:2]):
        for at, line in enumerate(text.split("\n"), 1):
            found = re.match(r"[ \t\n\x0b\f\r]*([0-9]+)[.)번]", line)
            if found and 0 < int(found[1]) < 2**63:
                head[exam] = (exam, int(found[1]), page, at)
            if exam in head:
                out.setdefault((*head[exam], page), []).append(line)
    return sorted((*k, "\n".join(v)) for k, v in out.items())


def rows(df):
    return sorted(tuple(r) for r in df.select("exam_id", "number", "start_page", "start_line", "page_no", "part").collect())


def test_regions_are_a_walk_line_by_line(spark):
    rng = random.Random(3)
    lines = ["1. one", " 2) two", "3번 three", "0. none", "text", "", "12", "1.", "99999999999999999999. big", "a 4. b", "\t5.x"]
    pages = [(e, p, "\n".join(rng.choices(lines, k=rng.randrange(1, 6)))) for e in range(4) for p in range(1, 40)]
    # a question that goes on over several blocks of pages, an exam without headings, gaps between pages
    pages += [(9, p, "7. long" if p == 3 else f"more {p}\n") for p in range(1, 400) if p % 5]
    pages += [(10, p, "nothing") for p in range(1, 200)] + [(11, 1, "1. a\n1. b\nc"), (11, 70, ""), (11, 200, "d\n1. e")]
    got = rows(windows.question_regions(spark.createDataFrame(pages, PAGES)))
    assert got == slow_regions(pages)
    assert len({r[4] for r in got if r[0] == 9}) > 300
    assert rows(windows.question_regions(spark.createDataFrame([], PAGES))) == []


def test_documents_hold_the_text_up_to_the_next_question(spark):
    pages = spark.createDataFrame([(0, 1, "Exam\n1. a\nb"), (0, 2, "c\n2. d\n1. again"), (0, 3, "e")], PAGES)
    q = spark.createDataFrame(
        [(0, 0, "e.pdf", 1, 1, "A", "why", {}, "know this"), (1, 0, "e.pdf", 2, 2, "B", "", {}, None), (2, 0, "e.pdf", 3, 2, "C", None, {}, "")],
        "item_id long, exam_id long, exam_name string, question_number long, exam_page long, answer string, explanation string, wrong_answers map<string,string>, background string",
    )
    got = [(r.kind, r.page_no, r.text) for r in pipelines.exam_only(q, pages).orderBy("seq").collect()]
    asked = [g for g in got if g[0] == assemble.QUESTION]
    # 1 runs on to the next page; 3 is nowhere, so its page stands without text
    assert asked == [(1, 1, "1. a\nb"), (1, 2, "c"), (1, 2, "2. d"), (1, 2, None)]
    told = [g[2] for g in got if g[0] == assemble.TEXT]
    assert ["Background:\nknow this" in t for t in told] == [True, False, False] and len(told) == 3
    part = pipelines.partial_exam(q.withColumn("number", q.question_number).withColumn("hint", q.exam_page + 1), pages, regions=True).orderBy("seq").collect()
    assert [r.seq for r in part] == list(range(1, 8))
    assert [(r.page_no, r.text) for r in part if r.kind == assemble.QUESTION and r.major == 0] == [(2, "1. again"), (3, "e")]


def test_numbers_of_one_long_group(spark):
    df = spark.range(30_000).selectExpr("'x' AS g", "id * 7 % 30000 AS m", "id")
    got = windows.numbered(df, "g", "m", "id", width=100).collect()
    assert all(r.seq == r.m + 1 for r in got) and len(got) == 30_000
