"""Recovery of cut responses against a scanner that goes character by character."""

import json
import random

from quizweave.operators import responses


def slow_elements(text, list_key):
    """(number, object or None) of each element of lists under list_key."""
    found, stack, inside, start, string, last = [], [], False, 0, None, None
    i = 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside, string = False, text[start + 1 : i]
        elif c == "\\":
            i += 1
        elif c == '"':
            inside, start = True, i
        elif c == ":":
            last = string
        elif c in "{[":
            listed = bool(stack) and stack[-1][2]
            entry = None
            if c == "{" and listed:
                entry = len(found)
                found.append(None)
            stack.append((c, i, c == "[" and last == list_key, entry))
            last = string = None
        elif c in "}]" and stack:
            _, at, _, entry = stack.pop()
            if entry is not None:
                found[entry] = text[at : i + 1]
        if c == ",":
            last = string = None
        i += 1
    out = []
    for n, piece in enumerate(found, 1):
        if piece is not None:
            try:
                out.append((n, json.loads(piece)))
            except json.JSONDecodeError:
                pass
    return out


def messy(rng, depth=0):
    words = ["a", "}", "{", '"', "\\", "]", "[", 'exam_pages": [{', "é😀", "", "x" * 150]
    kind = rng.randrange(6)
    if kind < 3 or depth > 2:
        return "".join(rng.choices(words, k=rng.randrange(4)))
    if kind == 3:
        return rng.randrange(100)
    if kind == 4:
        return [messy(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["k", "exam_page", "questions", "}"]): messy(rng, depth + 1) for _ in range(rng.randrange(3))}


def page(rng, number):
    fields = [("exam_page", number), ("questions", [{"question_number": str(q), "question_text": str(messy(rng, 9)) or "t", "answer": "[1"} for q in range(rng.randrange(4))])]
    fields += [(f"extra{i}", messy(rng)) for i in range(rng.randrange(4))]
    rng.shuffle(fields)
    return dict(fields)


def test_cut_pages_are_those_of_a_slow_scanner(spark):
    rng, rows = random.Random(11), []
    for n in range(300):
        whole = {"summary": messy(rng), "exam_pages": [page(rng, i) for i in range(rng.randrange(1, 5))], "more": {"exam_pages": [page(rng, 50)]} if n % 7 == 0 else messy(rng)}
        text = json.dumps(whole, ensure_ascii=n % 2 == 0, indent=None if n % 3 else 1)
        rows.append((n, "```json\n" * (n % 4 == 0) + text[: rng.randrange(len(text) + 1)]))
    want = []
    for n, text in rows:
        for pos, item in slow_elements(text, "exam_pages"):
            questions = [q for q in item["questions"] if {"question_number", "question_text", "answer"} <= set(q)]
            if questions:
                want.append((n, pos, item["exam_page"], [q["question_text"] for q in questions]))
    got = responses.recover_exam_pages(spark.createDataFrame(rows, "response_id long, text string"))
    assert sorted((r.response_id, r.pos, r.exam_page, [q.question_text for q in r.questions]) for r in got.collect()) == sorted(want)
    assert len(want) > 150


NOTHING = [None, "", "{", '"', "\\", '{"exam_pages":[', '{"exam_pages":[]}', '{"exam_pages":', '}]}{"exam_pages":[}', '{"exam_pages":[{"exam_page":1,"questions":[]}]', '{"other":[{"exam_page":1,"questions":[{"question_number":"1","question_text":"t","answer":"a"}]}]']


def test_nothing_to_recover(spark):
    rows = spark.createDataFrame(list(enumerate(NOTHING)), "response_id long, text string")
    assert responses.recover_exam_pages(rows).count() == 0
    got = sorted(tuple(r) for r in responses.parse_responses(rows).select("response_id", "status", "n_pages", "n_questions").collect())
    assert got == [(i, "ok" if t == '{"exam_pages":[]}' else "quarantine", 0, 0) for i, t in enumerate(NOTHING)]


def test_slides_with_other_keys_first(spark):
    text = '{"related_slides" : [ {"key_concepts":["a]","}"],"x":{"lecture_page":9},"lecture_page": 4,"importance":7}, {"lecture_page":5,"importance":'
    got = responses.recover_slides(spark.createDataFrame([(1, text)], "response_id long, text string")).collect()
    assert [(r.pos, r.lecture_page, r.importance, r.key_concepts) for r in got] == [(1, 4, 7, ["a]", "}"])]


def test_a_long_response(spark):
    pages = [{"note": '}"{' * 200, "exam_page": i, "questions": [{"question_number": "1", "question_text": "t" * 500, "answer": "a"}]} for i in range(400)]
    text = json.dumps({"exam_pages": pages})[:-500]
    got = responses.recover_exam_pages(spark.createDataFrame([(1, text)], "response_id long, text string"))
    assert sorted(r.exam_page for r in got.collect()) == list(range(399))
