"""Changing response schemas against a walk in plain Python."""

import json
from collections import Counter

from quizweave.operators import drift

RESPONSE = "response_id string, text string"
KNOWN = {"exam_pages": [{"exam_page": "number", "questions": [{"question_number": "string", "question_text": "string", "answer": "string"}]}]}
GOOD = {"question_number": "1", "question_text": "t", "answer": "2"}
TEXTS = {
    "fits": json.dumps({"exam_pages": [{"exam_page": 1, "questions": [GOOD]}]}),
    "kinds": json.dumps({"exam_pages": [{"exam_page": "4", "questions": [{**GOOD, "question_number": 3, "answer": 2.5}, {**GOOD, "answer": None}, {**GOOD, "answer": True}]}]}),
    "word page": json.dumps({"exam_pages": [{"exam_page": "four", "questions": [GOOD]}, {"exam_page": 5.0, "questions": [GOOD]}]}),
    "unknown": json.dumps({"x": {"exam_pages": []}, "exam_pages[].exam_page": 1, "": 0, "exam_pages": [{"exam_page": 1, "questions": [{**GOOD, "sure": [1]}], "a.b": "é"}]}),
    "not lists": json.dumps({"exam_pages": {"a": [GOOD]}}),
    "mixed": json.dumps({"exam_pages": [1, "x", None, [], {"questions": {"a": 1}}, {"exam_page": 7, "questions": [None, "q", GOOD]}]}),
    "empty": "{}", "list": "[1,2]", "text": '"x"', "null": "null", "no text": None, "blank": "", "broken": "{oops",
    "twice": '{"exam_pages":[],"exam_pages":[]}',
    "cut": json.dumps({"exam_pages": [{"exam_page": "8", "questions": [{**GOOD, "question_number": 9}]}, {"exam_page": 9, "questions": [GOOD]}]})[:-9],
    "long": json.dumps({"exam_pages": [{"exam_page": i, "questions": [GOOD] * 5, f"k{i}": i} for i in range(2_000)]}),
}


def kind(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def walk(v, path, known):
    expected = known if isinstance(known, str) or known is None else kind(known)
    yield path, kind(v), expected
    if isinstance(known, list) and isinstance(v, list):
        for x in v:
            yield from walk(x, path + "[]", known[0])
    if isinstance(known, dict) and isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}", known.get(k))
        for k, x in known.items():
            if k not in v:
                yield f"{path}.{k}", "missing", x if isinstance(x, str) else kind(x)


def once(pairs):
    if len(dict(pairs)) < len(pairs):
        raise ValueError
    return dict(pairs)


def slow_places(text):
    try:
        return [*walk(json.loads(text, object_pairs_hook=once), "$", KNOWN)]
    except (ValueError, TypeError):
        return [("$", "unreadable", "object")]


def test_places_are_a_walk(spark):
    df = spark.createDataFrame([*TEXTS.items()], RESPONSE)
    got = {(r.response_id, r.path, r.kind, r.expected): r.n for r in drift.response_places(df, "exam").collect()}
    want = {(i, *p): n for i, t in TEXTS.items() for p, n in Counter(slow_places(t)).items()}
    assert got == want
    assert (got["unknown", "$.exam_pages[].exam_page", "number", None], got["unknown", "$.exam_pages[].exam_page", "number", "number"]) == (1, 1)


def test_report_and_drift_count_responses(spark):
    df = spark.createDataFrame([*TEXTS.items()], RESPONSE)
    report = {(r.path, r.kind, r.expected): (r.status, r.responses, r.n) for r in drift.schema_report(df, "exam").collect()}
    each = [(i, p) for i, t in TEXTS.items() for p in slow_places(t)]
    assert {k: v[1:] for k, v in report.items()} == {p: (len({i for i, q in each if q == p}), n) for p, n in Counter(p for _, p in each).items()}
    assert report["$", "unreadable", "object"] == ("unreadable", 5, 5)
    assert report["$.exam_pages[].exam_page", "string", "number"] == ("differs", 2, 2)
    assert report["$.exam_pages[].questions[].sure", "array", None][0] == "unknown" and report["$.exam_pages", "missing", "array"] == ("missing", 1, 1)
    rows = {r.response_id: tuple(r)[1:] for r in drift.response_drift(df, "exam").collect()}
    assert rows["fits"] == (True, 0, 0, 0) and rows["broken"] == (False, 0, 0, 0) and rows["long"] == (True, 2_000, 0, 0)
    assert rows["kinds"] == (True, 0, 0, 5) and rows["empty"] == (True, 0, 1, 0)
    assert drift.schema_report(df.where("false"), "exam").count() == 0


def test_slides_have_places_too(spark):
    df = spark.createDataFrame([("a", '{"related_slides":[{"lecture_page":1,"key_concepts":["x",2]}]}')], RESPONSE)
    got = {(r.path, r.kind, r.status) for r in drift.schema_report(df, "lecture").collect() if r.status != "fits"}
    assert got == {("$.related_slides[].importance", "missing", "missing"), ("$.related_slides[].key_concepts[]", "number", "differs")}


def test_any_kinds_are_read(spark):
    df = spark.createDataFrame([*TEXTS.items()], RESPONSE)
    got = {}
    for r in drift.read_any_pages(df).orderBy("response_id", "pos").collect():
        got.setdefault(r.response_id, []).append((r.status, r.pos, r.exam_page, [tuple(q) for q in r.questions]))
    good = ("1", "t", "2")
    assert len(got.pop("long")) == 2_000
    assert got == {
        "fits": [("whole", 1, 1, [good])],
        "kinds": [("whole", 1, 4, [("3", "t", "2.5"), ("1", "t", "true")])],
        "word page": [("whole", 1, None, [good]), ("whole", 2, 5, [good])],
        "unknown": [("whole", 1, 1, [good])],
        "mixed": [("whole", 6, 7, [good])],
        "cut": [("cut", 1, 8, [("9", "t", "2")])],
    }
    assert drift.read_any_pages(df.where("false")).count() == 0
