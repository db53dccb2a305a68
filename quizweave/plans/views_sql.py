"""DuckDB SQL of the fixture views, as common table expressions."""

from __future__ import annotations

import re

from ..sources.fixtures import DRIFTING_PAGE, MESSY_AFTER, MESSY_BEFORE

WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"



def _messy(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "][exam_page % 3 + 1]"


VIEWS = {
    "lecture_pages": "SELECT lecture_id, 'lec_' || lecture_id || '.pdf' AS lecture_name, unnest(range(1, len(ls) + 1)) AS page_no, unnest(ls) AS page_text FROM (SELECT doc_id AS lecture_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)",
    "lectures": "SELECT lecture_id, lecture_name, max(page_no) AS page_count FROM lecture_pages GROUP BY ALL",
    "questions": "SELECT item_id, item_id // 20 AS exam_id, 'exam_' || (item_id // 20) || '.pdf' AS exam_name, item_id % 20 + 1 AS question_number, (item_id % 20) // 5 + 1 AS exam_page, coalesce(text, '') AS question_text, (item_id % 5 + 1)::VARCHAR AS answer, substr(coalesce(text, ''), 1, 40) AS explanation, list_filter([1, 2, 3, 4], lambda k: k <> item_id % 5 + 1) AS wrong FROM benchmark",
    "exam_counts": "SELECT exam_id, exam_name, max(exam_page) AS page_count FROM questions GROUP BY ALL",
    "exam_pages": "SELECT exam_id, exam_name, exam_page AS page_no, string_agg(question_number || '. ' || replace(question_text, chr(10), ' '), chr(10) ORDER BY question_number) AS page_text FROM questions GROUP BY ALL",
    "scan_lines": """SELECT exam_id, row_number() OVER (PARTITION BY exam_id ORDER BY q, k) - 1 AS line_no, line FROM (SELECT exam_id, 0 AS q, 0 AS k, 'Exam ' || exam_id AS line FROM exam_counts UNION ALL
        SELECT exam_id, question_number, k, CASE WHEN k = 0 THEN question_number || '. ' ELSE '' END || substr(t, k * 60 + 1, 60) FROM (SELECT exam_id, question_number, t, unnest(range(0, greatest(1, (length(t) + 59) // 60))) AS k FROM (SELECT exam_id, question_number, replace(question_text, chr(10), ' ') AS t FROM questions)))""",
    "scan_heads": r"SELECT exam_id, line_no, line, line_no // 15 + 1 AS page_no, line_no % 15 + 1 AS line_on_page, CASE WHEN n > 0 THEN n END AS number, last_value(CASE WHEN n > 0 THEN line_no END IGNORE NULLS) OVER (PARTITION BY exam_id ORDER BY line_no) AS head FROM (SELECT *, try_cast(regexp_extract(line, '^\s*(\d+)[.)번]', 1) AS BIGINT) AS n FROM scan_lines)",
    "regions": "SELECT l.exam_id, h.number, h.page_no AS start_page, h.line_on_page AS start_line, l.page_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS part FROM scan_heads l JOIN scan_heads h ON l.exam_id = h.exam_id AND l.head = h.line_no GROUP BY ALL",
    "located": """SELECT q.*, coalesce((SELECT min_by(p, abs(p - hint) * 100000 + p) FROM (SELECT DISTINCT page_no AS p FROM scan_heads s WHERE s.exam_id = q.exam_id AND s.number = q.question_number)), hint) AS start_page FROM (SELECT *, exam_page AS hint FROM questions) q""",
    "located_parts": """SELECT q.*, coalesce(r.page_no, q.start_page) AS page_no, r.part FROM located q LEFT JOIN (SELECT *, min(start_line) OVER (PARTITION BY exam_id, number, start_page) AS first_line FROM regions) r
        ON r.exam_id = q.exam_id AND r.number = q.question_number AND r.start_page = q.start_page AND r.start_line = r.first_line""",
    "reported": "SELECT *, exam_page + CASE WHEN item_id % 7 = 0 THEN 4 ELSE 0 END - CASE WHEN item_id % 11 = 0 THEN 4 ELSE 0 END AS reported_page, CASE WHEN item_id % 9 <> 0 THEN exam_name END AS source_name, CASE WHEN item_id % 13 = 0 THEN '번호없음' ELSE question_number || '번' END AS raw_number FROM questions",
    "q_words": f"SELECT item_id, {WORDS.format('question_text')} AS qw FROM questions",
    "p_words": f"SELECT lecture_id, page_no, {WORDS.format('page_text')} AS pw FROM lecture_pages",
    "scored": "SELECT item_id, lecture_id, page_no, (CASE WHEN len(qw) >= 5 AND contains(' ' || array_to_string(pw, ' ') || ' ', ' ' || array_to_string(qw, ' ') || ' ') THEN 110 ELSE 5 * ((20 * len(list_intersect(list_distinct(qw), list_distinct(pw)))) // len(list_distinct(qw))) END)::BIGINT AS score FROM q_words, p_words WHERE len(qw) > 0",
    "links": "SELECT * FROM scored WHERE score >= 50",
    "chunk_links": "SELECT item_id, lecture_id, page_no, score, (page_no - 1) // 40 AS chunk_no, (page_no - 1) % 40 + 1 AS local_page, lecture_id * 1000 + (page_no - 1) // 40 AS input_order FROM scored, range(2) c(copy) WHERE score >= 25 AND (copy = 0 OR item_id % 5 = 0)",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lecture_id, page_no) AS rank FROM links) WHERE rank <= 2",
    "responses": """SELECT exam_id AS response_id, CASE WHEN exam_id % 2 = 1 THEN substr(whole, 1, length(whole) * 7 // 10) ELSE whole END AS text FROM (
        SELECT exam_id, '{"exam_pages":[' || string_agg(p, ',' ORDER BY exam_page) || '],"summary":{"done":true}}' AS whole FROM (
        SELECT exam_id, exam_page, '{"exam_page":' || exam_page || ',"questions":[' || string_agg('{"question_number":"' || question_number || '","question_text":"' || md5(question_text) || '"' || CASE WHEN item_id % 6 = 0 THEN '' ELSE ',"answer":"' || answer || '"' END || '}', ',' ORDER BY question_number) || ']}' AS p
        FROM questions GROUP BY exam_id, exam_page) GROUP BY exam_id)""",
    "slide_responses": """SELECT exam_id AS response_id, CASE WHEN exam_id % 2 = 1 THEN substr(whole, 1, length(whole) * 7 // 10) ELSE whole END AS text FROM (
        SELECT exam_id, '{"related_slides":[' || string_agg('{"lecture_page":' || exam_page || ',"importance":' || (exam_page * 20 + 5) || ',"key_concepts":["c' || exam_page || '","e' || exam_id || '"]}', ',' ORDER BY exam_page) || ']}' AS whole
        FROM (SELECT DISTINCT exam_id, exam_page FROM questions) GROUP BY exam_id)""",
    "pieces": """SELECT response_id, pos, json_extract(j, '$.exam_page')::BIGINT AS exam_page, json_array_length(j, '$.questions') AS n_all, len(json_extract(j, '$.questions[*].answer')) AS n_complete, j FROM (
        SELECT response_id, pos, '{"exam_page":' || left(f, strpos(f, ']}') + 1) AS j FROM (
        SELECT response_id, unnest(fs[2:]) AS f, unnest(range(1, len(fs))) AS pos FROM (SELECT response_id, string_split(text, '{"exam_page":') AS fs FROM responses)) WHERE strpos(f, ']}') > 0) WHERE json_valid(j)""",
    # a page is complete if it ends within the characters that are left
    "messy_parts": f"""SELECT exam_id, exam_page, list, part, n_questions FROM (SELECT exam_id, exam_page, count(*) AS n_questions, unnest(['exam_pages', 'related_slides']) AS list, unnest([
        '{{' || {_messy(MESSY_BEFORE)} || '"exam_page":' || exam_page || ',"questions":[' || string_agg('{{"question_number":"' || question_number || '","question_text":"{{' || md5(question_text) || '","answer":"' || answer || ']"}}', ',' ORDER BY question_number) || ']' || {_messy(MESSY_AFTER)} || '}}',
        '{{' || replace({_messy(MESSY_BEFORE)}, 'exam_page', 'lecture_page') || '"importance":' || (exam_page * 20 + 5) || ',"key_concepts":["c}}' || exam_page || '"],"lecture_page":' || exam_page || '}}']) AS part FROM questions GROUP BY exam_id, exam_page)""",
    "messy": """SELECT *, list || '_' || exam_id AS response_id, row_number() OVER w AS pos, 26 + length(list) + sum(length(part) + 1) OVER w - 1 AS ends,
        (26 + length(list) + sum(length(part) + 1) OVER (PARTITION BY exam_id, list) - 1 + 2) * (20 + exam_id * 37 % 80) // 100 AS kept FROM messy_parts WINDOW w AS (PARTITION BY exam_id, list ORDER BY exam_page)""",
    "drifting": f"""SELECT response_id, CASE WHEN response_id % 6 = 1 THEN substr(whole, 1, CAST(floor(length(whole) * 0.7) AS INT)) ELSE whole END AS text FROM (
    SELECT doc_id AS response_id, CASE WHEN doc_id % 11 = 3 THEN '{{"exam_pages":{{"a":1}}}}' WHEN doc_id % 11 = 4 THEN '[1,2]' ELSE '{{"exam_pages":[' || {DRIFTING_PAGE} || ',{{"exam_page":77,"questions":[{{"question_number":"1","question_text":"t","answer":"1"}}]}},'
    || {DRIFTING_PAGE} || '],"model":"m"}}' END AS whole FROM documents WHERE doc_id IS NOT NULL) AS w""",
    "calls": """SELECT event_id, ts, user_id % 5 AS key_id, event_id // 3 AS request_id, event_id % 3 AS attempt, event_type <> 'error' AS ok,
        CASE WHEN event_type = 'error' THEN ['429 quota exceeded', '403 permission denied', 'request timeout', 'invalid api key', 'internal error'][(props->>'$.k')::BIGINT % 5 + 1] END AS error,
        CASE event_type WHEN 'signup' THEN 'MAX_TOKENS' WHEN 'purchase' THEN 'SAFETY' ELSE 'STOP' END AS finish_reason, user_id AS job_id FROM events""",
    "sessions": """SELECT conv_id, total_chunks, created, strftime(created, '%Y%m%d_%H%M%S') || '_' || substr(md5(conv_id::VARCHAR), 1, 6) AS session_id,
        CASE WHEN conv_id % 10 = 0 THEN 'no_state' WHEN conv_id % 10 = 1 THEN 'error' WHEN last_role = 'assistant' THEN 'complete' ELSE 'processing' END AS status
        FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS total_chunks, max_by(role, turn) AS last_role, TIMESTAMP '2024-01-01' + to_hours(conv_id * 7) AS created FROM conversations GROUP BY conv_id)""",
    "session_files": "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'results' WHEN 'user' THEN 'debug' ELSE 'sessions' END AS class, strlen(coalesce(text, ''))::BIGINT AS size, TIMESTAMP '2024-01-01' + to_hours(conv_id * 7 + turn) AS modified, 'chunk_' || conv_id || '_' || turn || '_lec_' || (conv_id % 50) || '.pdf.json' AS file_name FROM conversations",
    "jobs": "SELECT conv_id AS job_id, ['exam:' || conv_id || ':exam_' || (conv_id % 2) || '.pdf:' || md5(conv_id::VARCHAR)] AS exam_keys, ['lecture:' || conv_id || ':lec_' || (conv_id % 50) || '.pdf:' || md5(conv_id::VARCHAR)] AS lecture_keys, CASE WHEN conv_id % 2 = 0 THEN 'pro' ELSE 'flash' END AS model, 50 + 5 * (conv_id % 5) AS min_relevance FROM (SELECT DISTINCT conv_id FROM conversations)",
    "chunk_status": "SELECT conv_id AS job_id, turn AS chunk_no, file_name, turn % 5 = 3 AS failed FROM session_files WHERE class = 'results'",
    "expected": "SELECT conv_id AS job_id, count(*) FILTER (WHERE role = 'user') AS expected FROM conversations GROUP BY conv_id",
    "chunks": "SELECT lecture_id, (s - 1) // 40 AS chunk_no, s AS start_page, least(s + 39, page_count) AS end_page FROM (SELECT lecture_id, page_count, unnest(range(1, page_count + 1, 40)) AS s FROM lectures)",
    "extents": """SELECT *, exam_page AS start_page, CASE WHEN last_q AND exam_page < page_count THEN exam_page + 1 ELSE exam_page END AS end_page FROM (
        SELECT q.*, c.page_count, lead(question_number) OVER (PARTITION BY q.exam_id, q.exam_page ORDER BY question_number) IS NULL AS last_q FROM questions q JOIN exam_counts c USING (exam_id)) WHERE exam_page BETWEEN 1 AND page_count""",
    "index_": r"SELECT exam_id, number, list_sort(list(DISTINCT page_no)) AS pages FROM (SELECT exam_id, page_no, unnest(regexp_extract_all(page_text, '(?m)^\s*(\d+)[.)번]', 1))::BIGINT AS number FROM exam_pages) WHERE number > 0 AND page_no > 0 GROUP BY exam_id, number",
}


def with_views(body: str) -> str:
    """body with the views that it needs before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"(?:\bFROM|\bJOIN|,)\s*\(?{name}\b", text):
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    body = body.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
