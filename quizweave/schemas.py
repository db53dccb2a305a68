"""Schemas of the records that come from outside."""

QUESTION = "question_number: string, question_text: string, answer: string"
EXAM_PAGE = f"exam_page: int, questions: array<struct<{QUESTION}>>"
EXAM_RESPONSE = f"exam_pages array<struct<{EXAM_PAGE}>>, _corrupt string"
EXAM_FRAGMENT = f"exam_page int, questions array<struct<{QUESTION}>>, _corrupt string"
SLIDE_RESPONSE = "related_slides array<struct<lecture_page: int, importance: int, key_concepts: array<string>>>, _corrupt string"
SLIDE_FRAGMENT = "lecture_page int, importance int, key_concepts array<string>, _corrupt string"
RESPONSE_LOG = "response_id string, timestamp string, mode string, session_id string, files array<string>, response string, response_length int"
CHUNK_RESULT = f"lecture_idx int, lecture_path string, result struct<exam_pages: array<struct<{EXAM_PAGE}>>, error: string>, _corrupt string"
SESSION_STATE = "session_id string, mode string, exam_path string, lecture_paths array<string>, total_lectures int, processed_lectures int, status string, started_at string, _corrupt string"
JOB = "job_id string, exam_keys array<string>, lecture_keys array<string>, model string, multi_api boolean, min_relevance int"
STORED_RESULT = f"exam_pages array<struct<{EXAM_PAGE}>>, error string, _corrupt string"
