"""All queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, lines, lm, manifest, mixing, near_dups, secrets, survival, token_files, topk, toxicity, url_filters

MODULES = (secrets, decontaminate, near_dups, lines, lm, toxicity, token_files, chat, topk, mixing, survival, manifest, url_filters)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
