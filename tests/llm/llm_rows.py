from __future__ import annotations

MSG = "array<struct<role:string,content:string>>"
PROMPT = f"line_no BIGINT, id STRING, category STRING, conversations {MSG}, source STRING, lang STRING, batch_no INT"
LINE = "line_no BIGINT, raw_line STRING"
REGEN = f"resp_id BIGINT, conversations {MSG}, finish_reason STRING"
DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING, doc_domain STRING"


def msgs(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def prompt(n, content="text", id="x", category="c", batch=0, role="user"):
    return (n, id, category, msgs((role, content)), "s", "en", batch)
