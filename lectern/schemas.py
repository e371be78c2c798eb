"""Declared table schemas, as DDL."""

from __future__ import annotations

USERS = "user_id STRING, username STRING, is_admin INT"

DOCUMENTS = (
    "id BIGINT, filename STRING, safe_filename STRING, upload_timestamp TIMESTAMP, content STRING, "
    "author STRING, title STRING, publication_date STRING, source STRING, doi_url STRING"
)

CHUNKS = (
    "document_id BIGINT, chunk_index INT, chunk_text STRING, embedding ARRAY<FLOAT>"
)

CHAT_HISTORY = (
    "id BIGINT, user_id STRING, ts TIMESTAMP, selected_text STRING, question STRING, "
    "answer STRING, rating INT, comment STRING"
)

KNOWLEDGE_BASE = (
    "id BIGINT, question STRING, original_answer STRING, corrected_answer STRING, "
    "created_at TIMESTAMP, chat_history_id BIGINT, context_text STRING, corrected_by STRING, "
    "usage_count INT, embedding ARRAY<FLOAT>"
)

ENTRY = (
    "id BIGINT, question STRING, original_answer STRING, corrected_answer STRING, "
    "created_at TIMESTAMP, chat_history_id BIGINT, context_text STRING, corrected_by STRING, usage_count INT"
)

SELECTIONS = "ARRAY<STRUCT<id: STRING, text: STRING, document_name: STRING>>"

ASKS = (
    "ask_id BIGINT, question STRING, model STRING, token STRING, selected_text STRING, "
    f"active_document_name STRING, scoped_names ARRAY<STRING>, selections {SELECTIONS}"
)

KNOWLEDGE_INSERT = (
    "items ARRAY<STRUCT<question: STRING, answer: STRING, source: STRING>>"
)

EXTRACTION = (
    "text STRING, file_type STRING, page_count INT, char_count INT, truncated BOOLEAN, "
    "warnings ARRAY<STRING>"
)
