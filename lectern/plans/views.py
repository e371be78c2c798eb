"""The given tables seen with the engine's schemas.

Each view is one SQL text that both Spark and the SQL oracle read. Views take every row
and the whole text of the tables below them. Branches that the data leaves empty (errors,
citations, summary questions, copies with one more word) are planted by arithmetic on keys.
Times are epoch seconds. ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Tables whose rows cost much work each, with a key that deals them out evenly.
TABLES = ("customer", "documents", "embeddings", "conversations", "benchmark", "events", "pages")

VIEWS = {
    "users": """
        SELECT CAST(c_custkey AS STRING) AS user_id, c_name AS username,
               'tok-' || CAST(c_custkey AS STRING) AS token,
               CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS is_admin
        FROM {customer}""",
    "docs": """
        SELECT doc_id AS id,
               'doc_' || CAST(doc_id - CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS STRING)
                 || CASE WHEN doc_id % 10 <= 1 THEN '_contract.pdf'
                         WHEN doc_id % 3 = 0 THEN '_statute.docx' ELSE '_case.txt' END AS filename,
               1704067200 + doc_id * 60 AS uploaded_s,
               text AS content,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Title ' || CAST(doc_id AS STRING) END AS title,
               CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Author ' || CAST(doc_id % 17 AS STRING) END AS author,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(2000 + doc_id % 24 AS STRING) END AS publication_date,
               CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source,
               CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'doi/' || CAST(doc_id AS STRING) END AS doi_url
        FROM {documents}""",
    "chat": """
        SELECT id, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE CAST(conv_id % 61 AS STRING) END AS user_id,
               1706745600 + id AS ts_s,
               COALESCE(system_text, CASE WHEN id % 2 = 0 THEN question ELSE '' END) AS selected_text,
               question,
               CASE WHEN id % 11 = 0 THEN 'I CANNOT say more. ' || answer
                    WHEN id % 13 = 0 THEN '  Too short.  ' ELSE answer END AS answer,
               CASE WHEN id % 4 = 0 THEN NULL ELSE CAST((conv_id + turn) % 5 + 1 AS INT) END AS rating,
               CASE WHEN id % 3 = 0 THEN NULL ELSE 'comment ' || CAST(id AS STRING) END AS comment
        FROM (
            SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, u.turn, u.text AS question, a.text AS answer,
                   s.text AS system_text
            FROM {conversations} u
            JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
            LEFT JOIN {conversations} s ON s.conv_id = u.conv_id AND s.turn = 0 AND s.role = 'system'
            WHERE u.role = 'user') t""",
    "kb": """
        SELECT item_id AS id, text AS question,
               CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'Old answer ' || CAST(item_id AS STRING) END AS original_answer,
               'Answer: ' || text AS corrected_answer,
               1706745600 + item_id * 3600 AS created_s,
               CASE WHEN item_id % 6 = 0 THEN NULL ELSE item_id END AS chat_history_id,
               CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'ctx ' || CAST(item_id AS STRING) END AS context_text,
               CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'User' END AS corrected_by,
               CASE WHEN item_id % 7 = 0 THEN NULL ELSE CAST(item_id % 7 AS INT) END AS usage_count
        FROM {benchmark}""",
    "asks": """
        SELECT (conv_id * 1000 + turn) * 2 AS ask_id,
               text || CASE WHEN conv_id % 6 = 0 THEN ' Please write the SUMMARY.' ELSE '' END AS question,
               1706745600 + conv_id * 1800 + turn AS asked_s, conv_id, turn
        FROM {conversations} WHERE role = 'user'
        UNION ALL
        SELECT item_id * 2 + 1 AS ask_id, text || ' indeed' AS question,
               1706745600 + item_id * 3700 AS asked_s, CAST(NULL AS BIGINT) AS conv_id, CAST(NULL AS BIGINT) AS turn
        FROM {benchmark}""",
    "routed_asks": """
        SELECT a.ask_id, a.question, a.asked_s, COALESCE(a.conv_id % 6, 5) AS route,
               d.filename AS name1, e.filename AS name2,
               CASE WHEN a.conv_id % 5 = 0 THEN NULL ELSE 'tok-' || CAST(a.conv_id % 61 AS STRING) END AS token,
               CASE WHEN a.turn % 4 = 0 THEN '' ELSE a.question END AS past_selection
        FROM {asks} a
        LEFT JOIN {docs} d ON d.id = a.conv_id
        LEFT JOIN {docs} e ON e.id = a.conv_id + 1""",
    "fires": "SELECT event_id % 211 AS kb_id, event_id, ts FROM {events}",
    "rating_changes": """
        SELECT (event_id % 1009) * 1000 + event_id % 4 AS id, CAST(event_id % 5 + 1 AS INT) AS rating,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'note ' || CAST(event_id AS STRING) END AS comment,
               ts, event_id AS seq
        FROM {events}""",
    "corrections": """
        SELECT event_id AS seq, (event_id % 1013) * 1000 + event_id % 4 AS chat_id,
               'Corrected ' || event_type || ' ' || CAST(event_id AS STRING) AS corrected_answer,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'note ' || CAST(event_id AS STRING) END AS comment, ts
        FROM {events}""",
    "kb_edits": """
        SELECT event_id AS seq, event_id % 307 AS id, 'Edited ' || event_type AS question,
               'New answer ' || CAST(event_id AS STRING) AS answer, ts
        FROM {events}""",
    "qa_lines": """
        SELECT conv_id AS document_id, CASE WHEN turn < 4 THEN 1 ELSE 2 END AS part, turn,
               CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN 'Sure, here are the pairs:' || chr(10) ELSE '' END
               || CASE WHEN role = 'user' AND conv_id % 3 = 0
                         THEN 'Q: ' || text || chr(10) || 'A: short' || chr(10) || 'q:' || text
                       WHEN role = 'user' AND conv_id % 3 = 1
                         THEN 'Q: ' || text || chr(10) || 'A: A first answer of enough length.' || chr(13) || chr(10) || 'Q: ' || text
                       WHEN role = 'user' THEN 'Q:  ' || text
                       WHEN role = 'assistant' AND conv_id % 7 = 0
                         THEN 'a: draft' || chr(10) || chr(10) || '  A: ' || text || chr(10) || 'Q:' || chr(10) || 'A: nothing asked'
                       WHEN role = 'assistant' THEN 'A: ' || text
                       ELSE text END || chr(10) AS line
        FROM {conversations}""",
    "cited": """
        SELECT doc_id, text || CASE doc_id % 4
                 WHEN 0 THEN ' See Page ' || CAST(doc_id % 50 AS STRING) || ', p. 0' || CAST(doc_id % 9 AS STRING) || ' and page 7.'
                 WHEN 1 THEN ' p.3 p. 4 PAGE 5 page 6 p.7 p.8 page 3 homepage 9 page 10a'
                 WHEN 2 THEN ' page' || chr(10) || '12, pages 13, p 14'
                 ELSE '' END AS answer
        FROM {documents}""",
    "suggested": """
        SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  short   text ' ELSE text END AS snippet,
               '__SEARCHING__' || chr(10) || '__READY__' || chr(10) || CASE doc_id % 5
                 WHEN 0 THEN 'Here: ["What is stated in ' || CAST(doc_id AS STRING) || '?", "short", 12345678901, "ten chars!", "eleven char",' || chr(10) || '"Which parties are named?", "Which dates are named?", "What comes last here?"]'
                 WHEN 1 THEN 'No list today.'
                 WHEN 2 THEN 'Broken ["one question here", ]'
                 WHEN 3 THEN 'Empty [] list'
                 ELSE '["tiny", 5, null, true]' END AS response
        FROM {documents}""",
    "streams": """
        SELECT id, '__SEARCHING__' || chr(10)
               || '__CONTEXT__{{"similarity_score": 0.5, "context_source": "retrieval", "row": ' || CAST(id AS STRING) || '}}__' || chr(10) || chr(10)
               || '__READY__' || chr(10)
               || CASE WHEN id % 10 = 3 THEN '__ERROR__Request ' || CAST(id AS STRING) || ' failed__'
                       WHEN id % 10 = 2 THEN answer
                       ELSE answer || chr(10) || chr(10) || '__ENTRY_ID__' || CAST(id AS STRING) || '__' END AS transcript
        FROM {chat}""",
    "bodies": """
        SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '{{"results": []}}' ELSE
               '{{"results": [{{"caseName": "Case ' || CAST(doc_id AS STRING) || '", "court": "ca_' || CAST(doc_id % 12 AS STRING)
               || '_app", "dateFiled": "' || CAST(1990 + doc_id % 30 AS STRING) || '-05-01", "absolute_url": "/opinion/' || CAST(doc_id AS STRING)
               || '/", "snippet": "' || lang || '"}}, {{"case_name": "' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Other' END
               || '", "court_id": "scotus", "date_filed": "2001-01-01"}}]}}' END AS body
        FROM {documents}""",
    "raw_names": """
        SELECT page_id, CASE page_id % 6
                 WHEN 0 THEN url WHEN 1 THEN '../up/' || replace(url, '/', '|') || '.txt' WHEN 2 THEN url || '/' || chr(9) || 'a b' || chr(7) || '.md'
                 WHEN 3 THEN repeat(replace(url, '/', '-'), 12) WHEN 4 THEN '<<' || chr(63) || '>>' ELSE '' END AS filename
        FROM {pages}""",
    "metadata": """
        SELECT filename, MIN(author) AS author, MIN(title) AS title, MIN(publication_date) AS publication_date,
               MIN(source) AS source, MIN(doi_url) AS doi_url
        FROM {docs} WHERE title IS NOT NULL GROUP BY filename""",
    "form_files": """
        SELECT id, filename, CAST(length(content) AS BIGINT) * CASE WHEN id % 8 = 0 THEN 100000 ELSE 1 END AS size_bytes,
               CASE id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' ELSE NULL END AS mime_type
        FROM {docs}""",
    "json_texts": """
        SELECT event_id, CASE WHEN event_id % 10 = 0 THEN props || ' x' ELSE props END AS text FROM {events}""",
}


def needs(name: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[name])


class Tables:
    """Tables and views of one data folder as DataFrames, each built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder.rstrip("/"), {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            make = lambda: self.spark.read.parquet(self.path(name))
        elif name in VIEWS:
            make = lambda: self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in needs(name)})
        else:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]


def with_views(names: list[str], sql: str) -> str:
    """One SQL statement: the views named, those they need, then ``sql``."""
    ordered: list[str] = []

    def visit(name):
        if name in TABLES or name in ordered:
            return
        for n in needs(name):
            visit(n)
        ordered.append(name)

    for name in names:
        visit(name)
    def text(name):
        return VIEWS[name].format(**{n: (n if n in TABLES else f"v_{n}") for n in needs(name)})

    ctes = [f"v_{n} AS ({text(n)})" for n in ordered]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
