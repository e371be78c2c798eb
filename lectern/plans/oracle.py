"""SQL oracles for DuckDB: the same results stated independently of the Spark operators."""

from __future__ import annotations

from lectern.plans.views import with_views

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"
JS_WS = r"[\t-\r\p{Z}\x{FEFF}]+"


def _words(x, ws=WS):
    return f"list_filter(regexp_split_to_array({x}, '{ws}'), lambda w: w <> '')"


def _set(x):
    return f"list_distinct({_words(f'lower({x})')})"


def _trim(x, ws=WS):
    return f"regexp_replace(regexp_replace({x}, '^{ws}', ''), '{ws}$', '')"


CHUNKS = f"""chunks AS (
    SELECT document_id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS chunk_text FROM (
        SELECT id AS document_id, list_reduce(list_transform(ws, lambda w: [w]), lambda a, b:
            CASE WHEN length(a[-1]) + 1 + length(b[1]) <= 500
                 THEN list_append(a[:-2], a[-1] || ' ' || b[1]) ELSE list_concat(a, b) END) AS cs
        FROM (SELECT id, {_words('content')} AS ws FROM v_docs) w WHERE len(ws) > 0) f)"""

NL = "chr(10)"

# Cosine of word sets: shared words over the root of both sizes, all pairs of c and q.
SCORED = """cx AS (SELECT cid, unnest(cw) AS w FROM c), qx AS (SELECT qid, unnest(qw) AS w FROM q),
    dots AS (SELECT qid, cid, count(*) AS d FROM qx JOIN cx USING (w) GROUP BY ALL),
    scored AS (SELECT q.qid, c.cid, coalesce(d, 0) AS d,
                      coalesce(d, 0)::DOUBLE / sqrt(len(cw)::DOUBLE * len(qw)::DOUBLE) AS sim
               FROM q CROSS JOIN c LEFT JOIN dots ON dots.qid = q.qid AND dots.cid = c.cid
               WHERE len(qw) > 0 AND len(cw) > 0 {extra})"""

KB_OUT = """kb_id, kb.question AS kb_question, kb.corrected_answer AS answer,
    coalesce(nullif(kb.context_text, ''), '') AS context,
    coalesce(nullif(kb.corrected_by, ''), 'Unknown') AS corrected_by, coalesce(kb.usage_count, 0) AS usage_count"""

KB_TOP = f"""q AS (SELECT ask_id AS qid, {_set('question')} AS qw FROM v_asks),
    c AS (SELECT id AS cid, {_set('question')} AS cw FROM v_kb), {SCORED.format(extra='')},
    kb_top AS (SELECT qid AS ask_id, cid AS kb_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rank
               FROM scored QUALIFY rank <= 3)"""

CHUNK_TOP = f"""q AS (SELECT ask_id AS qid, {_set('question')} AS qw FROM v_asks),
    c AS (SELECT document_id * 10000000 + chunk_index AS cid, {_set('chunk_text')} AS cw FROM chunks),
    {SCORED.format(extra='')},
    chunk_top AS (SELECT qid AS ask_id, cid, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rank
                  FROM scored QUALIFY rank <= 4)"""

SCOPED = f"""scope AS (
        SELECT DISTINCT ask_id, question, d.id AS document_id
        FROM v_routed_asks a JOIN v_docs d ON d.filename IN (a.name1, a.name2) WHERE route IN (0, 4)),
    scoped AS (
        SELECT ask_id, document_id, chunk_index, chunk_text,
               len(list_intersect({_set('question')}, {_set('chunk_text')}))::DOUBLE
                 / sqrt(len({_set('question')})::DOUBLE * len({_set('chunk_text')})::DOUBLE) AS similarity
        FROM scope JOIN chunks USING (document_id) WHERE len({_set('question')}) > 0)"""

IS_SUMMARY = """(lower(question) LIKE '%summary%' OR lower(question) LIKE '%summarize%' OR lower(question) LIKE '%summarise%'
    OR lower(question) LIKE '%overview%' OR lower(question) LIKE '%briefly%' OR lower(question) LIKE '%in short%'
    OR lower(question) LIKE '%1-2 sentences%' OR lower(question) LIKE '%one or two sentences%'
    OR lower(question) LIKE '%write the summary%')"""


def _block(cap):
    return f"""'Document title: ' || coalesce(nullif(d.title, ''), d.filename) || {NL} || 'Document file: ' || d.filename
        || {NL} || {NL} || substr(d.content, 1, {cap})
        || CASE WHEN length(d.content) > {cap} THEN {NL} || {NL} || '[Truncated to keep the prompt responsive.]' ELSE '' END"""


RULE = f"{NL} || {NL} || '---' || {NL} || {NL}"

CONTEXT = f"""{CHUNKS}, {CHUNK_TOP}, {SCOPED},
    first_name AS (SELECT filename, min(id) AS id FROM v_docs GROUP BY filename),
    routed AS (SELECT a.*, f.id AS active_id, {IS_SUMMARY} AS wants_summary FROM v_routed_asks a
               LEFT JOIN first_name f ON a.route = 3 AND f.filename = a.name1),
    summaries AS (
        SELECT a.ask_id, string_agg({_block(12000)}, {RULE} ORDER BY d.id) AS prompt_text, count(*) AS n_chunks,
               min_by({_block(12000)}, d.id) AS first_chunk
        FROM routed a JOIN v_docs d ON d.filename IN (a.name1, a.name2)
        WHERE route IN (0, 4) AND wants_summary GROUP BY a.ask_id),
    ranked AS (
        SELECT ask_id, cid // 10000000 AS document_id, cid % 10000000 AS chunk_index, rank, sim FROM chunk_top
        JOIN v_routed_asks r USING (ask_id)
        WHERE NOT (route IN (0, 4) AND (name1 IS NOT NULL OR name2 IS NOT NULL))
        UNION ALL
        SELECT ask_id, document_id, chunk_index,
               row_number() OVER (PARTITION BY ask_id ORDER BY similarity DESC, document_id, chunk_index) AS rank, similarity
        FROM scoped QUALIFY rank <= 4),
    hits AS (
        SELECT ask_id, string_agg({NL} || {NL} || chunk_text, '' ORDER BY rank) AS prompt_text, count(*) AS n_chunks,
               max(sim) AS best, min_by(chunk_text, rank) AS first_chunk
        FROM ranked JOIN chunks USING (document_id, chunk_index) GROUP BY ask_id),
    context AS (
        SELECT a.ask_id, a.question, CASE WHEN route = 3 THEN name1 END AS active_document_name,
            CASE WHEN route = 1 THEN '[Selection 1 from: ' || coalesce(name1, 'none') || ']' || {NL} || question || {RULE}
                    || '[Selection 2 from: ' || coalesce(name2, 'none') || ']' || {NL} || 'Second: ' || question
                 WHEN route = 2 AND {_trim('question')} <> '' THEN {_trim('question')}
                 WHEN active_id IS NOT NULL THEN {_block(14000)}
                 WHEN s.ask_id IS NOT NULL THEN s.prompt_text ELSE coalesce(h.prompt_text, '') END AS prompt_text,
            CASE WHEN route IN (1, 2) OR active_id IS NOT NULL THEN 1 WHEN s.ask_id IS NOT NULL THEN s.n_chunks
                 ELSE coalesce(h.n_chunks, 0) END AS n_chunks,
            CASE WHEN route IN (1, 2) OR active_id IS NOT NULL OR s.ask_id IS NOT NULL THEN 1.0::DOUBLE
                 ELSE coalesce(h.best, 0.0)::DOUBLE END AS best_similarity,
            CASE WHEN route IN (1, 2) THEN 'selected_text' WHEN active_id IS NOT NULL THEN 'active_document'
                 WHEN s.ask_id IS NOT NULL THEN 'summary_document' ELSE 'retrieval' END AS context_source,
            CASE WHEN s.ask_id IS NOT NULL THEN s.first_chunk ELSE h.first_chunk END AS part_chunk
        FROM routed a LEFT JOIN v_docs d ON d.id = a.active_id
        LEFT JOIN summaries s ON s.ask_id = a.ask_id LEFT JOIN hits h ON h.ask_id = a.ask_id)"""

INSTRUCTIONS = [
    "Answer using only the provided context when it contains relevant information.",
    "If the context is insufficient, say what is missing instead of guessing.",
    "Do not include internal tags, metadata, JSON, or the words CONTEXT/QUESTION in the answer.",
    "If a specific document or highlighted excerpt was provided, treat it as the primary source and do not mix in unrelated documents.",
    "Keep the answer concise, structured, and directly responsive to the question.",
]

GATE = f"""CASE WHEN length({_trim('answer')}) < 80 THEN 'too_short'
    WHEN regexp_matches(lower(answer), 'i don''t know|i cannot|not enough context|insufficient|unable to answer|__error__')
    THEN 'error_phrase' END"""


def _greedy(items):
    """Sequential replay over ``items(id, w)``: an item stays unless an earlier one that stayed is near."""
    return f"""items AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM ({items})),
    ix AS (SELECT n, id, len(w) AS size, unnest(w) AS w FROM items),
    near AS MATERIALIZED (SELECT a.n, b.id AS other FROM ix a JOIN ix b ON a.w = b.w AND b.n < a.n
             GROUP BY a.n, b.id, a.size, b.size HAVING 10000 * count(*) * count(*) > 8464 * a.size * b.size),
    ordered AS MATERIALIZED (SELECT i.n, i.id, coalesce(list(other) FILTER (WHERE other IS NOT NULL), []) AS others
                FROM items i LEFT JOIN near USING (n) GROUP BY i.n, i.id),
    replay(n, kept) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT o.n, CASE WHEN list_has_any(o.others, r.kept) THEN r.kept ELSE list_append(r.kept, o.id) END
        FROM replay r JOIN ordered o ON o.n = r.n + 1),
    kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM replay ORDER BY n DESC LIMIT 1))"""


def _dense_greedy(items):
    """The same over dense vectors ``items(id, e)``."""
    near = """near AS MATERIALIZED (SELECT a.n, b.id AS other FROM items a JOIN items b ON b.n < a.n
             WHERE list_cosine_similarity(a.e, b.e) > 0.92),"""
    plain = _greedy(items)
    return plain[:plain.index("ix AS")] + near + plain[plain.index("    ordered AS"):]


def _turned(e, share, size="64"):
    return f"list_transform(range(1, {size} + 1), lambda i: {share} * {e}[i] + 0.3 * {e}[i % {size} + 1])"


VECTORS = "vs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"

AUTO = f"""good AS (SELECT *, {_set('question')} AS w FROM v_chat WHERE ({GATE}) IS NULL),
    q AS (SELECT id AS qid, w AS qw FROM good), c AS (SELECT id AS cid, {_set('question')} AS cw FROM v_kb),
    {SCORED.format(extra='')},
    known AS (SELECT DISTINCT qid FROM scored WHERE sim > 0.92),
    {_greedy("SELECT id, w FROM good WHERE id NOT IN (SELECT qid FROM known)")}"""

# Q/A lines: number the pairs by 'q:' lines, drop what precedes the last 'a:' of a pair.
QA = f"""lines AS (
        SELECT document_id, part, {_trim('unnest(ls)')} AS l, unnest(range(len(ls))) AS pos FROM (
            SELECT document_id, part,
                   regexp_split_to_array(string_agg(line, '' ORDER BY turn), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls
            FROM v_qa_lines GROUP BY ALL) t),
    tagged AS (
        SELECT *, CASE WHEN lower(l[1:2]) = 'q:' THEN 'q' WHEN lower(l[1:2]) = 'a:' THEN 'a' ELSE 'o' END AS tag FROM lines),
    numbered AS (
        SELECT *, sum(CASE WHEN tag = 'q' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, part ORDER BY pos) AS pair FROM tagged),
    answered AS (
        SELECT *, max(CASE WHEN tag = 'a' THEN pos END) OVER (PARTITION BY document_id, part, pair) AS a_pos FROM numbered WHERE pair > 0),
    pairs_all AS (
        SELECT document_id, part, pair,
               max(CASE WHEN tag = 'q' THEN {_trim('l[3:]')} END) AS question,
               {_trim("string_agg(CASE WHEN tag = 'a' THEN " + _trim('l[3:]') + " ELSE l END, ' ' ORDER BY pos) FILTER (WHERE pos >= a_pos AND tag <> 'q' AND (tag = 'a' OR l <> ''))")} AS answer
        FROM answered GROUP BY ALL),
    pairs AS (
        SELECT document_id, part, row_number() OVER (PARTITION BY document_id, part ORDER BY pair) - 1 AS pos, question, answer
        FROM pairs_all WHERE question <> '' AND answer IS NOT NULL)"""

# The uploaded bytes of the extract queries, as the text they hold.
UPLOADS = f"""uploads AS (
        SELECT id, filename, CASE WHEN id % 9 = 0 THEN '' WHEN id % 11 = 0 THEN content WHEN id % 13 = 0 THEN content
                                  WHEN id % 17 = 0 THEN ' ' ELSE content END AS body,
               id % 9 <> 0 AND id % 11 = 0 AS has_nul, id % 9 <> 0 AND id % 11 <> 0 AND id % 13 = 0 AS is_pdf,
               id % 9 = 0 AS is_empty FROM v_docs),
    judged AS (
        SELECT *, CASE WHEN is_pdf THEN 'pdf' WHEN NOT has_nul OR filename LIKE '%.txt' THEN 'text' ELSE 'unknown' END AS file_type FROM uploads),
    extracted AS (
        SELECT *, CASE WHEN is_empty THEN 'empty' WHEN file_type = 'unknown' THEN 'unsupported' WHEN is_pdf THEN 'pdf_unavailable'
                       WHEN {_trim('body')} = '' AND NOT has_nul THEN 'blank_text' END AS error_code FROM judged)"""

# Task prompts and suggestions, written out again so that a change in the code shows.
TASKS = (
    ("research", "llama3.1:8b", "You are a document assistant. Answer only from the provided context when possible. If insufficient, say what is missing instead of guessing."),
    ("argument", "gemma4:31b", "You are a legal research assistant. Structure every argument in IRAC format: Issue, Rule, Application, Conclusion. Cite specific page numbers for every claim. Flag weaknesses opposing counsel might exploit."),
    ("precedents", "gemma4:31b", "You are a legal research assistant. Identify and explain relevant legal precedents from the document. Note applicable jurisdictions and how they relate to the case."),
    ("risk", "gemma4:31b", "You are a legal risk analyst. Identify ambiguous language, missing standard clauses, unfavorable terms, and jurisdiction risks. Rate each risk High/Medium/Low with page citations."),
    ("clause", "llama3.1:8b", "You are a contract analysis assistant. Extract the requested clause type precisely. Return: exact clause text, plain English explanation, and risk level (Low/Medium/High). If missing, state explicitly."),
    ("summarize", "gemma4:31b", "You are a legal document analyst. Provide a structured summary covering: parties involved, key dates, main obligations, and notable clauses or findings."),
)
DEFAULT_SUGGESTIONS = (
    "What are the key parties and their obligations?",
    "What are the main legal risks in this document?",
    "What are the important dates and deadlines?",
    "Are there any unusual or concerning clauses?",
)

ORACLE: dict[str, str] = {}


def _add(name, views, sql):
    ORACLE[name] = with_views(views, sql)


def _build():
    _add("chunk_documents", ["docs"], f"WITH {CHUNKS} SELECT document_id, chunk_index, chunk_text FROM chunks")
    _add("chunk_counts", ["docs"], f"""WITH {CHUNKS}
        SELECT id, (SELECT count(*) FROM chunks WHERE document_id = v_docs.id) AS chunks_count FROM v_docs""")
    _add("embed_chunks", ["docs"], f"WITH {CHUNKS} SELECT document_id, chunk_index, len({_set('chunk_text')}) AS n_features FROM chunks")
    _add("retrieve_chunks", ["docs", "asks"], f"""WITH {CHUNKS}, {CHUNK_TOP}
        SELECT ask_id, rank, cid // 10000000 AS document_id, cid % 10000000 AS chunk_index, sim AS similarity FROM chunk_top""")
    _add("scoped_topk", ["docs", "routed_asks"], f"""WITH {CHUNKS}, {SCOPED}
        SELECT ask_id, row_number() OVER (PARTITION BY ask_id ORDER BY similarity DESC, document_id, chunk_index) AS rank,
               document_id, chunk_index, similarity FROM scoped QUALIFY rank <= 3""")
    _add("vector_topk", [], """WITH s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
                   list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s
            FROM embeddings q CROSS JOIN embeddings c)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id) AS rank, corpus_id,
               round(s, 5) AS score FROM s QUALIFY rank <= 3""")
    _add("kb_semantic_topk", ["asks", "kb"], f"""WITH {KB_TOP}
        SELECT ask_id, rank, {KB_OUT}, sim AS relevance_score FROM kb_top JOIN v_kb kb ON kb.id = kb_id WHERE sim >= 0.5""")
    _add("kb_asof_replay", ["asks", "kb"], f"""WITH
        q AS (SELECT ask_id AS qid, asked_s, {_set('question')} AS qw FROM v_asks),
        c AS (SELECT id AS cid, created_s, {_set('question')} AS cw FROM v_kb), {SCORED.format(extra='AND created_s < asked_s')}
        SELECT qid AS ask_id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rank, cid AS kb_id,
               sim AS relevance_score FROM scored QUALIFY rank <= 3""")
    _add("kb_keyword_topk", ["asks", "kb"], f"""WITH
        q AS (SELECT ask_id AS qid, {_set('question')} AS qw FROM v_asks),
        c AS (SELECT id AS cid, {_set('question')} AS cw FROM v_kb), {SCORED.format(extra='')}
        SELECT qid AS ask_id, row_number() OVER (PARTITION BY qid ORDER BY d DESC, cid) AS rank, cid AS kb_id,
               d::DOUBLE AS relevance_score FROM scored WHERE d > 0 QUALIFY rank <= 3""")
    recent = """recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS recency
                FROM v_chat QUALIFY recency <= 20),
        who AS (SELECT r.*, u.user_id AS uid FROM v_routed_asks r LEFT JOIN v_users u ON u.token = r.token)"""
    _add("history_latest20", ["routed_asks", "users", "chat"], f"""WITH {recent}
        SELECT ask_id AS request_id, recency, h.id, h.question FROM who JOIN recent h ON h.user_id IS NOT DISTINCT FROM who.uid""")
    _add("history_relevance", ["routed_asks", "users", "chat"], f"""WITH {recent},
        s AS (SELECT ask_id, h.id,
                len(list_filter({_words('lower(who.question)')}, lambda w: contains(lower(h.question), w)))
                + 2 * len(list_filter({_words('lower(past_selection)')}, lambda w: contains(lower(h.selected_text), w))) AS score
              FROM who JOIN recent h ON h.user_id IS NOT DISTINCT FROM who.uid)
        SELECT ask_id, row_number() OVER (PARTITION BY ask_id ORDER BY score DESC, id DESC) AS rank, id, score AS relevance_score
        FROM s WHERE score > 0 QUALIFY rank <= 3""")
    _add("user_lookup", ["routed_asks", "users"],
         "SELECT ask_id, r.token, user_id FROM v_routed_asks r LEFT JOIN v_users u ON u.token = r.token")
    _add("admin_flags", ["routed_asks", "users"],
         "SELECT ask_id, r.token, coalesce(is_admin = 1, false) AS is_admin FROM v_routed_asks r LEFT JOIN v_users u ON u.token = r.token")

    _add("summary_intent", ["asks"], f"SELECT ask_id, {IS_SUMMARY} AS is_summary FROM v_asks")
    context_views = ["docs", "asks", "routed_asks"]
    _add("context_cascade", context_views, f"""WITH {CONTEXT}
        SELECT ask_id, prompt_text, n_chunks, best_similarity, context_source FROM context""")
    tail = " || chr(10) || ".join(f"'{line}'" for line in INSTRUCTIONS)
    kb_block = f"{NL} || {NL} || '<knowledge_base_corrections>' || {NL}"
    _add("prompt_assembly", context_views + ["kb"], f"""WITH {CONTEXT},
        kq AS (SELECT ask_id, {_set('question')} AS qw FROM v_asks), kc AS (SELECT id, question, corrected_answer, {_set('question')} AS cw FROM v_kb),
        ks AS (SELECT ask_id, id, question, corrected_answer,
                      len(list_intersect(qw, cw))::DOUBLE / sqrt(len(qw)::DOUBLE * len(cw)::DOUBLE) AS sim
               FROM kq CROSS JOIN kc WHERE len(qw) > 0 AND len(cw) > 0),
        kt AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY sim DESC, id) AS r FROM ks QUALIFY r <= 3),
        kb AS (SELECT ask_id, string_agg(id::VARCHAR, ',' ORDER BY r) AS kb_ids,
                      string_agg('Q: ' || question || {NL} || 'A: ' || corrected_answer || {NL} || '---' || {NL}, '' ORDER BY r) AS block
               FROM kt WHERE sim >= 0.5 GROUP BY ask_id)
        SELECT c.ask_id, coalesce(kb_ids, '') AS kb_ids, '<context>' || {NL} || prompt_text
               || coalesce({kb_block} || block || '</knowledge_base_corrections>', '')
               || {NL} || '</context>' || {NL} || {NL} || '<question>' || {NL} || question || {NL} || '</question>' || {NL} || {NL} || {tail} AS prompt
        FROM context c LEFT JOIN kb ON kb.ask_id = c.ask_id""")
    _add("context_record", context_views, f"""WITH {CONTEXT}
        SELECT ask_id, CASE WHEN context_source IN ('selected_text', 'active_document') THEN prompt_text ELSE part_chunk END AS first_chunk,
               context_source, best_similarity AS similarity_score, active_document_name FROM context""")
    _add("selection_summary", ["routed_asks"], """SELECT ask_id, 2 AS n_selections, 2 * length(question) + 8 AS total_chars,
        length(question)::VARCHAR || ',' || (length(question) + 8)::VARCHAR AS lengths FROM v_routed_asks WHERE route = 1""")
    _add("document_names", ["routed_asks"], """SELECT ask_id, CASE
            WHEN route = 1 THEN CASE WHEN coalesce(name1, 'none') = coalesce(name2, 'none') THEN coalesce(name1, 'none')
                                     ELSE coalesce(name1, 'none') || '|' || coalesce(name2, 'none') END
            WHEN route = 3 THEN coalesce(name1, '') ELSE '' END AS names FROM v_routed_asks""")
    _add("context_mode", ["routed_asks"], """SELECT ask_id, CASE WHEN route = 2 THEN 'selected_text'
        WHEN route IN (0, 4) AND (name1 IS NOT NULL OR name2 IS NOT NULL) THEN 'all_documents' ELSE 'general_chat' END AS mode FROM v_routed_asks""")
    rows = ", ".join("({}, '{}', '{}', '{}')".format(i, *(x.replace("'", "''") for x in task)) for i, task in enumerate(TASKS))
    _add("task_prefix", ["asks"], f"""WITH tasks(i, task, model, prompt) AS (VALUES {rows})
        SELECT ask_id, task, coalesce(model, 'llama3.1:8b') AS model,
               CASE WHEN task <> 'research' THEN prompt || {NL} || {NL} ELSE '' END || question AS question
        FROM v_asks LEFT JOIN tasks ON i = ask_id % 7""")

    _add("kb_listing", ["kb"], """SELECT id, question, coalesce(nullif(original_answer, ''), '') AS original_answer,
        corrected_answer AS answer, created_s AS created_at, chat_history_id::VARCHAR AS chat_history_id,
        coalesce(nullif(corrected_by, ''), 'User') AS corrected_by, coalesce(usage_count, 0) AS usage_count FROM v_kb""")
    _add("kb_search", ["kb"], """SELECT id, question, corrected_answer FROM v_kb
        WHERE question ILIKE '%than%' OR corrected_answer ILIKE '%than%'""")
    _add("quality_gate", ["chat"], f"SELECT id, {GATE} AS gate_reason FROM v_chat")
    _add("near_dup_vs_kb", ["asks", "kb"], f"""WITH q AS (SELECT ask_id AS qid, {_set('question')} AS qw FROM v_asks),
        c AS (SELECT id AS cid, {_set('question')} AS cw FROM v_kb), {SCORED.format(extra='')}
        SELECT DISTINCT qid AS id FROM scored WHERE sim > 0.92""")
    _add("greedy_dedupe", ["docs"], f"""WITH RECURSIVE {_greedy("SELECT id, " + _set('content') + " AS w FROM v_docs")}
        SELECT id, id IN (SELECT id FROM kept) AS kept FROM items""")
    _add("vector_near_dup", [], f"""WITH {VECTORS}, changed AS (
            SELECT id, CASE id % 3 WHEN 0 THEN {_turned('e', 0.95)} WHEN 1 THEN {_turned('e', 0.0)} ELSE e END AS e FROM vs)
        SELECT DISTINCT c.id FROM changed c JOIN vs ON list_cosine_similarity(c.e, vs.e) > 0.92""")
    _add("vector_dedupe", [], f"""WITH RECURSIVE {VECTORS}, second AS (SELECT id, e, {_turned('e', 0.95)} AS b FROM vs),
        three AS (SELECT 3 * id AS id, e FROM vs UNION ALL SELECT 3 * id + 1, b FROM second
                  UNION ALL SELECT 3 * id + 2, {_turned('b', 0.95)} FROM second),
        {_dense_greedy("SELECT id, e FROM three")} SELECT id, id IN (SELECT id FROM kept) AS kept FROM items""")
    _add("auto_save_vectors", ["chat", "kb"], f"""WITH RECURSIVE {VECTORS},
        good AS (SELECT c.*, vs.e FROM v_chat c JOIN vs ON vs.id = c.id % (SELECT count(*) FROM vs) WHERE ({GATE}) IS NULL),
        base AS (SELECT DISTINCT {_turned('e', 0.95)} AS b FROM v_kb k JOIN vs ON vs.id = k.id % (SELECT count(*) FROM vs)),
        known AS (SELECT DISTINCT g.id FROM good g JOIN base ON list_cosine_similarity(g.e, b) > 0.92),
        {_dense_greedy("SELECT id, e FROM good WHERE id NOT IN (SELECT id FROM known)")}
        SELECT id AS chat_history_id, question, answer AS original_answer, answer AS corrected_answer, ts_s AS created_at,
               '' AS context_text, 'auto-query' AS corrected_by, 1 AS usage_count FROM v_chat WHERE id IN (SELECT id FROM kept)""")
    auto = AUTO
    _add("auto_save", ["chat", "kb"], f"""WITH RECURSIVE {auto}
        SELECT id AS chat_history_id, question, answer AS original_answer, answer AS corrected_answer, ts_s AS created_at,
               '' AS context_text, 'auto-query' AS corrected_by, 1 AS usage_count FROM v_chat WHERE id IN (SELECT id FROM kept)""")
    _add("knowledge_growth", ["chat", "kb", "corrections"], f"""WITH RECURSIVE {auto}, g AS (
            SELECT 'auto-query' AS corrected_by, question, answer AS corrected_answer FROM v_chat WHERE id IN (SELECT id FROM kept)
            UNION ALL SELECT 'User', question, corrected_answer FROM v_corrections k JOIN v_chat c ON c.id = k.chat_id
            UNION ALL SELECT 'Manual Entry', question, corrected_answer FROM v_kb)
        SELECT corrected_by, question, corrected_answer, len({_set('question')})::INT AS n_words FROM g
        WHERE contains(lower(question), 'than') OR contains(lower(corrected_answer), 'than')""")
    _add("stream_learning", ["chat", "kb"], f"""WITH RECURSIVE {auto}
        SELECT id AS chat_history_id, question, answer AS corrected_answer FROM v_chat WHERE id IN (SELECT id FROM kept)""")
    _add("qa_pairs_parse", ["qa_lines"], f"WITH {QA} SELECT document_id, part, pos, question, answer FROM pairs")
    _add("kb_candidates", ["qa_lines", "docs"], f"""WITH {QA},
        firsts AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(question) ORDER BY part, pos) AS n
                   FROM pairs WHERE length(answer) >= 20 QUALIFY n = 1)
        SELECT document_id, part, pos, question, answer AS original_answer, answer AS corrected_answer, filename AS context_text,
               'Auto-generated from: ' || filename AS corrected_by, 0 AS usage_count
        FROM firsts JOIN v_docs d ON d.id = document_id""")
    _add("pairs_saved", ["qa_lines", "docs"], f"""WITH {QA}
        SELECT document_id, count(*) AS n_parsed,
               count(DISTINCT CASE WHEN length(answer) >= 20 THEN lower(question) END) AS n_saved FROM pairs GROUP BY document_id""")
    _add("bulk_kb_load", ["kb"], """SELECT id - id % 5 AS request_id, question, '' AS original_answer, corrected_answer,
        coalesce(context_text, '') AS context_text, 'Manual Entry' AS corrected_by, 0 AS usage_count FROM v_kb""")
    _add("items_added", ["kb"], "SELECT count(*) AS n, count(*)::VARCHAR || ' knowledge items added' AS message FROM v_kb")
    _add("excerpts", ["docs"], f"""WITH e AS (
            SELECT id AS document_id, 1 AS part, {_trim('content[1:4000]')} AS excerpt FROM v_docs WHERE length({_trim('content')}) >= 200
            UNION ALL
            SELECT id, 2, {_trim('content[least(length(content) // 2, 4000) + 1 : least(length(content) // 2, 4000) + 4000]')}
            FROM v_docs WHERE length({_trim('content')}) >= 200)
        SELECT document_id, part, excerpt FROM e WHERE length(excerpt) >= 150""")

    feed = """feed AS (SELECT c.id, c.user_id, coalesce(nullif(u.username, ''), 'Anonymous') AS username, ts_s AS ts, question, answer,
        rating, comment, selected_text FROM v_chat c LEFT JOIN v_users u ON u.user_id = c.user_id WHERE rating IS NOT NULL)"""
    _add("ratings_feed", ["chat", "users"], f"WITH {feed} SELECT * FROM feed")
    _add("rating_display", ["chat", "users"], f"""WITH {feed} SELECT id, username, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day,
        repeat('★', rating) || repeat('☆', 5 - rating) AS stars,
        CASE WHEN rating <= 2 THEN '#e74c3c' WHEN rating <= 3 THEN '#f39c12' WHEN rating <= 4 THEN '#f1c40f' ELSE '#2ecc71' END AS colour,
        question, 'Context: ' || substr(selected_text, 1, 80) || '...' AS context_line, coalesce(nullif(comment, ''), 'No feedback') AS comment FROM feed""")
    _add("rating_stats", ["chat"], """SELECT count(rating) AS total_ratings,
        coalesce(round_even(avg(rating)::DECIMAL(20,10), 2)::DOUBLE, 0) AS average_rating,
        coalesce(min(rating), 0) AS min_rating, coalesce(max(rating), 0) AS max_rating FROM v_chat""")
    dist = "SELECT rating, count(*) AS n FROM v_chat WHERE rating IS NOT NULL GROUP BY rating"
    _add("rating_distribution", ["chat"], dist)
    _add("rating_distribution_map", ["chat"], dist)
    _add("rating_distribution_scaled", ["chat"], f"""WITH d AS ({dist}), s AS (
            SELECT r::INT AS rating, coalesce(n, 0) AS n FROM range(1, 6) t(r) LEFT JOIN d ON d.rating = r)
        SELECT rating, n, n::DOUBLE / greatest((SELECT max(n) FROM s), 1) AS share_of_max FROM s""")
    _add("rating_filter", ["chat"], "SELECT id, rating, comment FROM v_chat WHERE rating = 5")
    _add("rating_filter_counts", ["chat"], """SELECT s AS stars,
        (SELECT count(*) FROM v_chat WHERE rating IS NOT NULL AND (s = 'all' OR rating::VARCHAR = s)) AS showing,
        (SELECT count(rating) FROM v_chat)::BIGINT AS of_total FROM (SELECT unnest(['all', '1', '2', '3', '4', '5']) AS s)""")

    last = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts DESC, seq DESC) AS n FROM {v} QUALIFY n = 1"
    _add("apply_rating_changes", ["chat", "rating_changes"], f"""WITH l AS ({last.format(k='id', v='v_rating_changes')})
        SELECT c.id, (CASE WHEN l.id IS NULL THEN c.rating ELSE l.rating END)::VARCHAR AS rating,
               CASE WHEN l.id IS NULL THEN c.comment ELSE l.comment END AS comment FROM v_chat c LEFT JOIN l ON l.id = c.id""")
    _add("apply_corrections", ["chat", "corrections"], f"""WITH l AS ({last.format(k='chat_id', v='v_corrections')})
        SELECT c.id, CASE WHEN l.chat_id IS NULL THEN c.answer ELSE l.corrected_answer END AS answer,
               CASE WHEN l.chat_id IS NULL THEN c.comment ELSE l.comment END AS comment FROM v_chat c LEFT JOIN l ON l.chat_id = c.id""")
    _add("corrections_to_kb", ["chat", "corrections"], """SELECT seq, question,
        coalesce(lag(corrected_answer) OVER (PARTITION BY chat_id ORDER BY ts, seq), answer) AS original_answer, corrected_answer,
        chat_id AS chat_history_id, 'User' AS corrected_by, 0 AS usage_count
        FROM v_corrections k JOIN v_chat c ON c.id = k.chat_id""")
    _add("corrections_rejected", ["chat", "corrections"], """SELECT seq, chat_id, 'chat_not_found' AS reason FROM v_corrections
        WHERE chat_id NOT IN (SELECT id FROM v_chat)""")
    _add("kb_edit", ["kb", "kb_edits"], f"""WITH l AS ({last.format(k='id', v='v_kb_edits')})
        SELECT k.id, coalesce(l.question, k.question) AS question, coalesce(l.answer, k.corrected_answer) AS corrected_answer
        FROM v_kb k LEFT JOIN l ON l.id = k.id""")
    _add("kb_edit_missing", ["kb", "kb_edits"], "SELECT DISTINCT id FROM v_kb_edits WHERE id NOT IN (SELECT id FROM v_kb)")
    _add("kb_delete", ["kb", "fires"], "SELECT id, question FROM v_kb WHERE id NOT IN (SELECT kb_id * 3 FROM v_fires)")
    _add("usage_increment", ["kb", "fires"], """SELECT id, (coalesce(usage_count, 0)
        + (SELECT count(*) FROM v_fires f WHERE f.kb_id = v_kb.id))::BIGINT AS usage_count FROM v_kb""")
    deleted = f"""{CHUNKS}, wanted AS (SELECT DISTINCT coalesce(name1, 'gone_' || ask_id::VARCHAR) AS filename FROM v_routed_asks),
        target AS (SELECT filename, (SELECT min(id) FROM v_docs d WHERE d.filename = w.filename) AS document_id FROM wanted w)"""
    _add("cascade_delete", ["docs", "routed_asks"], f"""WITH {deleted}
        SELECT filename, document_id::VARCHAR AS document_id, (SELECT count(*) FROM chunks c WHERE c.document_id = t.document_id) AS chunks_deleted,
               CASE WHEN document_id IS NULL THEN 'not_found' ELSE 'deleted' END AS status FROM target t""")
    _add("cascade_delete_left", ["docs", "routed_asks"], f"""WITH {deleted}
        SELECT id, filename, (SELECT count(*) FROM chunks c WHERE c.document_id = d.id) AS n_chunks FROM v_docs d
        WHERE id NOT IN (SELECT document_id FROM target WHERE document_id IS NOT NULL)""")

    _add("page_citations", ["cited"], f"""WITH found AS (
            SELECT doc_id, unnest(ds) AS d, unnest(range(len(ds))) AS k FROM (
                SELECT doc_id, regexp_extract_all(answer, '(?i)\\b(?:page|p\\.)[\\t-\\r\\p{{Z}}\\x{{FEFF}}]*([0-9]+)\\b', 1) AS ds FROM v_cited) t),
        firsts AS (SELECT doc_id, d::BIGINT AS page, min(k) AS k, min_by(d, k) AS raw FROM found GROUP BY doc_id, d::BIGINT)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, page, 'p.' || raw AS label FROM firsts QUALIFY pos < 5""")
    default = "|".join(DEFAULT_SUGGESTIONS)
    _add("suggestion_parse", ["suggested"], f"""WITH m AS (
            SELECT doc_id, snippet, regexp_extract(response, '\\[(?s:.)*?\\]') AS arr FROM v_suggested),
        j AS (SELECT doc_id, snippet, CASE WHEN json_valid(arr) AND NOT regexp_matches(arr, ',\\s*\\]') THEN arr::JSON END AS arr FROM m),
        ok AS (SELECT doc_id, arr IS NOT NULL AND json_array_length(arr) > 0
                      AND length(regexp_replace({_trim('snippet', JS_WS)}, '{JS_WS}', ' ', 'g')) >= 100 AS usable,
                      list_filter(list_transform(list_filter(arr::JSON[], lambda e: json_type(e) = 'VARCHAR'), lambda e: e ->> '$'),
                                  lambda s: length(s) > 10) AS good FROM j)
        SELECT doc_id, CASE WHEN usable THEN array_to_string(good[1:4], '|') ELSE '{default}' END AS suggestions FROM ok""")
    _add("transcript_demux", ["streams", "chat"], """SELECT s.id, CASE WHEN s.id % 10 IN (2, 3) THEN NULL ELSE s.id::VARCHAR END AS entry_id,
        '{"similarity_score": 0.5, "context_source": "retrieval", "row": ' || s.id::VARCHAR || '}' AS context_json,
        CASE WHEN s.id % 10 = 3 THEN 'Request ' || s.id::VARCHAR || ' failed' END AS error,
        CASE WHEN s.id % 10 = 3 THEN '' ELSE c.answer END AS answer FROM v_streams s JOIN v_chat c ON c.id = s.id""")
    turns = f"""turns AS (SELECT conv_id * 1000 + turn AS request_id, {_words('text')} AS ws FROM conversations WHERE role = 'assistant'),
        toks AS (SELECT request_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS seq FROM turns)"""
    _add("ndjson_tokens", [], f"""WITH {turns} SELECT request_id, string_agg(w || ' ', '' ORDER BY seq) AS answer FROM toks
        WHERE seq % 17 <> 16 GROUP BY request_id""")
    _add("sse_tokens", [], f"""WITH {turns} SELECT request_id, string_agg(w || ' ', '' ORDER BY seq) AS answer FROM toks
        WHERE seq % 19 <> 18 AND (n < 3 OR seq < n - 3) GROUP BY request_id""")
    _add("export_conversations", [], f"""SELECT conv_id, string_agg('[' || CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || ']'
        || {NL} || text || {NL}, {NL} || '---' || {NL} || {NL} ORDER BY turn) AS export FROM conversations
        WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
    _add("search_results", ["bodies"], """SELECT doc_id, 0 AS pos, 'Case ' || doc_id::VARCHAR AS name,
            'ca ' || (doc_id % 12)::VARCHAR || ' app' AS court, (1990 + doc_id % 30)::VARCHAR AS year,
            'https://www.courtlistener.com/opinion/' || doc_id::VARCHAR || '/' AS url, lang AS snippet FROM documents WHERE doc_id % 10 <> 9
        UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN 'Unknown Case' ELSE 'Other' END, 'scotus', '2001', NULL, ''
        FROM documents WHERE doc_id % 10 <> 9""")

    _add("document_listing", ["docs"], f"""WITH {CHUNKS} SELECT id, filename, uploaded_s AS upload_timestamp, author, title, publication_date,
        source, doi_url, (SELECT count(*) FROM chunks WHERE document_id = v_docs.id) AS chunks_count FROM v_docs""")
    _add("document_lookup", ["docs"], "SELECT filename, min(id) AS document_id FROM v_docs GROUP BY filename")
    _add("documents_named", ["docs", "routed_asks"], """SELECT id, filename, title FROM v_docs d WHERE EXISTS (
        SELECT 1 FROM v_routed_asks a WHERE route IN (0, 4) AND d.filename IN (a.name1, a.name2))""")
    pages = f"""pages_of AS (SELECT id AS document_id, unnest(range(1, greatest(ceil(len(ws) / 350.0), 1)::BIGINT + 1)) AS page_no, ws
            FROM (SELECT id, {_words('content', JS_WS)} AS ws FROM v_docs) t),
        paged AS (SELECT document_id, page_no, CASE WHEN len(ws) = 0 THEN '(empty document)'
                  ELSE array_to_string(ws[(page_no - 1) * 350 + 1 : page_no * 350], ' ') END AS page_text FROM pages_of)"""
    _add("text_pages", ["docs"], f"WITH {pages} SELECT document_id, page_no, page_text FROM paged")
    _add("page_assembly", ["docs"], f"""WITH {pages},
        a AS (SELECT document_id, max(page_no) AS page_count,
                string_agg({NL} || {NL} || '[Page ' || page_no::VARCHAR || ']' || {NL} || {NL} || page_text, '' ORDER BY page_no)
                    FILTER (WHERE (document_id + page_no) % 5 <> 0) AS full_text FROM paged GROUP BY document_id),
        b AS (SELECT *, CASE WHEN page_count > 150 THEN 'too_many_pages' WHEN full_text IS NULL THEN 'no_text' END AS error_code FROM a)
        SELECT document_id, page_count::INT AS page_count, CASE WHEN error_code IS NULL THEN full_text[1:300000] END AS text,
               CASE WHEN error_code IS NULL THEN least(length(full_text), 300000)::VARCHAR END AS char_count,
               coalesce(error_code IS NULL AND length(full_text) > 300000, false) AS truncated, error_code FROM b""")
    _add("pdf_ingest", ["docs"], f"""WITH {pages}, {UPLOADS},
        timed AS (SELECT *, CASE WHEN document_id % 39 = 0 THEN 200 WHEN document_id % 65 = 0 THEN 149 ELSE 1 END AS times FROM paged),
        more AS (SELECT document_id, page_text, (page_no - 1) * times + unnest(range(1, times + 1)) AS page_no FROM timed),
        a AS (SELECT document_id, max(page_no) AS page_count,
                string_agg({NL} || {NL} || '[Page ' || page_no::VARCHAR || ']' || {NL} || {NL} || page_text, '' ORDER BY page_no)
                    FILTER (WHERE (document_id + page_no) % 5 <> 0) AS full_text FROM more GROUP BY document_id),
        b AS (SELECT *, CASE WHEN page_count > 150 THEN 'too_many_pages' WHEN full_text IS NULL THEN 'no_text' END AS error_code FROM a)
        SELECT e.id, CASE WHEN b.error_code IS NULL THEN page_count ELSE 0 END::INT AS page_count,
            CASE WHEN b.error_code IS NULL THEN least(length(full_text), 300000)::VARCHAR END AS char_count,
            CASE WHEN b.error_code IS NULL THEN (length(full_text) > 300000)::VARCHAR END AS truncated,
            CASE WHEN b.error_code IS NULL THEN md5(full_text[1:300000]) END AS text_md5,
            CASE WHEN b.error_code IS NULL AND length(full_text) > 300000 THEN 1 ELSE 0 END::INT AS n_warnings, b.error_code,
            CASE WHEN b.error_code IS NOT NULL THEN '422' END AS http_status,
            CASE b.error_code WHEN 'too_many_pages' THEN 'PDF exceeds the 150-page limit. Please upload a shorter document.'
                WHEN 'no_text' THEN 'This PDF appears to be scanned or image-based. Text extraction is not supported for image-only PDFs.' END AS error
        FROM extracted e JOIN b ON b.document_id = e.id WHERE e.file_type = 'pdf'""")
    _add("text_stats", ["docs"], f"""SELECT id, len({_words('content', JS_WS)}) AS n_words,
        ceil(len({_words('content', JS_WS)}) / 350.0)::BIGINT AS text_pages,
        greatest(1, ceil(strlen(content) / 3000.0))::BIGINT AS docx_pages FROM v_docs""")
    _add("doc_type", ["docs"], """SELECT id, CASE WHEN regexp_matches(filename, '(?i)contract|agreement') THEN 'contract'
        WHEN regexp_matches(filename, '(?i)code|statute|regulation') THEN 'statute' ELSE 'case' END AS doc_type FROM v_docs""")
    _add("search_query", ["docs"], f"""SELECT id, {_trim("replace(replace(regexp_replace(filename, '(?i)[.](pdf|docx|txt)$', ''), '_', ' '), '-', ' ') || ' ' || content[1:200]", JS_WS)}[1:100]
        AS search_query FROM v_docs""")
    _add("citation_line", ["docs"], """SELECT id, CASE WHEN coalesce(title, '') <> '' OR coalesce(author, '') <> '' THEN
        'Citation: ' || concat_ws(' ', '"' || nullif(title, '') || '"', 'by ' || nullif(author, ''), '(' || nullif(publication_date, '') || ')',
                  '- ' || nullif(source, ''), '[' || nullif(doi_url, '') || ']') END AS citation FROM v_docs""")
    cut = "substr({c}, 1, {n}) || CASE WHEN length({c}) > {n} THEN '{m}' ELSE '' END"
    _add("ellipsis_snippets", ["kb"], f"""SELECT id, {cut.format(c='question', n=100, m='…')} AS short_question,
        {cut.format(c='corrected_answer', n=120, m='…')} AS short_answer, {cut.format(c='question', n=150, m='...')} AS short_selection FROM v_kb""")
    _add("sanitize_names", ["raw_names"], """WITH b AS (
            SELECT page_id, regexp_extract(regexp_replace(filename, '(/[.]?)+$', ''), '[^/]*$') AS base FROM v_raw_names)
        SELECT page_id, coalesce(nullif(substr(regexp_replace(CASE WHEN base = '.' THEN '' ELSE base END,
            '[\\p{C}\\p{Zl}\\p{Zp}/\\\\<>:"|?*]', '', 'g'), 1, 255), ''), 'untitled') AS safe_filename FROM b""")
    _add("extract_text", ["docs"], f"""WITH {UPLOADS} SELECT id, file_type,
        CASE WHEN error_code IS NULL THEN least(length(body) + has_nul::INT, 300000)::VARCHAR END AS char_count,
        CASE WHEN error_code IS NULL THEN (length(body) + has_nul::INT > 300000)::VARCHAR END AS truncated, error_code,
        CASE error_code WHEN 'empty' THEN '422' WHEN 'unsupported' THEN '415' WHEN 'pdf_unavailable' THEN '500' WHEN 'blank_text' THEN '422' END AS http_status
        FROM extracted""")
    _add("attach_metadata", ["docs", "metadata"], """SELECT d.filename, d.id, m.author, m.title, m.publication_date, m.source, m.doi_url
        FROM v_docs d LEFT JOIN v_metadata m ON m.filename = d.filename""")
    _add("ui_admission", ["form_files"], """SELECT id, CASE WHEN size_bytes > 20 * 1024 * 1024 THEN 'too_large'
        WHEN mime_type IS NULL OR mime_type NOT IN ('application/pdf', 'text/plain',
            'application/vnd.openxmlformats-officedocument.wordprocessingml.document') THEN 'unsupported_type' END AS refused FROM v_form_files""")
    _add("json_documents", ["json_texts"], """SELECT event_id, json_valid(text) AS valid,
        CASE WHEN json_valid(text) THEN json(text)::VARCHAR END AS canonical FROM v_json_texts""")
    _add("table_counts", ["docs", "chat", "kb"], f"""WITH {CHUNKS}
        SELECT 'ratings' AS what, count(rating) AS n FROM v_chat UNION ALL SELECT 'kb_entries', count(*) FROM v_kb
        UNION ALL SELECT 'documents', count(*) FROM v_docs UNION ALL SELECT 'chunks', count(*) FROM chunks""")
    _add("vector_guard", [], """SELECT count(*) FILTER (WHERE vec_id % 50 <> 1) AS n_vectors, count(*) FILTER (WHERE vec_id % 50 = 1) AS n_missing,
        count(*) FILTER (WHERE vec_id % 50 = 0) AS n_wrong_dim, count(*) FILTER (WHERE vec_id % 50 = 0) > 0 AS rebuild FROM embeddings""")
    _add("schema_evolution", ["kb"], """SELECT id, question, corrected_answer, NULL::VARCHAR AS corrected_by, 0 AS usage_count FROM v_kb""")

    _add("stream_ingest", ["docs"], f"WITH {CHUNKS} SELECT document_id, chunk_index, chunk_text FROM chunks")
    _add("stream_rating_stats", [], "SELECT (event_id % 5 + 1)::INT AS rating, count(*) AS n FROM events GROUP BY ALL")
    _add("stream_usage", [], "SELECT event_id % 211 AS kb_id, count(*) AS n FROM events GROUP BY ALL")
    # The stored words differ by one more NUL where the upload has one in front of its first word.
    _add("ingest_report", ["docs"], f"""WITH {UPLOADS}, bodies AS (
            SELECT id, filename, error_code, CASE WHEN has_nul THEN ' ' || content ELSE content END AS content FROM extracted JOIN v_docs USING (id, filename)),
        sized AS (
            SELECT id, CASE WHEN has_nul THEN list_concat([chr(1) || ws[1]], ws[2:]) ELSE ws END AS ws FROM (
                SELECT id, has_nul, {_words('body')} AS ws FROM extracted WHERE error_code IS NULL) t WHERE len(ws) > 0),
        counted AS (
            SELECT id, len(list_reduce(list_transform(ws, lambda w: [length(w)::BIGINT]), lambda a, b:
                CASE WHEN a[-1] + 1 + b[1] <= 500 THEN list_append(a[:-2], a[-1] + 1 + b[1]) ELSE list_concat(a, b) END)) AS n FROM sized)
        SELECT filename, CASE WHEN error_code IS NULL THEN 'Uploaded' END AS message,
            CASE error_code WHEN 'empty' THEN 'Uploaded file is empty.' WHEN 'pdf_unavailable' THEN 'PDF processing is not available on the server.'
                 WHEN 'unsupported' THEN 'Unsupported file type. Please upload a PDF, DOCX, or plain text file.'
                 WHEN 'blank_text' THEN 'Uploaded text file is empty.' END AS error,
            count(*) AS n_files, (sum(CASE WHEN error_code IS NULL THEN coalesce(n, 0) END)::BIGINT)::VARCHAR AS n_chunks
        FROM extracted LEFT JOIN counted USING (id) GROUP BY ALL""")
    _add("kb_edit_buckets", ["kb", "kb_edits", "fires"], f"""WITH l AS ({last.format(k='id', v='v_kb_edits')})
        SELECT k.id, coalesce(l.question, k.question) AS question, coalesce(l.answer, k.corrected_answer) AS corrected_answer
        FROM v_kb k LEFT JOIN l ON l.id = k.id WHERE k.id NOT IN (SELECT kb_id * 3 FROM v_fires)""")
    _add("kb_append", ["kb"], """SELECT question, 2 * count(*) AS n_rows, count(*) + count(usage_count) AS n_counted FROM v_kb GROUP BY question""")
    _add("docx_ingest", ["docs"], f"""WITH made AS (
            SELECT id, CASE WHEN id % 97 = 1 AND id % 7 <> 0 THEN 'too_complex' WHEN id % 7 = 0 THEN 'unsupported' WHEN id % 7 = 2 THEN 'corrupt'
                       WHEN id % 7 = 3 OR body = '' THEN 'blank_docx' END AS error_code, body[1:300000] AS body
            FROM (SELECT id, array_to_string(list_filter(string_split(content, {NL}), lambda x: {_trim('x')} <> ''), {NL} || {NL}) AS body FROM v_docs) t)
        SELECT id, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE 'docx' END AS file_type, error_code,
               CASE error_code WHEN 'unsupported' THEN '415' WHEN 'too_complex' THEN '422' WHEN 'corrupt' THEN '422' WHEN 'blank_docx' THEN '422' END AS http_status,
               CASE WHEN error_code IS NULL THEN length(body)::VARCHAR END AS char_count, CASE WHEN error_code IS NULL THEN md5(body) END AS text_md5 FROM made""")
    uploads = f"""parts AS (
            SELECT id // 100 AS part, string_agg(CASE WHEN id // 100 % 5 = 4 THEN ' ' ELSE content END || {NL}, '' ORDER BY id) AS whole FROM v_docs GROUP BY ALL),
        kinds AS (SELECT part AS id, CASE part % 5 WHEN 3 THEN 'pdf_unavailable' WHEN 4 THEN 'blank_text' END AS code, whole[1:300000] AS content FROM parts),
        fine AS (SELECT id, content FROM kinds WHERE code IS NULL), {CHUNKS.replace('v_docs', 'fine')}"""
    _add("stream_uploads", ["docs"], f"""WITH {uploads}, told AS (
            SELECT document_id AS part, count(*) AS n, md5(string_agg(chunk_text, '|' ORDER BY chunk_index)) AS m, sum(len({_set('chunk_text')})) AS w
            FROM chunks GROUP BY document_id)
        SELECT k.id AS part, CASE WHEN k.id % 5 = 3 THEN 'pdf' ELSE 'text' END AS file_type, CASE WHEN code IS NULL THEN length(content)::VARCHAR END AS char_count,
               code AS rejected_as, n::VARCHAR AS n_chunks, m AS chunks_md5, w::BIGINT::VARCHAR AS n_words FROM kinds k LEFT JOIN told ON told.part = k.id""")
    replayed = f"""{AUTO},
        base AS (SELECT id, question, created_s, coalesce(usage_count, 0) AS used FROM v_kb
                 UNION ALL SELECT id + 10000000, question, ts_s, 1 FROM v_chat WHERE id IN (SELECT id FROM kept)),
        lq AS (SELECT id AS ask, ts_s, {_set('question')} AS w FROM v_chat), lb AS (SELECT id AS row, created_s, {_set('question')} AS w FROM base),
        lqx AS (SELECT ask, ts_s, len(w) AS size, unnest(w) AS word FROM lq), lbx AS (SELECT row, created_s, len(w) AS size, unnest(w) AS word FROM lb),
        met AS (SELECT ask, row, count(*)::DOUBLE / sqrt(a.size::DOUBLE * b.size::DOUBLE) AS sim FROM lqx a JOIN lbx b USING (word)
                WHERE created_s < ts_s GROUP BY ask, row, a.size, b.size),
        hits AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY sim DESC, row) AS rank FROM met QUALIFY rank <= 3)"""
    _add("replay_matches", ["chat", "kb"], f"""WITH RECURSIVE {replayed}
        SELECT ask AS ask_id, rank, row AS kb_id, sim AS relevance_score FROM hits WHERE sim >= 0.5""")
    _add("replay_usage", ["chat", "kb"], f"""WITH RECURSIVE {replayed}
        SELECT id, question, (used + (SELECT count(*) FROM hits h WHERE h.row = base.id AND sim >= 0.5))::BIGINT AS usage_count FROM base""")
    for indexed, plain in (("vector_topk_indexed", "vector_topk"), ("kb_keyword_indexed", "kb_keyword_topk"), ("retrieve_chunks_indexed", "retrieve_chunks")):
        ORACLE[indexed] = ORACLE[plain]


_build()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
