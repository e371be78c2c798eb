"""Transcripts, citations, suggestions, token logs, context and prompts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import markers
from lectern.operators import context, knowledge, transcripts

C = F.col("s")


def plain_pairs(raw):
    pairs, q, a = [], None, []
    def close():
        if q and a:
            pairs.append((q, " ".join(a).strip()))
    for line in (x.strip() for x in raw.splitlines()):
        tag = line[:2].lower()
        if tag == "q:":
            close()
            q, a = line[2:].strip(), []
        elif tag == "a:" and q:
            a = [line[2:].strip()]
        elif a and line:
            a.append(line)
    close()
    return pairs


def test_qa_lines_equal_the_line_machine(spark):
    rng = random.Random(2)
    parts = ["Q: one?", "q:two", "Q:", "A: yes", "a:  restarted", "A:", "more text", "", "   ", "intro", " Q:  pad ", " A: sep"]
    raws = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    raws += ["Q: a\r\nA: b\rcont\x0bmore\x85end", "A: first\nQ: x\nA: y"]
    df = spark.createDataFrame(list(enumerate(raws)), "id INT, s STRING").select("id", markers.qa_pairs(C).alias("p"))
    for r in df.collect():
        assert [(p["question"], p["answer"]) for p in r["p"]] == plain_pairs(raws[r["id"]]), raws[r["id"]]


@pytest.mark.parametrize("answer, want", [
    ("See Page 3, p.4 and page 3.", [(3, "p.3"), (4, "p.4")]),
    ("p. 07 then page 7", [(7, "p.07")]),
    ("homepage 9, page 10a, pages 3, p 4", []),
    ("p.1 p.2 p.3 p.4 p.5 p.6", [(i, f"p.{i}") for i in range(1, 6)]),
    ("épage 8", [(8, "p.8")]),
])
def test_citations(evaluate, answer, want):
    assert [(c["page"], c["label"]) for c in evaluate(markers.page_citations(C), s=answer)] == want


DEFAULTS = list(markers.DEFAULT_SUGGESTIONS)


@pytest.mark.parametrize("response, want", [
    ('x ["abcdefghij", "abcdefghijk", 5, null] y', ["abcdefghijk"]),
    ("[" + ", ".join(f'"question number {i}"' for i in range(6)) + "]", [f"question number {i}" for i in range(4)]),
    ("no array", DEFAULTS), ("[broken", DEFAULTS), ("[]", DEFAULTS), ('["tiny"]', []),
])
def test_suggestions(evaluate, response, want):
    assert evaluate(markers.suggestions(C, F.lit("w " * 100)), s=response) == want
    assert evaluate(markers.suggestions(C, F.lit("short")), s=response) == DEFAULTS


def test_markers_are_taken_out_and_text_stays(spark):
    whole = '__SEARCHING__\n__CONTEXT__{"context_chunks": ["a } __ b"], "n": 1}__\n\n__READY__\nThe answer\n\n__ENTRY_ID__42__'
    rows = [(1, whole), (2, "glued __READY__\ntext"), (3, "__ERROR__It broke__"), (4, "plain")]
    got = {r["id"]: r for r in transcripts.demux(spark.createDataFrame(rows, "id INT, transcript STRING")).collect()}
    assert (got[1]["entry_id"], got[1]["answer"], got[1]["error"]) == (42, "The answer", None)
    assert json.loads(got[1]["context_json"])["context_chunks"] == ["a } __ b"]
    assert got[2]["answer"] == "glued text" and got[2]["entry_id"] is None
    assert got[3]["error"] == "It broke" and got[4]["answer"] == "plain"


def test_token_logs(spark):
    lines = [(1, 0, '{"response": "He"}'), (1, 2, '{"response": "llo"}'), (1, 1, "junk"), (1, 3, '{"response": "x"} y'),
             (1, 4, '{"response": ""}'), (1, 12_345, '{"response": "!"}'), (2, 0, '{"other": 1}')]
    log = spark.createDataFrame(lines, "request_id INT, seq INT, line STRING")
    assert [tuple(r) for r in transcripts.ndjson_answers(log).collect()] == [(1, "Hello!")]
    tok = lambda t: 'data: {"choices": [{"delta": {"content": "%s"}}]}' % t
    sse = [(1, 0, tok("a")), (1, 1, ": ping"), (1, 2, tok("b")), (1, 3, "data: [DONE]"), (1, 4, tok("late")), (2, 0, tok("c")), (2, 1, "data: {bad")]
    log = spark.createDataFrame(sse, "request_id INT, seq INT, line STRING")
    assert sorted(tuple(r) for r in transcripts.sse_answers(log).collect()) == [(1, "ab"), (2, "c")]


def test_export(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo")]
    messages = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    want = "[You]\nhi\n\n---\n\n[Assistant]\nyo\n"
    assert transcripts.export_conversations(messages).first()["export"] == want
    transcripts.write_export(messages, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == want


def test_gate(evaluate):
    long = "x" * 80
    assert evaluate(knowledge.gate_reason(C), s=" " + "x" * 79 + "\n ") == "too_short"
    assert evaluate(knowledge.gate_reason(C), s=long) is None
    assert evaluate(knowledge.gate_reason(C), s=long + " I DON'T KNOW") == "error_phrase"


def test_document_candidates_keep_the_first_usable_pair(spark):
    rows = [(1, 1, 0, "What?", "short"), (1, 1, 1, "what?", "a" * 20), (1, 2, 0, "WHAT?", "b" * 30), (1, 2, 1, " ", "c" * 30)]
    pairs = spark.createDataFrame(rows, "document_id BIGINT, part INT, pos INT, question STRING, answer STRING")
    docs = spark.createDataFrame([(1, "f.txt")], "id BIGINT, safe_filename STRING")
    got = knowledge.document_candidates(pairs, docs).collect()
    assert [(r["question"], r["corrected_answer"], r["corrected_by"], r["usage_count"]) for r in got] == [
        ("what?", "a" * 20, "Auto-generated from: f.txt", 0)]


def test_auto_save_skips_known_and_repeated_questions(spark):
    answer = "This answer is long enough to be kept, since it has more than eighty characters in it."
    q = "what does the contract say about early termination by either of the two parties named here"
    rows = [(1, q, answer), (2, q + " please", answer), (3, "the known question of the base", answer), (4, "brief one", "no")]
    chat = spark.createDataFrame(rows, "id BIGINT, question STRING, answer STRING").withColumn("ts", F.current_timestamp())
    kb = spark.createDataFrame([(9, "The Known question of the base")], "id BIGINT, question STRING")
    got = knowledge.auto_save(chat, kb).collect()
    assert [(r["chat_history_id"], r["usage_count"], r["corrected_by"]) for r in got] == [(1, 1, "auto-query")]


ASK = ("ask_id BIGINT, question STRING, selected_text STRING, active_document_name STRING, "
       "scoped_names ARRAY<STRING>, selections ARRAY<STRUCT<id: STRING, text: STRING, document_name: STRING>>")


def test_every_branch_of_the_context_cascade(spark):
    docs = spark.createDataFrame(
        [(1, "a.txt", "Alpha", "z" * 14_000), (2, "b.txt", "", "y" * 14_001), (3, "c.txt", None, "w" * 12_001), (4, "a.txt", "Twin", "twin words here")],
        "id BIGINT, filename STRING, title STRING, content STRING")
    chunks = spark.createDataFrame([(1, 0, "red green"), (4, 0, "red blue"), (3, 0, "grey")], "document_id BIGINT, chunk_index INT, chunk_text STRING")
    asks = spark.createDataFrame([
        (1, "q", "", "a.txt", [], [("s", "one", "a.txt"), ("t", "two", "b.txt")]),
        (2, "q", "  picked ", "a.txt", [], []),
        (3, "q", "", "a.txt", [], []),
        (4, "q", "\n", "b.txt", None, None),
        (5, "an overview", "", None, ["c.txt", "a.txt"], []),
        (6, "red", "", None, ["a.txt"], []),
        (7, "red green", "", "missing.txt", [], []),
        (8, "red green", "", None, [], []),
    ], ASK)
    got = {r["ask_id"]: r for r in context.select_context(asks, docs, chunks).collect()}
    source = {k: r["context_source"] for k, r in got.items()}
    assert source == {1: "selected_text", 2: "selected_text", 3: "active_document", 4: "active_document",
                      5: "summary_document", 6: "retrieval", 7: "retrieval", 8: "retrieval"}
    assert got[1]["prompt_text"] == "[Selection 1 from: a.txt]\none\n\n---\n\n[Selection 2 from: b.txt]\ntwo"
    assert got[2]["prompt_text"] == "picked"
    assert got[3]["prompt_text"] == "Document title: Alpha\nDocument file: a.txt\n\n" + "z" * 14_000
    assert got[4]["prompt_text"] == "Document title: b.txt\nDocument file: b.txt\n\n" + "y" * 14_000 + context.TRUNCATION_NOTE
    assert [len(c) for c in got[5]["context_chunks"]] == [
        len(f"Document title: {t}\nDocument file: {f}\n\n") + n for t, f, n in
        [("Alpha", "a.txt", 12_000 + len(context.TRUNCATION_NOTE)), ("c.txt", "c.txt", 12_000 + len(context.TRUNCATION_NOTE)), ("Twin", "a.txt", 15)]]
    assert got[6]["context_chunks"] == ["red green", "red blue"]
    assert (got[7]["prompt_text"], got[7]["best_similarity"]) == ("", 0.0)
    assert got[8]["prompt_text"] == "\n\nred green\n\nred blue\n\ngrey" and round(got[8]["best_similarity"], 9) == 1.0


def test_prompt_and_names(spark):
    ctx = spark.createDataFrame([(1, "Why?", "text")], "ask_id BIGINT, question STRING, prompt_text STRING")
    hits = spark.createDataFrame([(1, 2, 8, "q2", "a2"), (1, 1, 9, "q1", "a1")], "ask_id BIGINT, rank INT, kb_id BIGINT, kb_question STRING, answer STRING")
    row = context.assemble_prompts(ctx, hits).first()
    assert row["kb_ids"] == [9, 8]
    assert row["prompt"].startswith(
        "<context>\ntext\n\n<knowledge_base_corrections>\nQ: q1\nA: a1\n---\nQ: q2\nA: a2\n---\n"
        "</knowledge_base_corrections>\n</context>\n\n<question>\nWhy?\n</question>\n\nAnswer using only")
    names = spark.createDataFrame([([("1", "t", "b"), ("2", "t", "a"), ("3", "t", "b"), ("4", "t", "")], "a")],
                                  "s ARRAY<STRUCT<id: STRING, text: STRING, document_name: STRING>>, active STRING")
    assert names.select(context.document_names(F.col("s"), F.col("active")).alias("n")).first()["n"] == ["b", "a"]


def test_search_results(evaluate):
    body = json.dumps({"results": [{"caseName": "", "case_name": "B", "court_id": "a_b", "dateFiled": "2001-02-03", "absolute_url": "/x/"}, {}]})
    got = [tuple(r) for r in evaluate(markers.search_results(C), s=body)]
    assert got == [("B", "a b", "2001", markers.RESULT_SITE + "/x/", ""), ("Unknown Case", "", "", None, "")]


def test_a_missing_answer_is_not_saved(spark):
    chat = spark.createDataFrame([(1, "a question of some words", None, None)], "id BIGINT, question STRING, answer STRING, ts TIMESTAMP")
    kb = spark.createDataFrame([], "id BIGINT, question STRING")
    assert knowledge.quality_gate(chat).first()["gate_reason"] == "too_short"
    assert knowledge.auto_save(chat, kb).count() == 0


def test_new_rows_are_whole_knowledge_rows(spark):
    """What the writers give can be searched and checked for duplicates again."""
    answer = "an answer that is long enough to be saved, as it has more than eighty characters in all of it"
    chat = spark.createDataFrame([(7, "how do herons sleep", answer)], "id BIGINT, question STRING, answer STRING").selectExpr("*", "timestamp_seconds(5) AS ts")
    kb = spark.createDataFrame([], "id BIGINT, question STRING")
    saved = knowledge.auto_save(chat, kb)
    loaded = knowledge.bulk_load(spark.createDataFrame([(1, [("where do storks nest", "on roofs", None)])], "request INT, items ARRAY<STRUCT<question: STRING, answer: STRING, source: STRING>>"))
    names = [f.split()[0] for f in schemas.ENTRY.split(", ")]
    grown = saved.select(*names, "vector").unionByName(loaded.select(*names, "vector"))
    rows = grown.collect()
    assert len({r["id"] for r in rows}) == 2 and all(r["vector"] and r["created_at"] for r in rows)
    assert knowledge.auto_save(chat, grown).count() == 0
    assert [r["question"] for r in knowledge.search(grown, "storks").collect()] == ["where do storks nest"]
    again = knowledge.auto_save(chat, kb).collect()
    assert [r["id"] for r in again] == [r["id"] for r in rows if r["chat_history_id"] == 7]


def test_qa_pairs_of_one_long_text_take_linear_time(spark):
    raw = "\n".join(f"Q: question {i}\nA: answer {i}\nmore" for i in range(40_000))
    df = spark.createDataFrame([(raw,)], "s STRING").select(F.explode(markers.qa_pairs(C)).alias("p"))
    assert df.where("p.answer LIKE 'answer % more'").count() == 40_000


def test_strict_json_is_one_whole_value(evaluate):
    mark = markers.END_MARK
    cases = {'{"response": "x"}': "x", '{"response": "x"} ': "x", '{"response": "x"}]': None, '{"response": "x"}, 1': None, '{"response": "x"}{"v":[1': None,
             f'{{"response": "x"}},"{mark}"]': None, f'{{"response": "{mark}"}}': mark, f'{{"response": "x"}},"{mark}"] junk': None, "": None, "x": None,
             '[{"response": "x"}': None, '{"response": 5}': "5", f'{{"response": "x"}}]}}{{"v":["{mark}"': None}
    for text, want in cases.items():
        assert evaluate(markers.strict_json(C, ".response", "string"), s=text) == want, text


def test_event_log_stops_at_the_first_done_in_any_segment(spark):
    def data(text):
        return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})

    rows = [("a", i, data(f"{i} ")) for i in range(30)] + [("a", 12, "data: [DONE]"), ("a", 25, "data:  [DONE] ")]
    rows += [("b", 0, "data: [DONE]"), ("b", 1, data("late"))] + [("c", i, data("x") if i != 7 else ": note") for i in range(9)] + [("d", 3, "data: {")]
    log = spark.createDataFrame(rows, "request_id STRING, seq BIGINT, line STRING")
    want = {"a": "".join(f"{i} " for i in range(12)), "c": "x" * 8}
    assert {r["request_id"]: r["answer"] for r in transcripts.sse_answers(log).collect()} == want
    events = log.select("request_id", "seq", F.expr("substring(line, 7)").alias("data")).withColumn("done", F.trim("data") == "[DONE]")
    cut = transcripts.ordered_concat(events, "request_id", "seq", "data", "out", segment_rows=5, stop=F.col("done"))
    assert {r["request_id"]: r["out"].count("choices") for r in cut.collect()} == {"a": 12, "b": 0, "c": 8, "d": 0}
