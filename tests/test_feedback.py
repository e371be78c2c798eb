"""Ratings, change logs and knowledge-base maintenance."""

from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from lectern.operators import changes, feedback, knowledge, replay
from lectern.operators.embedding import DenseWordSets
from lectern.sources import tables

CHAT = "id BIGINT, user_id STRING, question STRING, answer STRING, rating INT, comment STRING"


def chat(spark, ratings):
    return spark.createDataFrame([(i, "u", "q", "a", r, None) for i, r in enumerate(ratings)], CHAT)


@pytest.mark.parametrize("ratings", [[], [None], [4], [5, 5, 4, None], [1] * 131 + [2] * 69, [2] * 131 + [3] * 69])
def test_stats(spark, ratings):
    row = feedback.rating_stats(chat(spark, ratings)).first()
    real = [r for r in ratings if r is not None]
    mean = Decimal(sum(real)) / len(real) if real else Decimal(0)
    want = float(mean.quantize(Decimal("0.01"), ROUND_HALF_EVEN))
    assert tuple(row) == (len(real), want, min(real, default=0), max(real, default=0))


def test_distribution(spark):
    df = chat(spark, [5, 5, 1, None])
    assert feedback.rating_distribution_map(df).first()["distribution"] == {1: 1, 5: 2}
    scaled = {r["rating"]: (r["n"], r["share_of_max"]) for r in feedback.rating_distribution_scaled(df).collect()}
    assert scaled == {1: (1, 0.5), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (2, 1.0)}
    assert {r["share_of_max"] for r in feedback.rating_distribution_scaled(chat(spark, [])).collect()} == {0.0}


def test_the_last_change_wins_and_may_clear(spark):
    log = spark.createDataFrame([(0, 3, "x", 1, 1), (0, 5, None, 2, 2), (9, 1, "y", 1, 3)], "id BIGINT, rating INT, comment STRING, ts INT, seq INT")
    base = chat(spark, [1, 2]).withColumn("comment", F.lit("old"))
    got = {r["id"]: (r["rating"], r["comment"]) for r in changes.apply_ratings(base, log).collect()}
    assert got == {0: (5, None), 1: (2, "old")}


def test_corrections_chain_across_segments(spark):
    log = spark.createDataFrame(
        [(s, c, f"fix {s}", None, s) for s, c in [(1, 0), (2, 0), (11, 0), (12, 0), (35, 0), (3, 7)]],
        "seq INT, chat_id BIGINT, corrected_answer STRING, comment STRING, ts INT")
    updated, rows, rejects = changes.apply_corrections(chat(spark, [1, 2]), log, F.floor(F.col("ts") / 10))
    assert {r["seq"]: r["original_answer"] for r in rows.collect()} == {1: "a", 2: "fix 1", 11: "fix 2", 12: "fix 11", 35: "fix 12"}
    assert {r["id"]: r["answer"] for r in updated.collect()} == {0: "fix 35", 1: "a"}
    assert [(r["seq"], r["reason"]) for r in rejects.collect()] == [(3, "chat_not_found")]


def test_knowledge_edit_delete_and_usage(spark):
    kb = spark.createDataFrame([(1, "q1", "a1", None, [1.0]), (2, "q2", "a2", 4, [2.0])],
                               "id BIGINT, question STRING, corrected_answer STRING, usage_count INT, embedding ARRAY<FLOAT>")
    edits = spark.createDataFrame([(1, "n", "m", 1, 1), (5, "x", "y", 1, 2)], "id BIGINT, question STRING, answer STRING, ts INT, seq INT")
    edited, missing = changes.edit_knowledge(kb, edits)
    assert {r["id"]: (r["question"], r["embedding"]) for r in edited.collect()} == {1: ("n", None), 2: ("q2", [2.0])}
    assert [r["id"] for r in missing.collect()] == [5]
    left, gone = changes.delete_knowledge(kb, spark.createDataFrame([(2,), (8,)], "id BIGINT"))
    assert [r["id"] for r in left.collect()] == [1] and [r["id"] for r in gone.collect()] == [8]
    fires = spark.createDataFrame([(1,), (1,), (2,), (77,)], "kb_id BIGINT")
    assert {r["id"]: r["usage_count"] for r in changes.add_usage(kb, fires).collect()} == {1: 2, 2: 5}


def test_delete_takes_the_lowest_id_of_a_name(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id BIGINT, filename STRING")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "document_id BIGINT, chunk_index INT")
    asked = spark.createDataFrame([("a",), ("zz",), ("b",)], "filename STRING")
    docs_left, chunks_left, report = changes.delete_documents(docs, chunks, asked)
    assert [r["id"] for r in docs_left.collect()] == [2] and [r["document_id"] for r in chunks_left.collect()] == [2]
    assert {r["filename"]: (r["document_id"], r["chunks_deleted"], r["status"]) for r in report.collect()} == {
        "a": (1, 2, "deleted"), "b": (3, 0, "deleted"), "zz": (None, 0, "not_found")}


def test_bulk_load_and_listing(spark):
    items = [("What is the capital of France?", "Paris.", "User correction"), ("Q?", "A.", None)]
    asked = spark.createDataFrame([(1, items)], "request_id INT, items ARRAY<STRUCT<question: STRING, answer: STRING, source: STRING>>")
    got = knowledge.bulk_load(asked).orderBy("question").collect()
    assert [(r["context_text"], r["corrected_by"], r["original_answer"], r["usage_count"]) for r in got] == [
        ("User correction", "Manual Entry", "", 0)[0:4] if r["question"].startswith("What") else ("", "Manual Entry", "", 0) for r in got]
    kb = spark.createDataFrame([(1, "q", None, "a", None, 3), (2, "q", "o", "a", "", None), (3, "q", "o", "a", "X", 3)],
                               "id BIGINT, question STRING, original_answer STRING, corrected_answer STRING, corrected_by STRING, usage_count INT"
                               ).withColumn("created_at", F.current_timestamp()).withColumn("chat_history_id", F.lit(None).cast("bigint"))
    assert [(r["id"], r["corrected_by"]) for r in knowledge.listing(kb).collect()] == [(3, "X"), (1, "User"), (2, "User")]
    assert knowledge.search(kb, "").count() == 3 and knowledge.search(kb, "Q").count() == 3 and knowledge.search(kb, "%").count() == 0


def test_schema_evolution_guard_and_append(spark, tmp_path):
    old = spark.createDataFrame([(1, "q")], "id BIGINT, question STRING")
    new = tables.evolve(old, "id BIGINT, question STRING, corrected_by STRING, usage_count INT", {"usage_count": 0})
    assert tuple(new.first()) == (1, "q", None, 0)
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding ARRAY<FLOAT>")
    assert tuple(tables.vector_guard(vectors, 2).first()) == (2, 1, 1, True)
    texts = vectors.withColumn("t", F.lit("one two"))
    again = tables.ensure_vectors(texts, DenseWordSets(4), "t", 4).collect()
    assert {len(r["embedding"]) for r in again} == {4}
    assert tables.ensure_vectors(old.withColumn("embedding", F.array(F.lit(1.0))), None, "question", 1).first()["embedding"] == [1.0]
    for _ in range(2):
        tables.append(old, str(tmp_path / "t"))
    assert tables.scan(spark, str(tmp_path / "t"), "id").count() == 2


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(200)], "id BIGINT, question STRING, corrected_answer STRING")
    tables.write_buckets(kb, path, "id", 16, spread=2)
    names = lambda: {f.relative_to(tmp_path) for f in (tmp_path / "kb").rglob("*.parquet")}
    rows = lambda: {r["id"]: (r["question"], r["corrected_answer"]) for r in tables.read_buckets(spark, path, kb.schema).collect()}
    edits = spark.createDataFrame([(5, "new", "a", 1, 1), (5, "newer", "b", 2, 2), (900, "none", "x", 1, 3)], "id BIGINT, question STRING, answer STRING, ts INT, seq INT")
    edit = lambda rows, log: changes.edit_knowledge(rows, log)[0]
    old = names()
    touched = tables.change_buckets(spark, path, kb.schema, "id", 16, edits, edit)
    want = {i: (f"q{i}", f"a{i}") for i in range(200)} | {5: ("newer", "b")}
    assert rows() == want and len(touched) in (1, 2)
    untouched = {n for n in old if int(n.parts[1].split("=")[1]) not in touched}
    assert untouched <= names() and not (old - untouched) & names() and len(untouched) >= 14
    assert tables.change_buckets(spark, path, kb.schema, "id", 16, edits, edit) == touched and rows() == want
    gone = kb.where(tables.bucket_of("id", 16) == touched[0]).select("id")  # a bucket loses all its rows
    tables.change_buckets(spark, path, kb.schema, "id", 16, gone, lambda rows, ids: changes.delete_knowledge(rows, ids)[0])
    left = {r["id"] for r in gone.collect()}
    assert rows() == {i: r for i, r in want.items() if i not in left}
    assert tables.change_buckets(spark, path, kb.schema, "id", 16, gone.limit(0), edit) == []


def test_replay_sees_earlier_saves_only(spark):
    long = "An answer of more than eighty characters, which the quality gate therefore lets through to the base."
    log = spark.createDataFrame(
        [(1, "what does the lease say", long, 10), (2, "what does the lease say", long, 20), (3, "what does the lease say", "short", 20),
         (4, "how long is the notice period", "short", 30), (5, "how long is the notice period", long, 40), (6, "how long is the notice period", long, 50)],
        "id BIGINT, question STRING, answer STRING, s INT").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    kb = spark.createDataFrame([(100, "how long is the notice", "three months", 2, 0)], "id BIGINT, question STRING, corrected_answer STRING, usage_count INT, s INT")
    kb = kb.withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    found, base = replay.replay(log, kb, save_id=F.col("chat_history_id") + 1000)
    assert sorted((r["ask_id"], r["kb_id"]) for r in found.collect()) == [(2, 1001), (3, 1001), (4, 100), (5, 100), (6, 100), (6, 1005)]
    assert {r["id"]: r["usage_count"] for r in base.collect()} == {100: 5, 1001: 3, 1005: 2}
