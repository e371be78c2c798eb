"""Exact search, near duplicates and vectors against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.functions.vectors import word_set
from lectern.operators import neardup, retrieval
from lectern.operators.embedding import ColumnEmbedder, DenseWordSets, GivenVectors, ModelEmbedder
from lectern.operators.postings import WordIndex
from lectern.operators.topk import Limits, Search, top_k


def cosine(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b))


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(3)
    draw = lambda: {int(rng.paretovariate(0.6)) % 400 for _ in range(rng.randint(0, 14))}
    return {i: draw() for i in range(400)}, {i: draw() for i in range(90)}


def frame(spark, rows, key, extra=None, schema=""):
    data = [(k, sorted(v)) + ((extra(k),) if extra else ()) for k, v in rows.items()]
    return spark.createDataFrame(data, f"{key} BIGINT, vector ARRAY<BIGINT>{schema}")


def brute(corpus, queries, k, score, allowed=lambda c, q: True, positive=False):
    out = set()
    for q, qs in queries.items():
        scored = [(-score(cs, qs), c) for c, cs in corpus.items() if qs and cs and allowed(c, q)]
        scored = sorted(x for x in scored if not positive or x[0] < 0)
        out |= {(q, c, r + 1, -s) for r, (s, c) in enumerate(scored[:k])}
    return out


def found(df):
    return {(r["query_id"], r["corpus_id"], r["rank"], r["score"]) for r in df.collect()}


PATHS = {
    "queries broadcast": Limits(),
    "corpus broadcast": Limits(rows=10**6, values=1_000),
    "grid": Limits(rows=40, cell_corpus=150),
}


@pytest.mark.parametrize("path", PATHS)
def test_top_k_is_exact_under_ties_on_every_path(spark, sets, path):
    corpus, queries = sets
    if path == "corpus broadcast":
        corpus, queries = queries, corpus
        assert sum(map(len, corpus.values())) < 1_000 < sum(map(len, queries.values()))

    def run(search, extra=None, schema="", asked=None, asked_schema=None):
        return found(top_k(
            frame(spark, corpus, "corpus_id", extra, schema).repartition(3),
            frame(spark, queries, "query_id", asked or extra, asked_schema or schema), search, PATHS[path]))

    assert run(Search("cosine", 3)) == brute(corpus, queries, 3, cosine)
    overlap = lambda a, b: float(len(a & b))
    assert run(Search("overlap", 4, positive=True)) == brute(corpus, queries, 4, overlap, positive=True)
    before = brute(corpus, queries, 3, cosine, lambda c, q: c % 50 < q % 50)
    assert run(Search("cosine", 3, before=True), lambda i: i % 50, ", seen_at BIGINT") == before
    scoped = brute(corpus, queries, 3, cosine, lambda c, q: c % 7 in (q % 7, q % 5))
    assert run(Search("cosine", 3, scoped=True), lambda c: c % 7, ", scope BIGINT",
               lambda q: [q % 7, q % 5], ", scopes ARRAY<BIGINT>") == scoped


def test_chunk_hits_with_ids_of_any_size(spark):
    rows = [(2**62, 1, "b a"), (2**62, 0, "a b"), (-(2**62), 5, "a b"), (7, 0, "zz")]
    chunks = spark.createDataFrame(rows, "document_id BIGINT, chunk_index INT, chunk_text STRING")
    asks = spark.createDataFrame([(1, "b a")], "ask_id BIGINT, question STRING")
    got = sorted((r["rank"], r["document_id"], r["chunk_index"]) for r in retrieval.relevant_chunks(chunks, asks, 3).collect())
    assert got == [(1, -(2**62), 5), (2, 2**62, 0), (3, 2**62, 1)]


def test_dense_top_k_leaves_out_zero_vectors_and_refuses_other_dimensions(spark):
    rows = [(0, None), (6, []), (1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [2.0, 0.0])]
    corpus = spark.createDataFrame(rows, "corpus_id BIGINT, vector ARRAY<FLOAT>")
    asked = spark.createDataFrame([(9, [3.0, 0.0])], "query_id BIGINT, vector ARRAY<FLOAT>")
    got = sorted((r["rank"], r["corpus_id"], round(r["score"], 6)) for r in retrieval.vector_top_k(corpus, asked, 5).collect())
    assert got == [(1, 1, 1.0), (2, 5, 1.0), (3, 2, 0.6), (4, 4, -1.0)]
    other = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id BIGINT, vector ARRAY<FLOAT>")
    with pytest.raises(Exception, match="differ in dimension"):
        retrieval.vector_top_k(corpus, other).collect()


def test_cosine_expression(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], [2.0, 4.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [0.0, 0.0], [1.0, 1.0]), (4, None, [1.0, 1.0])],
        "id INT, a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = {r["id"]: r["c"] for r in df.select("id", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert round(got[1], 9) == 1.0 and got[2] == -1.0 and got[3] is None and got[4] is None
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>").select(
            vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_embedders(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "")], "id BIGINT, t STRING")
    dense = {r["id"]: r["embedding"] for r in DenseWordSets(16).transform(docs, "t").collect()}
    assert len(dense[1]) == 16 and sum(dense[1]) in (1.0, 2.0) and sum(dense[2]) == 0.0
    given = spark.createDataFrame([(1, [0.5])], "id BIGINT, embedding ARRAY<FLOAT>")
    assert {r["id"]: r["embedding"] for r in GivenVectors(given, "id").transform(docs, "t").collect()} == {1: [0.5], 2: None}
    fails = ColumnEmbedder(lambda c: F.when(c != "", F.array(F.lit(1.0), F.lit(2.0))), 2).transform(docs, "t", "v")
    assert {r["id"]: (r["v"], r["embed_failed"]) for r in fails.collect()} == {1: ([1.0, 2.0], False), 2: (None, True)}


def replay(rows, existing=(), t=0.92):
    kept = []
    for i, s in sorted(rows.items()):
        if not s or not any(o and 10000 * len(s & o) ** 2 > 8464 * len(s) * len(o) for o in [*existing, *kept]):
            kept.append(s)
            yield i


def dedupe(spark, rows):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in rows.items()], "id BIGINT, vector ARRAY<BIGINT>")
    return sorted(r["id"] for r in neardup.greedy_keep(df).where("kept").collect())


def test_greedy_keeps_what_a_dropped_row_would_have_suppressed(spark):
    base = set(range(30))
    rows = {1: base, 2: base - {0} | {100}, 3: base - {0, 1} | {100, 101}}
    assert cosine(rows[1], rows[2]) > 0.92 and cosine(rows[2], rows[3]) > 0.92 and cosine(rows[1], rows[3]) <= 0.95
    rows[3] = base - {0, 1, 2} | {100, 101, 102}
    assert cosine(rows[2], rows[3]) > 0.92 > cosine(rows[1], rows[3])
    assert dedupe(spark, rows) == [1, 3]


def test_threshold_is_strict(spark):
    rows = {1: set(range(25)), 2: set(range(23)) | {50, 51}}
    assert len(rows[1] & rows[2]) / 25 == 0.92
    assert dedupe(spark, rows) == [1, 2]


def test_greedy_equals_replay_with_a_third_of_rows_alike(spark):
    rng = random.Random(11)
    base = list(range(40))
    rows = {}
    for i in range(360):
        if i % 3 == 0:
            rows[i] = set(base) - {rng.choice(base)} | ({1000 + rng.randint(0, 5)} if rng.random() < 0.5 else set())
        elif i % 3 == 1:
            rows[i] = set(range(20)) | {2000 + i // 9}
        else:
            rows[i] = {rng.randint(0, 60) for _ in range(rng.randint(0, 12))}
    assert dedupe(spark, rows) == list(replay(rows))


def test_near_existing_equals_brute_force(spark):
    rng = random.Random(5)
    old = {i: {rng.randint(0, 30) for _ in range(rng.randint(0, 9))} for i in range(150)}
    new = {i: {rng.randint(0, 30) for _ in range(rng.randint(0, 9))} for i in range(150)}
    as_items = lambda rows: spark.createDataFrame([(i, sorted(s)) for i, s in rows.items()], "id BIGINT, vector ARRAY<BIGINT>")
    got = {r["id"] for r in neardup.near_existing(as_items(new), as_items(old)).collect()}
    assert got == {i for i, s in new.items() if s and any(o and cosine(s, o) > 0.92 for o in old.values())}


def test_knowledge_threshold_applies_after_the_limit(spark):
    kb = spark.createDataFrame(
        [(i, q, "a", "", None, None) for i, q in enumerate(["a b c d", "a b c x", "a b y z", "a b y w", "p q"])],
        "id BIGINT, question STRING, corrected_answer STRING, context_text STRING, corrected_by STRING, usage_count INT")
    asks = spark.createDataFrame([(1, "A b c D"), (2, "q p"), (3, "")], "ask_id BIGINT, question STRING")
    got = sorted((r["ask_id"], r["rank"], r["kb_id"], r["relevance_score"], r["corrected_by"], r["usage_count"])
                 for r in retrieval.knowledge_matches(kb, asks).collect())
    assert got == [(1, 1, 0, 1.0, "Unknown", 0), (1, 2, 1, 0.75, "Unknown", 0), (1, 3, 2, 0.5, "Unknown", 0),
                   (2, 1, 4, 1.0, "Unknown", 0)]
    words = sorted((r["ask_id"], r["rank"], r["kb_id"], r["relevance_score"])
                   for r in retrieval.knowledge_keyword_matches(kb, asks).collect())
    assert words == [(1, 1, 0, 4.0), (1, 2, 1, 3.0), (1, 3, 2, 2.0), (2, 1, 4, 2.0)]


def test_history_of_known_unknown_and_anonymous_users(spark):
    users = spark.createDataFrame([("u1", "t1")], "user_id STRING, token STRING")
    rows = [(i, "u1", None, "", f"law question {i}", "a") for i in range(1, 26)] + [
        (100, None, None, "Section Nine", "anon law", "a"), (101, None, None, "", "other", "a")]
    chat = spark.createDataFrame(rows, "id BIGINT, user_id STRING, ts TIMESTAMP, selected_text STRING, question STRING, answer STRING")
    asks = spark.createDataFrame(
        [(1, "t1", "law law 7", ""), (2, "nope", "LAW", "nine"), (3, None, "zzz", "")],
        "ask_id BIGINT, token STRING, question STRING, selected_text STRING")
    got = sorted((r["ask_id"], r["rank"], r["id"], r["relevance_score"]) for r in retrieval.relevant_history(asks, users, chat).collect())
    assert got == [(1, 1, 17, 3), (1, 2, 7, 3), (1, 3, 25, 2), (2, 1, 100, 3)]
    requests = asks.select(F.col("ask_id").alias("request_id"), "token")
    lately = retrieval.history_for(requests, users, chat).groupBy("request_id").count().collect()
    assert {r["request_id"]: r["count"] for r in lately} == {1: 20, 2: 2, 3: 2}


def test_existing_rows_that_share_an_id_stay_apart(spark):
    """Rows of two sources with one id are two rows."""
    words = [[f"w{i}_{j}" for j in range(40)] for i in range(30)]
    sets = lambda rows: spark.createDataFrame(rows, "id BIGINT, text STRING").select("id", word_set(F.col("text")).alias("vector"))
    known = sets([(i, " ".join(words[i])) for i in range(15)] + [(i, " ".join(words[15 + i])) for i in range(15)])
    asked = sets([(100 + i, " ".join(words[i]) + " more") for i in range(30)] + [(500, "none of these words")])
    assert sorted(r["id"] for r in neardup.near_existing(asked, known).collect()) == list(range(100, 130))


def test_stored_vectors_give_the_same_matches(spark):
    texts = [(i, 0, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(40)]
    chunks = spark.createDataFrame(texts, "document_id BIGINT, chunk_index INT, chunk_text STRING")
    asks = spark.createDataFrame([(i, f"w{i} w{i + 1} w{2 * i}") for i in range(8)], "ask_id BIGINT, question STRING")
    rows = lambda df: sorted(map(tuple, df.collect()))
    made = rows(retrieval.relevant_chunks(chunks, asks))
    stored = lambda df, text: df.withColumn("v", word_set(F.col(text)))
    assert rows(retrieval.relevant_chunks(stored(chunks, "chunk_text"), stored(asks, "question"), vector="v")) == made
    dense = DenseWordSets(64)
    found = retrieval.relevant_chunks(dense.transform(chunks, "chunk_text", "e"), dense.transform(asks, "question", "e"), vector="e", kind="dense")
    assert found.count() == 24


def test_model_embedder_falls_back_text_by_text(spark):
    """Batches that raise or answer with a wrong count are asked for one by one."""
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no")
            if len(texts) > 1 and any("short" in t for t in texts):
                return [[1.0, 2.0]] * (len(texts) - 1)
            return [[1.0, 2.0, 3.0] if "wide" in t else [float("nan"), 1.0] if "nan" in t else "bad" if "odd" in t else [float(len(t)), float(len(texts))] for t in texts]
        return model

    texts = ["a", "boom", None, "cc", "short", "wide", "nan", "odd", "", "dd", "ee", "ff", "gg", "hh"]
    df = spark.createDataFrame([(i, t, f"x{i}") for i, t in enumerate(texts)], "id BIGINT, t STRING, extra STRING").coalesce(1)
    made = ModelEmbedder(load, 2, batch_rows=4).transform(df, "t", "v")
    assert made.columns == ["id", "t", "extra", "v", "embed_failed"]
    got = {r["id"]: (r["v"], r["embed_failed"], r["extra"]) for r in made.collect()}
    bad = {1, 2, 5, 6, 7}
    assert {i for i, r in got.items() if r[1]} == bad == {i for i, r in got.items() if r[0] is None}
    assert got[0][0] == [1.0, 1.0] and got[4][0] == [5.0, 1.0] and got[8][0] == [0.0, 4.0] and got[13][0] == [2.0, 2.0]
    assert all(r[2] == f"x{i}" for i, r in got.items())
    assert ModelEmbedder(load, 2).transform(made, "t", "v").columns == made.columns
    assert ModelEmbedder(load, 2).transform(df.limit(0), "t", "v").count() == 0


@pytest.mark.parametrize("kind", ["cosine", "overlap"])
@pytest.mark.parametrize("hot", [20_000, 7])
def test_word_index_equals_the_scan(spark, tmp_path, kind, hot):
    rng = random.Random(31)
    word = lambda: min(int(rng.paretovariate(0.5)), 400)
    corpus = [(i % 150, i // 150, sorted({word() for _ in range(rng.randint(0, 40))})) for i in range(600)]
    queries = [(i, sorted({word() for _ in range(rng.randint(0, 14))} | ({9_000 + i} if i % 3 == 0 else set()))) for i in range(120)]
    queries += [(500, [7_777]), (501, [])]
    corpus = spark.createDataFrame(corpus, "corpus_id BIGINT, corpus_part BIGINT, vector ARRAY<BIGINT>")
    queries = spark.createDataFrame(queries, "query_id BIGINT, vector ARRAY<BIGINT>")
    index = WordIndex.build(corpus, f"{tmp_path}/index", most_k=5, hot=hot)
    for k, positive in ((1, False), (4, False), (3, True)):
        search = Search(kind, k, positive=positive)
        rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "corpus_id", "corpus_part", "score").collect())
        assert rows(index.top_k(queries, search)) == rows(top_k(corpus, queries, search))
    none = WordIndex.build(corpus.limit(0), f"{tmp_path}/none")
    assert none.top_k(queries, Search(kind, 2)).count() == 0
    assert (index.postings.agg(F.max("salt")).first()[0] > 0) == (hot == 7)
