"""Retrieval for batches of questions: chunks, knowledge base and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import let, or_default, words
from lectern.functions.vectors import word_set
from lectern.operators.dense import DenseIndex
from lectern.operators.joins import left_join_present
from lectern.operators.postings import WordIndex
from lectern.operators.topk import Search, top_k


def _vector(text: str, stored: str | None) -> Column:
    """The stored vector column, or the word set of ``text`` made on the spot."""
    return (F.col(stored) if stored else word_set(F.col(text))).alias("vector")


def _chunk_vectors(stored: str | None):
    return (
        F.col("document_id").alias("corpus_id"), F.col("chunk_index").alias("corpus_part"), _vector("chunk_text", stored),
    )


def chunk_index(chunks: DataFrame, vector: str | None = None, path: str | None = None) -> WordIndex:
    """An inverted index over chunks, for any number of later searches."""
    return WordIndex.build(chunks.select(*_chunk_vectors(vector)), path)


def relevant_chunks(
    chunks: DataFrame, asks: DataFrame, k: int = 3, vector: str | None = None, kind: str = "cosine",
    index: WordIndex | None = None,
) -> DataFrame:
    """Best k chunks of the whole corpus per ``asks(ask_id, question)``:
    ``(ask_id, rank, document_id, chunk_index, similarity)``.

    ``vector`` names a column that both sides hold, made by any embedder and stored beside the
    text; ``kind`` is ``dense`` for dense ones. Without it word sets are made for this search.
    With ``index``, as made by :func:`chunk_index`, the chunks themselves are not read."""
    queries = asks.select(F.col("ask_id").alias("query_id"), _vector("question", vector))
    if index is not None:
        return _chunk_hits(index.top_k(queries, Search(kind, k)))
    return _chunk_hits(top_k(chunks.select(*_chunk_vectors(vector)), queries, Search(kind, k)))


def scoped_chunks(
    docs: DataFrame, chunks: DataFrame, asks: DataFrame, k: int = 3, vector: str | None = None, kind: str = "cosine"
) -> DataFrame:
    """As :func:`relevant_chunks`, but each ask only sees documents named in its
    ``scoped_names``. Only chunks of documents that some ask names are searched."""
    names = asks.select(F.explode("scoped_names").alias("filename")).distinct()
    named = docs.join(names, "filename", "left_semi").select(
        F.col("id").alias("document_id"), F.xxhash64("filename").alias("scope")
    )
    corpus = chunks.join(named, "document_id").select(
        *_chunk_vectors(vector), "scope"
    )
    queries = asks.select(
        F.col("ask_id").alias("query_id"), _vector("question", vector),
        F.transform(F.array_distinct("scoped_names"), lambda n: F.xxhash64(n)).alias("scopes"),
    )
    return _chunk_hits(top_k(corpus, queries, Search(kind, k, scoped=True)))


def _chunk_hits(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("query_id").alias("ask_id"), "rank",
        F.col("corpus_id").alias("document_id"), F.col("corpus_part").cast("int").alias("chunk_index"),
        F.col("score").alias("similarity"),
    )


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = 3, index: DenseIndex | None = None) -> DataFrame:
    """Exact cosine top-k over given dense vectors: ``(query_id, corpus_id, score, rank)``. With ``index``
    only blocks that may hold a match are read, and ``corpus`` not at all."""
    return index.top_k(queries, k) if index is not None else top_k(corpus, queries, Search("dense", k))


def _kb_view(kb: DataFrame) -> DataFrame:
    return kb.select(
        F.col("id").alias("kb_id"), F.col("question").alias("kb_question"),
        F.col("corrected_answer").alias("answer"),
        or_default(F.col("context_text"), "").alias("context"),
        or_default(F.col("corrected_by"), "Unknown").alias("corrected_by"),
        or_default(F.col("usage_count"), 0).alias("usage_count"),
    )


def _attach_kb(found: DataFrame, kb: DataFrame) -> DataFrame:
    return found.select(
        F.col("query_id").alias("ask_id"), "rank", F.col("corpus_id").alias("kb_id"),
        F.col("score").alias("relevance_score"),
    ).join(_kb_view(kb), "kb_id")


def knowledge_matches(
    kb: DataFrame, asks: DataFrame, limit: int = 3, min_similarity: float = 0.5, as_of: bool = False,
    vector: str | None = None, kind: str = "cosine",
) -> DataFrame:
    """Best ``limit`` knowledge-base rows per ask, then only those similar enough.

    With ``as_of`` an ask (``asked_at``) sees only rows created before it, as when a
    log of asks is replayed. ``vector`` and ``kind`` as for :func:`relevant_chunks`.
    """
    def timed(df, stamp, *cols):
        extra = [F.unix_micros(F.col(stamp)).alias("seen_at")] if as_of else []
        return df.select(*cols, *extra)

    compared = _vector("question", vector)
    corpus = timed(kb, "created_at", F.col("id").alias("corpus_id"), compared)
    queries = timed(asks, "asked_at", F.col("ask_id").alias("query_id"), compared)
    found = top_k(corpus, queries, Search(kind, limit, before=as_of))
    return _attach_kb(found.where(F.col("score") >= min_similarity), kb)


def keyword_index(kb: DataFrame, path: str | None = None) -> WordIndex:
    """An inverted index over the questions of the base."""
    return WordIndex.build(kb.select(F.col("id").alias("corpus_id"), word_set(F.col("question")).alias("vector")), path)


def knowledge_keyword_matches(kb: DataFrame, asks: DataFrame, limit: int = 3, index: WordIndex | None = None) -> DataFrame:
    """Best ``limit`` rows by the number of distinct words shared with the question. With ``index``, as made by
    :func:`keyword_index`, only postings of the asks' words are read."""
    vector, search = word_set(F.col("question")).alias("vector"), Search("overlap", limit, positive=True)
    queries = asks.select(F.col("ask_id").alias("query_id"), vector)
    if index is not None:
        return _attach_kb(index.top_k(queries, search), kb)
    return _attach_kb(top_k(kb.select(F.col("id").alias("corpus_id"), vector), queries, search), kb)


def with_user(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the ``user_id`` of their token; NULL when absent or unknown."""
    known = users.groupBy("token").agg(F.min("user_id").alias("user_id"))
    return left_join_present(requests, known, "token")


def _with_past(who: DataFrame, past: DataFrame) -> DataFrame:
    """Requests with the history of their user. Anonymous requests, however many, meet the few
    anonymous rows by broadcast (at most the latest ones); all others join on real users."""
    past = past.withColumnRenamed("user_id", "past_user")
    same = F.col("user_id").eqNullSafe(F.col("past_user"))
    nobody = who.where("user_id IS NULL").join(F.broadcast(past.where("past_user IS NULL")), same)
    return who.where("user_id IS NOT NULL").join(past, F.col("user_id") == F.col("past_user")).unionByName(nobody)


def latest_history(chat: DataFrame, latest: int = 20) -> DataFrame:
    """The latest rows of each user, anonymous rows forming one user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return chat.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= latest)


def history_for(requests: DataFrame, users: DataFrame, chat: DataFrame, latest: int = 20) -> DataFrame:
    """What each request's user asked lately: ``(request_id, recency, id, …)``."""
    who = with_user(requests, users).select("request_id", "user_id")
    past = latest_history(chat, latest).select("user_id", "recency", "id", "ts", "selected_text", "question", "answer")
    return _with_past(who, past).drop("user_id", "past_user")


def relevant_history(
    asks: DataFrame, users: DataFrame, chat: DataFrame, limit: int = 3, latest: int = 20
) -> DataFrame:
    """The most relevant of a user's latest rows: one point per question word found in the
    past question, two per selection word found in the past selection.

    A user's history is at most ``latest`` rows, so it travels as one array and each ask
    is scored in place, without another shuffle.
    """
    past = latest_history(chat, latest).groupBy("user_id").agg(
        F.collect_list(F.struct(
            "id", "ts", "selected_text", "question", "answer",
            F.lower("question").alias("low_question"), F.lower("selected_text").alias("low_selected"),
        )).alias("past")
    )
    joined = _with_past(with_user(asks, users), past)

    def found(needles, text):
        return F.size(F.filter(needles, lambda w: F.contains(text, w)))

    def scores(asked):
        return F.transform(
            "past",
            lambda h: F.struct(
                (-(found(asked["q"], h["low_question"]) + 2 * found(asked["s"], h["low_selected"])))
                .alias("minus_score"),
                (-h["id"]).alias("minus_id"), h.alias("row"),
            ),
        )

    asked = F.struct(
        words(F.lower("question")).alias("q"),
        words(F.lower(F.coalesce("selected_text", F.lit("")))).alias("s"),
    )
    best = F.slice(F.sort_array(F.filter(let(asked, scores), lambda s: s["minus_score"] < 0)), 1, limit)
    return joined.select("ask_id", F.posexplode(best).alias("pos", "hit")).select(
        "ask_id", (F.col("pos") + 1).alias("rank"), F.col("hit.row.id").alias("id"),
        F.col("hit.row.ts").alias("ts"), F.col("hit.row.selected_text").alias("selected_text"),
        F.col("hit.row.question").alias("question"), F.col("hit.row.answer").alias("answer"),
        (-F.col("hit.minus_score")).alias("relevance_score"),
    )
