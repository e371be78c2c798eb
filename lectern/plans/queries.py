"""Registered queries: every operator run over the whole given tables."""

from __future__ import annotations

import io
import zipfile
from typing import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import markers, text
from lectern.functions.vectors import word_set
from lectern.operators import (
    changes, chunking, context, dense, feedback, knowledge, neardup, replay, retrieval, transcripts,
)
from lectern.plans.views import Tables
from lectern.session import cut_lineage, scratch_path, short_listings
from lectern.sources import files, tables
from lectern.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Registers ``fn(tables)`` as ``(spark, folder) -> DataFrame`` under its name."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    QUERIES[fn.__name__].__doc__ = fn.__doc__
    return fn


# Inputs with types that the shared SQL of the views leaves open.

def _chat(t):
    return t.chat.withColumn("ts", F.timestamp_seconds("ts_s")).drop("ts_s")


def _kb(t):
    return t.kb.withColumn("created_at", F.timestamp_seconds("created_s")).drop("created_s")


def _docs(t):
    return t.docs.withColumn("upload_timestamp", F.timestamp_seconds("uploaded_s")).drop("uploaded_s")


def _asks(t):
    return t.asks.select("ask_id", "question", F.timestamp_seconds("asked_s").alias("asked_at"))


def _routed(t):
    """Asks that between them take every route to a context."""
    second = F.concat(F.lit("Second: "), F.col("question"))
    item = lambda i, words, name: F.struct(
        F.lit(i).alias("id"), words.alias("text"), F.coalesce(name, F.lit("none")).alias("document_name")
    )
    picked = F.array(item("s1", F.col("question"), F.col("name1")), item("s2", second, F.col("name2")))
    scoped = F.filter(F.array("name1", "name2"), lambda n: n.isNotNull())
    on = lambda *routes: F.col("route").isin(*routes)
    return t.routed_asks.select(
        "ask_id", "question", "token", "past_selection",
        F.when(on(1), picked).alias("selections"),
        F.when(on(2), F.concat(F.lit("\n "), F.col("question"), F.lit(" \t"))).otherwise("").alias("selected_text"),
        F.when(on(3), F.col("name1")).alias("active_document_name"),
        F.when(on(0, 4), scoped).otherwise(F.array().cast("array<string>")).alias("scoped_names"),
    )


def _chunks(t):
    return chunking.chunk_documents(t.docs)


def _stored_chunks(t):
    """Chunks as a stored table, for queries that read them more than once."""
    return cut_lineage(_chunks(t))


def _files(t):
    """Documents as uploaded bytes, some empty, binary, PDF-like or blank."""
    body = F.encode("content", "UTF-8")
    content = (
        F.when(F.col("id") % 9 == 0, F.encode(F.lit(""), "UTF-8"))
        .when(F.col("id") % 11 == 0, F.concat(F.unhex(F.lit("00")), body))
        .when(F.col("id") % 13 == 0, F.concat(F.encode(F.lit("%PDF-"), "UTF-8"), body))
        .when(F.col("id") % 17 == 0, F.encode(F.lit(" \n\t "), "UTF-8"))
        .otherwise(body)
    )
    made = t.docs.select(F.col("id").cast("string").alias("path"), "filename", content.alias("content"))
    return made.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def _qa(t):
    return transcripts.ordered_concat(
        t.qa_lines.withColumn("key", F.struct("document_id", "part")), "key", "turn", "line", "raw"
    ).select("key.document_id", "key.part", "raw")


def _as_text(df, *columns):
    """Whole numbers that may be NULL, as text: result frames turn them into floats otherwise."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# Chunking, vectors and retrieval

@query
def chunk_documents(t):
    return _chunks(t)


@query
def chunk_counts(t):
    return chunking.chunk_counts(t.docs.select("id"), _chunks(t))


@query
def embed_chunks(t):
    return _chunks(t).select(
        "document_id", "chunk_index", F.size(word_set(F.col("chunk_text"))).alias("n_features")
    )


@query
def retrieve_chunks(t):
    """Best four chunks for every question."""
    return retrieval.relevant_chunks(_chunks(t), _asks(t), k=4)


@query
def scoped_topk(t):
    return retrieval.scoped_chunks(t.docs, _chunks(t), _routed(t).where(F.size("scoped_names") > 0), k=3)


@query
def vector_topk(t):
    corpus = t.embeddings.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.vector_top_k(corpus, asked, k=3)
    return found.select("query_id", "rank", "corpus_id", F.round("score", 5).alias("score"))


def _turned(share):
    """A vector blended with itself turned by one place, so that it is near the vector it was made of."""
    e = F.col("vector")
    turned = F.concat(F.slice(e, F.lit(2), F.size(e)), F.slice(e, 1, 1))
    return F.zip_with(e, turned, lambda a, b: F.lit(share) * a + F.lit(0.3) * b)


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@query
def vector_topk_indexed(t):
    """As vector_topk, from a stored index that skips blocks."""
    vectors = _vectors(t)
    found = retrieval.vector_top_k(vectors, vectors.withColumnRenamed("id", "query_id"), k=3, index=dense.DenseIndex.build(vectors))
    return found.select("query_id", "rank", "corpus_id", F.round("score", 5).alias("score"))


@query
def vector_near_dup(t):
    """Vectors, some blended, some turned, that a vector of the table is near to."""
    third = F.col("id") % 3
    changed = F.when(third == 0, _turned(0.95)).when(third == 1, _turned(0.0)).otherwise(F.col("vector"))
    return dense.dense_near_existing(_vectors(t).withColumn("vector", changed), dense.DenseIndex.build(_vectors(t)))


@query
def vector_dedupe(t):
    """First-come suppression over vectors, blends of them and blends of the blends."""
    first = _vectors(t).withColumn("id", 3 * F.col("id"))
    second = first.select((F.col("id") + 1).alias("id"), _turned(0.95).alias("vector"))
    third = second.select((F.col("id") + 1).alias("id"), _turned(0.95).alias("vector"))
    return dense.dense_greedy_keep(first.unionByName(second).unionByName(third))


@query
def auto_save_vectors(t):
    """As auto_save, with questions compared by dense vectors of the embeddings table."""
    vectors = _vectors(t)
    n = vectors.count()
    own = vectors.select(F.col("id").alias("vec"), "vector")
    near = vectors.select(F.col("id").alias("vec"), _turned(0.95).alias("vector"))
    chat = _chat(t).withColumn("vec", F.col("id") % n).join(own, "vec")
    kb = _kb(t).withColumn("vec", F.col("id") % n).join(near, "vec")
    saved = knowledge.auto_save(chat, kb, vector="vector").withColumn("created_at", F.unix_seconds("created_at"))
    return saved.drop("id", "vector")


@query
def kb_semantic_topk(t):
    return retrieval.knowledge_matches(_kb(t), _asks(t))


@query
def kb_asof_replay(t):
    found = retrieval.knowledge_matches(_kb(t), _asks(t), as_of=True, min_similarity=0.0)
    return found.select("ask_id", "rank", "kb_id", "relevance_score")


def _replayed(t):
    return replay.replay(_chat(t), _kb(t), save_id=F.col("chat_history_id") + 10_000_000)


@query
def replay_matches(t):
    """What each question of the log found when it was asked, saves of earlier questions included."""
    return _replayed(t)[0].select("ask_id", "rank", "kb_id", "relevance_score")


@query
def replay_usage(t):
    """The base after the log, with usage counts that follow from the matches."""
    return _replayed(t)[1].select("id", "question", "usage_count")


@query
def kb_keyword_topk(t):
    return retrieval.knowledge_keyword_matches(_kb(t), _asks(t)).select("ask_id", "rank", "kb_id", "relevance_score")


@query
def kb_keyword_indexed(t):
    """As kb_keyword_topk, from an inverted index of the base."""
    found = retrieval.knowledge_keyword_matches(_kb(t), _asks(t), index=retrieval.keyword_index(t.kb))
    return found.select("ask_id", "rank", "kb_id", "relevance_score")


@query
def retrieve_chunks_indexed(t):
    """As retrieve_chunks, from an inverted index of the chunks."""
    chunks = _chunks(t)
    return retrieval.relevant_chunks(chunks, _asks(t), k=4, index=retrieval.chunk_index(chunks))


@query
def history_latest20(t):
    requests = _routed(t).select(F.col("ask_id").alias("request_id"), "token")
    return retrieval.history_for(requests, t.users, _chat(t)).select("request_id", "recency", "id", "question")


@query
def history_relevance(t):
    asks = _routed(t).select("ask_id", "token", "question", F.col("past_selection").alias("selected_text"))
    found = retrieval.relevant_history(asks, t.users, _chat(t))
    return found.select("ask_id", "rank", "id", "relevance_score")


@query
def user_lookup(t):
    return retrieval.with_user(_routed(t).select("ask_id", "token"), t.users).select("ask_id", "token", "user_id")


@query
def admin_flags(t):
    return feedback.admin_flags(_routed(t).select("ask_id", "token"), t.users)


# Context and prompts

@query
def summary_intent(t):
    return t.asks.select("ask_id", text.is_summary_question(F.col("question")).alias("is_summary"))


@query
def context_cascade(t):
    found = context.select_context(_routed(t), t.docs, _stored_chunks(t))
    return found.select(
        "ask_id", "prompt_text", F.size("context_chunks").alias("n_chunks"), "best_similarity", "context_source"
    )


@query
def prompt_assembly(t):
    made = context.build_prompts(_routed(t), t.docs, _stored_chunks(t), _kb(t))
    return made.select("ask_id", F.array_join(F.col("kb_ids").cast("array<string>"), ",").alias("kb_ids"), "prompt")


@query
def context_record(t):
    made = context.context_records(context.select_context(_routed(t), t.docs, _stored_chunks(t)))
    got = lambda p: F.get_json_object("context_json", p)
    return made.select(
        "ask_id", got("$.context_chunks[0]").alias("first_chunk"), got("$.context_source").alias("context_source"),
        got("$.similarity_score").cast("double").alias("similarity_score"),
        got("$.active_document_name").alias("active_document_name"),
    )


@query
def selection_summary(t):
    return context.selection_summary(_routed(t))


@query
def document_names(t):
    names = context.document_names(F.col("selections"), F.col("active_document_name"))
    return _routed(t).select("ask_id", F.array_join(names, "|").alias("names"))


@query
def context_mode(t):
    mode = text.context_mode(F.col("selected_text"), F.size("scoped_names") > 0)
    return _routed(t).select("ask_id", mode.alias("mode"))


@query
def task_prefix(t):
    tasks = F.array(*[F.lit(n) for n, _, _ in context.TASKS])
    asks = t.asks.select("ask_id", "question", F.get(tasks, (F.col("ask_id") % 7).cast("int")).alias("task"))
    return context.apply_task(asks)


# Knowledge base

@query
def kb_listing(t):
    listed = knowledge.listing(_kb(t)).withColumn("created_at", F.unix_seconds("created_at"))
    return _as_text(listed, "chat_history_id")


@query
def kb_search(t):
    return knowledge.search(_kb(t), "ThAn").select("id", "question", "corrected_answer")


@query
def quality_gate(t):
    return knowledge.quality_gate(_chat(t)).select("id", "gate_reason")


@query
def near_dup_vs_kb(t):
    asked = t.asks.select(F.col("ask_id").alias("id"), word_set(F.col("question")).alias("vector"))
    known = t.kb.select("id", word_set(F.col("question")).alias("vector"))
    return neardup.near_existing(asked, known)


@query
def greedy_dedupe(t):
    """First-come duplicate suppression over the texts of all documents."""
    return neardup.greedy_keep(t.docs.select("id", word_set(F.col("content")).alias("vector")))


@query
def auto_save(t):
    """Questions of chat, saved unless near a base row or an earlier save."""
    saved = knowledge.auto_save(_chat(t), _kb(t)).withColumn("created_at", F.unix_seconds("created_at"))
    return saved.drop("id", "vector")


@query
def qa_pairs_parse(t):
    return transcripts.parse_qa(_qa(t))


@query
def kb_candidates(t):
    docs = t.docs.withColumn("safe_filename", text.sanitize_filename(F.col("filename")))
    made = knowledge.document_candidates(transcripts.parse_qa(_qa(t)), docs)
    return made.drop("id", "created_at", "chat_history_id", "vector")


@query
def pairs_saved(t):
    """Pairs parsed and pairs saved per document."""
    parsed = transcripts.parse_qa(_qa(t))
    docs = t.docs.withColumn("safe_filename", text.sanitize_filename(F.col("filename")))
    return knowledge.pair_counts(parsed, knowledge.document_candidates(parsed, docs))


@query
def bulk_kb_load(t):
    item = F.struct(
        F.col("question"), F.col("corrected_answer").alias("answer"), F.col("context_text").alias("source")
    )
    requests = t.kb.groupBy((F.col("id") - F.col("id") % 5).alias("request_id")).agg(F.collect_list(item).alias("items"))
    return knowledge.bulk_load(requests).drop("id", "created_at", "chat_history_id", "vector")


@query
def items_added(t):
    item = F.struct("question", F.col("corrected_answer").alias("answer"), F.col("context_text").alias("source"))
    requests = t.kb.select(F.col("id").alias("request_id"), F.array(item).alias("items"))
    return knowledge.items_added(knowledge.bulk_load(requests))


@query
def knowledge_growth(t):
    """Saved answers, corrections and bulk loads as one base, searched."""
    _, corrected, _ = changes.apply_corrections(t.chat, t.corrections)
    item = F.struct("question", F.col("corrected_answer").alias("answer"), F.col("context_text").alias("source"))
    loaded = knowledge.bulk_load(t.kb.select(F.col("id").alias("request_id"), F.array(item).alias("items")))
    columns = ("id", "question", "corrected_answer", "corrected_by", "vector")
    grown = knowledge.auto_save(_chat(t), _kb(t)).select(*columns)
    for more in (corrected, loaded):
        grown = grown.unionByName(more.select(*columns))
    return knowledge.search(grown, "than").select("corrected_by", "question", "corrected_answer", F.size("vector").alias("n_words"))


@query
def excerpts(t):
    return chunking.excerpt_rows(t.docs)


# Feedback

@query
def ratings_feed(t):
    return feedback.ratings_feed(_chat(t), t.users).withColumn("ts", F.unix_seconds("ts"))


@query
def rating_display(t):
    shown = feedback.rating_display(feedback.ratings_feed(_chat(t), t.users))
    return shown.withColumn("day", F.col("day").cast("string"))


@query
def rating_stats(t):
    return feedback.rating_stats(t.chat)


@query
def rating_distribution(t):
    return feedback.rating_distribution(t.chat)


@query
def rating_distribution_map(t):
    """Read back from the map, one row per star."""
    found = feedback.rating_distribution_map(t.chat)
    return found.select(F.explode("distribution").alias("rating", "n"))


@query
def rating_distribution_scaled(t):
    return feedback.rating_distribution_scaled(t.chat)


@query
def rating_filter(t):
    return feedback.rating_filter(t.chat, 5).select("id", "rating", "comment")


@query
def rating_filter_counts(t):
    return feedback.rating_filter_counts(t.chat)


# Changes

@query
def apply_rating_changes(t):
    return _as_text(changes.apply_ratings(t.chat, t.rating_changes).select("id", "rating", "comment"), "rating")


@query
def apply_corrections(t):
    chat, _, _ = changes.apply_corrections(t.chat, t.corrections)
    return chat.select("id", "answer", "comment")


@query
def corrections_to_kb(t):
    _, rows, _ = changes.apply_corrections(t.chat, t.corrections)
    return rows.drop("id", "created_at", "context_text", "vector")


@query
def corrections_rejected(t):
    _, _, rejects = changes.apply_corrections(t.chat, t.corrections)
    return rejects.select("seq", "chat_id", "reason")


@query
def kb_edit(t):
    edited, _ = changes.edit_knowledge(t.kb, t.kb_edits)
    return edited.select("id", "question", "corrected_answer")


@query
def kb_edit_missing(t):
    return changes.edit_knowledge(t.kb, t.kb_edits)[1]


@query
def kb_edit_buckets(t):
    """The same edits, then deletes, on a table cut by key: only buckets that change are written."""
    path, kb = scratch_path(t.spark, "kb-buckets"), t.kb
    tables.write_buckets(kb, path, "id", 16)
    edit = lambda rows, edits: changes.edit_knowledge(rows, edits)[0]
    tables.change_buckets(t.spark, path, kb.schema, "id", 16, t.kb_edits, edit)
    gone = t.fires.select((F.col("kb_id") * 3).alias("id")).distinct()
    tables.change_buckets(t.spark, path, kb.schema, "id", 16, gone, lambda rows, ids: changes.delete_knowledge(rows, ids)[0])
    return tables.read_buckets(t.spark, path, kb.schema).select("id", "question", "corrected_answer")


@query
def kb_append(t):
    """Bulk rows appended to the stored base."""
    path, columns = scratch_path(t.spark, "kb"), ("question", "corrected_answer", "usage_count")
    tables.append(t.kb.select(*columns), path)
    item = F.struct("question", F.col("corrected_answer").alias("answer"), F.col("context_text").alias("source"))
    loaded = knowledge.bulk_load(t.kb.select(F.col("id").alias("request_id"), F.array(item).alias("items")))
    tables.append(loaded.select(*columns), path)
    stored = tables.scan(t.spark, path, "question", "usage_count")
    return stored.groupBy("question").agg(F.count("*").alias("n_rows"), F.count("usage_count").alias("n_counted"))


@query
def kb_delete(t):
    gone = t.fires.select((F.col("kb_id") * 3).alias("id")).distinct()
    return changes.delete_knowledge(t.kb, gone)[0].select("id", "question")


@query
def usage_increment(t):
    return changes.add_usage(t.kb, t.fires).select("id", "usage_count")


def _delete_requests(t):
    return t.routed_asks.select(F.coalesce("name1", F.concat(F.lit("gone_"), F.col("ask_id").cast("string"))).alias("filename"))


@query
def cascade_delete(t):
    return _as_text(changes.delete_documents(t.docs, _chunks(t), _delete_requests(t))[2], "document_id")


@query
def cascade_delete_left(t):
    docs, chunks, _ = changes.delete_documents(t.docs, _chunks(t), _delete_requests(t))
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return docs.select("id", "filename").join(counted, docs["id"] == counted["document_id"], "left").select(
        "id", "filename", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )


# Transcripts

@query
def page_citations(t):
    found = t.cited.select("doc_id", F.posexplode(markers.page_citations(F.col("answer"))).alias("pos", "c"))
    return found.select("doc_id", "pos", "c.page", "c.label")


@query
def suggestion_parse(t):
    found = markers.suggestions(F.col("response"), F.col("snippet"))
    return t.suggested.select("doc_id", F.array_join(found, "|").alias("suggestions"))


@query
def transcript_demux(t):
    return _as_text(transcripts.demux(t.streams), "entry_id")


def _tokens(t, line):
    """Every word of every assistant turn as one log line."""
    turns = t.conversations.where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), text.words(F.col("text")).alias("ws")
    )
    return turns.select("request_id", F.size("ws").alias("n"), F.posexplode("ws").alias("seq", "w")).select(
        "request_id", "seq", line(F.concat("w", F.lit(" "))).alias("line")
    )


@query
def ndjson_tokens(t):
    bad = F.when(F.col("seq") % 17 == 16, '{"response": "cut')
    return transcripts.ndjson_answers(_tokens(t, lambda w: F.coalesce(bad, F.to_json(F.struct(w.alias("response"))))))


@query
def sse_tokens(t):
    def line(w):
        delta = F.struct(F.struct(w.alias("content")).alias("delta"))
        data = F.to_json(F.struct(F.array(delta).alias("choices")))
        return (
            F.when(F.col("seq") == F.col("n") - 3, "data: [DONE] ")
            .when(F.col("seq") % 19 == 18, ": keep-alive")
            .otherwise(F.concat(F.lit("data: "), data))
        )

    return transcripts.sse_answers(_tokens(t, line))


@query
def export_conversations(t):
    return transcripts.export_conversations(t.conversations)


@query
def search_results(t):
    return t.bodies.select("doc_id", F.posexplode(markers.search_results(F.col("body"))).alias("pos", "r")).select(
        "doc_id", "pos", "r.*"
    )


# Ingest and text

@query
def document_listing(t):
    return chunking.document_listing(_docs(t), _chunks(t)).withColumn(
        "upload_timestamp", F.unix_seconds("upload_timestamp")
    )


@query
def document_lookup(t):
    """Lowest id per file name."""
    return t.docs.groupBy("filename").agg(F.min("id").alias("document_id"))


@query
def documents_named(t):
    """Documents whose name occurs in a list, as a semi join."""
    names = _routed(t).select(F.explode("scoped_names").alias("filename"))
    return t.docs.join(names, "filename", "left_semi").select("id", "filename", "title")


@query
def text_pages(t):
    return chunking.text_pages(t.docs)


@query
def page_assembly(t):
    pages = cut_lineage(chunking.text_pages(t.docs))
    blank = (F.col("document_id") + F.col("page_no")) % 5 == 0
    made = chunking.assemble_pages(pages.withColumn("page_text", F.when(blank, " ").otherwise(F.col("page_text"))))
    return _as_text(made, "char_count")


@query
def text_stats(t):
    c = F.col("content")
    return t.docs.select(
        "id", text.word_count(c).alias("n_words"), text.text_page_count(c).alias("text_pages"),
        text.docx_page_estimate(F.octet_length(c)).alias("docx_pages"),
    )


@query
def doc_type(t):
    return t.docs.select("id", text.document_type(F.col("filename")).alias("doc_type"))


@query
def search_query(t):
    return t.docs.select("id", text.search_query(F.col("filename"), F.col("content")).alias("search_query"))


@query
def citation_line(t):
    fields = [F.col(c) for c in ("title", "author", "publication_date", "source", "doi_url")]
    return t.docs.select("id", text.citation_line(*fields).alias("citation"))


@query
def ellipsis_snippets(t):
    return t.kb.select(
        "id", text.ellipsis(F.col("question"), 100).alias("short_question"),
        text.ellipsis(F.col("corrected_answer"), 120).alias("short_answer"),
        text.ellipsis(F.col("question"), 150, "...").alias("short_selection"),
    )


@query
def sanitize_names(t):
    return t.raw_names.select("page_id", text.sanitize_filename(F.col("filename")).alias("safe_filename"))


@query
def extract_text(t):
    got = files.extract(_files(t))
    got = got.select(
        F.col("path").cast("bigint").alias("id"), "file_type", "char_count", "truncated", "error_code", "http_status"
    )
    return _as_text(got, "char_count", "truncated", "http_status")


_DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


@F.pandas_udf(T.BinaryType())
def _word_file(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """Word files made of texts, a paragraph a line: some without a document part, with too many parts, broken, or blank."""
    def made(i, text):
        body = "".join(f"<w:p><w:r><w:t>{escape('  ' if i % 7 == 3 else line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("[Content_Types].xml", "<Types/>")
            if i % 7:
                archive.writestr("word/document.xml", "<w:document" if i % 7 == 2 else _DOCX.format(body))
            for k in range(files.MAX_ZIP_ENTRIES if i % 97 == 1 else 0):
                archive.writestr(f"part{k}", b"")
        return out.getvalue()

    return pd.Series([made(i, t) for i, t in zip(ids, texts, strict=True)])


@query
def docx_ingest(t):
    """Word files through the container gate and text extraction."""
    made = t.docs.select(F.col("id").cast("string").alias("path"), F.concat("id", F.lit(".docx")).alias("filename"), _word_file("id", "content").alias("content"))
    got = files.extract(made.withColumn("size_bytes", F.octet_length("content").cast("bigint")))
    return _as_text(got.select(
        F.col("path").cast("bigint").alias("id"), "file_type", "error_code", "http_status", "char_count", F.md5("text").alias("text_md5")), "char_count", "http_status")


@query
def pdf_ingest(t):
    """PDF uploads with their page texts: some of too many pages, some of too many characters."""
    i = F.col("document_id")
    times = F.when(i % 39 == 0, 200).when(i % 65 == 0, 149).otherwise(1)
    pages = chunking.text_pages(t.docs)
    pages = pages.select("document_id", "page_no", "page_text", times.alias("times"), F.explode(F.sequence(F.lit(1), times)).alias("k"))
    pages = pages.withColumn("page_no", (F.col("page_no") - 1) * F.col("times") + F.col("k"))
    blank = (i + F.col("page_no")) % 5 == 0
    pages = pages.select(i.cast("string").alias("path"), "page_no", F.when(blank, " ").otherwise(F.col("page_text")).alias("page_text"))
    got = files.with_pages(files.extract(_files(t)), pages).where("file_type = 'pdf'")
    return _as_text(got.select(
        F.col("path").cast("bigint").alias("id"), "page_count", "char_count", "truncated", F.md5("text").alias("text_md5"),
        F.size("warnings").alias("n_warnings"), "error_code", "http_status", "error",
    ), "char_count", "truncated", "http_status")


@query
def ingest_report(t):
    got = files.extract(_files(t)).where(F.col("path").isNotNull())
    report = files.ingest_report(got)
    counted = report.groupBy("filename", "message", "error").agg(
        F.count("*").alias("n_files"), F.sum("chunks_count").alias("n_chunks")
    )
    return _as_text(counted, "n_chunks")


@query
def attach_metadata(t):
    plain = t.docs.select("id", "filename")
    return files.attach_metadata(plain, t.metadata)


@query
def ui_admission(t):
    return files.ui_admission(t.form_files).select("id", "refused")


@query
def json_documents(t):
    return files.json_documents(t.json_texts).select("event_id", "valid", "canonical")


@query
def table_counts(t):
    """Totals a display shows: ratings, base rows, documents, chunks."""
    def total(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")

    return (
        total(feedback.rating_filter(t.chat), "ratings").unionByName(total(t.kb, "kb_entries"))
        .unionByName(total(t.docs, "documents")).unionByName(total(_chunks(t), "chunks"))
    )


@query
def vector_guard(t):
    cut = F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 32)).when(
        F.col("vec_id") % 50 == 1, F.lit(None)
    ).otherwise(F.col("embedding"))
    return tables.vector_guard(t.embeddings.withColumn("embedding", cut), dim=64)


@query
def schema_evolution(t):
    from lectern.schemas import KNOWLEDGE_BASE

    old = t.kb.select("id", "question", "corrected_answer")
    return tables.evolve(old, KNOWLEDGE_BASE, {"usage_count": 0}).select(
        "id", "question", "corrected_answer", "corrected_by", "usage_count"
    )


# Streaming

def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query
def stream_ingest(t):
    out = scratch_path(t.spark, "ingest")
    docs = jobs.table_stream(t.spark, t.path("documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    _finish(jobs.ingest_chunks(docs, f"{out}/rows", f"{out}/state"))
    return t.spark.read.parquet(f"{out}/rows").select("document_id", "chunk_index", "chunk_text")


@query
def stream_learning(t):
    out = scratch_path(t.spark, "learn")
    rows = _chat(t)
    low, high = rows.approxQuantile("id", [0.33, 0.66], 0.01) or [0.0, 0.0]
    i = F.col("id")
    for part in (i.isNull() | (i <= low), (i > low) & (i <= high), i > high):  # what arrives before each run is one batch
        rows.where(part).write.mode("append").parquet(f"{out}/chat")
        _finish(jobs.learn(jobs.table_stream(t.spark, f"{out}/chat"), _kb(t), f"{out}/rows", f"{out}/state"))
    return t.spark.read.parquet(f"{out}/rows").select("chat_history_id", "question", "corrected_answer")


@query
def stream_uploads(t):
    """Files of a hundred documents each, some marked PDF and some blank, as a stream of uploads: what became of each."""
    out = scratch_path(t.spark, "uploads")
    part = F.floor(F.col("id") / 100)
    line = F.when((part % 5 == 3) & (F.col("id") % 100 == 0), F.concat(F.lit("%PDF-"), "content")).when(part % 5 == 4, " ").otherwise(F.col("content"))
    lines = t.docs.select(part.alias("part"), "id", line.alias("line"))
    lines.repartition("part").sortWithinPartitions("part", "id").select("part", "line").write.partitionBy("part").text(f"{out}/in")
    with short_listings(t.spark):  # a folder for each file
        _finish(jobs.ingest_files(jobs.file_stream(t.spark, f"{out}/in", "*.txt"), f"{out}/store", f"{out}/state"))
    stored = lambda name: t.spark.read.parquet(f"{out}/store/{name}")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]), "|")
    chunks = stored("chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.md5(text).alias("chunks_md5"), F.sum(F.size("vector")).alias("n_words"))
    rejected = stored("rejected").select("path", F.col("error_code").alias("rejected_as"))
    found = stored("files").join(rejected, "path", "left").join(chunks, F.md5("path") == F.col("document_id"), "left")
    return _as_text(found.select(
        F.regexp_extract("path", r"part=([0-9]+)", 1).cast("bigint").alias("part"), "file_type", "char_count", "rejected_as", "n_chunks", "chunks_md5", "n_words"),
        "char_count", "n_chunks", "n_words")


@query
def stream_rating_stats(t):
    out = scratch_path(t.spark, "ratings")
    log = jobs.table_stream(t.spark, t.path("events")).select((F.col("event_id") % 5 + 1).cast("int").alias("rating"))
    _finish(jobs.live_rating_counts(log, f"{out}/rows", f"{out}/state"))
    return jobs.current_counts(t.spark, f"{out}/rows", "rating")


@query
def stream_usage(t):
    out = scratch_path(t.spark, "usage")
    fires = jobs.table_stream(t.spark, t.path("events")).select((F.col("event_id") % 211).alias("kb_id"))
    _finish(jobs.live_usage_counts(fires, f"{out}/rows", f"{out}/state"))
    return jobs.current_counts(t.spark, f"{out}/rows", "kb_id")
