"""How the knowledge base grows: quality gate, automatic saves, document Q&A, bulk loads."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import contains_any, or_default, trim_ws
from lectern.functions.vectors import word_set
from lectern.operators.dense import DenseIndex, dense_greedy_keep, dense_near_existing, usable
from lectern.operators.embedding import WordSets
from lectern.operators.neardup import greedy_keep, near_existing
from lectern.schemas import ENTRY
from lectern.session import cut_lineage
from lectern.sources.tables import evolve

# Phrases that mark an answer as a failure.
ERROR_PHRASES = (
    "i don't know",
    "i cannot",
    "not enough context",
    "insufficient",
    "unable to answer",
    "__error__",
)


def gate_reason(answer: Column, min_chars: int = 80) -> Column:
    """Why an answer is not worth saving; NULL when it is. A missing answer is too short."""
    answer = F.coalesce(answer, F.lit(""))
    failed = contains_any(F.lower(answer), ERROR_PHRASES)
    return F.when(F.char_length(trim_ws(answer)) < min_chars, "too_short").when(failed, "error_phrase")


def knowledge_id(source: str, *keys: str) -> Column:
    """The id of a new row: a hash of where it comes from and its key there, the same on every run."""
    return F.xxhash64(F.lit(source), *keys)


def knowledge_rows(rows: DataFrame, embedder=None) -> DataFrame:
    """``rows`` with every column of the knowledge base, missing ones NULL, the question's vector
    made by ``embedder`` (word sets unless given); further columns stay."""
    rows = evolve(rows, ENTRY)
    return (embedder or WordSets()).transform(rows, "question", "vector")


def quality_gate(chat: DataFrame, min_chars: int = 80) -> DataFrame:
    return chat.withColumn("gate_reason", gate_reason(F.col("answer"), min_chars))


def auto_save(
    chat: DataFrame, kb: DataFrame, threshold: float = 0.92, source: str = "auto-query", vector: str | None = None,
    known: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """New knowledge-base rows from answered questions, in order of id: good answers to
    questions with no near duplicate in the base or among the rows saved before them.

    Questions are compared as word sets, or by ``vector``, a column of dense vectors that ``chat`` and ``kb``
    both have, which the new rows then keep. ``known``, if given, finds the ids of the ``(id, vector)`` rows that
    the base holds already, in place of a comparison with ``kb``."""
    good = chat.where(gate_reason(F.col("answer")).isNull())
    compared = F.col(vector) if vector else word_set(F.col("question"))
    asked = cut_lineage(good.select("id", compared.alias("vector")))
    if known is not None:
        near = known(asked)
    elif vector:
        base = kb.select(compared.alias("vector")).where(usable("vector")).distinct()
        near = dense_near_existing(asked, DenseIndex.build(base.withColumn("id", F.xxhash64("vector"))), threshold)
    else:
        near = near_existing(asked, kb.select(compared.alias("vector")), threshold)
    keep = dense_greedy_keep if vector else greedy_keep
    fresh = asked.join(near, "id", "left_anti")
    saved = keep(fresh, threshold).where("kept").select("id")
    given = [F.col(vector).alias("vector")] if vector else []
    rows = good.join(saved, "id", "left_semi").select(
        knowledge_id(source, "id").alias("id"), F.col("id").alias("chat_history_id"), "question", F.col("answer").alias("original_answer"),
        F.col("answer").alias("corrected_answer"), F.col("ts").alias("created_at"),
        F.lit("").alias("context_text"), F.lit(source).alias("corrected_by"), F.lit(1).alias("usage_count"), *given,
    )
    return evolve(rows, ENTRY) if vector else knowledge_rows(rows)


def document_candidates(
    pairs: DataFrame, docs: DataFrame, min_answer: int = 20, created_at: Column | None = None
) -> DataFrame:
    """Rows from Q/A pairs ``(document_id, part, pos, question, answer)`` a model wrote for
    documents: the first pair per question and document, answers long enough."""
    usable = pairs.select(
        "document_id", "part", "pos",
        trim_ws(F.col("question")).alias("question"), trim_ws(F.col("answer")).alias("answer"),
    ).where((F.col("question") != "") & (F.char_length("answer") >= min_answer))
    order = Window.partitionBy("document_id", F.lower("question")).orderBy("part", "pos")
    first = usable.withColumn("n", F.row_number().over(order)).where("n = 1")
    named = docs.select(F.col("id").alias("document_id"), F.col("safe_filename"))
    return knowledge_rows(first.join(named, "document_id").select(
        knowledge_id("document", "document_id", "part", "pos").alias("id"), _at(created_at), "document_id", "part", "pos", "question", F.col("answer").alias("original_answer"),
        F.col("answer").alias("corrected_answer"), F.col("safe_filename").alias("context_text"),
        F.concat(F.lit("Auto-generated from: "), "safe_filename").alias("corrected_by"),
        F.lit(0).alias("usage_count"),
    ))


def pair_counts(pairs: DataFrame, saved: DataFrame) -> DataFrame:
    """Pairs parsed and rows saved per document."""
    parsed = pairs.groupBy("document_id").agg(F.count("*").alias("n_parsed"))
    kept = saved.groupBy("document_id").agg(F.count("*").alias("n_saved"))
    return parsed.join(kept, "document_id", "left").select(
        "document_id", "n_parsed", F.coalesce("n_saved", F.lit(0)).alias("n_saved")
    )


def bulk_load(requests: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows from records with ``items ARRAY<STRUCT<question, answer, source>>``. The id follows
    from the record's other columns and the place in ``items``."""
    keys = [c for c in requests.columns if c != "items"]
    return knowledge_rows(requests.select(*keys, F.posexplode("items").alias("_at", "_item")).select(*keys, "_at", "_item.*").select(
        *keys, knowledge_id("bulk", *keys, "_at").alias("id"), _at(created_at), "question", F.lit("").alias("original_answer"), F.col("answer").alias("corrected_answer"),
        or_default(F.col("source"), "").alias("context_text"),
        F.lit("Manual Entry").alias("corrected_by"), F.lit(0).alias("usage_count"),
    ))


def items_added(rows: DataFrame) -> DataFrame:
    """The message of a bulk load: how many rows it added."""
    n = F.count("*")
    return rows.agg(n.alias("n"), F.concat(n.cast("string"), F.lit(" knowledge items added")).alias("message"))


def _at(created_at: Column | None) -> Column:
    return (F.current_timestamp() if created_at is None else created_at).alias("created_at")


def listing(kb: DataFrame) -> DataFrame:
    """The base for display, most used first."""
    return kb.select(
        "id", "question", or_default(F.col("original_answer"), "").alias("original_answer"),
        F.col("corrected_answer").alias("answer"), "created_at", "chat_history_id",
        or_default(F.col("corrected_by"), "User").alias("corrected_by"),
        F.coalesce("usage_count", F.lit(0)).alias("usage_count"),
    ).orderBy(F.desc("usage_count"), F.desc("id"))


def search(kb: DataFrame, needle: str) -> DataFrame:
    """Rows whose question or answer contains the needle, whatever the case."""
    if not needle:
        return kb
    low = F.lower(F.lit(needle))
    return kb.where(F.contains(F.lower("question"), low) | F.contains(F.lower("corrected_answer"), low))
