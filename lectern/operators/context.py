"""Context selection, prompt assembly and the context record, for batches of asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import has_text, is_summary_question, trim_ws
from lectern.operators.retrieval import knowledge_matches, relevant_chunks, scoped_chunks
from lectern.session import cut_lineage

# Texts and separators of the prompt.
TRUNCATION_NOTE = "\n\n[Truncated to keep the prompt responsive.]"
SEPARATOR = "\n\n---\n\n"
INSTRUCTIONS = (
    "Answer using only the provided context when it contains relevant information.\n"
    "If the context is insufficient, say what is missing instead of guessing.\n"
    "Do not include internal tags, metadata, JSON, or the words CONTEXT/QUESTION in the answer.\n"
    "If a specific document or highlighted excerpt was provided, treat it as the primary source "
    "and do not mix in unrelated documents.\n"
    "Keep the answer concise, structured, and directly responsive to the question."
)

# Task modes, their models and the prompts put before a question.
TASKS = (
    ("research", "llama3.1:8b", "You are a document assistant. Answer only from the provided context when possible. If insufficient, say what is missing instead of guessing."),
    ("argument", "gemma4:31b", "You are a legal research assistant. Structure every argument in IRAC format: Issue, Rule, Application, Conclusion. Cite specific page numbers for every claim. Flag weaknesses opposing counsel might exploit."),
    ("precedents", "gemma4:31b", "You are a legal research assistant. Identify and explain relevant legal precedents from the document. Note applicable jurisdictions and how they relate to the case."),
    ("risk", "gemma4:31b", "You are a legal risk analyst. Identify ambiguous language, missing standard clauses, unfavorable terms, and jurisdiction risks. Rate each risk High/Medium/Low with page citations."),
    ("clause", "llama3.1:8b", "You are a contract analysis assistant. Extract the requested clause type precisely. Return: exact clause text, plain English explanation, and risk level (Low/Medium/High). If missing, state explicitly."),
    ("summarize", "gemma4:31b", "You are a legal document analyst. Provide a structured summary covering: parties involved, key dates, main obligations, and notable clauses or findings."),
)


def document_block(title: Column, filename: Column, text: Column, cap: int) -> Column:
    """A document as prompt text, cut to ``cap`` characters with a note."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(
        F.lit("Document title: "), F.coalesce(F.nullif(title, F.lit("")), filename),
        F.lit("\nDocument file: "), filename, F.lit("\n\n"), F.substring(text, 1, cap),
        F.when(F.char_length(text) > cap, F.lit(TRUNCATION_NOTE)).otherwise(F.lit("")),
    )


def document_names(selections: Column, active: Column) -> Column:
    """Distinct document names of the selections in order, the active document last."""
    names = F.concat(
        F.transform(F.coalesce(selections, F.array()), lambda s: s["document_name"]), F.array(active)
    )
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def selections_text(selections: Column) -> Column:
    return F.array_join(
        F.transform(
            selections,
            lambda s, i: F.concat(
                F.lit("[Selection "), (i + 1).cast("string"), F.lit(" from: "),
                s["document_name"], F.lit("]\n"), s["text"],
            ),
        ),
        SEPARATOR,
    )


def selection_summary(asks: DataFrame) -> DataFrame:
    """Number of selections and their total characters, per ask that has any."""
    lengths = F.transform("selections", lambda s: F.char_length(s["text"]))
    return asks.where(F.size("selections") > 0).select(
        "ask_id", F.size("selections").alias("n_selections"),
        F.aggregate(lengths, F.lit(0), lambda a, n: a + n).alias("total_chars"),
        F.array_join(lengths.cast("array<string>"), ",").alias("lengths"),
    )


def select_context(
    asks: DataFrame, docs: DataFrame, chunks: DataFrame,
    k: int = 4, active_cap: int = 14_000, summary_cap: int = 12_000,
) -> DataFrame:
    """The first source of context that an ask has: selections, selected text, the active
    document, a summary of the scoped documents, or retrieved chunks.

    Each source is computed only for the asks that reach it. Returns ``asks`` plus
    ``prompt_text, context_chunks, best_similarity, context_source``.
    """
    has_selections = F.size(F.coalesce("selections", F.array())) > 0
    selected = trim_ws(F.col("selected_text"))
    first_of_name = docs.groupBy("filename").agg(F.min("id").alias("active_id"))
    routed = asks.join(
        first_of_name, asks["active_document_name"] == first_of_name["filename"], "left"
    ).select(
        asks["*"], "active_id",
        F.when(has_selections, "selections").when(has_text(F.col("selected_text")), "selected_text")
        .when(F.col("active_id").isNotNull(), "active_document").otherwise("open").alias("_route"),
    )
    names = F.coalesce("scoped_names", F.array())
    missing = F.when(F.col("active_document_name") != "", F.array("active_document_name")).otherwise(F.array())
    opened = routed.where(F.col("_route") == "open").withColumn(
        "scoped_names", F.array_distinct(F.concat(missing, names))
    )

    direct = routed.where(F.col("_route").isin("selections", "selected_text")).select(
        "ask_id",
        F.when(F.col("_route") == "selections", selections_text(F.col("selections")))
        .otherwise(selected).alias("prompt_text"),
    )
    direct = _whole(direct, "selected_text")

    active = (
        routed.where(F.col("_route") == "active_document").select("ask_id", "active_id")
        .join(docs.select(F.col("id").alias("active_id"), "title", "filename",
                          F.substring("content", 1, active_cap + 1).alias("content")), "active_id")
        .select("ask_id", document_block(F.col("title"), F.col("filename"), F.col("content"), active_cap)
                .alias("prompt_text"))
    )
    active = _whole(active, "active_document")

    wants_summary = (F.size("scoped_names") > 0) & is_summary_question(F.col("question"))
    parts = (
        opened.where(wants_summary).select("ask_id", F.explode("scoped_names").alias("filename"))
        .join(docs.select("id", "title", "filename",
                          F.substring("content", 1, summary_cap + 1).alias("content")), "filename")
        .select("ask_id", "id", document_block(F.col("title"), F.col("filename"), F.col("content"), summary_cap)
                .alias("part"))
    )
    summary = parts.groupBy("ask_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "part"))).alias("parts")
    ).select(
        "ask_id", F.array_join(F.col("parts.part"), SEPARATOR).alias("prompt_text"),
        F.col("parts.part").alias("context_chunks"), F.lit(1.0).alias("best_similarity"),
        F.lit("summary_document").alias("context_source"),
    )

    searched = cut_lineage(opened.join(summary.select("ask_id"), "ask_id", "left_anti"))
    everywhere = relevant_chunks(chunks, searched.where(F.size("scoped_names") == 0), k)
    within = scoped_chunks(docs, chunks, searched.where(F.size("scoped_names") > 0), k)
    hits = cut_lineage(everywhere.unionByName(within))
    texts = chunks.join(hits.select("document_id").distinct(), "document_id", "left_semi")
    hits = hits.join(texts, ["document_id", "chunk_index"])
    gathered = hits.groupBy("ask_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))).alias("hits"),
        F.max("similarity").alias("best"),
    )
    retrieved = searched.select("ask_id").join(gathered, "ask_id", "left").select(
        "ask_id",
        F.coalesce(
            F.array_join(F.transform("hits", lambda h: F.concat(F.lit("\n\n"), h["chunk_text"])), ""),
            F.lit(""),
        ).alias("prompt_text"),
        F.coalesce(F.col("hits.chunk_text"), F.array().cast("array<string>")).alias("context_chunks"),
        F.coalesce("best", F.lit(0.0)).alias("best_similarity"),
        F.lit("retrieval").alias("context_source"),
    )
    context = direct.unionByName(active).unionByName(summary).unionByName(retrieved)
    return asks.join(context, "ask_id")


def _whole(df: DataFrame, source: str) -> DataFrame:
    return df.select(
        "ask_id", "prompt_text", F.array("prompt_text").alias("context_chunks"),
        F.lit(1.0).alias("best_similarity"), F.lit(source).alias("context_source"),
    )


def assemble_prompts(contexts: DataFrame, matches: DataFrame) -> DataFrame:
    """Contexts and knowledge-base matches to prompts: the hand-off to an external model."""
    entry = F.concat(F.lit("Q: "), F.col("kb_question"), F.lit("\nA: "), F.col("answer"), F.lit("\n---\n"))
    blocks = (
        matches.groupBy("ask_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "kb_id", entry.alias("entry")))).alias("fired"))
        .select(
            "ask_id", F.col("fired.kb_id").alias("kb_ids"),
            F.concat(
                F.lit("\n\n<knowledge_base_corrections>\n"),
                F.array_join(F.col("fired.entry"), ""), F.lit("</knowledge_base_corrections>"),
            ).alias("kb_block"),
        )
    )
    prompt = F.concat(
        F.lit("<context>\n"), F.col("prompt_text"), F.coalesce("kb_block", F.lit("")),
        F.lit("\n</context>\n\n<question>\n"), F.col("question"), F.lit("\n</question>\n\n" + INSTRUCTIONS),
    )
    return contexts.join(blocks, "ask_id", "left").select(
        contexts["*"], F.coalesce("kb_ids", F.array().cast("array<bigint>")).alias("kb_ids"),
        prompt.alias("prompt"),
    )


def build_prompts(asks: DataFrame, docs: DataFrame, chunks: DataFrame, kb: DataFrame) -> DataFrame:
    return assemble_prompts(select_context(asks, docs, chunks), knowledge_matches(kb, asks))


def context_records(contexts: DataFrame) -> DataFrame:
    """The context of each ask as one JSON record."""
    return contexts.select(
        "ask_id",
        F.to_json(
            F.struct(
                "context_chunks", F.col("best_similarity").alias("similarity_score"),
                "context_source", "active_document_name",
            ),
            {"ignoreNullFields": "false"},
        ).alias("context_json"),
    )


def task_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TASKS), "task STRING, task_model STRING, task_prompt STRING")


def apply_task(asks: DataFrame) -> DataFrame:
    """Model and question by task mode; every mode but research puts its prompt first."""
    tasks = F.broadcast(task_table(asks.sparkSession))
    prefix = F.when(F.col("task_prompt").isNotNull() & (F.col("task") != "research"),
                    F.concat("task_prompt", F.lit("\n\n"))).otherwise(F.lit(""))
    return asks.join(tasks, "task", "left").select(
        "ask_id", "task", F.coalesce("task_model", F.lit("llama3.1:8b")).alias("model"),
        F.concat(prefix, F.col("question")).alias("question"),
    )
