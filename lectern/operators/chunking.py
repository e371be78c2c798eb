"""Documents to chunks, chunks per document, excerpts and text pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import chunk_array, excerpts, has_text, pages_of_words, trim_ws


def chunk_documents(
    docs: DataFrame, text: str = "content", key: str = "id", max_chars: int = 500
) -> DataFrame:
    """One row per chunk: ``(document_id, chunk_index, chunk_text)``. Narrow, no shuffle."""
    return docs.select(
        F.col(key).alias("document_id"),
        F.posexplode(chunk_array(F.col(text), max_chars)).alias("chunk_index", "chunk_text"),
    )


def chunk_counts(docs: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """Every document with its number of chunks, zero included."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    return docs.join(counts, docs[key] == counts["document_id"], "left").select(
        docs["*"], F.coalesce("n", F.lit(0)).cast("bigint").alias("chunks_count")
    )


def document_listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents newest first, with chunk counts and without their content."""
    listed = chunk_counts(docs.drop("content"), chunks)
    return listed.orderBy(F.desc("upload_timestamp"), F.desc("id"))


def excerpt_rows(
    docs: DataFrame, text: str = "content", key: str = "id",
    min_doc: int = 200, min_excerpt: int = 150, size: int = 4000,
) -> DataFrame:
    """The excerpts worth asking a model about: ``(document_id, part, excerpt)``, parts from 1."""
    return (
        docs.where(F.char_length(trim_ws(F.col(text))) >= min_doc)
        .select(
            F.col(key).alias("document_id"),
            F.posexplode(excerpts(F.col(text), size)).alias("pos", "excerpt"),
        )
        .where(F.char_length("excerpt") >= min_excerpt)
        .select("document_id", (F.col("pos") + 1).alias("part"), "excerpt")
    )


def text_pages(docs: DataFrame, text: str = "content", key: str = "id", per_page: int = 350) -> DataFrame:
    """``(document_id, page_no, page_text)`` with pages numbered from 1."""
    return docs.select(
        F.col(key).alias("document_id"),
        F.posexplode(pages_of_words(F.col(text), per_page)).alias("pos", "page_text"),
    ).select("document_id", (F.col("pos") + 1).alias("page_no"), "page_text")


def assemble_pages(
    pages: DataFrame, max_pages: int = 150, max_chars: int = 300_000
) -> DataFrame:
    """Page texts joined into tagged documents.

    Documents over ``max_pages`` are turned away from their page count alone,
    before any text is gathered, so a gathered group never exceeds that bound.
    """
    sized = pages.groupBy("document_id").agg(
        F.max("page_no").alias("page_count"),
        F.count("*").alias("rows"),
        F.count_if(has_text(F.col("page_text"))).alias("text_pages"),
    )
    over_limit = F.greatest("page_count", "rows") > max_pages
    fits = ~over_limit & (F.col("text_pages") > 0)
    tagged = F.concat(
        F.lit("\n\n[Page "), F.col("page_no").cast("string"), F.lit("]\n\n"), F.col("page_text")
    )
    texts = (
        pages.where(has_text(F.col("page_text")))
        .join(sized.where(fits).select("document_id"), "document_id", "left_semi")
        .withColumn("block", tagged)
        .groupBy("document_id")
        .agg(F.expr("listagg(block) WITHIN GROUP (ORDER BY page_no)").alias("full_text"))
    )
    over = F.char_length("full_text") > max_chars
    return sized.join(texts, "document_id", "left").select(
        "document_id",
        F.col("page_count").cast("int").alias("page_count"),
        F.substring("full_text", 1, max_chars).alias("text"),
        F.when(over, max_chars).otherwise(F.char_length("full_text")).alias("char_count"),
        F.coalesce(over, F.lit(False)).alias("truncated"),
        F.when(over_limit, "too_many_pages")
        .when(F.col("text_pages") == 0, "no_text")
        .alias("error_code"),
    )
