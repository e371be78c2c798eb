"""Change logs applied to snapshots: every operator returns a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.knowledge import knowledge_id, knowledge_rows


def latest_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change per key as struct ``new``. An aggregate, so a key that holds much of
    the log is combined before the shuffle."""
    cols = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("new")
    )


def apply_changes(
    base: DataFrame, changes: DataFrame, key: str, order: list[str], sets: dict[str, str]
) -> DataFrame:
    """``base`` with the columns ``sets = {base column: change column}`` taken from the last
    change of each key. Changes without a base row have no effect; a change may set NULL."""
    last = latest_changes(changes, key, order)
    changed = F.col("new").isNotNull()
    kept = [
        F.when(changed, F.col("new")[sets[c]]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
        for c in base.columns
    ]
    return base.join(last, key, "left").select(*kept)


def apply_ratings(chat: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rating and comment by chat id, ``ratings(id, rating, comment, ts, seq)``."""
    return apply_changes(chat, ratings, "id", ["ts", "seq"], {"rating": "rating", "comment": "comment"})


def previous_value(
    df: DataFrame, key: str, order: list[str], segment: Column, value: str, out: str
) -> DataFrame:
    """The value of the row before, per key. Rows are ordered inside (key, segment), and
    only segment ends are ordered per key, so one heavy key is still many groups.
    ``segment`` must not fall along the order."""
    df = df.withColumn("_seg", segment)
    inside = Window.partitionBy(key, "_seg").orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(inside)).withColumn("_in", F.lag(value).over(inside))
    ends = df.groupBy(key, "_seg").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_seg")))
    joined = rows.join(ends.drop("_last"), [key, "_seg"])
    return joined.withColumn(
        out, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_in"))
    ).drop("_seg", "_n", "_in", "_before")


def apply_corrections(
    chat: DataFrame, corrections: DataFrame, segment: Column | None = None, embedder=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``corrections(seq, chat_id, corrected_answer, comment, ts)`` to the updated chat rows,
    the new knowledge-base rows and the rejected corrections.

    Each new row keeps the answer it replaced, which for a second correction of the same
    chat row is the first correction.
    """
    segment = F.date_trunc("hour", "ts") if segment is None else segment
    asked = chat.select(F.col("id").alias("chat_id"), "question", "answer", F.lit(True).alias("_there"))
    matched = corrections.join(asked, "chat_id", "left")
    known = matched.where("_there")
    rejects = matched.where("_there IS NULL").select(*corrections.columns, F.lit("chat_not_found").alias("reason"))
    chain = previous_value(known, "chat_id", ["ts", "seq"], segment, "corrected_answer", "replaced")
    rows = chain.select(
        knowledge_id("correction", "chat_id", "seq").alias("id"), "seq", "question", F.coalesce("replaced", "answer").alias("original_answer"), "corrected_answer",
        F.col("ts").alias("created_at"), F.col("chat_id").alias("chat_history_id"),
        F.lit("User").alias("corrected_by"), F.lit(0).alias("usage_count"),
    )
    rows = knowledge_rows(rows, embedder)
    updated = apply_changes(
        chat, corrections.withColumnRenamed("chat_id", "id"), "id", ["ts", "seq"],
        {"answer": "corrected_answer", "comment": "comment"},
    )
    return updated, rows, rejects


def edit_knowledge(
    kb: DataFrame, edits: DataFrame, embedder=None, vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """``edits(id, question, answer, ts, seq)`` replace question and answer. Edited rows are embedded
    again by ``embedder``; without one their vectors are dropped. Second result: ids not found."""
    edited = apply_changes(kb, edits, "id", ["ts", "seq"], {"question": "question", "corrected_answer": "answer"})
    if vector in kb.columns:
        ids = edits.select("id").distinct().withColumn("_edited", F.lit(True))
        edited = edited.join(ids, "id", "left")
        again = F.lit(None)
        if embedder is not None:
            edited, again = embedder.transform(edited, "question", "_again"), F.col("_again")
        edited = edited.withColumn(
            vector, F.when(F.col("_edited").isNull(), F.col(vector)).otherwise(again)
        ).select(*kb.columns)
    missing = edits.join(kb.select("id"), "id", "left_anti").select("id").distinct()
    return edited, missing


def delete_knowledge(kb: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows left after deleting ``ids(id)``, and the ids not found."""
    left = kb.join(ids.select("id"), "id", "left_anti")
    missing = ids.join(kb.select("id"), "id", "left_anti").select("id").distinct()
    return left, missing


def add_usage(kb: DataFrame, fires: DataFrame) -> DataFrame:
    """Usage counts raised by one per firing, ``fires(kb_id)``."""
    fired = fires.groupBy("kb_id").agg(F.count("*").alias("fired"))
    return kb.join(fired, kb["id"] == fired["kb_id"], "left").select(
        *[kb[c] for c in kb.columns if c != "usage_count"],
        (F.coalesce(kb["usage_count"], F.lit(0)) + F.coalesce("fired", F.lit(0))).cast("bigint").alias("usage_count"),
    )


def delete_documents(
    docs: DataFrame, chunks: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``requests(filename)`` delete the lowest id of that name with its chunks. Returns the
    documents and chunks left, and a report with the chunks deleted per request."""
    names = requests.select("filename").distinct()
    target = (
        docs.join(names, "filename", "left_semi").groupBy("filename")
        .agg(F.min("id").alias("document_id"))
    )
    docs_left = docs.join(target, docs["id"] == target["document_id"], "left_anti")
    chunks_left = chunks.join(target, "document_id", "left_anti")
    counts = (
        chunks.join(target, "document_id", "left_semi").groupBy("document_id")
        .agg(F.count("*").alias("chunks_deleted"))
    )
    report = (
        names.join(target, "filename", "left").join(counts, "document_id", "left")
        .select(
            "filename", "document_id", F.coalesce("chunks_deleted", F.lit(0)).cast("bigint").alias("chunks_deleted"),
            F.when(F.col("document_id").isNull(), "not_found").otherwise("deleted").alias("status"),
        )
    )
    return docs_left, chunks_left, report
