"""A log of answered questions replayed against a knowledge base that grows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.changes import add_usage
from lectern.operators.knowledge import auto_save
from lectern.operators.retrieval import knowledge_matches
from lectern.schemas import ENTRY
from lectern.session import cut_lineage
from lectern.sources.tables import evolve


def replay(
    log: DataFrame, kb: DataFrame, limit: int = 3, min_similarity: float = 0.5, threshold: float = 0.92, save_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``log(id, question, answer, ts)`` in order of id against ``kb``: the matches each question found when it was
    asked, and the base after the last one, its usage counts raised by the matches.

    What is saved does not depend on what was found, so the loop closes in three steps: all saves of the log; a search in
    which a question sees only rows created before it, saves of earlier questions among them; a count of the matches
    per row. ``save_id`` names the id of a saved row, a hash of its question's id unless given.
    """
    saved = auto_save(log, kb, threshold)
    if save_id is not None:
        saved = saved.withColumn("id", save_id)
    base = evolve(kb, ENTRY)
    grown = cut_lineage(base.unionByName(saved.select(*base.columns)))
    asks = log.select(F.col("id").alias("ask_id"), "question", F.col("ts").alias("asked_at"))
    found = cut_lineage(knowledge_matches(grown, asks, limit, min_similarity, as_of=True))
    return found, add_usage(grown, found.select("kb_id"))
