"""Model transcripts and token logs back to tables, and conversation export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import markers
from lectern.functions.text import trim_ws


def parse_qa(transcripts: DataFrame) -> DataFrame:
    """``(document_id, part, raw)`` to ``(document_id, part, pos, question, answer)``. Narrow."""
    return transcripts.select(
        "document_id", "part", F.posexplode(markers.qa_pairs(F.col("raw"))).alias("pos", "pair")
    ).select("document_id", "part", "pos", "pair.question", "pair.answer")


def demux(transcripts: DataFrame, text: str = "transcript") -> DataFrame:
    """Entry id, context JSON, error and bare answer of each response."""
    t = F.col(text)
    return transcripts.select(
        *[c for c in transcripts.columns if c != text],
        markers.entry_id(t).alias("entry_id"), markers.context_json(t).alias("context_json"),
        markers.error_message(t).alias("error"), markers.strip_markers(t).alias("answer"),
    )


def ordered_concat(
    rows: DataFrame, key: str, order: str, text: str, out: str, segment_rows: int = 10_000, stop: Column | None = None
) -> DataFrame:
    """Texts of a key joined in order, in two steps: segments of the order first, then one
    short list of segments per key. The heavy step spreads even when one key is large. NULL texts add
    nothing. With ``stop`` a key ends before the first place in order that has a row where it holds."""
    row = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    halt = F.lit(None).cast("bigint") if stop is None else F.when(stop, F.col(order))
    parts = (
        rows.withColumn("_seg", F.floor(F.col(order) / segment_rows))
        .groupBy(key, "_seg")
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.min(halt).alias("_stop"))
    )
    live = F.col("_rows") if stop is None else F.filter("_rows", lambda r: F.col("_stop").isNull() | (r["o"] < F.col("_stop")))
    parts = parts.select(key, "_seg", "_stop", F.array_join(F.transform(live, lambda r: r["t"]), "").alias("_text"))
    found = parts.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_seg", "_text"))).alias("_parts"), F.min(F.when(F.col("_stop").isNotNull(), F.col("_seg"))).alias("_last"))
    kept = F.filter("_parts", lambda p: F.col("_last").isNull() | (p["_seg"] <= F.col("_last")))
    return found.select(key, F.array_join(F.transform(kept, lambda p: p["_text"]), "").alias(out))


def _token(line: Column, path: str) -> Column:
    return markers.strict_json(line, path, "string")


def ndjson_answers(log: DataFrame) -> DataFrame:
    """``(request_id, seq, line)`` of JSON lines to one answer per request; bad lines are skipped,
    and requests without a token."""
    tokens = log.select("request_id", "seq", _token(F.col("line"), ".response").alias("token"))
    return ordered_concat(tokens, "request_id", "seq", "token", "answer").where(F.col("answer") != "")


def sse_answers(log: DataFrame) -> DataFrame:
    """The same for ``data: `` lines, which count up to the first ``[DONE]``. One pass, one aggregate."""
    data = trim_ws(F.substring("line", 7, 1 << 30))
    events = log.where(F.startswith("line", F.lit("data: "))).select("request_id", "seq", data.alias("data"))
    done = F.col("data") == "[DONE]"
    token = F.when(~done, _token(F.col("data"), ".choices[0].delta.content"))
    tokens = events.select("request_id", "seq", done.alias("done"), token.alias("token"))
    return ordered_concat(tokens, "request_id", "seq", "token", "answer", stop=F.col("done")).where(F.col("answer") != "")


def export_blocks(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` to ordered export blocks; concatenating the blocks of a
    conversation gives its export. Never gathers a conversation."""
    shown = messages.where(F.col("role").isin("user", "assistant"))
    first = shown.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    who = F.when(F.col("role") == "user", "You").otherwise("Assistant")
    rule = F.when(F.col("turn") == F.col("first_turn"), "").otherwise("\n---\n\n")
    return shown.join(first, "conv_id").select(
        "conv_id", "turn",
        F.concat(rule, F.lit("["), who, F.lit("]\n"), F.col("text"), F.lit("\n")).alias("block"),
    )


def export_conversations(messages: DataFrame) -> DataFrame:
    """One export text per conversation."""
    return ordered_concat(export_blocks(messages), "conv_id", "turn", "block", "export")


def write_export(messages: DataFrame, path: str) -> None:
    """Export blocks as text files in conversation order, split by range."""
    blocks = export_blocks(messages)
    ordered = blocks.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    # Every block ends in a line break, which the writer adds again.
    lines = ordered.select(F.expr("substring(block, 1, char_length(block) - 1)").alias("block"))
    lines.write.mode("overwrite").text(path)
