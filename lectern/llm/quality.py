"""Line-first quality rules: lines are judged first, then the document by what is left of it.

A line fails by punctuation (mostly signs or shouting), navigation (items between separators, or a
few words that end no sentence) or boilerplate (phrases of notices). Failing lines are removed;
a document that loses more than half its words is rejected, whatever is left, and so is one that the
base rules refuse: too few words, or too many in repeated stretches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, schema_of, text_slices

MIN_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
LOST_PERCENT = 50
NAVIGATION_WORDS = 4

# Phrases of notices, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under the", "released under the", "is licensed under", "terms of use", "terms of service", "terms and conditions",
    "privacy policy", "cookie policy", "we use cookies", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "sign up for our", "click here to", "powered by", "back to top", "skip to content", "skip to main content",
    "share this article", "follow us on", "lorem ipsum",
)
# Marks that end a sentence or clause, with closing marks after them left out; item separators.
SENTENCE_END = ".!?:;,…。！？"
CLOSING = "\"')]}»”’"
SEPARATORS = "|•·»›"

_BLANKS = b" \t\n\r\x0b\x0c"
_SIGNS = b"#*$%&|<>"
_NOTICE = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_SENTENCE_END = re.compile(f"[{re.escape(SENTENCE_END)}][{re.escape(CLOSING)}]*$")
RULES = ("punctuation", "navigation", "boilerplate")


def _count(line: bytes, signs: bytes) -> int:
    return len(line) - len(line.translate(None, signs))


def line_rule(line: bytes, n_words: int) -> str | None:
    """The rule that a line of ``n_words`` words, at least one, breaks first."""
    signs, shouts = _count(line, _SIGNS), line.count(b"!")
    if (signs >= 3 and 5 * signs > n_words) or (shouts >= 3 and 2 * shouts > n_words):
        return "punctuation"
    items = sum(line.count(s.encode()) for s in SEPARATORS)
    if items >= 3 and 5 * items > n_words:
        return "navigation"
    if n_words <= NAVIGATION_WORDS and not _SENTENCE_END.search(line.rstrip(_BLANKS).decode(errors="replace")):
        return "navigation"
    return "boilerplate" if _NOTICE.search(line.lower()) else None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more. Windows are named by doubling, so exactly."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    rank = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        pair = rank[:len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words lost by each rule, the text without failing lines."""
    words = text.split()
    seen: set[bytes] = set()
    repeated, lost, left = 0, dict.fromkeys(RULES, 0), []
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            repeated += line in seen
            seen.add(line)
            rule = line_rule(line, n)
            if rule:
                lost[rule] += n
                continue
        left.append(line)
    chars = len(text.translate(None, _BLANKS).decode(errors="replace"))
    return len(words), chars, _count(text, _SIGNS), repeated, repeated_words(words), *lost.values(), b"\n".join(left)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"n_{r}" for r in RULES)]


def _measure(batches):
    for ids, texts in text_slices(batches):
        *counts, left = zip(*(measure(t or b"") for t in texts), strict=True)
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(left, pa.binary())], names=["doc_id", *_COUNTS, "cleaned"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, cleaned, base_failed, kept: one row per row of ``docs``, no shuffle.

    ``n_punctuation``, ``n_navigation`` and ``n_boilerplate`` count the words of the lines each rule
    removed, ``cleaned`` is the text without these lines. A null text has no words and is not kept;
    equal rows and null ids each keep their row; no rows give none; a text of any length is judged whole.
    """
    counted = id_and_text(docs, id_col, text_col).mapInArrow(
        _measure, schema_of(docs, ", ".join(f"{c} long" for c in _COUNTS) + ", cleaned binary", id_col))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    lost = sum((F.col(f"n_{r}") for r in RULES), F.lit(0))
    return counted.withColumn("cleaned", F.col("cleaned").cast("string")).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * lost <= LOST_PERCENT * F.col("n_words")))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, failing lines removed, all other columns as they are; in place, no shuffle.

    Odd rows are treated as in ``judge``.
    """
    at = docs.columns.index(text_col)

    def task(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["i", "text"])
            for places, texts in text_slices([rows]):
                stay, new = [], []
                for i, t in zip(places.to_pylist(), texts, strict=True):
                    n, _, _, _, again, *lost, left = measure(t or b"")
                    if n >= MIN_WORDS and 100 * again <= REPEATED_PERCENT * n and 100 * sum(lost) <= LOST_PERCENT * n:
                        stay.append(i)
                        new.append(left)
                part = batch.take(pa.array(stay, pa.int64()))
                yield part.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(task, docs.schema)
