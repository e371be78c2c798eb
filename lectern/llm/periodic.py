"""Periodic runs of words by recursive frequency splitting.

A run of period ``q`` is at least ``max(6, 4 * q)`` words long, so each of its words occurs at least
four times in it. A word that occurs less often in a segment can be in no run of that segment: it
splits it, and the parts are split again by their own counts until nothing moves. Only segments that
survive are scanned: for each lag, in strides of the lag, as three multiples of it in a row must
match inside a run. Matches are extended over ranks of blocks of doubled length, so a long run costs
no more than a short one, and a text of any kind no more than some n (log n)^2 steps.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, schema_of, text_slices

LEAST = 6
TIMES = 4
HITS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word as a number, equal for equal words."""
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))


def _parts(cuts: list[int], a: int, b: int) -> list[tuple[int, int]]:
    """The stretches of [a, b) between sorted ``cuts`` that can hold a run."""
    ends = zip([a - 1, *cuts], [*cuts, b], strict=True)
    return [(x + 1, y) for x, y in ends if y - x - 1 >= LEAST]


def segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of the stretches in which every word occurs ``TIMES`` times or more.

    The largest part of a split keeps the counts of the whole less those of the rest, and only words
    whose count fell are looked at again: each word is counted anew a logarithmic number of times.
    """
    counts = np.bincount(ids)
    pending = [(a, b, None, None) for a, b in _parts(np.flatnonzero(counts[ids] < TIMES).tolist(), 0, len(ids))]
    places: dict[int, np.ndarray] = {}
    if pending:
        order = np.argsort(ids, kind="stable")
        places = dict(enumerate(np.split(order, np.cumsum(counts)[:-1])))
    while pending:
        a, b, have, rare = pending.pop()
        if have is None:
            have = Counter(ids[a:b].tolist())
            rare = [w for w, n in have.items() if n < TIMES]
        if not rare:
            yield a, b
            continue
        cuts: list[int] = []
        for w in rare:
            at = places[w]
            cuts.extend(at[np.searchsorted(at, a):np.searchsorted(at, b)].tolist())
        parts = _parts(sorted(cuts), a, b)
        if not parts:
            continue
        x, y = max(parts, key=lambda p: p[1] - p[0])
        pending.extend((*p, None, None) for p in parts if p != (x, y))
        if 2 * (y - x) < b - a:
            pending.append((x, y, None, None))
            continue
        gone = Counter(ids[a:x].tolist())
        gone.update(ids[y:b].tolist())
        for w, n in gone.items():
            have[w] -= n
        pending.append((x, y, have, [w for w in gone if 0 < have[w] < TIMES]))


def block_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For each power of two, until all differ: a number for the block of that many words from each place."""
    ranks, size = [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
    while 2 * size <= len(ids):
        last = ranks[-1]
        width = int(last.max()) + 1
        if width == len(last):
            break
        pair = last[:-size].astype(np.int64) * width + last[size:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return ranks


def _reach(ranks: list[np.ndarray], at: np.ndarray, lag: np.ndarray, back: bool) -> np.ndarray:
    """How many words match those ``lag`` further on: from ``at`` forward, or before it backward."""
    done = np.zeros(len(at), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[level], 1 << level
        place = at - done - size if back else at + done
        fits = np.flatnonzero((place >= 0) & (place + lag < len(rank)))
        hit = fits[rank[place[fits]] == rank[(place + lag)[fits]]]
        done[hit] += size
    return done


def scan_lags(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids``."""
    found: dict[tuple[int, int], int] = {}
    ranks: list[np.ndarray] = []
    held: list[tuple[np.ndarray, int]] = []
    size = 0

    def extend():
        if not ranks:
            ranks.extend(block_ranks(ids))
        at = np.concatenate([k for k, _ in held])
        lag = np.repeat([q for _, q in held], [len(k) for k, _ in held])
        start = at - _reach(ranks, at, lag, back=True)
        length = at + _reach(ranks, at, lag, back=False) + lag - start
        good = np.flatnonzero(length >= np.maximum(LEAST, TIMES * lag))
        for s, n, q in zip(start[good].tolist(), length[good].tolist(), lag[good].tolist(), strict=True):
            found.setdefault((s, n), q)  # lags rise, and a multiple of the period gives the same stretch

    for q in range(1, len(ids) // TIMES + 1):
        step = ids[::q]
        same = step[1:] == step[:-1]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(k):
            held.append((k * q, q))
            size += len(k)
        if size > HITS:
            extend()
            held, size = [], 0
    if held:
        extend()
    return [(s, n, q) for (s, n), q in found.items()]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = [(a + s, n, q) for a, b in segments(ids) for s, n, q in scan_lags(ids[a:b])] if len(ids) >= LEAST else []
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay if every run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period, the earliest of these, then that of the smallest period."""
    best = None
    for run in found:  # in order of start and period, so only a greater one takes the place
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _find(batches):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for ids, texts in text_slices(batches):
        rows = []
        for text in texts:
            words = (text or b"").split()
            n, found = len(words), find_runs(word_ids(words))
            if found:
                words = [words[i] for i in np.flatnonzero(kept_words(n, found)).tolist()]
            named = [{"start": s, "length": size, "period": q} for s, size, q in found]
            rows.append((n, named, *(strongest(found) or (None, None, None)), b" ".join(words)))
        n, named, start, length, period, collapsed = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(named, pa.list_(run)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(period, pa.int64()), pa.array(collapsed, pa.binary())],
            names=["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, start, length, period, collapsed: one row per row of ``docs``, no shuffle.

    ``runs`` holds every run by start, then period; ``start``, ``length`` and ``period`` are the run's of
    greatest length by period (ties: first start, then smallest period), null without a run;
    ``collapsed`` is the words joined by blanks, each run cut to its first period. A null text has no
    words; equal rows and null ids each keep their row; no rows give none. A text is always one
    task's work, in time and memory some n log n of its words.
    """
    found = id_and_text(docs, id_col, text_col).mapInArrow(_find, schema_of(
        docs, "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, start long, length long, period long, collapsed binary", id_col))
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which every tenth text, by the crc32 of its id, repeats from some word on.

    With ``h`` the crc32, ``g = h // 10`` and ``n`` words, word ``i >= a = g % n`` becomes the word at
    ``a + (i - a) % p``, where ``p = 1 + (n - a) // (3 + g % 8)``. A null id counts as empty text.
    """
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    marked = id_and_text(docs, id_col, text_col).withColumn("mark", mark).withColumn(
        "words", F.when((F.col("mark") % 10 == 0) & F.col("text").rlike(WORD), words))
    g, n = F.floor(F.col("mark") / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    spot = marked.withColumn("a", a.cast("int")).withColumn("p", p.cast("int"))
    tail = F.concat(
        F.slice("words", F.lit(1), F.col("a")),
        F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a")))
    return spot.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(tail, " ")).alias("text"))
