"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers the case, undoes look-alike letters and digit substitutions and drops invisible
characters. The lexicon is learned: folded words and their beginnings, whichever are
frequent in toxic training documents and rare in the others, weighted by log odds; phrases of a
lexicon word and a neighbour that occur in clean documents only are exceptions and take the word
back. A logistic curve over the summed weight, the number of hits and both relative to the length
turns matches into a score. Lexicon, exceptions and curve are fitted on a bounded sample of
labelled rows (``SAMPLE``, those of smallest hash); every text is scored whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import id_and_text, id_bucket, schema_of, stored, text_slices

SAMPLE = 20_000
LEXICON = 4_000
EXCEPTIONS = 4_000
MIN_DOCS = 5
MIN_SHARE = 0.005
MIN_ODDS = 2.5
LOOSE_ODDS = 1.0
STEM = 4, 10
COPY_PARTS = 16
BANDS = 3
THRESHOLD = 0.3

# Characters that look like Latin letters, and digits or signs that stand for them.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()} | {ord(c): None for c in INVISIBLE}
_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\s.,;:?]*[013457-8@$!|][^\s.,;:?]*")
_TRAIL = re.compile(r"[!|]+$")


def _unleet(m: re.Match) -> str:
    """Substituted signs of one word with letters around them; a sign that only closes a word stays one."""
    word, tail = m[0], _TRAIL.search(m[0])
    body, end = (word[:tail.start()], tail[0]) if tail else (word, "")
    if not any(c.isalpha() for c in body):
        return word
    return "".join(SUBSTITUTES.get(c, c) for c in body) + end


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alikes undone, signs inside words read as letters; words
    separated by one blank, one at each end. Texts in Cyrillic or Greek fold the same way at any place."""
    text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
    if _HAS_SIGN.search(text):
        text = _MIXED.sub(_unleet, text)
    return " " + " ".join(_WORD.findall(text)) + " "


_HAS_SIGN = re.compile(r"[^\W\d_][013457-8@$!|]+[^\W\d_]|[013457-8@$!|][^\W\d_]|[^\W\d_][013457-8@$]")


class Lexicon:
    """Weighted terms, each `` word `` or `` stem``, and exception phrases, as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions=()):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not weights
        if not self.empty:
            self.automaton.make_automaton()

    def terms(self, folded: str) -> set[str]:
        """Every term found, words inside exceptions left out."""
        places = {start for start, _ in self.hits(folded)}
        return {folded[end - size + 1:end + 1] for end, (size, weight) in self.automaton.iter(folded) if weight is not None and end - size + 1 in places} if places else set()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place of the word, weight) of each hit: per word its heaviest term, none inside an exception."""
        if self.empty:
            return []
        best: dict[int, float] = {}
        covered = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                covered.append((start, end - 1))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if covered:
            # Stretches by start, with the furthest end so far: a place is covered if that end lies beyond it.
            covered.sort()
            starts = [a for a, _ in covered]
            ends = list(accumulate((b for _, b in covered), max))
            return [(s, w) for s, w in best.items() if not ((at := bisect_right(starts, s)) and ends[at - 1] > s)]
        return list(best.items())


def features(hits: list[tuple[int, float]], folded: str) -> list[float]:
    """Constant, number of hits up to three as a share of three, log of the summed weight, log of the weight by length."""
    n, length = len(hits), folded.count(" ") - 1
    weight = sum(w for _, w in hits)
    return [1.0, min(n, 3) / 3, math.log1p(weight), math.log1p(1000 * weight / max(length, 50)) if n else 0.0]


def _terms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in range(STEM[0], min(STEM[1], len(word)) + 1))]


_MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _sketch(batches):
    """Adds a hash of the whole text and ``BANDS`` keys, each of two least hashes of its five-word shingles: texts share a
    key with about the square of the share of shingles that both have."""
    for labels, texts in text_slices(batches):
        names, bands = [], []
        for t in texts:
            words = t.lower().split()
            shingles = [b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in shingles), np.uint64, len(shingles))
            least = []
            for m in _MIXERS[:2 * BANDS]:
                mixed = (hashes ^ (hashes >> np.uint64(31))) * m
                least.append((mixed ^ (mixed >> np.uint64(29))).min())
            names.append(xxhash.xxh3_64_intdigest(t))
            bands.append([(int(a) * 31 + int(b)) & (1 << 64) - 1 for a, b in zip(least[::2], least[1::2], strict=True)])
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [labels.cast(pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), signed(names), *(signed([k[b] for k in bands]) for b in range(BANDS))],
            names=["y", "text", "name", *(f"band{b}" for b in range(BANDS))])


def _count_terms(batches):
    """(term, pos, neg): labelled documents with each term, summed over a few thousand rows at a time."""
    pos, neg = Counter(), Counter()

    def flush():
        keys = list(pos.keys() | neg.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())],
            names=["term", "pos", "neg"])
        pos.clear()
        neg.clear()
        return out

    for labels, texts in text_slices(batches):
        for y, t in zip(labels.to_pylist(), texts, strict=True):
            seen = set()
            for w in set(fold((t or b"").decode()).split()):
                seen.update(_terms(w))
            (pos if y else neg).update(seen)
            if len(pos) + len(neg) > 500_000:
                yield flush()
    yield flush()


def _count_phrases(weights: dict[str, float]):
    """(term, pos, neg): labelled documents with each pair of a hit word and its neighbour."""
    def task(batches):
        lexicon = Lexicon(weights)
        for labels, texts in text_slices(batches):
            pos, neg = Counter(), Counter()
            for y, t in zip(labels.to_pylist(), texts, strict=True):
                folded, seen = fold((t or b"").decode()), set()
                for s, _ in lexicon.hits(folded):
                    end = folded.index(" ", s + 1)
                    after = folded.find(" ", end + 1)
                    before = folded.rfind(" ", 0, s)
                    if after > 0:
                        seen.add(folded[s:after + 1])
                    if before >= 0:
                        seen.add(folded[before:end + 1])
                (pos if y else neg).update(seen)
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())],
                names=["term", "pos", "neg"])
    return task


def _count_left(weights: dict[str, float], exceptions: list[str]):
    """(term, pos, neg): labelled documents with each term outside all exceptions."""
    def task(batches):
        lexicon = Lexicon(weights, exceptions)
        for labels, texts in text_slices(batches):
            pos, neg = Counter(), Counter()
            for y, t in zip(labels.to_pylist(), texts, strict=True):
                (pos if y else neg).update(lexicon.terms(fold((t or b"").decode())))
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())],
                names=["term", "pos", "neg"])
    return task


def _measure(weights, exceptions):
    def task(batches):
        lexicon = Lexicon(weights, exceptions)
        for labels, texts in text_slices(batches):
            rows = []
            for t in texts:
                folded = fold((t or b"").decode())
                rows.append(features(lexicon.hits(folded), folded))
            yield pa.RecordBatch.from_arrays([labels.cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])
    return task


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _concise(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Stems that stand for several words, the longest of those that say the same, and words that no stem kept stands for."""
    longest: dict[str, int] = {}
    word: dict[str, int] = {}
    for term, (pos, _) in found.items():
        body = term.rstrip()
        for k in range(STEM[0] + 1, len(body) + 1):
            if term.endswith(" "):
                word[body[:k]] = max(pos, word.get(body[:k], 0))
            elif k < len(body):
                longest[body[:k]] = max(pos, longest.get(body[:k], 0))
    stems = {t for t, (pos, _) in found.items() if not t.endswith(" ") and word.get(t, 0) < 0.5 * pos and longest.get(t, 0) < 0.95 * pos}
    return {t: round(odds, 6) for t, (_, odds) in sorted(found.items())
            if (t in stems or t.endswith(" ")) and not any(t[:k] in stems for k in range(STEM[0] + 1, len(t)))}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> tuple[dict[str, float], list[str], list[float]]:
    """Lexicon weights, exception phrases and curve from the labelled rows whose crc32 of the id mod 4 is not 2.

    Rows with a null label or id teach nothing; an id with several labels counts as toxic if one is.
    At most ``sample`` ids are used, those of smallest hash; of texts that are copies or near copies (``_sketch``)
    one teaches for each label they have. Without any label the lexicon is empty and every score is the same. ``LEXICON`` and ``EXCEPTIONS``
    bound the terms learned, as those of a sample of bounded size; no text is left out or cut.
    """
    rows = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).dropna()
    chosen = (rows.where(id_bucket(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    picked = chosen.collect()  # at most ``sample`` small rows
    spark = docs.sparkSession
    small = spark.createDataFrame(picked, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("y", T.IntegerType())]))
    train = id_and_text(docs, id_col, text_col).join(F.broadcast(small), "doc_id").select("y", "text")
    train = stored(train.where("text IS NOT NULL").mapInArrow(_sketch, "y int, text string, name long, " + ", ".join(f"band{b} long" for b in range(BANDS)))
                   .withColumn("row", F.monotonically_increasing_id()), "toxicity-sketches")
    # Of near copies one teaches for each label: in two steps, so that copies in any number are never one group.
    left = train.drop("text")
    for b in range(BANDS):
        first = F.min(F.struct("name", "row", *[f"band{c}" for c in range(BANDS) if c > b])).alias("one")
        left = left.withColumn("part", F.col("row") % COPY_PARTS).groupBy(f"band{b}", "y", "part").agg(first)
        left = left.groupBy(f"band{b}", "y").agg(F.min("one").alias("one")).select("y", "one.*")
    train = stored(train.join(left.select("row"), "row", "left_semi").select("y", "text"), "toxicity-train")

    n_pos, n_neg = (max(1, train.where(F.col("y") == v).count()) for v in (1, 0))
    def summed(rows):
        sums = rows.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        return sums.withColumn("odds", F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)))

    schema = "term string, pos long, neg long"
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * n_pos))
    # Words and stems that toxic texts favour; phrases of them that only clean texts have; what is left without these.
    found = summed(train.mapInArrow(_count_terms, schema)).where((F.col("pos") >= least) & (F.col("odds") >= LOOSE_ODDS))
    rough = {r["term"]: r["odds"] for r in found.orderBy(F.desc(F.col("odds") * F.least("pos", F.lit(50))), F.length("term"), "term").limit(LEXICON).collect()}
    exceptions: list[str] = []
    weights: dict[str, float] = {}
    if rough:
        pairs = summed(train.mapInArrow(_count_phrases(rough), schema)).where((F.col("neg") >= MIN_DOCS) & (F.col("neg") > 4 * F.col("pos")))
        exceptions = [r["term"] for r in pairs.orderBy(F.desc("neg"), "term").limit(EXCEPTIONS).collect()]
        left = summed(train.mapInArrow(_count_left(rough, exceptions), schema)).where(
            (F.col("pos") >= least) & (F.col("odds") >= MIN_ODDS) & (F.col("neg") * 20 <= F.col("pos"))).collect()  # at most LEXICON rows
        weights = _concise({r["term"]: (r["pos"], r["odds"]) for r in left})
        exceptions = [e for e in exceptions if Lexicon(weights).hits(e)]
    known = train.mapInArrow(_measure(weights, exceptions), "y int, x array<double>").collect()
    known.sort(key=lambda r: (r["y"], r["x"]))
    if not known:
        return weights, exceptions, [-3.0, 0.0, 0.0, 0.0]
    curve = _logistic(np.array([r["x"] for r in known]), np.array([r["y"] for r in known], float))
    return weights, exceptions, [round(float(c), 9) for c in curve]


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score, predicted, hits (place in the folded text, weight) for every row, whole texts, no shuffle.

    Null texts count as empty and are scored by the curve's constant; null ids and equal rows each keep their row; no rows give none.
    """
    weights, exceptions, curve = model

    def task(batches):
        lexicon, w = Lexicon(weights, exceptions), np.array(curve)
        for ids, texts in text_slices(batches):
            scores, hits = [], []
            for t in texts:
                folded = fold((t or b"").decode())
                found = lexicon.hits(folded)
                scores.append(1 / (1 + math.exp(-float(np.clip(w @ features(found, folded), -30, 30)))))
                hits.append([{"place": p, "weight": x} for p, x in found])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                 pa.array(hits, pa.list_(pa.struct([("place", pa.int64()), ("weight", pa.float64())])))],
                names=["doc_id", "score", "predicted", "hits"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        task, schema_of(docs, "score double, predicted int, hits array<struct<place: bigint, weight: double>>", id_col))


def clean(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are; scored in place, no shuffle.

    Odd rows are treated as in ``score``.
    """
    weights, exceptions, curve = model
    at = docs.columns.index(text_col)

    def task(batches):
        lexicon, w = Lexicon(weights, exceptions), np.array(curve)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
            for places, texts in text_slices([rows]):
                keep = []
                for t in texts:
                    folded = fold((t or b"").decode())
                    z = float(np.clip(w @ features(lexicon.hits(folded), folded), -30, 30))
                    keep.append(1 / (1 + math.exp(-z)) < THRESHOLD)
                yield batch.take(places.filter(pa.array(keep, pa.bool_())))

    return docs.mapInArrow(task, docs.schema)
