"""Benchmark decontamination by SimHash windows.

Texts and items are lower-cased, punctuation is a blank, shingles have five words. Around every
shingle that a text shares with an item (no similar window is without one), windows of the item's
length are fingerprinted: 64 bits, each the sign of the weighted sum over the window's shingles,
taken from running sums. Fingerprints of items of one length are indexed in eight blocks of eight
bits, each entered under all values within ``RADIUS // 8`` bits, so a probe by the eight blocks of
a window finds every fingerprint within ``RADIUS``. Candidates are verified by the exact weighted
Jaccard similarity of the shingle multisets. Items are sent to the tasks in slices of bounded
size; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, schema_of, stored, text_slices

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 20
BLOCKS = 8
SLICE = 8 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BALL = [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), k)]


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-case words; all ASCII but letters and digits divides them."""
    return (text or b"").decode().lower().encode().translate(_PLAIN).split()


def shingles(words: list[bytes]) -> list[bytes]:
    """Five words each; fewer words make one shingle, none make none."""
    if len(words) < SHINGLE:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


class Items:
    """Items of a slice, by number: words, shingle counts, and the index of their fingerprints by length."""

    def __init__(self, texts: list[bytes], frequency: dict[bytes, int], total: int):
        self.total, self.frequency = total, frequency
        self.words = [plain_words(t) for t in texts]
        self.bags = [Counter(shingles(w)) for w in self.words]
        self.mass = [sum(c * self.weight(s) for s, c in b.items()) for b in self.bags]
        self.ids = {w: i for i, w in enumerate({w for ws in self.words for w in ws})}
        self.short = {}  # items below five words match as they are
        self.holders = defaultdict(list)
        for i, ws in enumerate(self.words):
            if 0 < len(ws) < SHINGLE:
                self.short.setdefault(tuple(ws), []).append(i)
            for s in self.bags[i] if len(ws) >= SHINGLE else ():
                self.holders[s].append(i)
        long = [self._key([self.ids[w] for w in ws]) for ws in self.words if len(ws) >= SHINGLE]
        self.keys = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        by_length = defaultdict(list)
        for i, ws in enumerate(self.words):
            if len(ws) >= SHINGLE:
                by_length[len(ws)].append(i)
        self.index = {n: self._build(members) for n, members in by_length.items()}

    def weight(self, shingle: bytes) -> float:
        """Rarer among the items weighs more; a shingle of no item weighs most."""
        return math.log1p(self.total / max(self.frequency.get(shingle, 1), 1))

    @staticmethod
    def _key(ids) -> np.ndarray:
        ids = np.asarray(ids, np.uint64)
        n = len(ids) - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            out = (out ^ (ids[k:k + n] + np.uint64(1))) * _MULTIPLY
            out ^= out >> np.uint64(29)
        return out

    def signs(self, grams: list[bytes]) -> np.ndarray:
        """For each shingle 64 numbers: its weight, negative where its hash has no bit."""
        hashes = np.array([xxhash.xxh64_intdigest(g, 1) for g in grams], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        weights = np.array([self.weight(g) for g in grams])
        return np.where(bits, weights[:, None], -weights[:, None])

    @staticmethod
    def fingerprint(sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()

    def _build(self, members: list[int]):
        prints = np.concatenate([self.fingerprint(self.signs(shingles(self.words[i])).sum(0)[None]) for i in members])
        tables = []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(8 * b)).astype(np.uint8)
            value = (block[:, None] ^ np.array(BALL, np.uint8)[None]).ravel()
            owner = np.repeat(np.arange(len(members), dtype=np.int32), len(BALL))
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << 8) + 1))
            tables.append((starts, owner[order]))
        return np.array(members), prints, tables

    def near(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, bits that differ) for every window within ``RADIUS`` of an item of ``length`` words."""
        members, own, tables = self.index[length]
        found = []
        for b, (starts, owner) in enumerate(tables):
            block = (prints >> np.uint64(8 * b)).astype(np.uint8).astype(np.int64)
            sizes = starts[block + 1] - starts[block]
            window = np.repeat(np.arange(len(prints)), sizes)
            at = np.repeat(starts[block] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            found.append(window * len(members) + owner[at])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(members), pairs % len(members)
        distance = np.bitwise_count(prints[window] ^ own[item])
        keep = distance <= RADIUS
        return window[keep], members[item[keep]], distance[keep]

    def similarity(self, bag: Counter, item: int) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        other = self.bags[item]
        both = sum(min(c, other[s]) * self.weight(s) for s, c in bag.items() if s in other)
        every = sum(c * self.weight(s) for s, c in bag.items()) + self.mass[item] - both
        return both / every if every else 0.0

    def matches(self, words: list[bytes]) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, bits) of the best window of each item that reaches ``SIMILAR``."""
        best: dict[int, tuple] = {}
        if self.short:
            sizes = {len(k) for k in self.short}
            for n in sizes:
                for at in range(len(words) - n + 1):
                    for i in self.short.get(tuple(words[at:at + n]), ()):
                        best.setdefault(i, (i, 1.0, at, n, 0))
        if len(words) < SHINGLE or not len(self.keys):
            return list(best.values())
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.convolve(ids >= 0, np.ones(SHINGLE, np.int64), "valid") == SHINGLE)
        if not len(known):
            return list(best.values())
        keys = self._key(np.where(ids < 0, 0, ids))[known]
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hits = known[self.keys[spot] == keys]
        shared = defaultdict(set)  # item length -> places of shared shingles
        for at in hits.tolist():
            for i in self.holders.get(b" ".join(words[at:at + SHINGLE]), ()):
                shared[len(self.words[i])].add(at)
        for n, places in shared.items():
            self._windows(words, n, np.array(sorted(places)), best)
        return list(best.values())

    def _windows(self, words, n, places, best):
        grams = n - SHINGLE + 1
        last = max(len(words) - n, 0)
        starts = np.unique(np.clip((places[:, None] - np.arange(grams)[None]).ravel(), 0, last))
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
            low, high = int(group[0]), int(min(group[-1] + n, len(words)))
            local = shingles(words[low:high])
            sums = np.r_[np.zeros((1, 64)), np.cumsum(self.signs(local), axis=0)]
            begin = group - low
            end = np.minimum(begin + grams, len(local))
            prints = self.fingerprint(sums[end] - sums[begin])
            window, item, bits = self.near(n, prints)
            bags: dict[int, Counter] = {}
            for w, i, d in zip(window.tolist(), item.tolist(), bits.tolist(), strict=True):
                if w not in bags:
                    bags[w] = Counter(local[begin[w]:end[w]])
                s = self.similarity(bags[w], i)
                row = (i, s, int(group[w]), min(n, len(words)), int(d))
                if s >= SIMILAR - 1e-12 and (i not in best or (-s, row[2]) < (-best[i][1], best[i][2])):
                    best[i] = row


def item_slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slice_bytes: int = SLICE):
    """(table of item ids and keys, slices): different item texts in slices of about ``slice_bytes``."""
    rows = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    named = stored(rows.select("item_id", F.md5(F.col("text").cast("binary")).alias("item_key"), "text"), "benchmark-items")
    unique = named.groupBy("item_key").agg(F.min("text").alias("text"))
    total = unique.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = unique.count()
    parts = max(1, -(-total // slice_bytes))
    frequency = stored(_frequencies(unique), "benchmark-shingles") if count else None

    def slices():
        for p in range(parts if count else 0):
            mine = unique.where(F.pmod(F.xxhash64("item_key"), F.lit(parts)) == p)
            rows = mine.orderBy("item_key").collect()
            own = frequency.where("n > 1").join(F.broadcast(_grams(mine).select("gram").distinct()), "gram").collect()
            yield [r["item_key"] for r in rows], Items([r["text"].encode() for r in rows], {bytes(r["gram"]): r["n"] for r in own}, count)
    return named.select("item_id", "item_key"), slices()


def _grams(items: DataFrame) -> DataFrame:
    def task(batches):
        for keys, texts in text_slices(batches):
            bags = [sorted(set(shingles(plain_words(t)))) for t in texts]
            who = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(who)), pa.array([s for b in bags for s in b], pa.binary())], names=["item_key", "gram"])
    return items.select("item_key", "text").mapInArrow(task, "item_key string, gram binary")


def _frequencies(items: DataFrame) -> DataFrame:
    """(gram, n): the number of different items that hold a shingle."""
    return _grams(items).groupBy("gram").agg(F.count("*").alias("n"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, bits: every row of ``docs`` with each item it contains.

    The best window of each item (ties: the first). Null or wordless texts and items match nothing;
    an item below five words matches where its words stand in a row; equal items are each reported,
    equal rows too. A text shorter than an item is one window.
    """
    rows = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    named, slices = item_slices(benchmark)
    schema = schema_of(docs, "item_key string, similarity double, first_word int, n_words int, bits int", id_col)
    parts = []
    for keys, items in slices:
        sent = spark.sparkContext.broadcast((keys, items))

        def task(batches, sent=sent):
            keys, items = sent.value
            for ids, texts in text_slices(batches):
                found = [(n, *m) for n, t in enumerate(texts) if t for m in items.matches(plain_words(t))]
                if found:
                    who, item, similar, first, size, bits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(who)), pa.array([keys[i] for i in item]), pa.array(similar, pa.float64()),
                         *[pa.array(x, pa.int32()) for x in (first, size, bits)]],
                        names=["doc_id", "item_key", "similarity", "first_word", "n_words", "bits"])

        parts.append(stored(rows.mapInArrow(task, schema), "leaks"))
        sent.unpersist()
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        found = found.union(more)
    return found.join(named, "item_key").select("doc_id", "item_id", "similarity", "first_word", "n_words", "bits")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are; searched in place, no shuffle."""
    at = docs.columns.index(text_col)
    spark = docs.sparkSession
    for _, items in item_slices(benchmark)[1]:
        sent = spark.sparkContext.broadcast(items)

        def task(batches, sent=sent):
            items = sent.value
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not (t and items.matches(plain_words(t))) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
