"""SimHash near-duplicates by pigeonhole blocks.

Two fingerprints that differ in at most three bits agree on at least three of six blocks, so
close pairs share one of the 20 keys made of three blocks. Fingerprints, not documents, are
joined; equal ones collapse first. Members of a key are compared in one task, which gives out a
spanning forest instead of pairs. A key with more than ``BUCKET`` members is keyed again: on the
32 or 33 bits it leaves open, five of eight groups must agree, so at most ``FINE`` different
fingerprints meet under such a key, however large the corpus.
"""

from __future__ import annotations

import hashlib
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, id_and_text, named, runs, schema_of, spare_names, stored, text_slices, words

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
FINE = 1 << 13
COUNT_ROWS = 1 << 16


def _spread(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal groups of the bit places ``bits``."""
    groups = np.array_split(np.array(bits), parts)
    return [sum(1 << int(b) for b in g) for g in groups]


def masks() -> tuple[list[int], list[list[int]]]:
    """The 20 first masks; for each, its 56 finer ones."""
    blocks = _spread(list(range(64)), 6)
    first = [sum(c) for c in combinations(blocks, 6 - RADIUS)]
    finer = []
    for m in first:
        nibbles = _spread([b for b in range(64) if not m >> b & 1], 8)
        finer.append([m + sum(c) for c in combinations(nibbles, 8 - RADIUS)])
    return first, finer


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fold(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``lengths`` hashes: the bits set in over half of them; 0 for none."""
    out = np.zeros(len(lengths), np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    sums: dict[int, np.ndarray] = {}
    for at in range(0, len(hashes), COUNT_ROWS):
        part, own = hashes[at:at + COUNT_ROWS], owner[at:at + COUNT_ROWS]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for k, s in zip(own[starts], np.add.reduceat(bits, starts, axis=0, dtype=np.int64), strict=True):
            sums[k] = sums[k] + s if k in sums else s
    for k, s in sums.items():
        out[k] = np.packbits(2 * s > lengths[k], bitorder="little").view("<u8")[0]
    return out


def shingle_hashes(tokens: list[bytes]) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(tokens) < SHINGLE:
        return [digest(b" ".join(tokens), SEED)] if tokens else []
    return [digest(b" ".join(s), SEED) for s in zip(tokens, tokens[1:], tokens[2:], strict=False)]


def _fingerprint_batches(batches):
    for ids, texts in text_slices(batches):
        hashed = [shingle_hashes(words(t)) for t in texts]
        lengths = np.array([len(h) for h in hashed], np.int64)
        flat = np.fromiter(chain.from_iterable(hashed), np.uint64, int(lengths.sum()))
        keys = [hashlib.md5(t or b"").digest() for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array(fold(flat, lengths).view(np.int64)), pa.array(keys, pa.binary())], names=["doc_id", "fp", "key"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long), key (md5 of the text). A text without words, or null, has fingerprint zero."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprint_batches, schema_of(docs, "fp long, key binary", id_col))


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs among sorted fingerprints: each but a tree's first, and one before it."""
    open_, src, dst = np.arange(len(members)), [], []
    while len(open_):
        tree = open_[:1]
        open_ = open_[1:]
        while len(tree) and len(open_):
            near = np.zeros(len(open_), bool)
            by = np.zeros(len(open_), np.int64)
            for t in tree:
                hit = ~near & (np.bitwise_count(members[open_] ^ members[t]) <= RADIUS)
                near |= hit
                by[hit] = t
            src.append(members[open_[near]])
            dst.append(members[by[near]])
            tree, open_ = open_[near], open_[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


def _link(finer: list[list[int]] | None, bucket: int):
    """Task over rows sorted by (mask, value, fp): forest edges; members of a large key under their finer keys."""
    def task(batches):
        out: list[list] = [[], [], [], []]

        def flush():
            kinds = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in out],
                names=["mask", "value", "a", "b"])
            for x in out:
                x.clear()
            return kinds

        size, large = 0, False
        for key, cols, first, last in runs(batches, 2, bucket):
            if not cols:
                continue
            fps = cols[0].view(np.uint64)
            large = not (first and last)
            if large and finer is None:
                raise ValueError("more members than a fine key can have")
            if not large:
                if len(fps) < 2:
                    continue
                a, b = _forest(fps)
                out[0].append(np.full(len(a), -1, np.int32))
                out[1].append(np.zeros(len(a), np.int64))
                out[2].append(a.view(np.int64))
                out[3].append(b.view(np.int64))
                size += len(a)
            else:
                for k, m in enumerate(finer[key[0]]):
                    out[0].append(np.full(len(fps), key[0] * 100 + k, np.int32))
                    out[1].append((fps & np.uint64(m)).view(np.int64))
                    out[2].append(fps.view(np.int64))
                    out[3].append(np.zeros(len(fps), np.int64))
                size += len(fps) * len(finer[key[0]])
            if size > 100_000:
                yield flush()
                size = 0
        if size:
            yield flush()
    return task


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a spanning set of the links among different fingerprints ``fp``."""
    first, finer = masks()
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(first)])
    keyed = fps.select("fp", F.inline(keys)).select("mask", "value", "fp")
    schema = "mask int, value long, a long, b long"

    def grouped(df, finer_masks, most):
        return df.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_link(finer_masks, most), schema)

    found = stored(grouped(keyed, finer, bucket), "simhash-links")
    again = found.where("mask >= 0").select("mask", "value", F.col("a").alias("fp"))
    return found.where("mask < 0").select("a", "b").union(grouped(again, None, FINE).select("a", "b"))


def _components(rows: DataFrame, pick) -> DataFrame:
    """(fp, picked): the aggregate ``pick`` over all rows of the component of each different fingerprint."""
    unique = stored(rows.groupBy("fp").agg(pick.alias("least")), "fingerprint-ids")
    roots = components(links(unique.select("fp")))
    rooted = unique.join(roots, unique.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("picked"))
    return stored(rooted.join(least, "root").select("fp", "picked"), "fingerprint-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most three bits; a component
    without any id has null. Rows of equal id or text each get their row; no rows give none.
    """
    rows = stored(fingerprints(docs, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    least = _components(rows, F.min("doc_id"))
    return rows.join(least, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("picked").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: the one of smallest id (null ids last), then of smallest text hash.

    Of rows equal in both, the one whose other columns have the smallest hash stays, so the choice is
    the same on every run. A null text counts as empty; no rows give none.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    picked = _components(rows, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")))
    stay_id, stay_key, own, mark, row = spare_names(docs, "_id", "_key", "_own", "_mark", "_row")
    stay = stored(picked.select("picked.*").distinct().select(F.col("doc_id").alias(stay_id), F.col("key").alias(stay_key)), "simhash-stay")
    whole = [named(c) for c in docs.columns]
    others = [named(c) for c in docs.columns if c not in (id_col, text_col)]
    mine = docs.withColumns({
        own: F.unhex(F.md5(F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary"))),
        mark: F.md5(F.to_json(F.struct(F.lit(1), *others), {"ignoreNullFields": "false"}).cast("binary"))})
    kept = mine.join(stay, (F.col(own) == F.col(stay_key)) & named(id_col).eqNullSafe(F.col(stay_id)))
    one = kept.groupBy(stay_key, stay_id).agg(F.min_by(F.struct(*whole), F.col(mark)).alias(row))
    return one.select(*[F.col(row)[c].alias(c) for c in docs.columns])
