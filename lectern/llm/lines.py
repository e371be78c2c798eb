"""Line deduplication by a segment-partition edit join.

A line of at least ``MIN_CHARS`` code points is cut into ``edits + 1`` segments. If two lines are
within ``edits`` edits, one segment of the shorter stands unchanged in the longer, at a place that
its length and the number of the segment narrow down. So each line is entered under (length,
segment number, segment) and looks its substrings up for every length it can match; both become
rows of one shuffled key. Keys with few lines give candidate pairs; the lines of a key with many
are verified in tiles of bounded size, so no task and no row list grows with the square of a
group. Candidates are verified by bit-parallel edit distance in a band of ``2 * edits + 1`` bits.

Lines travel as 64-bit hashes. Their text is only fetched for candidates, which a bitmap of fixed
size, sent to the tasks, tells apart from nearly all other lines. Equal lines of any size are
counted by their hash; only blank lines are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, id_and_text, named, schema_of, spare_names, stored, text_slices

EDITS = 2
MIN_CHARS = 24
FEW = 32
TILE = 256
BITMAP_WORDS = 1 << 20
SEEN = 500_000
COPY_SHARE = 0.5

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Substrings:
    """Hashes of substrings of many texts laid end to end, by running sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up = np.cumprod(np.full(n + 1, _STEP)) * _BACK
        self.down = np.cumprod(np.full(n + 1, _BACK)) * _STEP
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def segments(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``number``: equal sizes, the last ones longer by one."""
    size, longer = np.divmod(length, edits + 1)
    first = edits + 1 - longer
    return size * number + np.maximum(number - first, 0), size + (number >= first)


def places(edits: int):
    """(difference in length, segment, shift of its start) that a longer line has to look up."""
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(low, high + 1):
                yield less, i, shift


def _keys(codes: np.ndarray, lengths: np.ndarray, edits: int):
    """(line, key, only looked up) of all lines, whose code points lie end to end."""
    at = np.cumsum(lengths) - lengths
    part = _Substrings(codes)
    for less, i, shift in places(edits):
        other = lengths - less
        start, size = segments(other, i, edits)
        start = start + shift
        fine = np.flatnonzero((other >= MIN_CHARS) & (start >= 0) & (start + size <= lengths))
        hashed = part(at[fine] + start[fine], size[fine])
        yield fine, _mix(hashed + other[fine].astype(np.uint64) * _STEP + np.uint64(i + 1)), bool(less or shift)


def line_hash(line: bytes) -> int:
    """63 bits and a low bit that is free."""
    return xxhash.xxh3_64_intdigest(line) & ~1


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32), np.array([len(x) for x in lines], np.int64)


def _key_rows(edits: int):
    def task(batches):
        seen: set[int] = set()
        for _, texts in text_slices(batches, 1 << 20):
            lines, names = [], []
            for t in texts:
                for line in (t or b"").split(b"\n"):
                    if len(line) >= MIN_CHARS and (h := line_hash(line)) not in seen:
                        seen.add(h)
                        if len(text := line.decode()) >= MIN_CHARS:
                            lines.append(text)
                            names.append(h)
            if len(seen) > SEEN:
                seen.clear()
            if lines:
                codes, lengths = _codes(lines)
                named = np.array(names, np.uint64)
                found = [(key, named[own] | np.uint64(only)) for own, key, only in _keys(codes, lengths, edits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], names=["key", "ref"])
    return task


def _meet(batches):
    """Rows sorted by (key, ref): candidate pairs (a, b) of keys with few lines; (key, ref) of those with many."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    long_key = None

    def groups(key, ref):
        """Pairs and long rows of whole runs."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        out = []
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            refs = np.unique(ref[s:s + n])
            entered, lines = refs[refs & 1 == 0], np.unique(refs & ~1)
            if len(lines) < 2 or not len(entered):
                continue
            if len(lines) > FEW:
                out.append((np.full(len(refs), key[s]), refs, np.zeros(len(refs), np.int8)))
                continue
            a, b = np.repeat(entered, len(lines)), np.tile(lines, len(entered))
            keep = a != b
            a, b = a[keep], b[keep]
            out.append((np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int8)))
        return out

    def rows(out):
        a, b, pair = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(pair)], names=["a", "b", "pair"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, ref = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        out = []
        if long_key is not None:  # a run that was given out in part goes on
            n = len(key) if key[-1] == long_key else int(np.argmax(key != long_key))
            if n:
                out.append((key[:n], ref[:n], np.zeros(n, np.int8)))
                key, ref = key[n:], ref[n:]
            if len(key):
                long_key = None
        key, ref = np.concatenate([held[0], key]), np.concatenate([held[1], ref])
        held = [key[:0], ref[:0]]
        if len(key):
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > 4096:
                n = len(key) - last
                out.append((key[last:], ref[last:], np.zeros(n, np.int8)))
                long_key = key[-1]
            else:
                held = [key[last:], ref[last:]]
            out += groups(key[:last], ref[:last]) if last else []
        if out:
            yield rows(out)
    if len(held[0]) and (out := groups(*held)):
        yield rows(out)


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """For each pair its edit distance, or ``edits + 1`` if it is larger: bit-parallel, all pairs at once.

    A word holds the vertical differences of the rows within ``edits`` of the diagonal, highest bit
    lowest row; the distance is followed down the outer diagonal and then along the last row.
    """
    swap = [len(x) > len(y) for x, y in zip(a, b, strict=True)]
    a, b = [y if s else x for x, y, s in zip(a, b, swap, strict=True)], [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    (ca, m), (cb, n) = _codes(a), _codes(b)
    at_a, at_b = np.cumsum(m) - m, np.cumsum(n) - n
    out = np.full(len(a), edits + 1)
    alive = np.flatnonzero((n - m <= edits) & (m > edits))
    plain = np.flatnonzero((n - m <= edits) & (m <= edits))
    for p in plain:
        out[p] = min(_small(a[p], b[p]), edits + 1)
    if not len(alive):
        return out
    one, top = np.uint64(1), np.uint64(63)
    vp = np.full(len(alive), (~0 << (63 - edits)) & (2 ** 64 - 1), np.uint64)
    vn = np.zeros(len(alive), np.uint64)
    score = np.full(len(alive), edits)
    for i in range(int(n[alive].max())):
        done = n[alive] <= i
        if done.any():
            out[alive[done]] = np.minimum(score[done], edits + 1)
            keep = ~done
            alive, vp, vn, score = alive[keep], vp[keep], vn[keep], score[keep]
            if not len(alive):
                break
        c, ma = cb[at_b[alive] + i], m[alive]
        match = np.zeros(len(alive), np.uint64)
        for t in range(2 * edits + 1):
            row = i + edits - t
            if row < 0:
                break
            fits = row < ma
            same = fits & (ca[at_a[alive] + np.minimum(row, ma - 1)] == c)
            match |= same.astype(np.uint64) << np.uint64(63 - t)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        down = i < ma - edits
        last_row = np.where(down, 0, i - (ma - edits) + 1).astype(np.uint64)
        bit = one << (top - np.minimum(last_row, top))
        score = score + np.where(down, (d0 >> top) == 0, ((hp & bit) != 0).astype(np.int64) - ((hn & bit) != 0))
        shifted = d0 >> one
        vp, vn = hn | ~(shifted | hp), shifted & hp
        if i % 16 == 15:  # the diagonal never comes down again by more than the band
            keep = score <= 2 * edits + (n - m)[alive]
            alive, vp, vn, score = alive[keep], vp[keep], vn[keep], score[keep]
            if not len(alive):
                break
    if len(alive):
        out[alive] = np.minimum(score, edits + 1)
    return out


def _small(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _verify(edits: int):
    """(a, b) of candidate rows (a, b, text of a, text of b) within ``edits``."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                keep = pa.array(within(a, b, edits) <= edits)
                yield batch.select([0, 1]).filter(keep)
    return task


def _verify_tiles(edits: int):
    """(a, b) within ``edits`` of rows sorted by (key, x, y), each a line (ref, text) of tile x or y."""
    def task(batches):
        held, name = [], None

        def close():
            x, y = name[1], name[2]
            left = [r for r in held if r[0] == x]
            right = [r for r in held if r[0] == y]
            pairs = [(p, q) for i, p in enumerate(left) for q in (right[i + 1:] if x == y else right)
                     if p[1] & q[1] & 1 == 0 and p[1] >> 1 != q[1] >> 1 and abs(len(p[2]) - len(q[2])) <= edits]
            for at in range(0, len(pairs), 20_000):
                part = pairs[at:at + 20_000]
                ok = within([p[2] for p, _ in part], [q[2] for _, q in part], edits) <= edits
                near = [sorted((p[1] & ~1, q[1] & ~1)) for (p, q), k in zip(part, ok, strict=True) if k]
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array([n[k] for n in near], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, x, y, tile, ref, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, x, y) != name:
                    if held:
                        yield from close()
                    held, name = [], (key, x, y)
                held.append((tile, ref, text))
        if held:
            yield from close()
    return task


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the lines named in ``wanted``; a bitmap of bounded size keeps most others from the shuffle."""
    slot = F.pmod(F.shiftright("line", 1), F.lit(BITMAP_WORDS * 64))
    marks = wanted.select(F.floor(slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    bitmap = np.zeros(BITMAP_WORDS, np.uint64)
    got = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITMAP_WORDS rows
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches):
        bits, seen = sent.value, set()
        for _, texts in text_slices(batches):
            names, lines = [], []
            for t in texts:
                for line in (t or b"").split(b"\n"):
                    if len(line) >= MIN_CHARS:
                        h = line_hash(line)
                        signed = h - (1 << 64) if h >> 63 else h
                        at = (signed >> 1) % (BITMAP_WORDS * 64)
                        if int(bits[at >> 6]) >> (at & 63) & 1 and h not in seen:
                            seen.add(h)
                            names.append(h)
                            lines.append(line)
            if len(seen) > SEEN:
                seen.clear()
            if names:
                yield pa.RecordBatch.from_arrays([_signed(names), pa.array(lines, pa.binary()).cast(pa.string())], names=["line", "text"])

    found = rows.mapInArrow(task, "line long, text string")
    return stored(found.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text")), "line-texts")


def links(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): every pair of different lines of ``MIN_CHARS`` or more code points within ``edits`` edits, a < b."""
    rows = id_and_text(docs, id_col, text_col)
    keyed = rows.mapInArrow(_key_rows(edits), "key long, ref long")
    met = stored(keyed.repartition("key").sortWithinPartitions("key", "ref").mapInArrow(_meet, "a long, b long, pair byte"), "line-keys")
    pairs = stored(met.where("pair = 1").select("a", "b").distinct(), "line-pairs")
    crowd = met.where("pair = 0").select(F.col("a").alias("key"), F.col("b").alias("ref")).distinct()
    sizes = crowd.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowd = stored(crowd.join(sizes, "key"), "line-crowds")
    name = F.col("ref").bitwiseAND(F.lit(-2)).alias("line")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).union(crowd.select(name)).distinct()
    texts = _texts(rows, stored(wanted, "line-names"))

    left, right = texts.select(F.col("line").alias("a"), F.col("text").alias("s")), texts.select(F.col("line").alias("b"), F.col("text").alias("t"))
    few = pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(_verify(edits), "a long, b long")

    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("ref"), F.col("tiles")).cast("int")
    spread = crowd.withColumn("tiles", tiles).withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("key", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "ref", name)
    crowded = (spread.join(texts, "line").select("key", "x", "y", "tile", "ref", "text").repartition("key", "x", "y")
               .sortWithinPartitions("key", "x", "y", "ref").mapInArrow(_verify_tiles(edits), "a long, b long"))
    return stored(few.union(crowded).distinct(), "line-links")


def _occurrences(alike: bool):
    """(doc_id, key, n, at, line, size): a row for each text (at -1, size all its code points), and for each of its lines that is not blank."""
    def task(batches):
        for ids, texts in text_slices(batches):
            names = ids.to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for who, (i, t) in enumerate(zip(names, texts, strict=True)):
                t = t or b""
                key = hashlib.md5(t if alike else b"%s\0%s" % (b"-" if i is None else str(i).encode(), t)).digest()
                lines = t.split(b"\n")
                found = [(n, line_hash(x), len(y)) for n, x in enumerate(lines) if x and (y := x.decode()).strip()]
                for n, h, size in [(-1, 0, len(t.decode())), *found]:
                    for column, value in zip(out, (who, key, len(lines), n, h, size), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()),
                 _signed(out[4]), pa.array(out[5], pa.int64())], names=["doc_id", "key", "n", "at", "line", "size"])
    return task


def _placed(docs: DataFrame, edits: int, id_col: str, text_col: str, alike: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_lines, chars) of every row, and for each document that has any: its repeated lines, the later ones, code points shared."""
    rows = id_and_text(docs, id_col, text_col)
    near = links(docs, edits, id_col, text_col)
    roots = components(near)
    degree = near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = degree.join(roots, "node", "left").select(F.col("node").alias("line"), F.coalesce("root", "node").alias("root"), "links")
    known = stored(known, "line-classes")
    every = stored(rows.mapInArrow(_occurrences(alike), schema_of(docs, "key binary, n int, at int, line long, size long", id_col)), "line-places")
    base = every.where("at < 0").select("doc_id", "key", F.col("n").alias("n_lines"), F.col("size").alias("chars"))

    place = F.struct("doc_id", "key", "at")
    counted = every.where("at >= 0").groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    counted = counted.join(known, "line", "left").where("n > 1 OR root IS NOT NULL")
    counted = stored(counted.select("line", F.coalesce("root", "line").alias("class"), "first", F.coalesce("links", F.lit(0)).alias("links")), "line-counts")
    first = counted.groupBy("class").agg(F.min("first").alias("first"))
    classes = stored(counted.drop("first").join(first, "class"), "line-firsts")
    placed = every.where("at >= 0").join(classes, "line").select("doc_id", "key", "at", "size", "class", "first", "links").dropDuplicates(["key", "at"])
    placed = stored(placed, "line-repeats")
    texts = placed.groupBy("class", "key").agg(F.count("*").alias("here")).groupBy("class").agg(F.count("*").alias("documents"), F.sum("here").alias("places"))
    placed = placed.join(stored(texts, "line-spread"), "class").where("places > 1")
    later = ~((F.col("first.key") == F.col("key")) & (F.col("first.at") == F.col("at")))
    row = F.struct("at", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"), F.col("links"))
    told = placed.groupBy("key").agg(
        F.sort_array(F.collect_list(row)).alias("repeated"), F.sort_array(F.collect_list(F.when(later, F.col("at")))).alias("later"),
        F.sum(F.when(F.col("documents") > 1, F.col("size")).otherwise(0)).alias("shared"))
    return base, told


def repeats(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", copies: str = "whole") -> DataFrame:
    """doc_id, key, n_lines, copy, repeated, removed: one row per row of ``docs``.

    Lines are near if within ``edits`` edits; a class is what is reachable over near lines. ``repeated``
    has for each line whose class occurs more than once: its number ``at`` (from 0), the id and line
    number of the class's first occurrence (by id, then text, then line), and ``links``, the number
    of different lines near it. ``removed`` are the numbers of the lines that go: those with an
    earlier occurrence. A document more than ``COPY_SHARE`` of whose code points stand in lines of
    classes that other documents have is a ``copy``. ``copies`` says what becomes of copies: "cut"
    takes every line with an earlier occurrence from them too; "alike" does so as well, but rows of
    equal text are one document, whatever their ids, so that equal texts lose the same lines and stay
    equal; "whole" takes nothing from a ``copy``. Null texts have one empty line. Rows equal in id and
    text count as one document and get equal rows. Lines below ``MIN_CHARS`` code points are near
    no other line, but repeat if equal; blank lines never repeat.
    """
    base, told = _placed(docs, edits, id_col, text_col, copies == "alike")
    copy = F.coalesce(F.col("shared") > COPY_SHARE * F.col("chars"), F.lit(False))
    none = F.array().cast("array<int>")
    later = F.coalesce("later", none)
    return base.join(told, "key", "left").select(
        "doc_id", "key", "n_lines", copy.alias("copy"), "repeated", (F.when(copy, none).otherwise(later) if copies == "whole" else later).alias("removed"))


def clean(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", copies: str = "whole") -> DataFrame:
    """``docs`` without the lines that ``repeats`` removes; all rows and columns stay, only texts get shorter.

    Null texts stay null, null ids and equal rows are treated as in ``repeats``; no rows give none. A
    text whose lines all go is empty.
    """
    text, alike = F.coalesce(docs[text_col], F.lit("")), copies == "alike"
    if copies == "whole":
        gone = repeats(docs, edits, id_col, text_col).select("key", F.col("removed").alias("later")).dropDuplicates(["key"])
    else:
        _, gone = _placed(docs, edits, id_col, text_col, alike)
    row, lines = spare_names(docs, "_row", "_gone")
    gone = gone.where(F.size("later") > 0).select(F.col("key").alias(row), F.col("later").alias(lines))
    name = text if alike else F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.lit("\0"), text)
    kept = F.array_join(F.filter(F.split(named(text_col), "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n")
    joined = docs.withColumn(row, F.unhex(F.md5(name.cast("binary")))).join(stored(gone, "line-removals"), row, "left")
    shorter = F.when(F.col(lines).isNull(), named(text_col)).otherwise(kept)
    return joined.select(*[shorter.alias(c) if c == text_col else named(c) for c in docs.columns])
