"""Near-duplicate checks on 0/1 word vectors, exact at any threshold.

Two sets with cosine above t must overlap so much that their rarest few features meet (prefix
filtering, Chaudhuri 2006, Bayardo 2007). So candidates meet on an equality join over a short prefix
of rare features, not by comparing all with all. What travels is one small row per prefix feature:
id, feature, size, place in the order, and a 128-bit signature. Three bounds leave few candidates:

* size: the smaller set must be large enough for the larger one;
* place: at the first feature two sets share, all further ones stand behind it in both;
* signature: each bit is the parity of the features hashed to it, so bits that differ are features
  that only one set has, whatever the size of the sets.

Vectors are fetched for the pairs left, and only there. A feature that many prefixes hold is split:
such rows meet on pairs of features, as sets that overlap in two features share two in a prefix
longer by one.

Where all rows of a table are compared among themselves (:func:`greedy_keep`), what is written to disk
is kept to a few times the sets: they are stored once, a prefix row is a key, an id and two numbers,
sets must share several features of their prefixes, and a sketch of 1,024 parities is compared before vectors are.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.session import brief_shuffles, cut_by, cut_lineage, remove_folder, stored

HEADS = 8
HOT = 2_000
CROWDED = 20_000
MATCHES = 3
SKETCH = 1_024
SLOTS = 1 << 20
FEW_IDS = 1_000_000
FEW_PAIRS = 10_000


def _above(dot: Column, a: Column, b: Column, t: Fraction) -> Column:
    """dot / sqrt(a·b) > t in whole numbers."""
    left = dot.cast("bigint") * dot * (t.denominator**2)
    return left > a.cast("bigint") * b * (t.numerator**2)


def feature_counts(items: DataFrame) -> np.ndarray:
    """How many items have a feature of each of ``SLOTS`` classes of features, by the low bits of their hash. The table has one
    size whatever the vocabulary; that rare features share a slot costs candidates, never results."""
    slot = F.col("feature").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    got = items.select(F.explode("vector").alias("feature")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()  # at most SLOTS rows
    counts = np.zeros(SLOTS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def prefixes(items: DataFrame, counts: np.ndarray, t: Fraction, hot: int = HOT, least: int = 0) -> DataFrame:
    """``items(id, vector)`` to one row per key: ``(id, feature, second, size, pos, small, sig0, sig1)``. Narrow.

    Features are ordered by their slot's count, then hash; any order that is the same for all items will do, and rare
    features first leaves the fewest candidates. ``small`` marks the features that suffice when the item is the
    smaller of a pair. Features of slots below ``least`` have no partner: they take up their place in the prefix, but no
    row is made for them. A feature whose slot counts over ``hot`` items is keyed with each later one of the prefix and one more; sets so
    small that an overlap of one may do for a partner are keyed by the feature alone too (``second`` NULL).
    """
    shared = items.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([items.schema["id"], *T.StructType.fromDDL(_KEYS).fields])

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _prefix_rows(batch, shared.value, t, hot, least)

    return items.where(F.size("vector") > 0).select("id", "vector").mapInArrow(task, schema)


_KEYS = "feature BIGINT, second BIGINT, size INT, pos INT, small BOOLEAN, sig0 BIGINT, sig1 BIGINT"


def _prefix_rows(batch: pa.RecordBatch, counts: np.ndarray, t: Fraction, hot: int, least: int):
    sets = batch.column(1)
    flat = sets.flatten().to_numpy(zero_copy_only=False)
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    n = counts[flat & (SLOTS - 1)]
    order = np.lexsort((flat, n, owner))
    flat, n = flat[order], n[order]
    pos = np.arange(len(flat)) - starts[owner]

    # The least overlap with the smallest partner, and with one of equal size, in whole numbers.
    kinds, kind = np.unique(size, return_inverse=True)
    low, high = (np.array([int(k * r) + 1 for k in kinds.tolist()])[kind] for r in (t * t, t))
    as_large, as_small = size - low + 1, size - high + 1
    keep = (pos < as_large[owner]) & (n >= least)
    paired = keep & (n > hot) & (low >= 2)[owner]
    alone = keep & (~paired | (size <= float(1 / t) ** 4 + 1e-6)[owner])

    bit = np.uint64(1) << (flat & 63).astype(np.uint64)
    first_half = (flat >> 6) & 1 == 0
    signatures = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts).view(np.int64) for half in (first_half, ~first_half)]

    at, second = [np.flatnonzero(alone)], [np.zeros(int(alone.sum()), np.int64)]
    for i in np.flatnonzero(paired).tolist():
        later = flat[i + 1:min(starts[owner[i]] + as_large[owner[i]] + 1, starts[owner[i]] + size[owner[i]])]
        at.append(np.full(len(later), i))
        second.append(later)
    none = np.arange(sum(map(len, at))) < len(at[0])
    at, second = np.concatenate(at), np.concatenate(second)
    own = owner[at]
    columns = [
        batch.column(0).take(pa.array(own)), pa.array(flat[at]), pa.array(second, pa.int64(), mask=none), pa.array(size[own].astype(np.int32)),
        pa.array(pos[at].astype(np.int32)), pa.array(pos[at] < as_small[own]), *(pa.array(s[own]) for s in signatures)]
    rows = pa.RecordBatch.from_arrays(columns, names=["id", *(c.split()[0] for c in _KEYS.split(", "))])
    for k in range(0, rows.num_rows, 100_000):
        yield rows.slice(k, 100_000)


def _may_meet(a: str, b: str, t: Fraction) -> Column:
    """Join condition of two prefix rows: the same key, and no bound that rules the pair out."""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    key = (F.col(f"{a}.feature") == F.col(f"{b}.feature")) & F.col(f"{a}.second").eqNullSafe(F.col(f"{b}.second"))
    roles = ((sa <= sb) & F.col(f"{a}.small")) | ((sb <= sa) & F.col(f"{b}.small")) | F.col(f"{a}.second").isNotNull()
    placed = F.least(sa - F.col(f"{a}.pos"), sb - F.col(f"{b}.pos"))
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("sig0", "sig1")), F.lit(0))
    signed = F.floor((sa + sb - apart) / 2)
    return key & roles & _above(F.least(sa, sb, placed, signed.cast("int")), sa, sb, t)


def _candidates(a: DataFrame, b: DataFrame, t: Fraction, earlier: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of prefix rows that no bound rules out; with ``earlier`` only pairs in which b has the smaller id."""
    on = _may_meet("a", "b", t)
    if earlier:
        on = (F.col("b.id") < F.col("a.id")) & on
    return a.alias("a").join(b.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, t: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` that are near, by the vectors of both sides, which are fetched for these alone."""
    ours = left.select(F.col("id").alias("a"), F.col("vector").alias("x"))
    theirs = right.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    overlap = F.size(F.array_intersect("x", "y"))
    met = pairs.join(ours, "a").join(theirs, "b")
    return met.where(_above(overlap, F.size("x"), F.size("y"), t)).select("a", "b")


def _heads(prefix: DataFrame) -> DataFrame:
    """The earliest few rows of each key; each task keeps no more before the shuffle."""
    place = F.row_number().over(Window.partitionBy("feature", "second").orderBy("id"))
    return prefix.withColumn("place", place).where(F.col("place") <= HEADS).drop("place")


def near_existing(items: DataFrame, existing: DataFrame, threshold: float = 0.92, hot: int = HOT) -> DataFrame:
    """Ids of ``items(id, vector)`` that have a row of ``existing(vector)`` above the threshold.

    Existing rows are told apart by their vectors alone, so rows of several sources may share ids.
    Items are first held against the first few rows of each key, which settles nearly all items of
    a large group of near copies; only the others meet all rows."""
    t = Fraction(str(threshold))
    items = items.where(F.size("vector") > 0).select("id", "vector")
    existing = existing.where(F.size("vector") > 0).select("vector").distinct()
    existing = cut_lineage(existing.withColumn("id", F.monotonically_increasing_id()))
    counts = feature_counts(existing)
    left = cut_lineage(prefixes(items, counts, t, hot, least=1))
    right = cut_lineage(prefixes(existing, counts, t, hot, least=1))
    near = lambda a, b: _verified(_candidates(a, b, t), items, existing, t).select(F.col("a").alias("id")).distinct()
    soon = cut_lineage(near(left, _heads(right)))
    return soon.union(near(left.join(soon, "id", "left_anti"), right))


def among(rows: DataFrame, ids: DataFrame, how: str, on: list[str] | str = "id", most: int | None = None) -> DataFrame:
    """``rows`` with an id among ``ids`` (``left_semi``) or without one (``left_anti``). A bounded number of ids is broadcast, so that
    the rows stay where they lie; ``most``, if known, is a number that the ids do not exceed."""
    few = (ids.count() if most is None else most) <= FEW_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, how)


def greedy_rounds(undecided: DataFrame, near_earlier) -> list[DataFrame]:
    """The ids dropped in each round of first-come suppression over rows ``(id, …)``, until none is undecided.

    ``near_earlier(a, b)`` gives pairs ``(a, b)``, at least one for every row of ``a`` that an earlier row of
    ``b`` is near to. Rows without an undecided earlier neighbour stay, and the rows near them go:
    first those whose known neighbour stays, then those that have another one there.
    """
    dropped = []
    while not undecided.isEmpty():
        pairs = cut_lineage(near_earlier(undecided, undecided))
        held = cut_lineage(pairs.select(F.col("a").alias("id")).distinct())
        n = held.count()
        if not n:
            break
        gone = cut_lineage(pairs.join(held.withColumnRenamed("id", "b"), "b", "left_anti").select(F.col("a").alias("id")).distinct())
        dropped.append(gone)
        still = cut_lineage(held.join(gone, "id", "left_anti"))
        if still.isEmpty():
            break
        rest = cut_lineage(among(undecided, still, "left_semi", most=n))
        stays = among(undecided, held, "left_anti", most=n)
        gone = cut_lineage(near_earlier(rest, stays).select(F.col("a").alias("id")).distinct())
        dropped.append(gone)
        undecided = cut_lineage(among(rest, gone, "left_anti", most=n))
    return dropped


def decided(ids: DataFrame, firsts: DataFrame, dropped: list[DataFrame]) -> DataFrame:
    """``(id, kept)`` of ``ids``: kept if among ``firsts`` and never dropped."""
    stayed = firsts.select("id")
    for gone in dropped:
        stayed = stayed.join(gone, "id", "left_anti")
    stayed = stayed.withColumn("stayed", F.lit(True))
    return ids.select("id").join(stayed, "id", "left").select("id", F.coalesce("stayed", F.lit(False)).alias("kept"))


def greedy_keep(items: DataFrame, threshold: float = 0.92, hot: int = CROWDED) -> DataFrame:
    """First-come duplicate suppression over ``items(id, vector)``: an item stays unless an
    earlier item that stayed is above the threshold. Returns ``(id, kept)``.

    Equal vectors collapse first, by two hashes and their size, so a group of copies costs one row. A row is first tested
    against the earliest few rows of each of its keys, which settles nearly all rows of a large group of
    near copies, so the pairs of a group are never listed. A feature of more than ``hot`` items is keyed in pairs: that
    spares comparisons, but a long prefix then makes rows with the square of its length.
    """
    t = Fraction(str(threshold))
    spark = items.sparkSession
    with brief_shuffles(spark):
        path, given = stored(items.select("id", "vector"), "sets")
        print_of = F.xxhash64("vector")
        sizes = cut_lineage(given.select("id", F.size("vector").alias("size"), print_of.alias("print"), F.xxhash64(F.lit(1), F.col("vector")).alias("check")))
        sets = sizes.where("size > 0")
        groups = cut_lineage(sets.groupBy("size", "print", "check").agg(F.min("id").alias("id"), F.count("*").alias("n")))
        known = groups.where("n > 1").withColumnRenamed("id", "first")
        copies = cut_lineage(sets.join(known, ["size", "print", "check"]).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "print"))
        more = copies.count()
        first = among(given.where(F.size("vector") > 0).withColumn("print", print_of), copies, "left_anti", ["id", "print"], more).select("id", "vector")
        if more > FEW_IDS:  # what is read often has no copies then
            whole = path
            path, first = stored(first, "sets")
            remove_folder(spark, whole)
        undecided = cut_by(_keyed(first, feature_counts(first), t, hot), "key")
        sketches = cut_by(_sketches(first), "id")

        def near_earlier(a, b):
            soon, n = _checked(_sharing(a, _earliest(b), t), sketches, first, t)
            others = among(a, soon.select(F.col("a").alias("id")).distinct(), "left_anti", most=n) if n else a
            return soon.union(_checked(_sharing(others, b, t), sketches, first, t)[0])

        dropped = greedy_rounds(undecided, near_earlier)
        remove_folder(spark, path)
    blank = sizes.where("size = 0").select("id", F.lit(True).alias("kept"))
    return decided(sets, groups, dropped).unionByName(blank)


def _keyed(items: DataFrame, counts: np.ndarray, t: Fraction, hot: int) -> DataFrame:
    """``items(id, vector)`` to one row per key, ``(key, id, size, pos)``, from a prefix longer by ``MATCHES - 1``. Narrow.

    The order, features without a partner and features that are split are those of :func:`prefixes`; a key is a feature, or a
    hash of two, for which ``pos`` is -1. That unlike features share a key costs candidates, never results."""
    shared = items.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([T.StructField("key", T.LongType()), items.schema["id"], *T.StructType.fromDDL("size INT, pos INT").fields])

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _keys(batch, shared.value, t, hot)

    return items.mapInArrow(task, schema)


def _keys(batch: pa.RecordBatch, counts: np.ndarray, t: Fraction, hot: int):
    flat, size, owner, starts = _flat(batch.column(1))
    n = counts[flat & (SLOTS - 1)]
    order = np.lexsort((flat, n, owner))
    flat, n = flat[order], n[order]
    pos = np.arange(len(flat)) - starts[owner]
    low = _least_overlap(size, t)
    ends = np.minimum(size - low + MATCHES, size)
    keep = (pos < ends[owner]) & (n >= 2)
    paired = keep & (n > hot) & (low >= 2)[owner]
    alone = np.flatnonzero(keep & (~paired | (size <= float(1 / t) ** 4 + 1e-6)[owner]))
    at = np.flatnonzero(paired)
    fan = (starts + ends)[owner[at]] - at - 1  # the features behind it in the prefix
    left = np.repeat(at, fan)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan)
    mixed = flat.view(np.uint64)[left] * np.uint64(0x9E3779B97F4A7C15) + flat.view(np.uint64)[right] * np.uint64(0xC2B2AE3D27D4EB4F)
    own = owner[np.concatenate([alone, left])]
    columns = [
        pa.array(np.concatenate([flat[alone], mixed.view(np.int64)])), batch.column(0).take(pa.array(own)), pa.array(size[own].astype(np.int32)),
        pa.array(np.concatenate([pos[alone], np.full(len(left), -1)]).astype(np.int32))]
    rows = pa.RecordBatch.from_arrays(columns, names=["key", "id", "size", "pos"])
    for k in range(0, rows.num_rows, 100_000):
        yield rows.slice(k, 100_000)


def _flat(sets: pa.Array):
    """Features, and of each set its size, of each feature its set, and where the features of a set begin."""
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return sets.flatten().to_numpy(zero_copy_only=False), size, np.repeat(np.arange(len(size)), size), np.cumsum(size) - size


def _least_overlap(size: np.ndarray, t: Fraction) -> np.ndarray:
    """The least overlap of a set with the smallest partner, in whole numbers."""
    kinds, kind = np.unique(size, return_inverse=True)
    return np.array([int(k * t * t) + 1 for k in kinds.tolist()])[kind]


def _earliest(keyed: DataFrame) -> DataFrame:
    """The earliest few rows of each key, where the rows lie."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return keyed.withColumn("place", place).where(F.col("place") <= HEADS).drop("place")


def _sharing(a: DataFrame, b: DataFrame, t: Fraction) -> DataFrame:
    """Pairs ``(a, b)`` of keyed rows in which b has the smaller id, that share as many features early in their order as near
    sets do. Of the first ``MATCHES`` that near sets share, all further ones stand behind them; one may be split and so have no key
    of its own, where two are they share the key of both."""
    sa, sb = F.col("a.size"), F.col("b.size")
    behind = lambda s: F.col(f"{s}.size") - F.col(f"{s}.pos") + (MATCHES - 1)
    may = _above(F.least(sa, sb, behind("a"), behind("b")), sa, sb, t)
    sure = (F.col("a.pos") < 0) | _above(F.lit(MATCHES - 1), sa, sb, t)
    met = a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("b.id") < F.col("a.id")) & may)
    pairs = met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("n"), F.max(sure).alias("sure"))
    return pairs.where(F.col("sure") | (F.col("n") >= MATCHES - 1)).select("a", "b")


def _sketches(items: DataFrame) -> DataFrame:
    """``items(id, vector)`` to ``(id, size, sketch)``: ``SKETCH`` bits, each the parity of the features that fall on it. Narrow."""
    schema = T.StructType([items.schema["id"], *T.StructType.fromDDL("size INT, sketch ARRAY<BIGINT>").fields])

    def task(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                flat, size, owner, _ = _flat(part.column(1))
                odd = np.bincount(owner * SKETCH + (flat & (SKETCH - 1)), minlength=len(size) * SKETCH) & 1
                longs = np.packbits(odd.astype(np.uint8)).view(np.int64)
                each = np.arange(len(size) + 1, dtype=np.int32) * (SKETCH // 64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(each), pa.array(longs))], names=["id", "size", "sketch"])

    return items.mapInArrow(task, schema)


def _checked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, t: Fraction) -> tuple[DataFrame, int]:
    """Pairs that are near, and a number that they do not exceed: if there are many, of each ``a`` the one with the earliest ``b`` that
    the sketches allow, or else all others. Bits of two sketches that differ are features that only one set has; vectors are
    fetched for the pairs left."""
    side = lambda s: sketches.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    sa, sb = F.col("size_a"), F.col("size_b")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, bits: n + bits)
    allowed = _above(F.floor((sa + sb - apart) / 2).cast("int"), sa, sb, t)
    pairs = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").where(allowed).select("a", "b"))
    n = pairs.count()

    def near(pairs):
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        vectors = among(sets, ids, "left_semi", most=2 * n)
        vectors = vectors if n <= FEW_PAIRS else cut_lineage(vectors)
        return cut_lineage(_verified(pairs, vectors, vectors, t))

    if n <= FEW_PAIRS:
        return (near(pairs) if n else pairs), n
    earliest = cut_lineage(pairs.groupBy("a").agg(F.min("b").alias("b")))
    found = near(earliest)
    others = pairs.join(found.select("a").distinct(), "a", "left_anti").join(earliest, ["a", "b"], "left_anti")
    return found.union(near(cut_lineage(others))), n
