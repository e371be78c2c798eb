"""Exact search and duplicate checks over dense vectors, in blocks around centres.

An index holds the corpus as a table cut by block: a vector lies in the block of the centre most
like it. A block's radius is the widest angle between its centre and its rows. For a query at
angle a to a centre no row of that block is nearer than a less the radius, so blocks that
cannot hold a match are skipped: their files are not even read. Where vectors fall into no groups at all, the
bound rules nothing out and every block is visited: results are exact whatever the data.

Queries meet blocks on an equality join, in cells with a bounded share of either side. A cell
gives out only what may still count: the best k that reach the query's k-th score so far, or the ids found near.
Duplicate checks put neighbouring blocks together, so that a vector is sent once for some hundred thousand
others, and send directions in single precision; pairs too close to the threshold for that are compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.neardup import HEADS, decided, greedy_rounds
from lectern.operators.topk import _OUT, Search, _Best, _Block, _dense_rows, _lists, _numbers, _with_vectors
from lectern.session import cut_lineage, scratch_path

CELL_ROWS = 20_000
NEAR_BLOCKS = 8
MOST_CENTRES = 1_024
SAMPLE_PER_CENTRE = 16
SPREAD = 8
SLACK = 1e-6
ANGLE_SLACK = 1e-3
PAIRS_IN_FLIGHT = 4_000_000
NO_ROW = np.iinfo(np.int64).max


def usable(vector: str):
    """Whether a vector has a direction: not null, no null or non-finite part, some part not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def _centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Directions of ``k`` or fewer groups of unit vectors: starts far apart, then means."""
    chosen = [0]
    best = sample @ sample[0]
    while len(chosen) < k and best.min() < 1 - SLACK:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(size > SLACK, sums / np.maximum(size, SLACK), centres)
    return centres


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1, 1))


@dataclass(frozen=True)
class Blocks:
    """Centre, radius (an angle) and number of rows of each block; there are at most ``MOST_CENTRES``."""

    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def first_blocks(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the blocks nearest to it that together have ``k`` rows."""
        if not self.sizes.any():
            return [np.zeros(0, np.int64)] * len(queries)
        order = np.argsort(_angles(_units(queries), self.centres), axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[order], axis=1) < k).sum(axis=1) + 1
        return [o[:n][self.sizes[o[:n]] > 0] for o, n in zip(order, enough, strict=True)]

    def open_blocks(self, queries: np.ndarray, least: np.ndarray | float) -> np.ndarray:
        """queries × blocks: which blocks may hold a row whose cosine is at least ``least``."""
        if not self.sizes.any():
            return np.zeros((len(queries), 1), bool)
        nearest = np.maximum(_angles(_units(queries), self.centres) - self.radii - SLACK, 0)
        return (np.cos(nearest) >= np.reshape(least, (-1, 1)) - SLACK) & (self.sizes > 0)

    def groups(self, most: int) -> np.ndarray:
        """The group of each block: blocks in the order of their centres along the direction in which these differ most,
        put together up to ``most`` rows."""
        spread = self.centres - self.centres.mean(axis=0)
        along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0]
        group, number, held = np.zeros(len(self.sizes), np.int64), 0, 0
        for b in np.argsort(along, kind="stable").tolist():
            if held and held + self.sizes[b] > most:
                number, held = number + 1, 0
            group[b], held = number, held + int(self.sizes[b])
        return group


@dataclass(frozen=True)
class DenseIndex:
    """Rows ``(id, part, vector, block)``, files cut by block, and what is known of the blocks."""

    rows: DataFrame
    blocks: Blocks
    cell_rows: int = CELL_ROWS

    @staticmethod
    def build(corpus: DataFrame, path: str | None = None, cell_rows: int = CELL_ROWS, centres: int | None = None) -> "DenseIndex":
        """Index ``corpus(id[, part], vector)``. Vectors without a direction are left out; vectors of
        different dimension raise. Centres are chosen on a sample of ``SAMPLE_PER_CENTRE`` rows each, those of
        smallest hash; every row is indexed."""
        spark = corpus.sparkSession
        part = F.col("part") if "part" in corpus.columns else F.lit(0)
        rows = corpus.where(usable("vector")).select(
            F.col("id").cast("bigint").alias("id"), part.cast("bigint").alias("part"), F.col("vector").cast("array<double>").alias("vector"))
        rows = cut_lineage(rows)
        n, least, most = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if least != most:
            raise ValueError("vectors differ in dimension")
        k = max(1, min(centres or -(-n // cell_rows), MOST_CENTRES, n))
        picked = rows.orderBy(F.xxhash64("id", "part"), "id", "part").limit(SAMPLE_PER_CENTRE * k).select("vector").toArrow()
        middle = _centres(_units(_dense_rows(picked)), k) if n else np.zeros((1, 1))

        def place(batches):
            for batch in batches:
                home, angle = np.zeros(0, np.int64), np.zeros(0)
                if batch.num_rows:
                    angles = _angles(_units(_dense_rows(batch)), middle)
                    home = angles.argmin(axis=1)
                    angle = angles[np.arange(len(home)), home]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle)], names=["id", "part", "vector", "block", "angle"])

        placed = rows.mapInArrow(place, "id BIGINT, part BIGINT, vector ARRAY<DOUBLE>, block INT, angle DOUBLE")
        path = path or scratch_path(spark, "dense-index")
        spread = F.pmod(F.xxhash64("id", "part"), F.lit(SPREAD))
        placed.repartition("block", spread).write.partitionBy("block").parquet(path)
        held = spark.read.schema("id BIGINT, part BIGINT, vector ARRAY<DOUBLE>, angle DOUBLE, block INT").parquet(path)
        known = held.groupBy("block").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row for each block
        sizes, radii = np.zeros(len(middle), np.int64), np.zeros(len(middle))
        for r in known:
            sizes[r["block"]], radii[r["block"]] = r["n"], r["radius"]
        return DenseIndex(held.drop("angle"), Blocks(middle, radii, sizes), cell_rows)

    def _cells(self, rows: DataFrame, visits: DataFrame, run, out: str, sizes: np.ndarray, share_rows: int) -> DataFrame:
        """``run(rows, queries)`` on Arrow tables for every cell: the rows of a block, or group of blocks, and the queries
        that visit it, both cut into shares of ``share_rows`` or fewer. ``sizes`` has the rows of each."""
        asked = visits.groupBy("block").count().collect() if sizes.any() else []  # a row for each block
        if not asked:
            return rows.sparkSession.createDataFrame([], out)
        split = [(r["block"], int(-(-sizes[r["block"]] // share_rows)), -(-r["count"] // share_rows)) for r in asked]
        plan = lambda: F.broadcast(rows.sparkSession.createDataFrame(split, "block INT, subs INT, chunks INT"))
        share = lambda own: F.pmod(F.xxhash64("id", "part"), F.col(own)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = rows.where(F.col("block").isin([r["block"] for r in asked]))
        left = rows.join(plan(), "block").withColumns({"sub": share("subs")}).withColumn("chunk", every("chunks")).drop("subs", "chunks")
        right = visits.join(plan(), "block").withColumns({"chunk": share("chunks")}).withColumn("sub", every("subs")).drop("subs", "chunks")
        keys = ["block", "sub", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, out)

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """The blocks each query looks at first: ``(id, part, vector, block, least)``."""
        blocks = self.blocks
        return _visiting(queries.withColumn("least", F.lit(float("-inf"))), lambda q, _: blocks.first_blocks(q, k))

    def top_k(self, queries: DataFrame, k: int = 3, counts: dict | None = None) -> DataFrame:
        """Exact cosine top-k of ``queries(query_id, vector)``: ``(query_id, corpus_id, corpus_part, score, rank)``.

        The nearest blocks give each query a k-th score; then the blocks that may still reach it are
        visited. ``counts``, if given, gets the numbers of visits made and of all query-block pairs.
        """
        asked = queries.where(usable("vector")).select(
            F.col("query_id").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("part"), F.col("vector").cast("array<double>").alias("vector"))
        asked = cut_lineage(asked)
        search, blocks = Search("dense", k), self.blocks

        def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
            return _best_of_cell(rows, queries, search)

        first = cut_lineage(self.visits(asked, k))
        cells = lambda visits: self._cells(self.rows, visits, best, _OUT, blocks.sizes, self.cell_rows)
        found = cut_lineage(cells(first))
        worst = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        open_ = asked.join(worst, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

        def further(rows, least):
            seen = blocks.first_blocks(rows, k)
            mask = blocks.open_blocks(rows, least)
            for m, s in zip(mask, seen, strict=True):
                m[s] = False
            return [np.flatnonzero(m) for m in mask]

        more = cut_lineage(_visiting(open_.select("id", "part", "vector", "least"), further))
        if counts is not None:
            counts["visits"], counts["pairs"] = first.count() + more.count(), asked.count() * int((blocks.sizes > 0).sum())
        return _ranked(found.unionByName(cells(more)), k)

    def near(self, items: DataFrame, rows: DataFrame, threshold: float, earlier: bool = False) -> DataFrame:
        """``(a, b)`` once for every row ``a`` of ``items(id, part, vector)`` that one of the index's ``rows`` is above
        the threshold to, ``b`` the one of lowest id; with ``earlier`` only rows of smaller id count."""
        blocks, most = self.blocks, self.cell_rows * NEAR_BLOCKS
        groups = blocks.groups(most)

        def flag(rows: pa.Table, items: pa.Table) -> pa.Table:
            return _near_in_cell(rows, items, blocks, threshold, earlier)

        def grouped(batches):
            for batch in batches:
                if batch.num_rows:
                    own = batch.column("block").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), batch.column("part"), _directions(batch), pa.array(own.astype(np.int32)), pa.array(groups[own].astype(np.int32))],
                        names=["id", "part", "unit", "own", "block"])

        visits = _visiting(
            items.select("id", "part", "vector", F.lit(threshold).alias("least")),
            lambda q, least: [np.unique(groups[m]) for m in blocks.open_blocks(q, least)] if blocks.sizes.any() else [groups[:0]] * len(q),
            units=True)
        placed = rows.select("id", "part", "vector", "block").mapInArrow(grouped, "id BIGINT, part BIGINT, unit ARRAY<FLOAT>, own INT, block INT")
        sizes = np.bincount(groups, weights=blocks.sizes).astype(np.int64)
        found = cut_lineage(self._cells(placed, cut_lineage(visits), flag, "a BIGINT, b BIGINT, sure BOOLEAN", sizes, most))
        near, close = found.where("sure").select("a", "b"), found.where("NOT sure").select("a", "b")
        if not close.isEmpty():
            near = near.unionByName(_above_in_full(close, items, rows, threshold))
        return near.groupBy("a").agg(F.min("b").alias("b"))


def _visiting(queries: DataFrame, choose, units: bool = False) -> DataFrame:
    """``(id, part, vector, least)`` once for every block that ``choose(vectors, least)`` names; with ``units`` the direction
    in single precision in place of the vector."""
    schema = "id BIGINT, part BIGINT, " + ("unit ARRAY<FLOAT>, " if units else "vector ARRAY<DOUBLE>, least DOUBLE, ") + "block INT"
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                blocks = choose(_dense_rows(batch), batch.column("least").to_numpy(zero_copy_only=False))
                owner = np.repeat(np.arange(batch.num_rows), [len(b) for b in blocks])
                block = np.concatenate([np.zeros(0, np.int64), *blocks]).astype(np.int32)
                if units:
                    batch = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), _directions(batch)], names=names[:-1])
                for at in range(0, len(owner), 10_000):
                    part = batch.take(pa.array(owner[at:at + 10_000]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block[at:at + 10_000])], names=names)

    return queries.select("id", "part", "vector", "least").mapInArrow(task, schema)


def _directions(batch) -> pa.ListArray:
    """The vectors of a batch at length one, in single precision."""
    unit = _units(_dense_rows(batch)).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.reshape(-1)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id", "corpus_part")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_cell(rows: pa.Table, queries: pa.Table, search: Search) -> pa.Table:
    """The best k rows of a cell for each of its queries, none below the query's k-th score so far."""
    asked = _with_vectors(queries)
    best = _Best(_Block(asked, search), search)
    if asked.num_rows:
        best.worst = asked.column("least").to_numpy().copy()
        for batch in rows.combine_chunks().to_batches(max_chunksize=10_000):
            best.add(batch)
    return pa.Table.from_batches([best.result()])


def _unit_rows(data: pa.Table) -> np.ndarray:
    values, lengths = _lists(data, "unit", np.float32)
    return values.reshape(len(lengths), -1)


def _near_in_cell(rows: pa.Table, items: pa.Table, blocks: Blocks, threshold: float, earlier: bool) -> pa.Table:
    """``(a, b, sure)``: the items ``a`` that a row is above the threshold to, with the first such row, and the pairs with earlier rows
    that single precision leaves open. Some leading dimensions come first: their product and those of the rests' lengths
    bound the cosine, and only pairs the bound leaves are compared in full."""
    out = lambda a, b, sure: pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})
    if not rows.num_rows or not items.num_rows:
        return out([], [], [])
    a, b = _unit_rows(items), _unit_rows(rows)
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors differ in dimension")
    ids, others, own = _numbers(items, "id"), _numbers(rows, "id"), _numbers(rows, "own")
    by_id, by_block = np.argsort(ids, kind="stable"), np.lexsort((others, own))
    lead, doubt = max(1, a.shape[1] // 4), (a.shape[1] + 16) * 2.0**-23
    found, open_a, open_b = np.full(len(a), NO_ROW), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = np.flatnonzero(np.diff(own[by_block], prepend=-1))
    for first, last in zip(bounds, np.append(bounds[1:], len(own)), strict=True):
        here = by_block[first:last]
        block, there, y = own[here[0]], others[here], b[here]
        lead_y = _leading(y, lead)
        angle = np.arccos(np.clip(a @ blocks.centres[block].astype(np.float32), -1, 1)) - blocks.radii[block] - ANGLE_SLACK
        visiting = by_id[(np.cos(np.maximum(angle, 0)) >= threshold - ANGLE_SLACK)[by_id]]
        step = max(1, PAIRS_IN_FLIGHT // len(here))
        for at in range(0, len(visiting), step):
            part = visiting[at:at + step]
            until = np.searchsorted(there, ids[part[-1]]) if earlier else len(there)
            x = a[part]
            may = _leading(x, lead) @ lead_y[:until].T >= threshold - doubt
            n = np.count_nonzero(may)
            if n * 4 < may.size:
                pairs = np.divmod(np.flatnonzero(may), max(until, 1))
                cosine = np.concatenate([np.zeros(0, np.float32), *(
                    np.einsum("ij,ij->i", x[pairs[0][k:k + 100_000]], y[pairs[1][k:k + 100_000]]) for k in range(0, n, 100_000))])
            else:
                cosine = x @ y[:until].T
                pairs = np.nonzero(cosine >= threshold - doubt)
                cosine = cosine[pairs]
            row, other = part[pairs[0]], there[pairs[1]]
            met = other < ids[row] if earlier else np.ones(len(row), bool)
            sure = met & (cosine > threshold + doubt)
            np.minimum.at(found, row[sure], other[sure])
            doubtful = met & ~sure & (cosine >= threshold - doubt)
            open_a.append(row[doubtful])
            open_b.append(other[doubtful])
    open_a, open_b = np.concatenate(open_a), np.concatenate(open_b)
    still = open_b < found[open_a]
    near = found < NO_ROW
    a, b = np.concatenate([ids[near], ids[open_a[still]]]), np.concatenate([found[near], open_b[still]])
    return out(a, b, np.arange(len(a)) < near.sum())


def _leading(units: np.ndarray, lead: int) -> np.ndarray:
    """The leading dimensions and the length of the rest: products of these are no less than the cosine."""
    rest = np.sqrt((units[:, lead:] ** 2).sum(axis=1, keepdims=True))
    return np.concatenate([units[:, :lead], rest], axis=1)


def _above_in_full(pairs: DataFrame, items: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose cosine is above the threshold in double precision."""
    ours, theirs = items.select(F.col("id").alias("a"), F.col("vector").alias("x")), rows.select(F.col("id").alias("b"), F.col("vector").alias("y"))

    def above(batches):
        for batch in batches:
            x, y = (_dense_rows(batch.select([c]).rename_columns(["vector"])) for c in "xy")
            cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt((x**2).sum(axis=1)) * np.sqrt((y**2).sum(axis=1)))
            yield batch.select(["a", "b"]).filter(pa.array(cosine > threshold))

    return pairs.join(ours, "a").join(theirs, "b").mapInArrow(above, "a BIGINT, b BIGINT")


def _firsts(rows: DataFrame) -> DataFrame:
    """The earliest few rows of every block; each task keeps no more before the shuffle."""
    place = F.row_number().over(Window.partitionBy("block").orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= HEADS).drop("place")


def dense_near_existing(items: DataFrame, index: DenseIndex, threshold: float = 0.92) -> DataFrame:
    """Ids of ``items(id, vector)`` that have a row of the index above the threshold in cosine.

    Items are first held against a few rows of each block, which settles most of a large group of near copies."""
    asked = cut_lineage(items.where(usable("vector")).select(
        F.col("id").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("part"), F.col("vector").cast("array<double>").alias("vector")))
    near = lambda a, b: index.near(a, b, threshold).select(F.col("a").alias("id"))
    soon = cut_lineage(near(asked, _firsts(index.rows)))
    return soon.union(near(asked.join(soon, "id", "left_anti"), index.rows)).distinct()


def dense_greedy_keep(items: DataFrame, threshold: float = 0.92, cell_rows: int = CELL_ROWS, centres: int | None = None) -> DataFrame:
    """First-come duplicate suppression over dense ``items(id, vector)``: an item stays unless an earlier item
    that stayed is above the threshold in cosine. Returns ``(id, kept)``.

    Equal vectors collapse first. Vectors without a direction are near nothing and stay.
    """
    items = items.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    good = items.where(usable("vector"))
    blank = items.where(~F.coalesce(usable("vector"), F.lit(False))).select("id", F.lit(True).alias("kept"))
    firsts = cut_lineage(good.groupBy("vector").agg(F.min("id").alias("id")))
    index = DenseIndex.build(firsts, cell_rows=cell_rows, centres=centres)

    def near_earlier(a, b):
        soon = cut_lineage(index.near(a, _firsts(b), threshold, earlier=True))
        others = a.join(soon.select(F.col("a").alias("id")), "id", "left_anti")
        return soon.union(index.near(others, b, threshold, earlier=True))

    dropped = greedy_rounds(index.rows, near_earlier)
    return decided(good, firsts, dropped).unionByName(blank)
