"""Duplicate checks over word sets with every bound in play, and the dense index, against plain numpy."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import dense, neardup
from lectern.operators.prefix_index import BUCKETS, PrefixIndex


def sets_frame(spark, rows):
    return spark.createDataFrame([(i, sorted(s)) for i, s in rows.items()], "id BIGINT, vector ARRAY<BIGINT>")


def near(a, b, t):
    return len(a & b) / (len(a) * len(b)) ** 0.5 > t + 1e-12


def replay(rows, t):
    kept = {}
    for i, s in sorted(rows.items()):
        if not s or not any(o and near(s, o, t) for o in kept.values()):
            kept[i] = s
    return sorted(kept)


def mixed_sets(seed):
    rng = random.Random(seed)
    hashes = [rng.getrandbits(63) - 2**62 for _ in range(90)]
    base = hashes[:40]
    rows = {}
    for i in range(240):
        kind = i % 4
        if kind == 0:
            rows[i] = set(base) - set(rng.sample(base, rng.randint(0, 4))) | set(rng.sample(hashes[40:], rng.randint(0, 3)))
        elif kind == 1:
            rows[i] = set(rng.sample(hashes[:12], rng.randint(1, 9)))
        elif kind == 2:
            rows[i] = set(rng.sample(hashes, rng.randint(0, 60)))
        else:
            rows[i] = {rng.choice(hashes[:6]) for _ in range(rng.randint(1, 3))}
    return rows


@pytest.mark.parametrize("threshold, hot", [(0.92, 2_000), (0.92, 2), (0.6, 5), (0.3, 3)])
def test_greedy_with_split_features(spark, threshold, hot):
    rows = mixed_sets(int(threshold * 100) + hot)
    got = neardup.greedy_keep(sets_frame(spark, rows), threshold, hot)
    assert sorted(r["id"] for r in got.where("kept").collect()) == replay(rows, threshold)


@pytest.mark.parametrize("threshold, hot", [(0.92, 2), (0.5, 1), (0.6, 2_000)])
def test_near_existing_with_split_features(spark, threshold, hot):
    old, new = mixed_sets(1), mixed_sets(2)
    got = {r["id"] for r in neardup.near_existing(sets_frame(spark, new), sets_frame(spark, old), threshold, hot).collect()}
    assert got == {i for i, s in new.items() if s and any(o and near(s, o, threshold) for o in old.values())}


def test_sets_stay_where_they_lie(spark):
    """Joins on the key that rows were dealt out by shuffle their other side alone."""
    from lectern.session import cut_by

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    sets = cut_by(sets_frame(spark, mixed_sets(3)), "id")
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a BIGINT, b BIGINT").hint("merge")
    plan = pairs.join(sets.withColumnRenamed("id", "a"), "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_prefix_rows_hold_no_vectors(spark):
    items = sets_frame(spark, mixed_sets(3))
    made = neardup.prefixes(items, neardup.feature_counts(items), neardup.Fraction("0.92"), least=2)
    assert set(made.columns) == {"id", "feature", "second", "size", "pos", "small", "sig0", "sig1"}
    assert made.count() < items.select(F.explode("vector")).count()


def test_greedy_writes_little_to_shuffles_and_nothing_stays(spark, monkeypatch):
    """Rows of the duplicate check hold no signatures, are not keyed in pairs at some thousand items, and sets are kept once."""
    items = sets_frame(spark, {i: {1000 * i + j for j in range(200)} | set(range(-40, 0)) for i in range(30)})
    counts = neardup.feature_counts(items)
    counts[counts >= 30] = 3_000  # words of some thousand items
    made = neardup._keyed(items, counts, neardup.Fraction("0.92"), neardup.CROWDED)
    assert made.columns == ["key", "id", "size", "pos"] and made.where("pos < 0").isEmpty()
    paths = []
    stored = neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda *a: paths.append((made := stored(*a))[0]) or made)
    assert neardup.greedy_keep(items).where("kept").count() == 30
    assert len(paths) == 1 and not os.path.exists(paths[0])


@pytest.mark.parametrize("threshold, hot", [(0.92, 2), (0.92, 20_000), (0.6, 5), (0.3, 3)])
def test_greedy_in_two_waves_and_without_broadcasts(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(neardup, "FEW_PAIRS", 3)
    monkeypatch.setattr(neardup, "FEW_IDS", 2)
    rows = mixed_sets(int(threshold * 50) + hot)
    got = neardup.greedy_keep(sets_frame(spark, rows), threshold, hot)
    assert sorted(r["id"] for r in got.where("kept").collect()) == replay(rows, threshold)


# dense


def cluster_rows(n, dim=16, groups=12, spread=0.05, seed=0):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(groups, dim))
    heart /= np.linalg.norm(heart, axis=1, keepdims=True)
    return (heart[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))) * rng.uniform(0.5, 2, size=(n, 1))


def vectors_frame(spark, rows, odd=()):
    return spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(rows)), *odd], "id BIGINT, vector ARRAY<DOUBLE>")


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16)]


def cosines(a, b):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit(a) @ unit(b).T


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_dense_index_top_k_is_exact(spark, spread):
    rows, asked = cluster_rows(900, spread=spread), cluster_rows(60, spread=spread, seed=1)
    rows[100:110] = rows[99]  # ties go to the lower id
    asked[0] = rows[99]
    index = dense.DenseIndex.build(vectors_frame(spark, rows, ODD), cell_rows=100, centres=12)
    assert index.blocks.sizes.sum() == 900
    queries = vectors_frame(spark, asked, ODD).withColumnRenamed("id", "query_id")
    counts = {}
    found = index.top_k(queries, 4, counts).collect()
    score = cosines(asked, rows)
    for q in range(60):
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        want = np.lexsort((np.arange(900), -np.round(score[q], 12)))[:4]
        assert [r["corpus_id"] for r in got] == want.tolist()
        assert np.allclose([r["score"] for r in got], score[q][want])
    assert len(found) == 240
    assert counts["pairs"] == 60 * (index.blocks.sizes > 0).sum()
    if spread < 1:
        assert counts["visits"] < counts["pairs"] / 3  # most blocks are never read


def test_dense_index_of_few_rows(spark):
    queries = vectors_frame(spark, cluster_rows(3)).withColumnRenamed("id", "query_id")
    none = dense.DenseIndex.build(vectors_frame(spark, [], ODD))
    assert none.top_k(queries, 3).count() == 0
    one = dense.DenseIndex.build(vectors_frame(spark, cluster_rows(1)))
    assert one.top_k(queries, 3).count() == 3
    with pytest.raises(ValueError):
        dense.DenseIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id BIGINT, vector ARRAY<DOUBLE>"))


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_dense_near_existing(spark, spread):
    both = cluster_rows(500, spread=spread, seed=2)
    rows, asked = both[:380], both[380:]
    threshold = float(np.median(cosines(asked, rows).max(axis=1)))
    index = dense.DenseIndex.build(vectors_frame(spark, rows, ODD), cell_rows=60, centres=9)
    got = {r["id"] for r in dense.dense_near_existing(vectors_frame(spark, asked, ODD), index, threshold).collect()}
    want = set(np.flatnonzero((cosines(asked, rows) > threshold).any(axis=1)).tolist())
    assert got == want and 50 < len(want) < 70


@pytest.mark.parametrize("spread, threshold", [(0.05, 0.975), (3.0, 0.5)])
def test_dense_greedy_equals_replay(spark, spread, threshold):
    rows = cluster_rows(400, spread=spread, seed=3)
    rows[50:60] = rows[7]
    assert ((cosines(rows, rows) > threshold).sum() - 400) > 100
    got = dense.dense_greedy_keep(vectors_frame(spark, rows, ODD), threshold, cell_rows=70, centres=8).collect()
    assert len(got) == 400 + len(ODD)
    score, kept = cosines(rows, rows), []
    for i in range(400):
        if not any(score[i, j] > threshold for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in got if r["kept"]) == kept + [i for i, _ in ODD]
    assert len(kept) < 390


def test_dense_near_in_groups_of_blocks():
    """Blocks are put together for duplicate checks, and pairs at the threshold are left to double precision."""
    import pyarrow as pa

    sizes = np.array([30, 50, 0, 90, 20, 10])
    group = dense.Blocks(np.eye(6), np.zeros(6), sizes).groups(100)
    assert np.bincount(group, weights=sizes).max() <= 100 and len(set(group.tolist())) < 5
    angle = np.array([0.5, 0.5 + 1e-9, 0.5 - 1e-9, 0.2, 0.9])
    unit = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).reshape(-1)))
    flat = np.stack([np.cos(angle), np.sin(angle), 0 * angle, 0 * angle], axis=1)
    rows = pa.table({"id": np.arange(5), "part": np.zeros(5, np.int64), "unit": unit(flat), "own": np.zeros(5, np.int32)})
    items = pa.table({"id": [9], "part": [0], "unit": unit(np.array([[1.0, 0, 0, 0]]))})
    blocks = dense.Blocks(np.array([[1.0, 0, 0, 0]]), np.array([1.0]), np.array([5]))
    got = dense._near_in_cell(rows, items, blocks, np.cos(0.5), False).to_pylist()
    assert [(r["b"], r["sure"]) for r in got] == [(3, True), (0, False), (1, False), (2, False)]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_stored_prefixes_equal_brute_force(spark, tmp_path, hot):
    """Base and two batches, words the base never had among them; only buckets needed are there to be read."""
    rng = random.Random(7)
    base, one, two, asked = mixed_sets(4), mixed_sets(5), mixed_sets(6), mixed_sets(8)
    for rows in (one, two, asked):
        for i in list(rows)[:60]:
            rows[i] = {10**12 + k for k in range(rng.randint(8, 14))} | ({rng.getrandbits(40)} if rng.random() < 0.3 else set())
    path = str(tmp_path / "index")
    index = PrefixIndex.open(spark, path, sets_frame(spark, base).select("vector"), hot=hot)
    index.extend(sets_frame(spark, one), 0)
    index.extend(sets_frame(spark, two), 1)
    items = sets_frame(spark, asked)
    want = lambda *old: {i for i, s in asked.items() if s and any(o and near(s, o, 0.92) for rows in old for o in rows.values())}
    got = lambda before: {r["id"] for r in index.near(items, before).collect()}
    assert got(None) == want(base, one, two) and got(1) == want(base, one) and got(0) == want(base)
    assert want(base) < want(base, one, two)
    index.extend(sets_frame(spark, two), 1)  # the batch is run again
    again = PrefixIndex.open(spark, path, sets_frame(spark, {}).select("vector"), hot=hot)
    assert {r["id"] for r in again.near(items).collect()} == got(None)
    few = sets_frame(spark, {i: asked[i] for i in list(asked)[:2]})
    needed = {r[0] for r in index._prefixes(few.where(F.size("vector") > 0)).select(F.pmod(F.xxhash64("feature"), F.lit(BUCKETS))).distinct().collect()}
    before = {r["id"] for r in index.near(few).collect()}
    for folder in (tmp_path / "index" / "prefix").glob("*/bucket=*"):
        if int(folder.name.split("=")[1]) not in needed:
            for file in folder.iterdir():
                file.write_bytes(b"")  # unreadable, so that reading it would fail
    assert {r["id"] for r in index.near(few).collect()} == before and len(needed) < BUCKETS
