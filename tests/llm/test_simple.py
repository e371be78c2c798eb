"""Sharding, SimHash, MaxScore, SentencePiece and language model against plain Python."""

import hashlib
import heapq
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash

from lectern.llm import lm, maxscore, pieces, shards, simhash
from lectern.llm.queries import QUERIES
from tests.llm.fixtures import documents, odd_rows, prose

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


# sharding


def check_shards(rows, got, n):
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == want
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_odd_rows(spark):
    rows = odd_rows()
    check_shards(rows, shards.assign(documents(spark, rows), 5).collect(), 5)
    assert shards.assign(documents(spark, []), 5).count() == 0


def test_shards_equal_heap_over_groups(spark):
    """With every group an item of its own the loads are those of the plain heap."""
    rows = [(i, prose(i % 50, 5 + i % 50)) for i in range(300)]
    got = shards.assign(documents(spark, rows), 7, cells=100_000).collect()
    check_shards(rows, got, 7)
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len(t) + 16
    heap = [0] * 7
    for s in sorted(sizes.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + s)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert sorted(loads.values()) == sorted(heap)


def test_shards_balance(spark):
    got = QUERIES["op4_sharding"](spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert len(loads) == 40 and max(loads) - min(loads) < 0.02 * max(loads)


# SimHash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
    hashes = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """component by id for (doc_id, fingerprint)."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in pairs), key=key)


def test_simhash_odd_rows(spark):
    rows = odd_rows()
    want = brute_components([(i, fingerprint(t)) for i, t in rows])
    assert sorted(rows_of(simhash.near_duplicates(documents(spark, rows))), key=key) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r[0], fingerprint(r[1])) for r in docs])
    assert sorted(rows_of(QUERIES["op5_simhash"](spark, FOLDER)), key=key) == want


def test_simhash_fine_keys_are_bounded():
    _, finer = simhash.masks()
    assert max(1 << (64 - m.bit_count()) for masks in finer for m in masks) == 1 << 13 == simhash.FINE


@pytest.mark.parametrize("bucket", [4096, 20])
def test_simhash_links_keep_every_component(spark, bucket):
    """Dense balls of fingerprints and chains; small buckets send keys through their finer ones."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(3):
        centre = int(rng.integers(0, 1 << 63))
        ball = [centre]
        for _ in range(60):
            x = ball[int(rng.integers(0, len(ball)))]
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            ball.append(x)
        fps.update(ball)
    fps.update(int(x) for x in rng.integers(0, 1 << 63, 200))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, bucket)).collect()}
    want = {}
    for x, _, c in brute_components([(x, x) for x in fps]):
        want.setdefault(c, set()).add(x)
    got = defaultdict(set)
    for (s,) in signed:
        got[roots.get(s, s)].add(s % (1 << 64))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


# MaxScore


def brute_top(vectors, queries, k):
    out = []
    for qi, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qi)
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).astype(float).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, [0.0] * 8), (2050, [-1.0] * 8), (10, rows[10][1])]
    odd = [(3000, None), (3050, [None] * 8), (3100, [float("nan")] * 8), (3150, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    vectors = maxscore.integer_vectors(df)
    plain = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    got = sorted(rows_of(maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)))
    assert got == brute_top(plain, [p for p in plain if p[0] % 50 == 0], 5)


def test_top_k_few_candidates_and_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (7, [3.0, 1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    vectors = maxscore.integer_vectors(df)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 1)
    got = sorted(rows_of(maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)))
    one = [(50, 1, 7, 393216), (50, 2, 0, 131072)]
    assert got == sorted([(0, 1, 7, 196608), (0, 2, 50, 131072), (0, 3, 50, 131072), *one, *one])
    assert maxscore.top_k(vectors.where("false"), vectors.where("false"), 5).count() == 0


# SentencePiece


PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["", " ", "  ", "a ", " a", "a  b", "▁", "a▁b ▁▁", "é\n\t", "<s> <unk> <0x41>", "a" + " " * 17 + "b", "x" * 3000, " ⁇ "]
    rows = odd_rows() + [(500 + i, t) for i, t in enumerate(texts)]
    got = rows_of(pieces.digest(documents(spark, rows), PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(got, key=key) == sorted(want, key=key)
    full = pieces.encode(documents(spark, rows), PATH)
    sources = dict(rows)
    for r in full.where("doc_id NOT IN (2)").collect():
        source, ends = (sources[r["doc_id"]] or "").encode(), r["ends"]
        assert len(r["ids"]) == len(ends) and ends[-1] == len(source) and ends == sorted(ends) and ends[0] == 0
        for i, start, end in zip(r["ids"][1:-1], ends, ends[1:]):
            piece = library.id_to_piece(i)
            part = source[start:end]
            assert part == bytes([int(piece[3:5], 16)]) if library.is_byte(i) else part.decode().replace(" ", "▁") in (piece, piece[1:])
    plain = pieces.decode(full, PATH)
    assert dict(plain.where("doc_id > 100").collect()) == {i: library.decode(library.encode(t or "")) for i, t in rows if i and i > 100}
    assert pieces.digest(documents(spark, []), PATH).count() == 0


def double_array(entries):
    """A compiled character map for entries of one or two bytes, built slot by slot."""
    pool, place = b"", {}
    for k, v in entries.items():
        place[k] = len(pool)
        pool += v + b"\0"
    units = [0] * 4096
    units[0] = 256 << 10 | 0  # children of the root from 256
    following = 512
    for first in {k[:1] for k in entries}:
        node = 256 ^ first[0]
        units[node] = (following ^ node) << 10 | first[0]
        base = following
        following += 256
        if first in entries:
            units[node] |= 1 << 8
            units[base] = 1 << 31 | place[first]
        for k in entries:
            if k[:1] == first and len(k) == 2:
                child = base ^ k[1]
                units[child] = (following ^ child) << 10 | 1 << 8 | k[1]
                units[following] = 1 << 31 | place[k]
                following += 256
    blob = struct.pack("<4096I", *units)
    return struct.pack("<I", len(blob)) + blob + pool


def test_character_map_takes_the_longest_prefix():
    m = pieces.Model(PATH)
    m.chars = pieces.CharacterMap(double_array({b"f": b"F", b"fi": b"<fi>", "é".encode(): b"e"}))
    plain, origin = m.normalise("a fi fé".encode())
    assert plain == b"a <fi> Fe"
    assert origin.tolist() == [0, 1, 2, 2, 2, 2, 4, 5, 6, 8]
    m.squeeze = True
    assert m.normalise(b"  a   b ")[0] == b"a b"


# language model


def test_language_model_base_and_sums(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    model = lm.fit(docs.where(~lm.held_out(docs["doc_id"])))
    got = sorted((tuple(r) for r in lm.score(docs, model).collect()), key=lambda r: key(r[:4]))
    counts = Counter()
    for _, t in train:
        counts.update((t or "").encode().lower().split())
        counts[None] += 1
    total = sum(counts.values())
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    want.sort(key=lambda r: key(r[:4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(math.isclose(a[4], b[4], rel_tol=1e-9) for a, b in zip(got, want))
    assert all(r[5] < 0 for r in got)


def test_language_model_is_normalised():
    counts = {b"w%d" % i: 1000 // (i + 1) for i in range(500)}
    counts[lm.END] = 100
    head = {t: c for t, c in counts.items() if c > 4}
    total = sum(counts.values())
    v = lm.Vocabulary(list(head), list(head.values()), total, len(counts), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    for k in range(v.n - 1):
        assert math.isclose((10 ** v.share[v.classes == k]).sum(), 1)
    net = lm.Bilinear(v.n, v.mass)
    net.train(np.zeros(5000, int), np.ones(5000, int), np.arange(5000) % 7, np.random.default_rng(0), {})
    assert np.allclose((10.0 ** net.table()).sum(1), 1, atol=1e-4)
    tail = {t: c for t, c in counts.items() if t not in head}
    mass = sum(tail.values())
    assert math.isclose(sum((c - v.discount) / mass for c in tail.values()) + v.discount * v.tail_types / mass, 1)


def plain_score(model, tail_counts, text):
    """log10 probability of a text, token by token, from the parameters alone."""
    v, net, inner = model.vocabulary, model.net, model.members
    places, before, tail = v.places(), v.n, v.n - 1
    tail_mass = max(float(v.mass[tail]), 1.0)
    total, near, far, context = 0.0, before, before, inner.own + before
    for w in [*lm.words(text.encode()), lm.END]:
        at = places.get(w, -1)
        c = v.classes[at] if at >= 0 else tail
        s = (net.r[near] * net.w[0] + net.r[far] * net.w[1]).astype(float) @ net.q.T.astype(float) + net.b
        total += (s[c] - np.log(np.exp(s).sum())) / np.log(10)
        if at < 0:
            n = tail_counts.get(w, 0)
            unknown = v.discount * max(v.tail_types, 1) / tail_mass if v.mass[tail] > 0 else 1.0
            total += math.log10((n - v.discount) / tail_mass if n else min(max(unknown, 1e-12), 1.0))
        else:
            group = np.flatnonzero(v.classes == c)
            if len(group) > 1:
                weight = inner.share[group] * np.exp(inner.weights[group].astype(float) @ inner.weights[inner.words + context].astype(float))
                total += math.log10(weight[group == at][0] / weight.sum())
        near, far, context = c, near, at if 0 <= at < inner.own else inner.own + c
    return total


def test_language_model_score_is_the_plain_product(spark, monkeypatch):
    monkeypatch.setattr(lm, "OWN", 8)
    monkeypatch.setattr(lm, "WORD_CONTEXTS", 12)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["ä" * 40]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    docs = documents(spark, rows)
    model = lm.fit(docs, head=40)
    assert np.abs(model.members.weights[:model.members.words]).max() > 0.01
    head = set(model.vocabulary.tokens)
    tail = Counter(w for _, t in rows for w in lm.words(t.encode()) if w not in head)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}
    for i, t in rows:
        assert math.isclose(got[i], plain_score(model, tail, t), rel_tol=1e-4, abs_tol=1e-3)


def test_language_model_words_follow_their_context():
    counts = {b"w%d" % i: 1000 for i in range(64)}
    counts[lm.END] = 2000
    v = lm.Vocabulary(list(counts), list(counts.values()), sum(counts.values()), len(counts), 0, 0)
    v.classes = np.where(np.arange(65) < 33, 0, 1)
    mass = np.bincount(v.classes, v.counts)
    inner = lm.Members(v.classes, np.log10(v.counts / mass[v.classes]), 3, 2048)
    rng = np.random.default_rng(1)
    for k in inner.shared():  # shares of a class are weights of a distribution in every context
        members = np.flatnonzero(v.classes == k)
        z = inner.normalisers(np.arange(inner.contexts))[:, k]
        assert np.allclose((inner.share[members] * np.exp(inner.weights[inner.words:] @ inner.weights[members].T)).sum(1), 10.0 ** z, atol=1e-4)
    target = rng.integers(33, 65, 20_000)
    context = target - 33  # each word has a context of its own
    square = np.zeros(len(inner.weights), np.float32)
    for _ in range(3):
        inner.train(context, target, v.classes[target], rng, square)
    z = inner.normalisers(np.arange(inner.contexts))
    gain = inner.scores(context, target, v.classes[target], z)
    assert gain.mean() > 0.5
    members = np.flatnonzero(v.classes == 1)
    weight = inner.share[members] * np.exp(inner.weights[inner.words:] @ inner.weights[members].T)
    assert np.allclose(weight.sum(1), 10.0 ** z[:, 1], rtol=1e-3)


def test_vectors_of_tasks_are_averaged_by_weight(spark):
    rng = np.random.default_rng(4)
    rows, sums, weights = [], np.zeros((3, 50, lm.DIM)), np.zeros((3, 50))
    for part in range(30):
        for block in range(3):
            at = np.flatnonzero(rng.random(50) < 0.3)
            w, x = rng.integers(1, 9, len(at)).astype(float), rng.normal(size=(len(at), lm.DIM)).astype(np.float16)
            rows.append((block, part, *[bytearray(y.tobytes()) for y in (at.astype(np.int16), w, x)]))
            sums[block][at] += x * w[:, None]
            weights[block][at] += w
    got = lm._averaged(spark.createDataFrame(rows, "block int, part int, rows binary, weights binary, vectors binary")).collect()
    assert sorted(r["block"] for r in got) == [0, 1, 2]
    for r in got:
        at = np.frombuffer(r["rows"], np.int16)
        assert at.tolist() == np.flatnonzero(weights[r["block"]]).tolist()
        want = sums[r["block"]][at] / weights[r["block"]][at][:, None]
        assert np.allclose(np.frombuffer(r["vectors"], np.float32).reshape(-1, lm.DIM), want, atol=1e-5)


def test_language_model_head_grows():
    assert lm.head_size(0) == lm.head_size(lm.HEAD_TOKENS) == lm.HEAD
    assert lm.head_size(64 * lm.HEAD_TOKENS) == pytest.approx(2 * lm.HEAD, abs=1)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    r = QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(base_score)", "sum(score)", "sum(n_tokens)").first()
    assert r[1] > r[0] + 0.5 * r[2]


def test_language_model_without_rows(spark):
    model = lm.fit(documents(spark, []))
    assert lm.score(documents(spark, []), model).count() == 0
    assert lm.score(documents(spark, [(1, "a b")]), model).first()["n_known"] == 0


def test_registered_oracles(spark):
    import __spark_entry__ as entry
    from lectern.llm.queries import ORACLES
    from tests.check_oracle import compare, connect

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(QUERIES) == 10
    for name in ORACLES:
        assert compare(spark, connect(FOLDER), name, FOLDER)[0] is None
