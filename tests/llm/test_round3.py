"""Manifest, quality rules and periodic runs against plain Python, and their registered queries against SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import manifest, periodic, quality
from lectern.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import documents, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


# manifest


def runs_of(digests):
    """All levels of a tree, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, place, now):
    """(proof, value at the root) of a leaf that reads ``now``."""
    proof = ""
    for level in levels[:-1]:
        first = place - place % 3
        left, right = "".join(level[first:place]), "".join(level[place + 1:first + 3])
        proof, now, place = proof + left + right, sha(left + now + right), place // 3
    return proof, now


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))
    found = lambda r: leaf((*r[:4], r[4].replace("\n", "")) if r[4] is not None and crc(r[0]) % 2 == 0 else r)
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = runs_of([leaf(r) for r in sources[s]])
    top = runs_of([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for place, r in enumerate(sources[s]):
            low, now = climb(trees[s], place, found(r))
            high, now = climb(top, at, now)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(low + high), now, now == top[-1][0]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


MANIFEST_DDL = "doc_id long, source string, lang string, n_chars int, text string, place long, size long, digest string, `group` string, left string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "d", "g", "l") for r in rows], MANIFEST_DDL)


def results(df):
    proved = manifest.verify(manifest.manifest(df, manifest.without_line_breaks()))
    return [tuple(r) for r in proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("steps")).cast("binary"), 256), "folded_root", "verified").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", i, f"text\n{i}") for i in range(n)]
    assert in_order(results(made(spark, rows))) == in_order(plain_manifest(rows))


def test_manifest_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "a", "é", "z", "日本", "hot"]), rng.choice([None, "en"]), rng.choice([None, 5]), t) for i, t in odd_rows()]
    rows += [(1000 + i, "hot", "en", 3, f"line\nline {i}") for i in range(60)] + [(5, "a", "en", 1, "same\n")] * 3 + [(None, None, None, None, None)] * 2
    got = results(made(spark, rows))
    assert in_order(got) == in_order(plain_manifest(rows))
    assert {r[6] for r in got} == {True, False}
    assert results(made(spark, [])) == []


def test_manifest_unharmed_rows_verify(spark):
    rows = [(i, f"s{i % 4}", "en", 1, f"a\nb{i}") for i in range(50)]
    proved = manifest.verify(manifest.manifest(made(spark, rows)))
    assert proved.where("NOT verified").count() == 0 and proved.count() == 50
    assert proved.where("found <> leaf").count() == 0


# quality


def plain_rule(line):
    n = len(WORD.findall(line))
    signs, shouts, items = (sum(line.count(c) for c in marks) for marks in ("#*$%&|<>", "!", quality.SEPARATORS))
    if (signs >= 3 and 5 * signs > n) or (shouts >= 3 and 2 * shouts > n):
        return "punctuation"
    bare = line.rstrip(" \t\n\r\x0b\x0c")
    core = bare.rstrip(quality.CLOSING)
    ended = core[-1:] in tuple(quality.SENTENCE_END) and core != ""
    if (items >= 3 and 5 * items > n) or (n <= 4 and not ended):
        return "navigation"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return "boilerplate" if any(p in low for p in quality.BOILERPLATE) else None


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lost = Counter()
    for line in lines:
        lost[plain_rule(line)] += len(WORD.findall(line))
    left = "\n".join(x for x in text.split("\n") if not WORD.search(x) or plain_rule(x) is None)
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    gone = [lost[r] for r in quality.RULES]
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), *gone, left,
            failed, not failed and 2 * sum(gone) <= n)


QUALITY_TEXTS = [
    prose(5, 30) + ".", "Home | About | News | Contact | Jobs\n" + prose(6, 40) + ".", "\n".join(["Home", "About us", "Read more"] * 12),
    prose(7, 25).replace(" ", "!! "), prose(8, 30).replace(" ", "*** "), prose(9, 60) + ".\nAll Rights Reserved by us, the makers of this.\n" + prose(10, 30) + '."',
    (prose(11, 9) + " ") * 12, "same line here.\n" * 30, "a\x1cb c\x85d e f" * 30, "Ünïcode “quoted.”\n" * 5 + prose(12, 30) + "…", "• one • two • three • four\n" * 10,
    "We USE Cookies on this page for you and for all of us here today.\n" * 4, " \t\n\r\x0b\x0c", "ſign up for our list today and be glad of it.\n" * 9, "*" * 50_000, "! " * 50_000,
]


def test_quality_against_plain(spark):
    rows = odd_rows() + [(500 + i, t) for i, t in enumerate(QUALITY_TEXTS)] + [(500, QUALITY_TEXTS[0])]
    got = [tuple(r) for r in quality.judge(documents(spark, rows)).collect()]
    assert in_order(got) == in_order([(i, *plain_quality(t)) for i, t in rows])
    assert quality.judge(documents(spark, [])).collect() == []
    kept = {i: t for i, t in rows if i is not None and i >= 500 and plain_quality(t)[-1]}
    docs = documents(spark, rows)
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.where("doc_id >= 500").collect()} == {i: plain_quality(t)[-3] for i, t in kept.items()}
    assert 0 < len(kept) < len(QUALITY_TEXTS)
    assert cleaned.count() == sum(plain_quality(t)[-1] for _, t in rows)


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words(seed):
    rng = random.Random(seed)
    for _ in range(100):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        want = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
        assert quality.repeated_words(words) == len(want)


def test_quality_finds_labelled_junk():
    con = duckdb.connect()
    rows = con.execute("SELECT quality, text FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id)").fetchall()
    kept = Counter((q, plain_quality(t)[-1]) for q, t in rows)
    assert kept[0, False] > 20 * kept[0, True] and kept[1, True] > 20 * kept[1, False]


# periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_tail(i, words):
    h, n = crc(i), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]


def plain_row(i, words):
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return i, len(found), *best, milli, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(300):
        kinds = rng.choice([1, 2, 3, 5, 9])
        words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(70))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))] + words[:rng.randrange(9)]
        assert periodic.find_runs(periodic.word_ids(words)) == plain_runs(words)


def test_segments_hold_frequent_words_only():
    rng = random.Random(9)
    for _ in range(200):
        ids = np.array([rng.randrange(12) for _ in range(rng.randrange(6, 90))])
        found = list(periodic.segments(ids))
        for a, b in found:
            assert min(Counter(ids[a:b].tolist()).values()) >= 4
        for s, m, _ in plain_runs(ids.tolist()):
            assert any(a <= s and s + m <= b for a, b in found)
    chain = periodic.word_ids([b"%d" % w for k in range(20_000) for w in (k + 1, k, k, k)])
    assert list(periodic.segments(chain)) == []


def test_runs_of_long_texts():
    same = np.zeros(40_000, np.int64)
    assert periodic.find_runs(same) == [(0, 40_000, 1)]
    tiled = np.tile(np.arange(500), 60)
    assert periodic.find_runs(tiled) == [(0, 30_000, 500)]
    inner = np.concatenate([np.tile(np.r_[np.zeros(8, np.int64), np.arange(1, 4)], 30)])
    assert periodic.find_runs(inner) == plain_runs(inner.tolist())


def test_periodic_query_rows(spark):
    rows = odd_rows() + [(700 + i, "x y " * i + "z z z z z z z " + "x y\n" * 5) for i in range(40)] + [(900, "Und " * 3000)]
    df = documents(spark, rows)
    found = periodic.runs(periodic.repeated_tails(df))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = found.select("doc_id", F.size("runs").cast("long"), "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")),
                       F.sha2(listed.cast("binary"), 256), F.sha2(F.col("collapsed").cast("binary"), 256)).collect()
    words = [(i, plain_tail(i, WORD.findall(t or ""))) for i, t in rows]
    assert in_order([tuple(r) for r in got]) == in_order([plain_row(i, w) for i, w in words])
    assert sum(crc(i) % 10 == 0 for i, _ in rows) > 3
    assert periodic.runs(documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_quality_rules", "op13_periodic_runs"])
def test_query_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    whole = [tuple(int(x) if isinstance(x, float) else x for x in r) for r in want.fetchall()]
    assert in_order([tuple(r) for r in got.select(*names).collect()]) == in_order(whole)
