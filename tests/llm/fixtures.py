"""Small tables with every odd row the operators must bear."""

from __future__ import annotations

import random

# Columns named like those the operators make themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, token string, key string, item int, line string, score double, n int, " \
    "_own string, _key string, _id string, _row string, _gone int, _mark int, _OWN_ int"


def documents(spark, rows):
    """A documents table, further columns included, from (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, 2, "t", "k", 3, "l", 0.5, 4, "o", "y", "i", "r", 6, 7, 8) for i, t in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows():
    """(doc_id, text): null and empty texts, null and repeated ids, equal rows, blanks, a very long text, near copies."""
    base = prose(1, 200)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (None, "a null id"), (None, "a null id"),
            (6, "one"), (7, "one two"), (8, "one two three"), (9, prose(2, 20_000)), (10, base + " tail"), (11, "x" * 30_000),
            (12, "Tab\tand no-break ▁ É日本🙂\x00 end"), (13, base.upper()), (2, "another text under an id"), (-5, base + " more")]
    return rows + [(100 + i, prose(i, 30 + i)) for i in range(40)]
