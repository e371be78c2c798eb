"""Text rules against plain restatements, on hand-made rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import chunking

C = F.col("s")


def plain_chunks(value, limit=500):
    out = []
    for word in value.split():
        if out and len(out[-1]) + 1 + len(word) <= limit:
            out[-1] += " " + word
        else:
            out.append(word)
    return out


@pytest.mark.parametrize("value", [
    "", " \n\t ", "x" * 501, "a" * 249 + " " + "b" * 250, "a" * 249 + " " + "b" * 251,
    "one two three\x1ffour", "a\n\n\nb\r\nc", "é😀 " * 400, "x" * 700 + " y " + "z" * 500 + " w",
    "s " + "x" * 501 + " e",
])
def test_chunks_of_edge_texts(evaluate, value):
    assert evaluate(text.chunk_array(C), s=value) == plain_chunks(value)


def test_chunks_of_random_texts(spark):
    rng = random.Random(7)
    texts = [
        "".join(rng.choice(["w", "long" * rng.randint(1, 9), " ", "\n", " ", "é"]) for _ in range(rng.randint(0, 90)))
        for _ in range(300)
    ]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id BIGINT, s STRING").select(
        "id", text.chunk_array(C, 20).alias("c")
    ).collect()
    assert all(r["c"] == plain_chunks(texts[r["id"]], 20) for r in got)


def test_blank_documents_have_no_chunks_but_are_counted(spark):
    docs = spark.createDataFrame([(1, "  "), (2, "a b")], "id BIGINT, content STRING")
    counts = chunking.chunk_counts(docs, chunking.chunk_documents(docs))
    assert {r["id"]: r["chunks_count"] for r in counts.collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("name, want", [
    ("../../etc/passwd", "passwd"), ("a/b/", "b"), ("a/.", "a"), (".", "untitled"), ("..", ".."),
    ("re\x07port x y.txt", "reportx y.txt"), ("n" * 300, "n" * 255), (None, "untitled"), ("", "untitled"),
    ('<>:"|?*', "untitled"), ("a\\b.md", "ab.md"), ("naïve😀.txt", "naïve😀.txt"),
])
def test_sanitized_names(evaluate, name, want):
    assert evaluate(text.sanitize_filename(C), s=name) == want


def test_excerpts_start_at_half_of_short_texts(spark):
    long, short = "ab" * 6000, "0123456789" * 30
    docs = spark.createDataFrame([(1, long), (2, short), (3, "x" * 199), (4, "y" * 200)], "id BIGINT, content STRING")
    got = {(r["document_id"], r["part"]): r["excerpt"] for r in chunking.excerpt_rows(docs).collect()}
    assert got == {(1, 1): long[:4000], (1, 2): long[4000:8000], (2, 1): short, (2, 2): short[150:], (4, 1): "y" * 200}


def test_pages_of_words(evaluate):
    words = [f"w{i}" for i in range(701)]
    got = evaluate(text.pages_of_words(C), s=" \n".join(words))
    assert got == [" ".join(words[i:i + 350]) for i in (0, 350, 700)]
    assert evaluate(text.pages_of_words(C), s=" \t") == ["(empty document)"]
    assert evaluate(text.text_page_count(C), s="") == 0


def test_pages_over_the_limit_are_turned_away(spark):
    rows = [(1, i, f"p{i}") for i in range(1, 152)] + [(2, 1, "a"), (2, 2, " "), (2, 3, "c"), (3, 1, "\n")]
    pages = spark.createDataFrame(rows, "document_id BIGINT, page_no INT, page_text STRING")
    got = {r["document_id"]: r for r in chunking.assemble_pages(pages).collect()}
    assert (got[1]["error_code"], got[1]["text"], got[1]["page_count"]) == ("too_many_pages", None, 151)
    assert (got[2]["text"], got[2]["page_count"]) == ("\n\n[Page 1]\n\na\n\n[Page 3]\n\nc", 3)
    assert (got[3]["error_code"], got[3]["char_count"]) == ("no_text", None)


def test_pages_are_cut_at_the_character_limit(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 50)], "document_id BIGINT, page_no INT, page_text STRING")
    row = chunking.assemble_pages(pages, max_chars=20).first()
    assert (row["text"], row["char_count"], row["truncated"]) == (("\n\n[Page 1]\n\n" + "x" * 50)[:20], 20, True)


def test_small_rules(evaluate):
    assert evaluate(text.is_summary_question(C), s="Give it IN SHORT please") is True
    assert evaluate(text.is_summary_question(C), s="Who signed?") is False
    assert evaluate(text.document_type(C), s="Lease-AGREEMENT.pdf") == "contract"
    assert evaluate(text.document_type(C), s="penal_code.txt") == "statute"
    assert evaluate(text.ellipsis(C, 3), s="abcd") == "abc…"
    assert evaluate(text.ellipsis(C, 4), s="abcd") == "abcd"
    assert evaluate(text.search_query(F.lit("My_file-1.PDF"), C), s="t" * 300) == ("My file 1 " + "t" * 200)[:100]
    assert evaluate(text.or_default(C, "none"), s="") == "none"
    assert evaluate(text.trim_ws(C), s="  a b\n\x1c") == "a b"
    nothing = F.lit(None).cast("string")
    assert evaluate(text.citation_line(C, nothing, nothing, F.lit("S"), F.lit("")), s="T") == 'Citation: "T" - S'
    assert evaluate(text.citation_line(nothing, nothing, C, C, C), s="x") is None


def test_trim_takes_no_time_for_blanks_inside(spark):
    inside = "a" + " " * 300_000 + "b"
    rows = spark.createDataFrame([("\u3000\x85\t" + inside + "\u00a0 \n",), ("\ufeffx",), ("",), (None,)], "x STRING")
    start = time.time()
    got = [r[0] for r in rows.select(text.trim_ws(F.col("x"))).collect()]
    assert got == [inside, "\ufeffx", "", None] and time.time() - start < 20
    assert rows.select(text.trim_ws(F.col("x"), text.JS_WS)).collect()[1][0] == "x"


def test_names_that_end_in_very_many_slashes(evaluate):
    clean = text.sanitize_filename(F.col("s"))
    for tail in ("/." * 200_000, "/" * 400_000, "/./" * 100_000, "//." * 100_000):
        assert evaluate(clean, s="up/name.txt" + tail) == "name.txt"
    assert evaluate(clean, s="/." * 100_000 + "x") == ".x"
    assert evaluate(clean, s="a/..") == ".." and evaluate(clean, s="a/./b.md/.") == "b.md" and evaluate(clean, s="/" * 9) == "untitled"
