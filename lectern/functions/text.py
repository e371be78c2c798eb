"""Text expressions. All are built-in Spark columns; lengths count code points."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace of Python's str.split()/strip() and of JavaScript's \s and trim().
WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"
NOT_WS = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
JS_WS = r"[\t-\r\p{Z}\x{FEFF}]+"
_Z = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANKS = {WS: "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" + _Z, JS_WS: "\t\n\x0b\f\r\ufeff" + _Z}

# Words that mark a question as asking for a summary.
SUMMARY_MARKERS = (
    "summary",
    "summarize",
    "summarise",
    "overview",
    "briefly",
    "in short",
    "1-2 sentences",
    "one or two sentences",
    "write the summary",
)

# Display colours by star rating.
STAR_COLOURS = ((2, "#e74c3c"), (3, "#f39c12"), (4, "#f1c40f"), (None, "#2ecc71"))


def or_default(col: Column, default) -> Column:
    """``x or default``: NULL, '' and 0 all give way to the default."""
    blank = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.coalesce(F.nullif(col, blank), F.lit(default))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, for use inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def contains_any(col: Column, needles) -> Column:
    hits = [F.contains(col, F.lit(n)) for n in needles]
    return functools.reduce(lambda a, b: a | b, hits)


def trim_ws(col: Column, ws: str = WS) -> Column:
    """Without whitespace at the ends; looks at the ends only, so long runs inside cost nothing."""
    return F.trim(col, F.lit(BLANKS[ws]))


def has_text(col: Column) -> Column:
    """Not NULL and not only whitespace; looks no further than the first other character."""
    return F.coalesce(col.rlike(NOT_WS), F.lit(False))


def squeeze(col: Column, ws: str = WS) -> Column:
    """Whitespace runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(col, ws, " "))


def words(col: Column, ws: str = WS) -> Column:
    return F.filter(F.split(col, ws), lambda w: w != "")


def chunk_array(col: Column, max_chars: int = 500) -> Column:
    """Greedy packing of whole words into chunks of at most ``max_chars``.

    On single-spaced text the greedy rule is one leftmost-longest match: up to
    ``max_chars`` characters that end at a word boundary, or one overlong word.
    """
    if max_chars < 2:
        raise ValueError("max_chars must be at least 2")
    packed = rf"[^ ](?:.{{0,{max_chars - 2}}}[^ ])?(?= |$)"
    overlong = rf"[^ ]{{{max_chars + 1},}}"
    return F.regexp_extract_all(squeeze(col), F.lit(f"{packed}|{overlong}"), F.lit(0))


def excerpts(col: Column, size: int = 4000) -> Column:
    """Two excerpts: the head, and a window starting at half the text (at most ``size`` in)."""
    start = F.least(F.floor(F.char_length(col) / 2), F.lit(size)).cast("int")
    return F.array(
        trim_ws(F.substring(col, 1, size)),
        trim_ws(F.substring(col, start + F.lit(1), F.lit(size))),
    )


def pages_of_words(col: Column, per_page: int = 350) -> Column:
    """Pages of ``per_page`` words; a text without words is one placeholder page."""
    page = rf"[^ ]++(?: [^ ]++){{0,{per_page - 1}}}+"
    pages = F.regexp_extract_all(squeeze(col, JS_WS), F.lit(page), F.lit(0))
    return let(
        pages, lambda p: F.when(F.size(p) == 0, F.array(F.lit("(empty document)"))).otherwise(p)
    )


def word_count(col: Column) -> Column:
    return F.size(words(col, JS_WS))


def text_page_count(col: Column, per_page: int = 350) -> Column:
    return F.ceil(word_count(col) / per_page)


def docx_page_estimate(size_bytes: Column, per_page: int = 3000) -> Column:
    return F.greatest(F.lit(1), F.ceil(size_bytes / per_page))


def is_summary_question(col: Column) -> Column:
    return contains_any(F.lower(col), SUMMARY_MARKERS)


def ellipsis(col: Column, limit: int, mark: str = "…") -> Column:
    return F.concat(
        F.substring(col, 1, limit),
        F.when(F.char_length(col) > limit, F.lit(mark)).otherwise(F.lit("")),
    )


def star_bar(rating: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), rating), F.repeat(F.lit("☆"), F.lit(5) - rating))


def star_colour(rating: Column) -> Column:
    out = None
    for limit, colour in STAR_COLOURS[:-1]:
        out = F.when(rating <= limit, colour) if out is None else out.when(rating <= limit, colour)
    return out.otherwise(STAR_COLOURS[-1][1])


def citation_line(
    title: Column, author: Column, publication_date: Column, source: Column, doi_url: Column
) -> Column:
    """One display line; absent parts vanish, and without title and author there is none."""

    def part(col, before, after):
        return F.when(col != "", F.concat(F.lit(before), col, F.lit(after)))

    line = F.concat_ws(
        " ",
        part(title, '"', '"'),
        part(author, "by ", ""),
        part(publication_date, "(", ")"),
        part(source, "- ", ""),
        part(doi_url, "[", "]"),
    )
    shown = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(author, F.lit("")) != "")
    return F.when(shown, F.concat(F.lit("Citation: "), line))


def document_type(filename: Column) -> Column:
    return (
        F.when(filename.rlike("(?i)contract|agreement"), "contract")
        .when(filename.rlike("(?i)code|statute|regulation"), "statute")
        .otherwise("case")
    )


def search_query(filename: Column, text: Column) -> Column:
    """Search words from a file name and the start of its text, 100 characters at most."""
    name = F.translate(F.regexp_replace(filename, r"(?i)\.(pdf|docx|txt)$", ""), "_-", "  ")
    head = F.substring(F.coalesce(text, F.lit("")), 1, 200)
    return F.substring(trim_ws(F.concat(name, F.lit(" "), head), JS_WS), 1, 100)


def sanitize_filename(name: Column) -> Column:
    """Base name without control, separator or reserved characters, 255 at most."""
    # Slashes, and dots alone behind them, are trimmed from the end without a repeated group, which the JVM matches by recursion.
    bare = F.rtrim(F.regexp_replace(name, r"/\.(?=/|\z)", "/"), F.lit("/"))
    base = F.regexp_replace(bare, r"^.*/", "")
    base = F.when(base == ".", "").otherwise(base)
    kept = F.regexp_replace(base, r'[\p{C}[\p{Z}&&[^ ]]/\\<>:"|?*]', "")
    return or_default(F.substring(kept, 1, 255), "untitled")


def context_mode(selected_text: Column, has_documents: Column) -> Column:
    return (
        F.when(F.char_length(F.coalesce(selected_text, F.lit(""))) > 0, "selected_text")
        .when(has_documents, "all_documents")
        .otherwise("general_chat")
    )
