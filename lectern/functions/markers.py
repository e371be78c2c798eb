"""Expressions that read model output: citations, suggestions, stream markers, Q/A lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import JS_WS, let, squeeze, trim_ws

# Citation and array patterns, the markers of a response stream, the site of search results.
CITATION = r"(?i)(?<![A-Za-z0-9_])(?:page|p\.)[\t-\r\p{Z}\x{FEFF}]*([0-9]+)(?![A-Za-z0-9_])"
FIRST_ARRAY = r"\[[\s\S]*?\]"
CONTEXT_MARK = r"__CONTEXT__(\{.*?\})__\n\n"
ENTRY_MARK = r"__ENTRY_ID__([0-9]+)__"
ERROR_MARK = r"__ERROR__(.*?)__"
ANY_MARK = (
    r"__SEARCHING__\n?|__READY__\n?|__CONTEXT__\{.*?\}__\n\n|(\n\n)?__ENTRY_ID__[0-9]+__|__ERROR__.*?__"
)
RESULT_SITE = "https://www.courtlistener.com"
END_MARK = "end-of-text-3b9f"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Questions suggested when a model gives none.
DEFAULT_SUGGESTIONS = (
    "What are the key parties and their obligations?",
    "What are the main legal risks in this document?",
    "What are the important dates and deadlines?",
    "Are there any unusual or concerning clauses?",
)


def page_citations(answer: Column, limit: int = 5) -> Column:
    """Cited pages in order of first mention: ARRAY<STRUCT<page, label>>."""

    def distinct(digits):
        plain = F.transform(digits, lambda d: F.regexp_replace(d, "^0+(?=[0-9])", ""))
        return let(plain, lambda numbers: F.transform(
            F.slice(F.array_distinct(numbers), 1, limit),
            lambda p: F.struct(
                p.try_cast("bigint").alias("page"),
                F.concat(F.lit("p."), F.element_at(digits, F.array_position(numbers, p).cast("int"))).alias("label"),
            ),
        ))

    return let(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), distinct)


def suggestions(response: Column, snippet: Column, limit: int = 4) -> Column:
    """Suggested questions: the strings of the first JSON array in a response, else defaults."""
    default = F.array(*[F.lit(s) for s in DEFAULT_SUGGESTIONS])
    found = F.try_parse_json(F.regexp_extract(strip_markers(response), FIRST_ARRAY, 0))
    short = F.char_length(squeeze(F.coalesce(snippet, F.lit("")), JS_WS)) < 100

    def chosen(items):
        texts = F.transform(
            F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")
        )
        good = F.slice(F.filter(texts, lambda s: F.char_length(s) > 10), 1, limit)
        return F.when(items.isNotNull() & (F.size(items) > 0), good).otherwise(default)

    items = F.try_variant_get(found, "$", "array<variant>")
    return F.when(short, default).otherwise(let(items, chosen))


def strict_json(text: Column, path: str = "", kind: str = "variant") -> Column:
    """The part of a JSON text at a path; NULL unless the text is one whole value.

    The parser stops after the first value, so the text is read as the first of two items of an
    array: only a single value leaves the end mark in second place. Texts that hold the mark themselves
    are read inside an array and inside an object instead.
    """
    def marked(parsed):
        whole = F.try_variant_get(parsed, "$[1]", "string") == END_MARK
        return F.when(whole, F.try_variant_get(parsed, f"$[0]{path}", kind))

    def twice(inside):
        valued = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
        single = F.size(F.try_variant_get(inside, "$", "array<variant>")) == 1
        return F.when(valued.isNotNull() & single, F.try_variant_get(inside, f"$[0]{path}", kind))

    odd = F.contains(text, F.lit(END_MARK))
    return F.when(odd, let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), twice)).otherwise(
        let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]'))), marked))


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, ANY_MARK, "")


def entry_id(text: Column) -> Column:
    return _group(text, ENTRY_MARK).try_cast("bigint")


def context_json(text: Column) -> Column:
    return _group(text, CONTEXT_MARK)


def error_message(text: Column) -> Column:
    return _group(text, ERROR_MARK)


def qa_pairs(raw: Column) -> Column:
    """Q:/A: lines of a transcript to ARRAY<STRUCT<question, answer>>.

    'Q:' opens a block that ends before the next one; the last 'A:' in it starts the answer, and
    the lines after it that are not empty extend it. Blocks without a question or an answer give
    none. Each line is looked at a fixed number of times.
    """
    tag = lambda line: F.lower(F.substring(line, 1, 2))
    rest = lambda line: trim_ws(F.substring(line, 3, 1 << 30))

    def pair(block):
        def answered(at):
            after = F.filter(F.slice(block, at + 2, F.size(block)), lambda x: x != "")
            return F.struct(
                rest(F.get(block, F.lit(0))).alias("question"),
                F.when(at.isNotNull(), trim_ws(F.array_join(F.concat(F.array(rest(F.get(block, at))), after), " "))).alias("answer"))

        return let(F.array_max(F.transform(block, lambda x, i: F.when(tag(x) == "a:", i))), answered)

    def blocks(lines):
        def cut(starts):
            ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))
            return F.zip_with(starts, ends, lambda a, b: let(F.slice(lines, a + 1, b - a), pair))

        at = F.array_compact(F.transform(lines, lambda x, i: F.when(tag(x) == "q:", i)))
        return F.filter(let(at, cut), lambda p: (p["question"] != "") & p["answer"].isNotNull())

    return let(F.transform(F.split(raw, LINE_BREAK), lambda x: trim_ws(x)), blocks)


def search_results(body: Column) -> Column:
    """Saved search responses to ARRAY<STRUCT<name, court, year, url, snippet>>."""
    schema = (
        "results ARRAY<STRUCT<caseName: STRING, case_name: STRING, court: STRING, court_id: STRING, "
        "dateFiled: STRING, date_filed: STRING, absolute_url: STRING, snippet: STRING>>"
    )

    def either(*cols, default):
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(default))

    return F.transform(
        F.from_json(body, schema)["results"],
        lambda r: F.struct(
            either(r["caseName"], r["case_name"], default="Unknown Case").alias("name"),
            F.translate(either(r["court"], r["court_id"], default=""), "_", " ").alias("court"),
            F.substring(either(r["dateFiled"], r["date_filed"], default=""), 1, 4).alias("year"),
            F.when(r["absolute_url"] != "", F.concat(F.lit(RESULT_SITE), r["absolute_url"])).alias("url"),
            F.coalesce(r["snippet"], F.lit("")).alias("snippet"),
        ),
    )
