"""Secret scan with multipart credential linking, in DataFrame functions only.

Three strong patterns (assignments, access identifiers, long hex) are always reported. Weak parts
(identifiers, secret-looking words, endpoints) are reported only if a complementary part lies
within ``SCOPE`` code points in the same text: a weak secret needs an identifier or an endpoint,
an identifier or endpoint needs a secret. Linked parts do not overlap, so no string completes itself:
a weak part inside a strong one is dropped, and so is a weak secret inside an identifier or endpoint.
Only a strong secret that starts before an identifier or endpoint and ends in it completes that too.
The link is a sweep over both ends of all parts in order, so a text with many parts never makes pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, stored

SCOPE = 200

# The three strong patterns, in the order in which they are listed.
STRONG = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
# No group is repeated in any pattern: the JVM matches repeated groups by recursion, which a long text overflows.
WEAK = {
    "identifier": r"""(?<![A-Za-z0-9])(?:(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}|(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,})""",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}",
    "endpoint": r"""(?<![A-Za-z0-9])(?:(?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9-](?::[0-9]+)?)""",
}
KINDS = [*STRONG, *WEAK]
# The role of each kind: strong parts complete weak ones too.
ROLE = {"assign": "secret", "access": "name", "hex": "secret", "identifier": "name", "secret": "secret", "endpoint": "place"}
NEEDS = {"secret": ("name", "place"), "name": ("secret",), "place": ("secret",)}


def _found(kind: str, pattern: str) -> Column:
    """For each match: its kind, number, the code points between it and the one before, its own, and those of its value."""
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("m")),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"),
            (F.length(F.regexp_extract(x["m"], pattern, 2)) if kind == "assign" else F.length(x["m"])).alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), rows)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): (doc_id, key) of every row, and (key, kind, start, stop) of every reported span of each different row.

    ``key`` names an id together with its text. Places are code points, the stop exclusive.
    """
    found = F.flatten(F.array_compact(F.array(*[_found(k, p) for k, p in (STRONG | WEAK).items()])))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\0"), F.coalesce("text", F.lit("")))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.md5(name).alias("key"), found.alias("found"))
    rows = stored(rows, "secret-matches")

    each = rows.where(F.size("found") > 0).select("key", "found").dropDuplicates(["key"]).select("key", F.inline("found"))
    upto = Window.partitionBy("key", "kind").orderBy("i")
    start = F.sum("gap").over(upto.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("start", start).where("size IS NOT NULL").withColumn("stop", F.col("start") + F.col("size"))
    placed = placed.where((F.col("kind") != KINDS.index("assign")) | (F.col("value") >= 6))
    role = reduce(lambda c, k: c.when(F.col("kind") == KINDS.index(k), ROLE[k]), KINDS, F.when(F.lit(False), ""))
    strong = F.col("kind") < len(STRONG)
    name, secret = F.col("role") != "secret", F.col("role") == "secret"
    before = Window.partitionBy("key").orderBy("start", F.desc("stop"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("role", role)
    inside = F.coalesce(F.max(F.when(strong, F.col("stop"))).over(upto) >= F.col("stop"), F.lit(False))
    placed = placed.withColumn("inside", ~strong & inside).where("NOT inside")
    within = F.coalesce(F.max(F.when(~strong & name, F.col("stop"))).over(upto) >= F.col("stop"), F.lit(False))
    placed = placed.withColumn("inside", ~strong & secret & within).where("NOT inside")
    # A strong secret that reaches into a name or endpoint, but not over it, is evidence of its own.
    reach = F.max(F.when(strong & secret, F.col("stop"))).over(before)
    spliced = F.coalesce(~strong & name & (reach > F.col("start")), F.lit(False))
    placed = stored(placed.withColumn("spliced", spliced).select("key", "kind", "role", "start", "stop", "spliced"), "secret-parts")

    # Both ends of all parts in order: the last part of each role that ends before, the first that starts after.
    ends = placed.withColumn("opens", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("at", F.when(F.col("opens"), F.col("start")).otherwise(F.col("stop")))
    left = Window.partitionBy("key").orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, -1)

    def met(r):
        last = F.max(F.when(~F.col("opens") & (F.col("role") == r), F.col("start"))).over(left)
        first = F.min(F.when(F.col("opens") & (F.col("role") == r), F.col("start"))).over(right)
        return F.coalesce(F.when(F.col("opens"), last >= F.col("start") - SCOPE).otherwise(first <= F.col("start") + SCOPE), F.lit(False))

    met_by = {r: reduce(lambda a, b: a | b, [met(x) for x in needs]) for r, needs in NEEDS.items()}
    linked = ends.withColumn("met", reduce(lambda c, r: c.when(F.col("role") == r, met_by[r]), NEEDS, F.when(F.lit(False), F.lit(False))))
    linked = linked.where(~strong & (F.col("met") | F.col("spliced"))).select("key", "kind", "start", "stop").distinct()
    return rows.select("doc_id", "key"), placed.where(strong).select("key", "kind", "start", "stop").union(linked)


def _listed(only_strong: bool) -> Column:
    """kind:start:stop of a row's spans by start, then kind, joined with commas."""
    row = F.struct("start", "kind", "stop")
    kept = F.sort_array(F.collect_list(F.when(F.col("kind") < len(STRONG), row) if only_strong else row))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak: one row per row of ``docs``.

    Null counts as empty; texts without a span have zero counts, the digest of nothing and empty
    ``spans``. Equal rows each get their row.
    """
    rows, found = spans(docs, id_col, text_col)
    counts = [F.count_if(F.col("kind") == KINDS.index(k)).alias(f"n_{k}") for k in STRONG]
    grouped = found.groupBy("key").agg(
        *counts, F.count_if(F.col("kind") >= len(STRONG)).alias("n_weak"), _listed(True).alias("base"), _listed(False).alias("spans"))
    none = F.lit("")
    return rows.join(grouped, "key", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(F.coalesce("base", none).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_weak", F.lit(0)).cast("long").alias("n_weak"))
