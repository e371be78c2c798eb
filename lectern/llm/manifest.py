"""Merkle manifest of a dataset: a tree over the rows of each source, a tree over the sources above.

Rows get their places by a range sort whose parts are numbered from their sizes, so a source that
holds a third of the rows is spread like any other. Each level is joined with itself on computed
sibling places: with three children a node, a node in slot ``s`` looks for slots ``s + 1`` and
``s + 2`` mod 3 of its run. Rows in slot zero then emit the parents. Each level is a stored table, a
third of the one before. Proofs are put together from the root down, so a node's siblings are found
once, however many rows share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
_IN_PART = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields, any of them replaced."""
    return digest(*[encoded(changed.get(f, F.col(f))) for f in FIELDS])


def _place(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(group, …)`` with place and size: the row's number in its group, from 0, and the group's rows.

    Rows are range-sorted by group and ``order``; each part's first place of a group follows from the
    counts of the parts before. Nothing but these counts is gathered by group.
    """
    sort = ["group", *order]
    number = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = stored(ranged.select("*", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit(_IN_PART)).alias("at")), "manifest-rows")
    counts = ranged.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "group", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"),
        F.sum("n").over(Window.partitionBy("group")).alias("size"))
    return ranged.join(bases, ["group", "part"]).withColumn("place", F.col("at") + F.col("base")).drop("part", "at", "base")


def tree(nodes: DataFrame) -> list[DataFrame]:
    """The levels over ``nodes(group, place, size, digest, …)``, each with left and right: the digests of the
    siblings before and after a node, joined. A group ends at the level where its size is 1."""
    levels = []
    nodes = stored(nodes, "manifest-nodes")
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        if most <= 1:
            levels.append(nodes.withColumns({"left": F.lit(""), "right": F.lit("")}))
            return levels
        slot = F.col("place") % FAN
        level = nodes.where("size > 1")
        for step in range(1, FAN):
            mine = level.withColumn("other", F.col("place") - slot + (slot + step) % FAN)
            theirs = nodes.select("group", F.col("place").alias("other"), F.col("digest").alias(f"sibling{step}"))
            level = mine.join(theirs, ["group", "other"], "left").drop("other")
        # In order of slots: those below a node's own come after the wrap, so of the larger steps.
        found = [F.coalesce(f"sibling{step}", F.lit("")) for step in range(1, FAN)]
        low = F.concat(F.lit(""), *[F.when(slot + step >= FAN, found[step - 1]).otherwise("") for step in range(1, FAN)])
        high = F.concat(F.lit(""), *[F.when(slot + step < FAN, found[step - 1]).otherwise("") for step in range(1, FAN)])
        level = stored(level.withColumns({"left": low, "right": high}).drop(*[f"sibling{s}" for s in range(1, FAN)]), "manifest-level")
        ended = nodes.where("size = 1").withColumns({"left": F.lit(""), "right": F.lit("")})
        levels.append(level.unionByName(ended))
        most = -(-most // FAN)
        nodes = level.where(slot == 0).select(
            "group", F.floor(F.col("place") / FAN).alias("place"), F.ceil(F.col("size") / FAN).alias("size"), digest("digest", "right").alias("digest"))


def _paths(levels: list[DataFrame], roots: DataFrame, *carried: str) -> DataFrame:
    """Every node of the lowest level with its steps to the root: its own siblings, then its parent's.
    ``roots(group, steps, …)`` has the steps above each group's last node; further columns are handed down."""
    below = None
    step = F.struct("left", "right")
    for level in reversed(levels):
        first = level.where("size = 1").join(roots, "group").drop("left", "right")
        if below is not None:
            above = below.select("group", F.col("place").alias("up"), F.col("steps").alias("above"), *carried)
            inner = level.where("size > 1").withColumn("up", F.floor(F.col("place") / FAN)).join(above, ["group", "up"])
            inner = inner.withColumn("steps", F.concat(F.array(step), "above")).drop("up", "above", "left", "right")
            first = first.unionByName(inner)
        below = first
    return below


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, found, subroot, root, steps: one row per row of ``docs``.

    ``steps`` is the proof: the siblings' digests to the left and right of each node from leaf to
    root; ``found`` is the leaf of the row as it would be with ``tampered_text``. A source's rows
    stand by id (null first), then leaf, so rows that are equal, or that share an id, have a
    defined tree; null is a source of its own and the first. One row is its own subroot, one
    source's subroot the root. No rows give none. Further columns of ``docs`` play no part.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    found = leaf() if tampered_text is None else leaf(text=tampered_text)
    rows = docs.select(*FIELDS).select("doc_id", group.alias("group"), leaf().alias("digest"), found.alias("found"))
    placed = _place(rows.withColumn("tie", F.monotonically_increasing_id()), "doc_id", "digest", "tie").drop("tie")
    low = tree(placed)

    ends = low[0].where("size = 1").select("group", "digest")
    for level in low[1:]:
        ends = ends.unionByName(level.where("size = 1").select("group", "digest"))
    tops = ends.select(F.lit("").alias("group"), F.col("group").alias("source_key"), F.col("digest"))
    high = tree(_place(tops, "source_key"))
    root = high[-1].where("size = 1").first()  # one row, or none of an empty table
    none = F.array().cast("array<struct<left: string, right: string>>")
    start = high[0].sparkSession.range(1).select(F.lit("").alias("group"), none.alias("steps"))
    sources = _paths(high, start).select(F.col("source_key").alias("group"), "steps", F.col("digest").alias("subroot"))
    return _paths(low, stored(sources, "manifest-sources"), "subroot").select(
        "doc_id", F.col("digest").alias("leaf"), "found", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "steps")


def proof(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to. A run of one still becomes its hash."""
    return F.aggregate(steps, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def verify(proved: DataFrame) -> DataFrame:
    """``manifest`` rows with folded_root, recomputed from the leaf found, and verified."""
    root = proved.withColumn("folded_root", folded(F.col("found"), F.col("steps")))
    return root.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_breaks(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text as tampering leaves it: of every second row, by the crc32 of the id (null: of nothing), line breaks are gone."""
    mark = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.when(mark % 2 == 0, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
