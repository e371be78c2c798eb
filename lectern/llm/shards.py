"""Sharding by longest processing time: groups of equal texts, largest first, to the least loaded shard.

Groups stay whole. A group above one ``cells``-th of all bytes is an item of its own, which bounds
their number by ``cells``; all smaller groups are bundled by the hash of their text into ``cells``
items. The heap therefore sees at most ``2 * cells`` items, whatever the size of the corpus, and
every item is far smaller than a shard unless a single group is not. Slots are numbered inside
small cells of rows from offsets that are sums over cells, so no task sees a whole shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, stored

CELLS = 4096
OVERHEAD = 16


def least_loaded(sizes: dict, shards: int) -> dict:
    """Shard of each item: by falling size (ties: smaller item), each to the least loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item in sorted(sizes, key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + sizes[item], shard))
    return out


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 16. A null text counts as empty and shares the
    group of empty texts; a null id is an id like any other; rows that are equal get slots of
    their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"))
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n")), "shard-rows")
    total = rows.agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n")).first()
    all_bytes, all_rows = total["bytes"] or 0, total["n"] or 0

    groups = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
    large = [r["key"] for r in groups.where(F.col("bytes") * cells > all_bytes).orderBy("key").collect()]
    own = spark.createDataFrame([(bytes(k), cells + i) for i, k in enumerate(large)], "key binary, own int")
    cell = F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")
    placed = rows.join(F.broadcast(own), "key", "left").withColumn("item", F.coalesce("own", cell)).drop("own")

    items = placed.groupBy("item").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n")).collect()
    home = least_loaded({r["item"]: r["bytes"] for r in items}, shards)
    parts = {r["item"]: -(-r["n"] * cells // max(all_rows, 1)) for r in items}
    split = spark.createDataFrame([(i, home[i], parts[i]) for i in home], "item int, shard int, parts long")
    placed = placed.join(F.broadcast(split), "item").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")).cast("int"))

    base, filled = [], [0] * shards
    for r in placed.groupBy("shard", "item", "part").agg(F.sum("n").alias("n")).orderBy("shard", "item", "part").collect():
        base.append((r["item"], r["part"], filled[r["shard"]]))
        filled[r["shard"]] += r["n"]
    offsets = spark.createDataFrame(base, "item int, part int, base long")
    before = Window.partitionBy("item", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.join(F.broadcast(offsets), ["item", "part"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
