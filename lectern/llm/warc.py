"""Merkle fixity audit of WARC archives.

Pages are laid out as WARC records in archives of bounded size, each record at its byte offset.
A record's hash is a leaf; records that start in the same range of offsets, in order, make a node,
``FAN`` neighbouring nodes one node of the next level, up to one root an archive. Two replicas are
compared root by root; only below roots that differ are the children looked at, level by level,
down to the ranges, and only records of ranges that differ are compared themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

ARCHIVE_BYTES = 1 << 27
RANGE_BYTES = 1 << 16
FAN = 16


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """The bytes of a page as a WARC response record; nulls are empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = part(html)
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), part(page_id), F.lit(">\r\nWARC-Target-URI: "), part(url),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def layout(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, archive, offset, length, digest: where each page's record lies.

    Archives are filled by the hash of the record, in the order of digest and id; equal pages
    follow each other. No pages, no records.
    """
    rows = pages.select("page_id", record().alias("bytes")).select(
        "page_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    rows = stored(rows.groupBy("page_id", "length", "digest").agg(F.count("*").alias("n")), "warc-records")
    total = rows.agg(F.sum(F.col("length") * F.col("n"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    rows = rows.withColumn("archive", F.pmod(F.xxhash64("digest", "page_id"), F.lit(archives)))
    before = Window.partitionBy("archive").orderBy("digest", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0))
    rows = rows.withColumn("first", first)
    return rows.select("page_id", "archive", "length", "digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select(
        "page_id", "archive", (F.col("first") + F.col("k") * F.col("length")).alias("offset"), "length", "digest")


def _hash(*fields: str) -> Column:
    """The hash of a group's rows, in the order of the first field."""
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])), ",").cast("binary"), 256)


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """(archive, node, digest) of each level, ranges of offsets first, roots last."""
    ranged = records.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES))
    out = [stored(ranged.groupBy("archive", "node").agg(_hash("offset", "length", "digest").alias("digest")), "merkle")]
    for _ in range(levels):
        up = out[-1].withColumn("parent", F.floor(F.col("node") / FAN))
        out.append(stored(up.groupBy("archive", "parent").agg(_hash("node", "digest").alias("digest")).withColumnRenamed("parent", "node"), "merkle"))
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """archive, offset, kind, length, digest, found_length, found_digest of every record that differs.

    Both sides have (archive, offset, length, digest). ``kind`` is ``changed``, ``missing`` (only in the
    primary) or ``extra`` (only in the replica). Equal or empty sides give no rows; several records
    at one place are compared as a whole, each pair of unequal ones a row.
    """
    fields = ("archive", "offset", "length", "digest")
    a, b = (stored(x.select(*fields), "warc-side") for x in (primary, replica))
    most = max(x.agg(F.max("offset")).first()[0] or 0 for x in (a, b)) // RANGE_BYTES
    levels = 0
    while FAN ** levels <= most:
        levels += 1
    trees = list(zip(tree(a, levels), tree(b, levels), strict=True))
    open_ = None
    for ours, theirs in reversed(trees):
        if open_ is not None:  # children of nodes that differ, and no others
            parent = open_.select("archive", F.col("node").alias("parent"))
            ours, theirs = (x.withColumn("parent", F.floor(F.col("node") / FAN)).join(parent, ["archive", "parent"], "left_semi") for x in (ours, theirs))
        both = ours.select("archive", "node", F.col("digest").alias("x")).join(theirs.select("archive", "node", F.col("digest").alias("y")), ["archive", "node"], "full")
        open_ = stored(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "node"), "merkle-open")
    below = lambda x: x.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(open_, ["archive", "node"], "left_semi").drop("node")
    theirs = below(b).select("archive", "offset", F.col("length").alias("found_length"), F.col("digest").alias("found_digest"))
    both = below(a).join(theirs, ["archive", "offset"], "full").where(
        ~(F.col("digest").eqNullSafe(F.col("found_digest")) & F.col("length").eqNullSafe(F.col("found_length"))))
    kind = F.when(F.col("digest").isNull(), "extra").when(F.col("found_digest").isNull(), "missing").otherwise("changed")
    return both.select("archive", "offset", kind.alias("kind"), "length", "digest", "found_length", "found_digest")


def damaged(pages: DataFrame, records: DataFrame) -> DataFrame:
    """A replica of ``records``, read back from the pages, that has suffered: by the crc32 of the id
    mod 100, a record with 7 has one byte changed, one with 11 lost its second half, one with 13 is gone."""
    fate = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % 100
    size = F.octet_length("bytes")
    hurt = (F.when(fate == 7, F.overlay("bytes", F.lit("#").cast("binary"), F.floor(size / 2).cast("int"), F.lit(1)))
            .when(fate == 11, F.substring("bytes", F.lit(1), F.floor(size / 2).cast("int"))).otherwise(F.col("bytes")))
    read = pages.select("page_id", record().alias("bytes")).where(fate != 13).select(
        "page_id", F.sha2("bytes", 256).alias("digest"), F.octet_length(hurt).cast("long").alias("now_length"), F.sha2(hurt, 256).alias("now"))
    known = read.groupBy("page_id", "digest").agg(F.first("now").alias("now"), F.first("now_length").alias("now_length"))
    same = known["page_id"].eqNullSafe(records["page_id"]) & (known["digest"] == records["digest"])
    return records.join(known, same).select("archive", "offset", F.col("now_length").alias("length"), F.col("now").alias("digest"))
