"""What the operators share: row batches for Python tasks, stored tables, row keys, label spreading.

Every operator first selects the columns it needs, so further columns of a table, whatever
their names, never clash with its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import scratch_path

SLICE_BYTES = 4 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def schema_of(docs: DataFrame, rest: str, id_col: str = "doc_id") -> T.StructType:
    """The id as it is typed in ``docs``, then the columns of the DDL text ``rest``."""
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(rest).fields])


def text_slices(batches: Iterable[pa.RecordBatch], budget: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, list]]:
    """Ids and UTF-8 texts (``None``: null) of a few rows at a time; a longer text comes alone."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes + 64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.column(0).slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks (space, tab to carriage return), A-Z in lower case."""
    return text.lower().split() if text else []


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def runs(batches: Iterable[pa.RecordBatch], keys: int, limit: int) -> Iterator[tuple[tuple, list[np.ndarray], bool, bool]]:
    """Runs of equal leading ``keys`` columns in sorted batches.

    Gives (key, remaining columns, first, last) for each part of a run; a run of up to ``limit`` rows
    comes as one part, a longer one in parts of at least that size, so that memory stays bounded.
    """
    key, held, count, first = None, [], 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(c[a] for c in cols[:keys])
            if here != key:
                if held:
                    yield key, [np.concatenate(x) for x in zip(*held, strict=True)], first, True
                key, held, count, first = here, [], 0, True
            held.append([c[a:b] for c in cols[keys:]])
            count += b - a
            if count > limit:
                yield key, [np.concatenate(x) for x in zip(*held, strict=True)], first, False
                held, count, first = [], 0, False
    if held or not first:
        yield key, [np.concatenate(x) for x in zip(*held, strict=True)] if held else [], first, True


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node but the smallest ones themselves.

    Alternating stars: each node is hung on its smallest neighbour until nothing moves, in
    logarithmically many rounds. Minima are aggregated before the shuffle; joins are plain
    equality joins of stored tables, which adaptive execution splits where one node is hot.
    """
    def tidy(df):
        return df.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()

    def mark(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = stored(tidy(edges), "edges")
    state = mark(now)
    while state[0]:
        least = stored(now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low")), "least")
        far = now.join(least, now.lo == least.node, "left").select(F.col("hi").alias("a"), F.coalesce("low", "lo").alias("b"))
        wide = stored(tidy(far), "edges")
        least = stored(wide.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low")), "least")
        near = wide.join(least, wide.hi == least.node).select(F.col("lo").alias("a"), F.col("low").alias("b"))
        now = stored(tidy(near.union(least.select("node", "low"))), "edges")
        before, state = state, mark(now)
        if before == state:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
