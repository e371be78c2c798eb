"""Pluggable embedders: DataFrame in, DataFrame with one more vector column out."""

from __future__ import annotations

from typing import Callable, Protocol, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.vectors import dense, word_set


class Embedder(Protocol):
    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class WordSets:
    """Sparse 0/1 vectors over words, as ascending ARRAY<BIGINT> of word hashes."""

    def transform(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        return df.withColumn(out, word_set(F.col(text)))


class DenseWordSets:
    """The same vectors folded to ``dim`` places, for tables with a float vector column."""

    def __init__(self, dim: int = 768):
        self.dim = dim

    def transform(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        return df.withColumn(out, dense(word_set(F.col(text)), self.dim))


class GivenVectors:
    """Vectors that already exist in another table, joined on by key."""

    def __init__(self, vectors: DataFrame, key: str, vector: str = "embedding"):
        self.vectors, self.key, self.vector = vectors, key, vector

    def transform(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        given = self.vectors.select(self.key, F.col(self.vector).alias(out))
        return df.join(given, self.key, "left")


class ColumnEmbedder:
    """Any column function, such as a user's pandas UDF around a model.

    A failed or wrongly sized vector becomes NULL with ``embed_failed`` set, and
    so never takes part in ranking or duplicate checks.
    """

    def __init__(self, fn: Callable[[Column], Column], dim: int):
        self.fn, self.dim = fn, dim

    def transform(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        raw = df.withColumn("_raw", self.fn(F.col(text)))
        good = F.col("_raw").isNotNull() & (F.size("_raw") == self.dim)
        return (
            raw.withColumn(out, F.when(good, F.col("_raw")))
            .withColumn("embed_failed", F.col(out).isNull())
            .drop("_raw")
        )


class ModelEmbedder:
    """A model called with lists of texts, in batches of ``batch_rows``, one text at a time where a batch fails.

    ``load`` is called once per task and gives the function that takes texts to vectors. A call
    that raises, or gives another number of vectors than texts, is repeated text by text, so that one bad text
    costs only itself. A text whose own call fails, or whose vector has another length than ``dim`` or a
    part that is no finite number, has a NULL vector with ``embed_failed`` set; so has a NULL text,
    which the model never sees. Works in place, without a shuffle, on any columns.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence]], dim: int, batch_rows: int = 64):
        self.load, self.dim, self.batch_rows = load, dim, batch_rows

    def transform(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        load, dim, size = self.load, self.dim, self.batch_rows
        kept = [f for f in df.schema.fields if f.name not in (out, "embed_failed")]
        schema = T.StructType([
            *kept, T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("embed_failed", T.BooleanType())])
        at, stay = df.columns.index(text), [df.columns.index(f.name) for f in kept]

        def embed(batches):
            model = load()
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    part = batch.slice(start, size)
                    vectors = _embedded(model, part.column(at).to_pylist(), dim)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i) for i in stay), pa.array(vectors, pa.list_(pa.float32())), pa.array([v is None for v in vectors])],
                        names=schema.names)

        return df.mapInArrow(embed, schema)


def _embedded(model, texts: list[str | None], dim: int) -> list[np.ndarray | None]:
    """A vector, or None, for each text."""
    told = [i for i, t in enumerate(texts) if t is not None]
    out: list[np.ndarray | None] = [None] * len(texts)
    found = _called(model, [texts[i] for i in told]) if told else []
    if found is None:
        singles = [_called(model, [texts[i]]) for i in told]
        found = [s[0] if s else None for s in singles]
    for i, vector in zip(told, found, strict=True):
        out[i] = _checked(vector, dim)
    return out


def _called(model, texts: list[str]) -> list | None:
    """The model's vectors, or None if it raises or gives another number of them."""
    try:
        found = list(model(texts))
    except Exception:  # whatever a model raises, the texts are tried alone
        return None
    return found if len(found) == len(texts) else None


def _checked(vector, dim: int) -> np.ndarray | None:
    try:
        numbers = np.asarray(vector, np.float32)
    except (TypeError, ValueError):
        return None
    return numbers if numbers.shape == (dim,) and np.isfinite(numbers).all() else None
