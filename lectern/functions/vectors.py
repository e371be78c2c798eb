"""Vector expressions: word sets, dense cosine and the dimension check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import words


def word_set(col: Column) -> Column:
    """The distinct lower-case words of a text as 64-bit hashes, ascending: a 0/1 vector
    in sparse form. 64 bits keep different words apart at any realistic vocabulary."""
    hashes = F.transform(words(F.lower(col)), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(hashes))


def dense(word_hashes: Column, dim: int) -> Column:
    """The same vector folded to ``dim`` places and written out as ARRAY<FLOAT>."""
    places = F.array_distinct(F.transform(word_hashes, lambda h: F.pmod(h, F.lit(dim)).cast("int")))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(F.array_contains(places, i), 1.0).otherwise(0.0).cast("float"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors in DOUBLE; NULL when either has no length.

    Vectors of different length raise: that is a schema fault, not a score.
    """
    def total(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    same = F.size(a) == F.size(b)
    score = F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        same, score
    ).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))
