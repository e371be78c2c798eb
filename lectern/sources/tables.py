"""Table scans, appends, schema evolution and the vector-dimension guard."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import cut_lineage, remove_folder


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, spread: int = 1) -> None:
    """A table cut into folders by the hash of its key, ``spread`` files in each."""
    cut = df.withColumn("bucket", bucket_of(key, buckets))
    cut.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(spread))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def change_buckets(
    spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, changes: DataFrame,
    apply: Callable[[DataFrame, DataFrame], DataFrame],
) -> list[int]:
    """Applies ``changes``, rows with the key of what they change, to a table of :func:`write_buckets`: only the
    buckets that hold such a key are read and written, all other files stay as they are. Returns these buckets.

    ``apply(rows, changes)`` gives the new rows of the buckets it is handed. What it gives is stored before
    anything is overwritten, and replaces the old files bucket by bucket. Run again after a failure it gives the same
    rows, if ``apply`` gives the same for rows already changed, as setting values and deleting do; added counts need a change log
    that is cut by batch.
    """
    touched = sorted(r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets``
    if not touched:
        return touched
    rows = read_buckets(spark, path, schema).where(F.col("bucket").isin(touched)).drop("bucket")
    new = cut_lineage(apply(rows, changes).withColumn("bucket", bucket_of(key, buckets)))
    left = {r[0] for r in new.select("bucket").distinct().collect()}
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in touched:
        if bucket not in left:  # all its rows are gone, and a write of no rows replaces nothing
            remove_folder(spark, f"{path}/bucket={bucket}")
    return touched


def evolve(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` it lacks, NULL or defaulted; extra ones stay."""
    fields = T.StructType.fromDDL(schema).fields
    out = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in df.columns])
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def ensure_vectors(df: DataFrame, embedder, text: str, dim: int, vector: str = "embedding") -> DataFrame:
    """The table as it is, or embedded again when the vector column is missing or any vector
    has another dimension."""
    if vector in df.columns and not vector_guard(df, dim, vector).first()["rebuild"]:
        return df
    return embedder.transform(df.drop(vector), text, vector)


def vector_guard(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Counts of vectors, missing vectors and vectors of another dimension, and whether the
    table has to be embedded again."""
    wrong = F.count_if(F.size(vector) != dim)
    return df.agg(
        F.count(vector).alias("n_vectors"),
        F.count_if(F.col(vector).isNull()).alias("n_missing"),
        wrong.alias("n_wrong_dim"),
        (wrong > 0).alias("rebuild"),
    )
