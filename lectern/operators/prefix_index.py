"""A stored index of word sets for duplicate checks that go on batch after batch.

The order of features, the counts of their slots in the base, is fixed when the index is made, so prefixes written
then and later agree; features the base lacks come first, as the rarest. Prefix rows are cut by feature, sets by id, and
both by batch: a check reads the slot counts, a table of bounded size, and only the buckets that hold a feature of its own prefixes, then only the sets of the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.neardup import HOT, SLOTS, _candidates, _heads, _verified, feature_counts, prefixes
from lectern.session import cut_lineage, folders

BUCKETS = 64
BASE = -1
_ROWS = "id BIGINT, feature BIGINT, second BIGINT, size INT, pos INT, small BOOLEAN, sig0 BIGINT, sig1 BIGINT, batch_id INT, bucket INT"


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _touched(df: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in df.select(_bucket(column)).distinct().collect())  # at most BUCKETS


@dataclass(frozen=True)
class PrefixIndex:
    """``order(slot, n)``, ``prefix`` rows and ``sets(id, vector)`` under ``path``, all cut by bucket."""

    spark: SparkSession
    path: str
    threshold: str = "0.92"
    hot: int = HOT

    @staticmethod
    def open(spark: SparkSession, path: str, base: DataFrame, threshold: float = 0.92, hot: int = HOT) -> "PrefixIndex":
        """The index under ``path``, made from ``base(vector)`` if it is not there or was not finished."""
        index = PrefixIndex(spark, path, str(threshold), hot)
        if "_SUCCESS" not in folders(spark, f"{path}/prefix/batch_id={BASE}"):
            sets = cut_lineage(base.where(F.size("vector") > 0).select("vector").distinct())
            counts = feature_counts(sets)
            held = np.flatnonzero(counts)
            spark.createDataFrame(pa.table({"slot": held, "n": counts[held]})).coalesce(1).write.mode("overwrite").parquet(f"{path}/order")
            index.extend(sets, BASE)
        return index

    def _read(self, table: str, schema: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").where(F.col("bucket").isin(buckets))

    def _prefixes(self, items: DataFrame) -> DataFrame:
        """Prefix rows of ``items(id, vector)`` in the order of the index."""
        order = self.spark.read.schema("slot BIGINT, n BIGINT").parquet(f"{self.path}/order").toArrow()  # at most SLOTS rows
        counts = np.zeros(SLOTS, np.int64)
        counts[order.column("slot").to_numpy()] = order.column("n").to_numpy()
        return prefixes(items, counts, Fraction(self.threshold), self.hot)

    def extend(self, sets: DataFrame, batch_id: int) -> None:
        """Adds ``sets(vector)`` as those of a batch; a second run of the batch replaces what the first wrote."""
        sets = sets.where(F.size("vector") > 0).select("vector").distinct().withColumn("id", F.xxhash64("vector"))
        sets = cut_lineage(sets)
        sets.withColumn("bucket", _bucket("id")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/sets/batch_id={batch_id}")
        rows = self._prefixes(sets).withColumn("bucket", _bucket("feature"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/prefix/batch_id={batch_id}")

    def near(self, items: DataFrame, before: int | None = None) -> DataFrame:
        """Ids of ``items(id, vector)`` that a set of the index is above the threshold to; with ``before`` only sets
        of earlier batches count. Sets that share a hash are all compared."""
        items = items.where(F.size("vector") > 0).select("id", "vector")
        left = cut_lineage(self._prefixes(items))
        earlier = F.lit(True) if before is None else F.col("batch_id") < before
        stored = self._read("prefix", _ROWS, _touched(left, "feature")).where(earlier).drop("batch_id", "bucket")
        t = Fraction(self.threshold)

        def near(a, b):
            # Candidates first, then only the buckets of sets that hold one.
            candidates = cut_lineage(_candidates(a, b, t))
            sets = self._read("sets", "id BIGINT, vector ARRAY<BIGINT>, batch_id INT, bucket INT", _touched(candidates, "b")).where(earlier).select("id", "vector")
            return _verified(candidates, items, sets, t).select(F.col("a").alias("id")).distinct()

        soon = cut_lineage(near(left, _heads(stored)))
        return soon.union(near(left.join(soon, "id", "left_anti"), stored))
