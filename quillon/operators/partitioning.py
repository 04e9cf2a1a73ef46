"""Placement of rows in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import numbered


def _dealt(indexed: DataFrame, total: int, n: int) -> DataFrame:
    """``n`` partitions, equal give or take one row, by the dense column ``__idx``."""
    to = F.expr(f"cast(__idx * {n} div {max(total, 1)} as int)")
    return indexed.withColumn("__to", to).repartitionById(n, F.col("__to")).sortWithinPartitions("__idx").drop("__idx", "__to")


def repartition_ordered(df: DataFrame, n: int) -> DataFrame:
    """``n`` partitions of equal size (give or take one) in the order that rows had."""
    indexed, total = numbered(df, "__idx")
    return _dealt(indexed, total, n)


def repartition(df: DataFrame, n: int, ordered: bool = False, everywhere: bool = True) -> DataFrame:
    """Ordered; else balanced; else (``everywhere`` off) without moving rows between executors.

    Spark cannot cut a partition in place: to have more partitions than there
    are, rows move.
    """
    if not everywhere and n <= df.rdd.getNumPartitions():
        return df.coalesce(n)
    return repartition_ordered(df, n) if ordered else df.repartition(n)


def by_random(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.repartitionById(n, F.floor(F.rand(seed) * n).cast("int"))


def by_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.repartition(n, *(columns or df.columns))


def by_number(df: DataFrame, n: int, number) -> DataFrame:
    """Row to partition ``number`` mod ``n``."""
    return df.repartitionById(n, F.pmod(number, F.lit(n)).cast("int"))


def union_ordered(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of ``a`` and then all of ``b``, in their orders, in as many partitions as both had."""
    n = a.rdd.getNumPartitions() + b.rdd.getNumPartitions()
    (x, n_x), (y, n_y) = numbered(a, "__idx"), numbered(b.toDF(*a.columns), "__idx")
    return _dealt(x.unionByName(y.withColumn("__idx", F.col("__idx") + n_x)), n_x + n_y, n)


def approx_size(df: DataFrame) -> int:
    """Bytes that the optimizer expects."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
