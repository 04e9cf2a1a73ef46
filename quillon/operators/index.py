"""Dense global index without a window over the whole dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import computed_once

_LOW = (1 << 33) - 1


def numbered(df: DataFrame, name: str = "idx") -> tuple[DataFrame, int]:
    """``df`` with its 0-based position in partition order, and the number of rows.

    The rows are computed once, with their partition and their number in it,
    into a reliable checkpoint: a plan that is run twice may deal its rows out
    otherwise (ranges are sampled, partitions are merged by size). Then rows
    are counted by partition (a row each comes to the driver) and the running
    sums are broadcast, so the order stays and nothing is shuffled.
    """
    pid, number = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))
    tagged = computed_once(df.withColumns({"__pid": pid, "__number": number}))
    counts = tagged.groupBy("__pid").agg(F.count("*").alias("n")).collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["__pid"]):
        offsets.append((r["__pid"], total))
        total += r["n"]
    small = df.sparkSession.createDataFrame(offsets, "__pid int, __offset long")
    got = tagged.join(F.broadcast(small), "__pid").withColumn(name, F.col("__offset") + F.col("__number"))
    return got.drop("__pid", "__number", "__offset"), total


def with_index(df: DataFrame, name: str = "idx") -> DataFrame:
    return numbered(df, name)[0]


def partition_counts(df: DataFrame) -> DataFrame:
    """(partition, n) of the partitions that have rows."""
    return df.select(F.spark_partition_id().alias("partition")).groupBy("partition").agg(F.count("*").alias("n"))
