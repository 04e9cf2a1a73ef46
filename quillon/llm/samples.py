"""Bounded samples of labelled rows, for models that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def share_of(key, seed: int):
    """A number in [0, 1) from a hash of ``key``, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / F.lit(1_000_000)


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """``docs`` rows of about ``bound`` labelled ids, half of each class where there are as many, with ``label`` (0/1) and ``weight`` (rows that one stands for).

    Ids are chosen by hash. At most ``bound`` ids (within the spread of the
    hash) are broadcast, so no text is shuffled; null ids and labels are left out, and of
    several labels for one id the greatest counts.
    """
    given = labels.select(F.col(id_col), (F.col(label_col) != 0).cast("int").alias("label")).where(f"{id_col} is not null and label is not null")
    given = given.groupBy(id_col).agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, bound / 2 / n) for k, n in counts.items()}
    by_label = lambda x: F.when(F.col("label") == 1, F.lit(x.get(1, 1.0))).otherwise(F.lit(x.get(0, 1.0)))
    picked = given.where(share_of(F.col(id_col), seed) < by_label(share))
    picked = picked.withColumn("weight", by_label({k: 1 / v for k, v in share.items()}))
    return docs.drop("label", "weight").join(F.broadcast(picked), id_col)
