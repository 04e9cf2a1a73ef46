"""Typed binary partitions, as Parquet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dataset import Dataset, PairDataset


def partition_object_file(session, path: str) -> Dataset:
    df = session.spark.read.parquet(path)
    return (PairDataset if df.columns == ["key", "value"] else Dataset)(df, session)


def save(data: Dataset, path: str, compression: int = 6, overwrite: bool = False) -> None:
    """Level 0 stores plainly, 1 to 9 compress by zstd."""
    if not 0 <= compression <= 9:
        raise ValueError("compression goes from 0 to 9")
    writer = data.df.select(*[F.col(c) for c in data.df.columns]).write.mode("overwrite" if overwrite else "errorifexists")
    writer = writer.option("compression", "zstd" if compression else "uncompressed")
    (writer.option("parquet.compression.codec.zstd.level", compression) if compression else writer).parquet(path)
