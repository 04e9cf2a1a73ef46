"""Helpers that the corpus operators share: shared-folder materialisation,
native ``let`` binding and names of texts."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.callables import ship
from ..shared import new_folder

#: The word of every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = new_folder(spark, label)
    _forget_at_exit(spark, path)
    return path


_worker: dict = {}


def worker_cache(name, make: Callable):
    """What an operator keeps in a worker process between tasks; that of the operator before is let go."""
    if name not in _worker:
        _worker.clear()
        _worker[name] = make()
    return _worker[name]


#: Bytes of an Arrow batch, for sessions that leave Spark's own bound: long texts should not fill a worker's memory.
BATCH_BYTES, _UNBOUND = "8m", "67108864b"


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package shipped to the workers, in batches of bounded size."""
    ship(df)
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == _UNBOUND:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


_paths: list[tuple[SparkSession, str]] = []


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _paths:
        atexit.register(_delete_all)
    _paths.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _delete_all() -> None:
    for spark, path in _paths:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended first; its folder is then left to the cluster
            return


#: Bytes of input for a partition, where a number of partitions is derived from the data.
PART = 1 << 24


def part_count(df: DataFrame, part: int = PART) -> int:
    """Partitions for what ``df`` reads: one for ``part`` bytes of its leaves, one for each core at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # above: the optimizer's way to say that it does not know
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-known // part))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage as checkpoint() does, in compressed columns: a lost
    executor costs nothing that was written, and later passes prune columns.
    Spark drops the write's own shuffle files when it ends. Small inputs do not
    become many small files: a file stands for ``PART`` bytes of what the plan
    reads, or there is one for each core.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # is read when a frame is made: coalesce makes one
    try:
        df.coalesce(part_count(df)).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns behind a Generate, which projections are never collapsed through."""
    cell = "__once"
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in named.items()]))).alias(cell)
    return df.select("*", made).select(*[df[c] for c in df.columns], *[F.col(cell)[k].alias(k) for k in named])


def text_name(text: Column) -> Column:
    return F.xxhash64(text)


def named(df: DataFrame, text: Column, **columns: Column) -> DataFrame:
    """``node``, a number that equal texts share and no others, ``text`` and ``columns`` of each row.

    The XXH64 of the text is its name. Where a second hash shows that texts of
    one name differ (a few in ten billion; the driver gets these names), they
    take the second one.
    """
    rows = df.select(*[c.alias(k) for k, c in columns.items()], text_name(text).alias("node"), text.alias("text"))
    second = F.xxhash64(F.lit(7), F.col("text"))
    both = rows.select("node", second.alias("x")).groupBy("node").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    taken = [r["node"] for r in both.where("lo <> hi").select("node").collect()]
    return rows.withColumn("node", F.when(F.col("node").isin(taken), second).otherwise(F.col("node"))) if taken else rows


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
