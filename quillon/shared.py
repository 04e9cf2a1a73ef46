"""What driver and executors share: a folder, and results that are computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session names none, a temporary one is set if all runs in one
    process on one machine; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillon.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("quillon.shared.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: the same rows in the same partitions and order, however often it is read, also after executors are lost."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A copy of the session (same context, catalogue and settings) with other settings, for plans whose reader has no option of its own for them."""
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in settings.items():
        copy.conf.set(k, v)
    return copy
