"""Text: lines, and records with any delimiter."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators.partitioning import repartition_ordered
from ..shared import session_with


def _lines(session, path: str, min_partitions: int, delimiter: str = "\n"):
    """Records, in so many splits of the files at least: smaller splits, so that nothing is shuffled and one file keeps its order."""
    read = lambda spark: spark.read.option("lineSep", delimiter).text(path)
    df = read(session.spark)
    if min_partitions < 2 or df.rdd.getNumPartitions() >= min_partitions:
        return df
    n = min_partitions
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = max(1, -(-size // n))
    return read(session_with(session.spark, {"spark.sql.files.maxPartitionBytes": f"{split}b", "spark.sql.files.openCostInBytes": "0b"}))


def text_file(session, path: str, min_partitions: int = 1) -> Dataset:
    """Lines split at ``\\n`` alone; any file system that Spark reads. A file's lines keep their order, files come as Spark deals them out."""
    return Dataset(_lines(session, path, min_partitions), session)


def by_file(df, *columns):
    """``df`` of a file reader with a partition for each file, in the order of the files' paths.

    The driver has the list of files anyway. Rows go where their file's number
    says, so nothing is read twice, sampled or sorted over the whole.
    """
    # file:/x and file:///x are one path, as any scheme's are here.
    files = sorted(re.sub(r"^(\w+):/+", r"\1:/", f) for f in df.inputFiles())
    if not files:
        return df.select(*columns)
    small = df.sparkSession.createDataFrame(list(enumerate(files)), "__file int, __path string")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^(\w+):/+", "$1:/")
    tagged = df.select(*columns, path.alias("__path"), F.monotonically_increasing_id().alias("__number"))
    placed = tagged.join(F.broadcast(small), "__path").repartitionById(len(files), F.col("__file"))
    return placed.sortWithinPartitions("__number").select(*columns)


def partition_text_file(session, path: str) -> Dataset:
    """Part files of a folder, in the order of their names, a partition for each."""
    return Dataset(by_file(session.spark.read.option("lineSep", "\n").text(path), "value"), session)


def parse_delimiter(text: str) -> tuple[str, list[str]]:
    """``D!E1!E2``: delimiter and the texts after which it is none; ``\\!`` is a plain exclamation mark."""
    parts = [p.replace("\0", "!") for p in text.replace("\\!", "\0").split("!")]
    if not parts[0]:
        raise ValueError("empty delimiter")
    return parts[0], [p for p in parts[1:] if p]


def plain_file(session, path: str, min_partitions: int = 1, delim: str = "\n") -> Dataset:
    """Records ended by a delimiter. With exceptions a file is one task's work, as its meaning depends on what stands before."""
    d, exceptions = parse_delimiter(delim)
    if not exceptions:
        return Dataset(_lines(session, path, min_partitions, d), session)
    quote = lambda x: re.sub(r"([^\w\s])", r"\\\1", x)
    pattern = "".join(f"(?<!{quote(e)})" for e in exceptions) + quote(d)
    whole = session.spark.read.text(path, wholetext=True)
    parts = whole.select(F.split("value", pattern, -1).alias("p"))
    last = F.element_at("p", -1) == ""
    kept = F.when(last, F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p"))
    found = parts.select(F.explode(kept).alias("value"))
    return Dataset(found if found.rdd.getNumPartitions() >= min_partitions else repartition_ordered(found, min_partitions), session)


def save(data: Dataset, path: str, overwrite: bool = False, append: bool = False) -> None:
    """A line an element, a part file a partition."""
    cols = data.df.columns
    line = F.col(cols[0]).cast("string") if len(cols) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *[F.col(c).cast("string") for c in cols]), F.lit(")"))
    mode = "overwrite" if overwrite else "append" if append else "errorifexists"
    data.df.select(F.coalesce(line, F.lit("None")).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)
